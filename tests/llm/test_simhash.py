import re

import numpy as np
import pytest
import xxhash

from quernstone.llm import simhash
from tests.llm.cases import ODD, clashing, mapped, none, odd


def brute_print(text, n=3, repeats=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in (grams if repeats else set(grams))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    """Least index reachable, by looking at all pairs."""
    f = np.array(prints, dtype=np.uint64)
    near = [np.flatnonzero(np.bitwise_count(f ^ x) <= radius) for x in f]
    label = np.arange(len(f))
    while (new := np.array([label[n].min() for n in near])).tolist() != label.tolist():
        label = new
    return label.tolist()


@pytest.mark.parametrize(("n", "radius"), [(40, 0), (400, 2), (2500, 6)])
def test_trees_against_all_pairs(n, radius):
    draw = np.random.default_rng(n)
    x = draw.integers(0, 2**63, 12, dtype=np.uint64)[draw.integers(0, 12, n)]
    for _ in range(4):
        x = x ^ np.where(draw.random(n) < 0.6, np.uint64(1) << draw.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    x = np.unique(np.concatenate([x, draw.integers(0, 2**63, n, dtype=np.uint64)]))
    draw.shuffle(x)
    assert simhash.local_roots(x, np.zeros(len(x), dtype=np.int64), radius).tolist() == brute_components(x, radius)


@pytest.mark.parametrize("radius", [0, 1, 2, 6])
def test_links_meet_in_a_shard(spark, radius):
    from pyspark.sql import functions as F

    draw = np.random.default_rng(1)
    rows = []
    for i in range(200):
        a = int(draw.integers(0, 2**63))
        b = a
        for k in draw.choice(64, radius, replace=False):
            b ^= 1 << int(k)
        rows.append((a, b - (b >> 63 << 64)))
    df = spark.createDataFrame(rows, "a long, b long")
    assert df.where(~F.arrays_overlap(simhash.shard_keys(F.col("a"), radius), simhash.shard_keys(F.col("b"), radius))).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    prints = [brute_print(t) for _, t in docs]
    label = brute_components(prints, 2)
    want = {i: (f"{p:016x}", docs[k][0]) for (i, _), p, k in zip(docs, prints, label)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op10_simhash(spark, sf).collect()} == want


def test_distinct_words():
    texts = ["a b a c", "", None, "X x", "one"]
    assert simhash.fingerprints(texts, 1, repeats=False).tolist() == [brute_print(t, 1, False) for t in texts]


def test_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (102, 100)], "fp long, root long")
    got = {r["fp"]: r["root"] for r in simhash.contract(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == got[102] == 100


def test_odd_rows(spark):
    rows = simhash.near_groups(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (2, 3, 4)} == {2}  # no words: linked like any other
    extra = simhash.near_groups(mapped(clashing(spark, "_fp", "_tag", "fp", "root", "component", "shard", "a.b")))
    assert sorted(map(str, extra.collect())) == sorted(map(str, rows))
    assert simhash.near_groups(none(spark)).collect() == []
