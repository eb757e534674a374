"""Each stage against a brute-force version of it, on its predecessor's rows."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import toxicity
from quernstone.llm.common import written
from tests.llm.cases import clashing, mapped, none
from tests.llm.test_mixing import fill
from tests.llm.test_sharding import held

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"\w+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert set(stages[-1].columns) == {*stages[0].columns, "shard", "slot"}


def test_toxic_documents_go(spark, stages):
    model = toxicity.learn(stages[0], spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    rows = [(r["doc_id"], r["text"]) for r in stages[0].collect()]
    kept = []
    for i, n, m in toxicity.scan([t for _, t in rows], model.lexicon):
        if model.score(toxicity.features(rows[i][1] if m else None, n, m, model.lexicon)) < 0.5:
            kept.append(rows[i][0])
    assert ids(stages[1]) == sorted(kept) and len(kept) < len(rows)


def five(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_one_of_each_near_group_stays(stages):
    """Links by the five-word shingles of every two texts that share one: 0.8 of them."""
    rows = sorted((r["doc_id"], r["text"]) for r in stages[1].collect())
    own, at = [five(t) for _, t in rows], {}
    for i, s in enumerate(own):
        for g in s or {()}:
            at.setdefault(g, []).append(i)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in {(a, b) for x in at.values() for a in x for b in x if a < b}:
        both = len(own[a] & own[b])
        share = both / (len(own[a]) + len(own[b]) - both) if own[a] else 1.0
        if share >= 0.8:
            x, y = sorted((root(a), root(b)))
            label[y] = x
    assert ids(stages[2]) == [rows[i][0] for i in range(len(rows)) if root(i) == i]


def test_near_copies_are_caught(stages):
    """No two that stay are alike in 0.8 of their five-word shingles, but for one in fifty of such pairs."""
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))}
    alike = []
    for df in (stages[1], stages[2]):
        own, at = {r["doc_id"]: shingles(r["text"]) for r in df.collect()}, {}
        for i, s in own.items():
            for g in s:
                at.setdefault(g, []).append(i)
        pairs = {(a, b) for x in at.values() if len(x) < 200 for a in x for b in x if a < b}
        alike.append(sum(len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]) for a, b in pairs))
    assert alike[0] > 10 and alike[1] <= alike[0] / 50


def test_benchmark_passages_go(spark, stages):
    grams = lambda t: {tuple(w[i : i + 8]) for w in [WORD.findall((t or "").lower())] for i in range(len(w) - 7)}
    bench = set().union(*[grams(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert ids(stages[3]) == sorted(r["doc_id"] for r in stages[2].collect() if not grams(r["text"]) & bench)


def test_sources_meet_their_targets(stages):
    words = lambda df: {r[0]: r[1] for r in df.groupBy("source").agg(F.sum(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")))).collect()}
    before, after = words(stages[3]), words(stages[4])
    order = sorted(before, key=lambda s: (s is None, s or ""))
    targets = fill([before[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(before.values()), 2.0)
    longest = stages[3].agg(F.max(F.length("text"))).first()[0]
    assert all(abs(after.get(s, 0) - t) <= longest for s, t in zip(order, targets))
    assert max(r["count"] for r in stages[4].groupBy("doc_id").count().collect()) <= 2


def test_shards(stages):
    rows = stages[5].collect()
    assert ids(stages[5]) == ids(stages[4])
    held(rows, corpus_pipeline.SHARDS)


def test_run_is_the_stages(spark, stages):
    told = lambda df: sorted((r["doc_id"], r["shard"], r["slot"]) for r in df.collect())
    assert told(corpus_pipeline.run(spark, SF)) == told(stages[5])


def test_odd_rows(spark):
    """Null and repeated ids, null and empty texts, columns called like those of the operators, maps and dotted names, through all stages."""
    names = ("copies", "size", "_toxicity", "_contaminated", "_tag", "component", "start", "a.b")
    docs = mapped(clashing(spark, *names))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, written(stage(spark, docs, SF), "test-odd")
        assert docs.columns == before.columns + ["shard", "slot"] * (i == 4)
    rows = docs.collect()
    assert rows and all(r[n] == f"kept {n}" for r in rows for n in names)
    assert all(r["map"] == {"k": "v", "none": None} and r["nested"][0]["m"] == {1: "x"} for r in rows)
    held(rows, corpus_pipeline.SHARDS)


def test_empty_table(spark):
    docs = none(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
