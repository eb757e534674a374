import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import common, sharding
from tests.llm.cases import ODD, clashing, none, odd

SF = "/root/testdata/sf0.01"


@settings(max_examples=60, deadline=None)
@given(n=st.integers(1, 3000), seed=st.integers(0, 9))
def test_permutation_is_one_to_one(n, seed):
    assert sorted(sharding.permute(np.arange(n), n, seed).tolist()) == list(range(n))


def test_locate_agrees_with_the_permutation():
    positions = sharding.permute(np.arange(1000), 1000, 5)
    assert all(sharding.locate(i, 1000, 7, 5) == (p % 7, p // 7) for i, p in enumerate(positions.tolist()))


def held(rows, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_query_keeps_its_law_and_reruns_agree(spark):
    rows = sharding.op1_sharding(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held(rows, 16)
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["size"] == len((docs[r["doc_id"]] or "").encode()) + 1 and r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    assert all(r["text_crc32"] == zlib.crc32((docs[r["doc_id"]] or "").encode()) for r in rows)
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source")
    where = lambda d: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(d, 5).collect()}
    assert where(df) == where(df.repartition(13))


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_odd_rows(spark, shards):
    rows = sharding.shard(odd(spark), shards).collect()
    assert len(rows) == len(ODD)
    held(rows, shards)


def test_empty_and_clashing(spark):
    assert sharding.shard(none(spark), 4).collect() == []
    out = sharding.shard(clashing(spark, "_row_md5", "_row_run", "_number", "_position", "shard"), 4)
    assert out.columns.count("shard") == 1 and {r["_number"] for r in out.collect()} == {"kept _number"}


@pytest.mark.parametrize("large", [False, True])
def test_places_are_those_of_the_row_numbers(spark, monkeypatch, large):
    """Shard and slot of each row are what ``locate`` computes from its number; numbers have no gap, also where rows repeat."""
    if large:
        monkeypatch.setattr(sharding, "LEAST_LARGE", 20)
        monkeypatch.setattr(common, "CHUNK", 7)
    rows = [(None, "x")] * 500 + [(5, "y")] * 90 + [(i, str(i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, v string").repartition(6)
    numbered, n = sharding.number_rows(df)
    got = numbered.collect()
    assert n == len(rows) and sorted(r["row_number"] for r in got) == list(range(n))
    assert sorted((str(r["doc_id"]), r["v"]) for r in got) == sorted((str(a), b) for a, b in rows)
    own = {(r["doc_id"], r["v"]): r["row_number"] for r in got if r["doc_id"] not in (None, 5)}
    dealt = sharding.shard(df, 16).collect()
    held(dealt, 16)
    for r in dealt:
        if (r["doc_id"], r["v"]) in own:
            assert (r["shard"], r["slot"]) == sharding.locate(own[r["doc_id"], r["v"]], n, 16)
    same = sharding.shard(df.repartition(3), 16).collect()
    assert sorted(map(str, same)) == sorted(map(str, dealt))
