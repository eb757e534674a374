import pytest
from pyspark.sql import functions as F

from quernstone.llm import mixing
from quernstone.llm.common import n_words
from tests.llm.cases import ODD, clashing, none, odd

SF = "/root/testdata/sf0.1"


def fill(sizes, weights, total, most):
    """Targets in turn: what full sources can't take is shared among the others, until none is above its bound."""
    targets, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in full]
    return targets


@pytest.mark.parametrize(("sizes", "budget"), [([10, 20, 30], 1.5), ([1, 1, 1000], 1.5), ([0, 5, 7, 0, 900, 3], 1.9), ([4, 4, 4, 4], 3.0), ([100], 0.5), ([500, 3, 3, 3, 3], 1.2)])
def test_targets_share_all_that_fits(spark, sizes, budget):
    df = spark.createDataFrame([(f"s{i:02}" if i else None, n) for i, n in enumerate(sizes)], "source string, source_size long")
    order = [*range(1, len(sizes)), 0]  # null is last
    rows = {r["source"]: r["target"] for r in mixing.targets(df, (3, 1, 2), budget, 2.0).collect()}
    want = fill([sizes[i] for i in order], [(3, 1, 2)[k % 3] for k in range(len(order))], budget * sum(sizes), 2.0)
    got = [rows[f"s{i:02}" if i else None] for i in order]
    assert all(abs(a - b) < 1e-9 * (1 + b) for a, b in zip(got, want)) and abs(sum(got) - min(budget, 2.0) * sum(sizes)) < 1e-6


@pytest.mark.parametrize("equal", [True, False])
def test_rows_of_one_id_are_told_apart(spark, equal):
    """Without ids, and even if they agree in everything, so many rows are taken as come nearest the target."""
    rows = [(None, "a", 10, 0 if equal else i) for i in range(1000)] + [(i, "b", 10, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long, other long").repartition(7)
    got = mixing.mix(df, F.col("n"), weights=(1, 4), budget=0.6).groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.count("*").alias("rows")).collect()
    assert {r["source"]: r["rows"] for r in got} == {"a": 1000, "b": 300}
    assert all(abs(r["taken"] - r["target"]) <= 10 for r in got)
    again = mixing.mix(df.repartition(3), F.col("n"), weights=(1, 4), budget=0.6)
    told = lambda d: sorted((str(r["doc_id"]), r["other"], r["copies"]) for r in d.collect())
    assert told(again) == told(mixing.mix(df, F.col("n"), weights=(1, 4), budget=0.6))


@pytest.mark.parametrize("kind", ["int", "date", "double"])
def test_sources_of_other_types(spark, kind):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, F.expr(f"cast({'date_from_unix_date(int(id % 4))' if kind == 'date' else 'id % 4'} as {kind})")).alias("source"), F.lit(10).alias("n"))
    out = mixing.mix(df, F.col("n"))
    assert dict(out.dtypes)["source"] == kind
    got = out.groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
    assert len(got) == 4 and all(abs(r["taken"] - r["target"]) <= 10 for r in got)


def test_each_source_comes_near_its_target(spark):
    rows = mixing.op3_mixing(spark, SF).withColumn("k", F.monotonically_increasing_id()).collect()
    docs = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    taken, target = {}, {}
    for r in rows:
        assert r["size"] == 0 or r["taken"] % r["size"] == 0 and 0 <= r["taken"] <= 2 * r["size"]
        s = docs[r["doc_id"]]
        taken[s], target[s] = taken.get(s, 0) + r["taken"], r["target"]
    assert len(rows) == len(docs)
    assert all(abs(taken[s] - t) <= 0.02 * t + 4000 for s, t in target.items())


def test_larger_budget_holds_the_smaller(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few, more = ({r["doc_id"]: r["copies"] for r in mixing.mix(df, n_words(F.col("text")), budget=b).collect()} for b in (0.4, 0.5))
    assert all(more[i] >= n for i, n in few.items())


def test_odd_rows(spark):
    rows = mixing.mix(odd(spark), n_words(F.col("text"))).collect()
    assert len(rows) == len(ODD) and all(0 <= r["copies"] <= 2 for r in rows)
    assert [r["text"] for r in rows].count("") == 1 and [r["doc_id"] for r in rows].count(1) == 2


def test_empty_and_clashing(spark):
    assert mixing.mix(none(spark), n_words(F.col("text"))).collect() == []
    rows = mixing.mix(clashing(spark, "_source", "whole", "head", "need", "with_last", "_s", "_mix_hash", "_mix_plan", "copies"), n_words(F.col("text"))).collect()
    assert len(rows) == len(ODD) and {r["whole"] for r in rows} == {"kept whole"} and all(isinstance(r["copies"], int) for r in rows)
