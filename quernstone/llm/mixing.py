"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash; a source's share is the documents whose hash lies
below that source's threshold, so a larger budget's mix contains a smaller
one's. Thresholds come from histograms: words are summed by source and the
first bits of the hash, the bucket in which the running sum passes the budget is
found, and only that bucket's rows are summed again by the next bits. Nothing is
sorted but the sums of one level, at most 4096 a source.

The hash is the id's; rows of one id are told apart by a hash of the whole row, and rows
that agree in everything by their number: of these so many are taken as the target wants.

A target above the source's size takes whole copies first and a share of one
more copy by threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import comparable, equal_rows, free_name, id_hash, n_words, table, written

#: Hex digits of the hash that one level of the histogram tells apart; levels of the id's hash, and of the row's.
DIGITS, ID_LEVELS, ROW_LEVELS = 3, 3, 5


def targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> DataFrame:
    """(source, source_size) -> these, target, ``whole`` copies and ``need``, the words to take beyond these.

    Sources weigh ``weights`` in turn by the code points of their names, null last, and share
    ``budget`` times all words in proportion. What a source can't take, ``most`` times its
    size being full, is shared by weight among the others: sources are full in order of
    size by weight, so prefix sums tell which. All windows run over a row for each source.
    """
    name = F.col("source").cast("string")
    order = [name.isNull(), name]
    turn = F.element_at(F.lit(list(weights)), (F.row_number().over(Window.orderBy(*order)) - 1) % len(weights) + 1).cast("double")
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("source_size") / F.col("w"), *order)
    size = F.col("source_size")
    x = sizes.withColumn("w", turn).withColumn("goal", F.lit(float(budget)) * F.sum(size).over(everything).cast("double"))
    x = x.withColumn("below", F.coalesce(F.sum(most * size).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    x = x.withColumn("open_w", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    fits = (F.col("goal") - F.col("below")) * F.col("w") / F.col("open_w") <= most * size
    edge = F.min(F.when(fits, size / F.col("w"))).over(everything)
    x = x.withColumn("edge", edge)
    full = F.col("edge").isNull() | (size / F.col("w") < F.col("edge"))
    x = x.withColumn("taken", F.coalesce(F.sum(F.when(full, most * size)).over(everything), F.lit(0.0))).withColumn("rest_w", F.sum(F.when(~full, F.col("w"))).over(everything))
    target = F.when(full, most * size).otherwise((F.col("goal") - F.col("taken")) * F.col("w") / F.col("rest_w"))
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int")
    out = x.withColumn("target", target).withColumn("whole", whole)
    return out.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * size).alias("need"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, size, h) rows and the plan -> (source, head, left, n, k): the threshold of each source.

    Rows whose hash is below ``head`` are taken once more; of the ``n`` words of the ``k`` rows
    whose hash begins with it, ``left`` are still wanted. Each level keeps the digits found so
    far and the words still to take inside that bucket; only rows in it are looked at again,
    until there is one, or rows that agree in everything.
    """
    at = plan.select(F.col("source").alias("s"), F.lit("").alias("head"), F.col("need").alias("left"))
    rows = sized
    for level in range(ID_LEVELS + ROW_LEVELS):
        inside = rows.join(at, same(rows["source"], at["s"]) & F.col("h").startswith(F.col("head"))).select(rows["source"], "size", "h", "head", "left")
        if level:
            rows = inside = written(inside, "mix-bucket")  # a 4096th of the rows above it, unless ids repeat
            rows = rows.drop("head", "left")
        bins = inside.groupBy("source", F.substring("h", 1 + level * DIGITS, DIGITS).alias("digits")).agg(F.sum("size").alias("n"), F.count("*").alias("k"), F.first("head").alias("head"), F.first("left").alias("left"))
        upto = Window.partitionBy("source").orderBy("digits").rowsBetween(Window.unboundedPreceding, 0)
        # the first bucket whose running sum passes what is wanted; without one all of the bucket is taken
        met = bins.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("digits", "n", "k", "upto", "head", "left")).alias("b"))
        at = met.select(F.col("source").alias("s"), F.concat("b.head", "b.digits").alias("head"), (F.col("b.left") - (F.col("b.upto") - F.col("b.n"))).alias("left"), "b.n", "b.k")
        at = written(at, "mix-level")  # a row for each source
        if at.where("k > 1").isEmpty():
            break
    return at.withColumnRenamed("s", "source")


def mix(docs: DataFrame, size: Column, source_col: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` with size, source_size, target and ``copies``, the times the mix takes each row.

    Sources, of any type, weigh ``weights`` in turn by code point (null last) and share
    ``budget`` times all sizes; none is asked for more than ``most`` times its size. A source
    without words has target 0 and is left out. Rows of one id, or without any, may be
    taken apart; of rows that agree in everything so many are taken once more as come
    nearest the target. Reruns agree, and texts of any length and an empty table are
    mixed like others. Columns named like an added one are replaced.
    """
    docs = docs.withColumn("size", size.cast("long")).drop("source_size", "target", "copies")
    h, found = free_name(docs, "_mix_hash"), free_name(docs, "_mix_plan")
    row = F.lpad(F.hex(F.xxhash64(*comparable(docs))), 16, "0")
    full_hash = F.concat(F.substring(id_hash(id_col, "mix"), 1, DIGITS * ID_LEVELS), F.substring(F.lower(row), 1, DIGITS * ROW_LEVELS))
    sized = docs.withColumn(h, full_hash)
    narrow = written(sized.select(F.col(source_col).alias("source"), "size", F.col(h).alias("h")), "mix-sizes")
    sizes = narrow.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    plan = written(targets(sizes, weights, budget, most), "mix-targets")
    cut = thresholds(narrow, plan.where("source_size > 0"))
    both = plan.join(cut, same(plan["source"], cut["source"]), "left")
    # a table of its own: Spark knows its size, and broadcasts it if it is small or else joins by shuffle
    recipe = written(both.select(plan["source"], "source_size", "target", "whole", "need", "head", "left", "n", "k"), "mix-plan")
    ties = not recipe.where("k > 1").isEmpty()
    recipe = recipe.select(F.struct(*recipe.columns).alias(found))
    joined = sized.join(recipe, same(sized[source_col], F.col(found)["source"]), "left")
    p = F.col(found)
    at_edge = F.col(h).startswith(p["head"])
    alone = at_edge & (p["n"] - p["left"] < p["left"])
    more = (p["need"] > 0) & (p["head"].isNull() | (F.col(h) < p["head"]) | alone)
    told = lambda df, copies, *more: df.withColumns({"source_size": p["source_size"], "target": p["target"], "copies": p["whole"] + copies.cast("int")}).select(*[f"`{c}`" for c in docs.columns], "source_size", "target", "copies", *more)
    if not ties:
        return told(joined, F.coalesce(more, F.lit(False)))
    tied = F.coalesce(at_edge & (p["need"] > 0) & (p["k"] > 1), F.lit(False))
    wanted = free_name(docs, "_mix_wanted")
    rest = told(joined.where(tied).withColumn(wanted, F.round(p["left"] / F.nullif(F.col("size"), F.lit(0)))), F.lit(0), wanted)
    rest, number = equal_rows(rest)
    rest = rest.withColumn("copies", F.col("copies") + F.coalesce(F.col(number) < F.col(wanted), F.lit(False)).cast("int")).drop(wanted, number)
    return told(joined.where(~tied), F.coalesce(more, F.lit(False))).unionByName(rest)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed 3, 1, 2 by source at 150% of all words, twice a source's words at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = mix(docs, F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 9) AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source),
lv AS (  -- by the level at which a source is full: size / weight
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS goal,
         coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below,
         sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM src),
edge AS (  -- the first source that is not full, and all after it
  SELECT min(source_size / w) AS lvl FROM lv WHERE (goal - below) * w / open_w <= 2 * source_size),
tgt AS (
  SELECT lv.source, source_size, w,
         CASE WHEN lvl IS NULL OR source_size / w < lvl THEN (2 * source_size)::DOUBLE
              ELSE (SELECT (any_value(l2.goal) - coalesce(sum(CASE WHEN l2.source_size / l2.w < lvl THEN 2 * l2.source_size END), 0)::DOUBLE) FROM lv l2)
                   * w / (SELECT sum(l3.w) FROM lv l3 WHERE l3.source_size / l3.w >= lvl) END AS target
  FROM lv, edge),
part AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole FROM tgt),
bins AS (SELECT source, h, sum(size) AS n FROM sized GROUP BY source, h),
run AS (
  SELECT b.source, b.h, b.n, p.target - p.whole * p.source_size AS need,
         sum(b.n) OVER (PARTITION BY b.source ORDER BY b.h) AS upto
  FROM bins b JOIN part p ON b.source IS NOT DISTINCT FROM p.source),
edge_h AS (SELECT source, min(h) AS h0 FROM run WHERE upto > need GROUP BY source),
cut AS (
  SELECT e.source, e.h0, (r.n - (r.need - (r.upto - r.n)) < r.need - (r.upto - r.n)) AS with_last
  FROM edge_h e JOIN run r ON r.source IS NOT DISTINCT FROM e.source AND r.h = e.h0)
SELECT s.doc_id, s.size, p.source_size, p.target,
       (s.size * (p.whole + CASE WHEN s.h < c.h0 OR (c.with_last AND s.h = c.h0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN part p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN cut c ON c.source IS NOT DISTINCT FROM s.source
"""
