"""Long series cut into chunks: running sums, maxima, row numbers, as-of values and first breaches.

A window by key alone sends a whole series to one task. Here a series is cut into chunks by
a column that its order never goes back on (a day, a range of scores); windows run inside
chunks, and what earlier chunks bring along is computed on a row for each chunk and joined
back. So the size of a task is that of a chunk, however few keys there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.sources.store import written

#: Children of a node of the tree in which breaches are looked up.
FAN_OUT = 64


def _before(keys: list[str], chunk: str):
    return Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)


def _within(keys: list[str], chunk: str, order: list[str]):
    return Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_sum(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row of its series."""
    df = df.withColumn(out, value)
    totals = df.groupBy(*keys, chunk).agg(F.sum(out).alias("_own"))
    carried = totals.withColumn("_carry", F.coalesce(F.sum("_own").over(_before(keys, chunk)), F.lit(0))).drop("_own")
    inside = df.withColumn(out, F.sum(out).over(_within(keys, chunk, order)))
    return inside.join(carried, [*keys, chunk]).withColumn(out, F.col(out) + F.col("_carry")).drop("_carry")


def running_max(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the largest ``value`` up to and with each row of its series."""
    tops = df.groupBy(*keys, chunk).agg(F.max(value).alias("_own"))
    carried = tops.withColumn("_carry", F.max("_own").over(_before(keys, chunk))).drop("_own")
    inside = df.withColumn(out, F.max(value).over(_within(keys, chunk, order)))
    return inside.join(carried, [*keys, chunk]).withColumn(out, F.greatest(out, "_carry")).drop("_carry")


def numbered(df: DataFrame, keys: list[str], chunk: str, order: list[str], out: str) -> DataFrame:
    """``df`` with a number from 0 for each row of its series, in order."""
    counts = df.groupBy(*keys, chunk).agg(F.count("*").alias("_own"))
    carried = counts.withColumn("_carry", F.coalesce(F.sum("_own").over(_before(keys, chunk)), F.lit(0))).drop("_own")
    inside = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys, chunk).orderBy(*order)) - 1)
    return inside.join(carried, [*keys, chunk]).withColumn(out, F.col(out) + F.col("_carry")).drop("_carry")


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], chunk: Column, strict: bool = False) -> DataFrame:
    """``left`` with ``values`` of the latest right row of its keys at or before (``strict``: before) its time.

    ``chunk`` is an expression of the column ``_t``, the time of either side, that never
    falls as time goes on. A right row whose value is null wins like any other.
    """
    mark = 1 if not strict else -1
    keep = [c for c in left.columns if c not in values]
    l = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(mark).alias("_side"), F.struct(*keep).alias("_left"))
    r = right.select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(*[F.col(v) for v in values]).alias("_right"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_chunk", chunk)
    last = r.withColumn("_chunk", chunk).groupBy(*keys, "_chunk").agg(F.max_by("_right", "_t").alias("_own"))
    every = both.select(*keys, "_chunk").distinct().join(last, [*keys, "_chunk"], "left")
    carried = every.withColumn("_carry", F.last("_own", ignorenulls=True).over(_before(keys, "_chunk"))).drop("_own")
    inside = both.withColumn("_last", F.last("_right", ignorenulls=True).over(_within(keys, "_chunk", ["_t", "_side"]))).where(F.col("_side") == mark)
    found = inside.join(carried, [*keys, "_chunk"], "left").withColumn("_last", F.coalesce("_last", "_carry"))
    return found.select("_left.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def first_at_or_below(points: DataFrame, series: DataFrame, keys: list[str], point_id: str, start: str, bound: str, ts: str, value: str, chunk: Column) -> DataFrame:
    """(``point_id``, ``hit_ts``, ``hit_value``): the first row of a point's series from ``start`` on whose value is at most ``bound``.

    The rows of a series are the leaves of a tree of ``FAN_OUT`` children a node, each node
    holding its children's minima. A point climbs until a later sibling goes as low as its
    bound and descends to the first such leaf: joins on equal node numbers, twice the height
    of the tree, and no pair of a point and a row is ever formed but that one. Points without
    such a row have no row here. Rows of one time count in the order of their value.
    """
    rows = numbered(series.select(*keys, F.col(ts).alias("_t"), F.col(value).alias("_v")).withColumn("_chunk", chunk), keys, "_chunk", ["_t", "_v"], "_i").drop("_chunk")
    rows = written(rows, "leaves")  # read for the height, for each level and for the answer
    height = max(1, (rows.agg(F.max("_i")).first()[0] or 0).bit_length())
    levels = [rows.select(*keys, "_i", "_v")]
    while len(levels) == 1 or FAN_OUT ** (len(levels) - 1) < 2**height:
        below = levels[-1]
        node = F.floor(F.col("_i") / FAN_OUT).alias("_n")
        up = below.groupBy(*keys, node).agg(F.sort_array(F.collect_list(F.struct((F.col("_i") % FAN_OUT).alias("k"), F.col("_v").alias("v")))).alias("_kids"), F.min("_v").alias("_v"))
        levels.append(written(up.withColumnRenamed("_n", "_i"), "level"))  # joined once on the way up and once for each level on the way down
    start_row = asof(points.select(point_id, *keys, F.col(start).alias("_at"), F.col(bound).alias("_bound")), rows.groupBy(*keys, "_t").agg(F.max("_i").alias("_i")), keys, "_at", "_t", ["_i"], chunk, strict=True)
    todo = start_row.withColumn("_i", F.coalesce(F.col("_i") + 1, F.lit(0)))
    found = None
    kid = lambda least: F.get(F.filter("_kids", lambda x: (x["k"] >= least) & (x["v"] <= F.col("_bound"))), F.lit(0))["k"]
    for level in range(1, len(levels)):  # climb: siblings from this place on, then those behind the parent
        nodes = levels[level].select(*keys, F.col("_i").alias("_node"), "_kids")
        step = todo.withColumn("_node", F.floor(F.col("_i") / FAN_OUT)).join(nodes, [*keys, "_node"], "left")
        step = step.withColumn("_hit", kid(F.col("_i") % FAN_OUT)).drop("_kids")
        hit = step.where("_hit IS NOT NULL").withColumn("_leaf", F.col("_node") * FAN_OUT + F.col("_hit"))
        hit = hit.select(point_id, *keys, "_bound", "_leaf")
        for down in range(level - 1, 0, -1):  # descend to the first leaf that is low enough
            nodes = levels[down].select(*keys, F.col("_i").alias("_leaf"), "_kids")
            hit = hit.join(nodes, [*keys, "_leaf"]).withColumn("_leaf", F.col("_leaf") * FAN_OUT + kid(F.lit(0))).drop("_kids")
        found = hit if found is None else found.unionByName(hit)
        todo = step.where("_hit IS NULL").select(point_id, *keys, "_bound", (F.col("_node") + 1).alias("_i"))
    leaves = rows.select(*keys, F.col("_i").alias("_leaf"), F.col("_t").alias("hit_ts"), F.col("_v").alias("hit_value"))
    return found.join(leaves, [*keys, "_leaf"]).select(point_id, "hit_ts", "hit_value")


def first_in_range(points: DataFrame, series: DataFrame, keys: list[str], point_id: str, start: str, end: str, bound: str, ts: str, value: str, chunk: Column) -> DataFrame:
    """(``point_id``, ``hit_ts``, ``hit_value``): the first row of a point's series from ``start`` to ``end`` whose value is at most ``bound``.

    For spans that hold few rows of a long series. The rows of a span are the disjoint union of at
    most two nodes a level of a binary tree, of as many levels as the longest span needs; the
    first of these whose minimum is low enough holds the answer, which is looked up in blocks of
    ``FAN_OUT`` rows, one join for each power of that in the longest span. Rows of one time are
    one row with the least of their values, so a span is as long as it has times.
    """
    from quernstone.operators.rangerank import nodes_of

    # rows, starts and ends in one order: the rows in front of each number rows and bound spans at once
    row = series.groupBy(*keys, F.col(ts).alias("_t")).agg(F.min(value).alias("_v")).select(*keys, "_t", F.lit(1).alias("_kind"), "_v")
    place = lambda t, kind: points.select(*keys, F.col(t).alias("_t"), F.lit(kind).alias("_kind"), F.col(point_id), F.col(bound).alias("_bound"))
    every = row.unionByName(place(start, 0), allowMissingColumns=True).unionByName(place(end, 2), allowMissingColumns=True).withColumn("_chunk", chunk)
    every = written(running_sum(every, keys, "_chunk", ["_t", "_kind", "_v"], (F.col("_kind") == 1).cast("long"), "_upto").drop("_chunk"), "places")
    rows = every.where("_kind = 1").select(*keys, "_t", "_v", (F.col("_upto") - 1).alias("_i"))
    at = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_upto")))
    spans = every.where("_kind <> 1").groupBy(point_id, *keys, "_bound").agg(at(0).alias("_lo"), (at(2) - 1).alias("_hi")).where("_hi >= _lo")
    longest = spans.agg(F.max(F.col("_hi") - F.col("_lo") + 1)).first()[0] or 1
    levels = longest.bit_length()
    every = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda l: F.struct(l.cast("int").alias("level"), F.call_function("shiftright", F.col("_i"), l).alias("node")))
    lows = rows.select(*keys, "_v", F.explode(every).alias("_at")).groupBy(*keys, "_at.level", "_at.node").agg(F.min("_v").alias("_low"))
    asked = spans.select(point_id, *keys, "_bound", F.explode(nodes_of(F.col("_lo"), F.col("_hi"), levels)).alias("_at")).select(point_id, *keys, "_bound", "_at.*")
    leaf = F.call_function("shiftleft", F.col("node"), F.col("level"))
    low = asked.join(lows, [*keys, "level", "node"]).where(F.col("_low") <= F.col("_bound"))
    todo = low.groupBy(point_id, *keys, "_bound").agg(F.min(F.struct(leaf.alias("_i"), "level")).alias("_n"))
    todo = todo.select(point_id, *keys, "_bound", "_n._i", "_n.level")
    bits = FAN_OUT.bit_length() - 1
    for top in range((levels - 1) // bits, -1, -1):  # nodes of so many blocks' levels: the first of those in the block that is low enough
        least = top * bits
        kids = lows.where(F.col("level") == least).groupBy(*keys, F.floor(F.col("node") / FAN_OUT).alias("_block"))
        kids = kids.agg(F.sort_array(F.collect_list(F.struct(F.col("node").alias("k"), F.col("_low").alias("v")))).alias("_kids"))
        first = F.shiftright("_i", least)
        inside = lambda x: (x["k"] >= first) & (x["v"] <= F.col("_bound"))  # noqa: E731, B023
        found = todo.where(F.col("level") > least).withColumn("_block", F.floor(first / FAN_OUT)).join(kids, [*keys, "_block"])
        found = found.withColumn("_i", F.shiftleft(F.get(F.filter("_kids", inside), F.lit(0))["k"], least)).withColumn("level", F.lit(least))
        todo = todo.where(F.col("level") <= least).unionByName(found.select(point_id, *keys, "_bound", "_i", "level"))
    return todo.join(rows, [*keys, "_i"]).select(point_id, F.col("_t").alias("hit_ts"), F.col("_v").alias("hit_value"))
