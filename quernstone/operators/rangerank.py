"""Ranks within sliding windows, by a merge-sort tree: no row ever sees its window as a list.

The rows of a series, numbered from 0, are the leaves of a binary tree; a node of level l
covers 2**l neighbouring rows. A range of rows is the disjoint union of at most two nodes a
level. Each row is a member of one node a level, each question (how many values of rows lo to hi
are less than v?) goes to the nodes of its range, and members and questions of a node are
sorted by value once: the rank in a node is the number of members in front. A range's rank
is the sum over its nodes. Rows grow by a factor of the logarithm of the longest range, tasks
hold a node and the questions that reach it, which is a few times the longest range at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators import chunked
from quernstone.sources.store import written


def nodes_of(lo: Column, hi: Column, levels: int) -> Column:
    """The nodes (level, node) whose rows are exactly those of lo to hi."""
    found = []
    for level in range(levels):
        left, right = F.ceil(lo / (1 << level)), F.floor((hi + 1) / (1 << level))
        inside = left < right
        node = lambda at: F.struct(F.lit(level).alias("level"), at.cast("long").alias("node"))
        found += [F.when(inside & (left % 2 == 1), node(left)), F.when(inside & (right % 2 == 1), node(right - 1))]
    return F.array_compact(F.array(*found))


def range_ranks(rows: DataFrame, keys: list[str], number: str, value: str, lo: str, hi: str, longest: int) -> DataFrame:
    """(keys, ``number``, less, equal, n): of the values of rows ``lo`` to ``hi`` of its series, how many are less than a row's own, equal to it, and there at all.

    ``number`` counts a series' rows from 0 without gaps. Ranges hold ``longest`` rows at most.
    Null values are not there; a row with a null value has no ranks. Rows without any gets none.
    """
    levels = max(1, longest.bit_length())
    # the level at which no node of a range can lie is left out
    member = F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda l: F.struct(l.cast("int").alias("level"), F.call_function("shiftright", F.col(number), l).alias("node"))))
    some = rows.where(F.col(value).isNotNull())
    members = some.select(*keys, member.alias("_at"), F.col(value).alias("_v"), F.lit(1).alias("_member"))
    asked = some.select(*keys, F.explode(nodes_of(F.greatest(F.col(lo), F.lit(0)), F.col(hi), levels)).alias("_at"), F.col(value).alias("_v"), F.lit(0).alias("_member"), F.col(number).alias("_for"))
    both = members.unionByName(asked, allowMissingColumns=True).select(*keys, "_at.level", "_at.node", "_v", "_member", "_for")
    node = [*keys, "level", "node"]
    sorted_ = Window.partitionBy(*node).orderBy("_v", "_member")  # questions come before members of their value
    equal = Window.partitionBy(*node, "_v")
    ranked = both.withColumn("_less", F.sum("_member").over(sorted_.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_equal", F.sum("_member").over(equal))
    ranked = ranked.withColumn("_n", F.sum("_member").over(Window.partitionBy(*node)))
    found = ranked.where("_member = 0").groupBy(*keys, F.col("_for").alias(number))
    return found.agg(*[F.sum(f"_{c}").alias(c) for c in ("less", "equal", "n")])


def with_percentile_rank(bars: DataFrame, value: str, n: int, out: str, keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """``bars`` with the average rank of the newest among the last n values, over n; null unless all n are there. Times are distinct in a series."""
    keys = list(keys)
    days = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (512 * 86_400_000_000)).cast("long")
    rows = chunked.numbered(bars.withColumn("_chunk", days), keys, "_chunk", [ts], "_i").withColumn("_lo", F.col("_i") - (n - 1))
    rows = written(rows.drop("_chunk"), "numbered")  # read as members, as questions and as rows
    ranks = range_ranks(rows.select(*keys, "_i", "_lo", F.col(value).alias("_value")), keys, "_i", "_value", "_lo", "_i", n)
    rank = (F.col("less") + (F.col("equal") + 1) / 2) / n
    return rows.join(ranks, [*keys, "_i"], "left").withColumn(out, F.when(F.col("n") == n, rank)).drop("_i", "_lo", "less", "equal", "n")


def with_matched_percentile(bars: DataFrame, value: str, group: str, days: int, least: int, out: str, longest: int, keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """``bars`` with the mid-rank of the newest among the last ``days`` days' values of its ``group``, or of all groups where these are fewer than ``least``.

    A value's own row counts. ``longest`` bounds the rows of so many days. Values are there, times distinct in a series.
    """
    keys = list(keys)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    chunk = F.floor(F.col("_t") / (64 * 86_400_000_000)).cast("long")
    rows = written(bars.withColumn("_t", micros).withColumn("_since", micros - F.lit(days * 86_400_000_000 + 1)), "timed")
    for name, own in (("_own", [*keys, group]), ("_all", keys)):
        numbered = chunked.numbered(rows.withColumn("_chunk", chunk), own, "_chunk", ["_t"], f"{name}_i").drop("_chunk")
        places = numbered.select(*own, F.col("_t").alias("_at"), F.col(f"{name}_i").alias(f"{name}_before"))
        # the last row that lies too far back, and so the first that counts
        asked = chunked.asof(numbered, places, own, "_since", "_at", [f"{name}_before"], F.floor(F.col("_t") / (64 * 86_400_000_000)).cast("long"))
        rows = written(asked.withColumn(f"{name}_lo", F.coalesce(F.col(f"{name}_before") + 1, F.lit(0))).drop(f"{name}_before"), "timed")
    for name, own in (("_own", [*keys, group]), ("_all", keys)):
        ranks = range_ranks(rows.select(*own, f"{name}_i", f"{name}_lo", F.col(value).alias("_value")), own, f"{name}_i", "_value", f"{name}_lo", f"{name}_i", longest)
        rows = rows.join(ranks.withColumnsRenamed({c: f"{name}_{c}" for c in ("less", "equal", "n")}), [*own, f"{name}_i"])
    mid = lambda name: (F.col(f"{name}_less") + 0.5 * F.col(f"{name}_equal")) / F.col(f"{name}_n")
    return rows.withColumn(out, F.when(F.col("_own_n") < least, mid("_all")).otherwise(mid("_own"))).select(*bars.columns, out)
