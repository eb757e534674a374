"""Sweeps over documents that are rows: every document's grid in one job.

A document's axes give its cells, each a copy of the document with other numbers in it. What
a cell asks of the bars is read off its text, and equal questions of all documents' cells are
one: each average is computed once for each length in use, from prefix sums and a join on row
numbers, each pair of averages is run once, and the runs are joined back to the cells.
"""

from __future__ import annotations

import itertools
import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.indicators import running
from quernstone.operators import chunked
from quernstone.operators import engines as G
from quernstone.plans.lookups import pruned_axes
from quernstone.plans.spec import PERIODIC, nodes, stripped, sweep_axes
from quernstone.plans.validation import run_return
from quernstone.sources.store import written

#: Which axes matter most, and the cells of a grid that are run at most.
IMPACT = {"stop_loss_pct": 0, "take_profit_pct": 1, "indicator_period": 2, "percentile_window": 2, "rsi_upper": 3, "rsi_lower": 4}
MOST_CELLS = 50
#: Prices as whole numbers of so many a unit, so that sums are exact.
SCALE = 1_000_000


def mutated(spec: dict, axis: str, base: float, value: float) -> None:
    """Put ``value`` wherever the document holds the axis' own value."""
    same = lambda x: round(float(x), 6) == base
    for x in nodes(spec):
        method = x.get("method", {})
        if axis in ("stop_loss_pct", "take_profit_pct") and x.get("type") == axis.removesuffix("_pct") and method.get("kind") == "percent" and same(method["value"]):
            method["value"] = value
        if axis == "indicator_period" and x.get("kind") == "indicator" and x.get("name") in PERIODIC and "period" in x.get("params", {}) and same(x["params"]["period"]):
            x["params"]["period"] = round(value)
        if axis == "percentile_window" and x.get("kind") == "percentile" and "window" in x and same(x["window"]):
            x["window"] = round(value)
        right = x.get("right", {})
        if axis in ("rsi_lower", "rsi_upper") and x.get("type") == "compare" and x.get("left", {}).get("name") == "rsi" and "value" in right and same(right["value"]):
            if (x.get("op") in ("<", "<=", "below")) == (axis == "rsi_lower"):
                right["value"] = value


def sweep_cells(documents: DataFrame, id_col: str, json_col: str, most: int = MOST_CELLS) -> DataFrame:
    """(id, cell, away, document): the grid of each document, at most ``most`` cells; the axes that matter least go first.

    ``away`` is how many steps a cell is from the document's own values, over all its axes: 0 for
    the document itself, 1 for its neighbours.
    """
    rank = F.create_map(*[F.lit(x) for kv in IMPACT.items() for x in kv])[F.col("axis")]
    axes = sweep_axes(documents, id_col, json_col).withColumn("_n", F.size("points")).withColumn("_rank", F.struct(rank.alias("impact"), "base", "axis"))
    kept = pruned_axes(axes, [id_col], "_rank", "_n", most).where("kept")
    of = kept.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("_rank", "axis", "base", "points"))).alias("_axes"))

    @F.pandas_udf("array<struct<cell:int,away:int,document:string>>")
    def grid(texts: pd.Series, axes: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, axes):
            cells = []
            for i, combo in enumerate(itertools.product(*[list(enumerate(a["points"])) for a in own])):
                spec, away = json.loads(text), 0
                # all at once: a value that one axis has put is not what another looks for
                for k, (a, (_, value)) in enumerate(zip(own, combo)):
                    mutated(spec, a["axis"], a["base"], -1e9 - k)
                for k, (a, (step, value)) in enumerate(zip(own, combo)):
                    mutated(spec, a["axis"], -1e9 - k, value)
                    away += abs(step - min(range(len(a["points"])), key=lambda j: abs(a["points"][j] - a["base"])))
                cells.append({"cell": i, "away": away, "document": json.dumps(spec, sort_keys=True)})
            out.append(cells)
        return pd.Series(out, dtype=object)

    both = documents.select(id_col, F.col(json_col).alias("_text")).join(of, id_col)
    return both.select(id_col, F.explode(grid("_text", "_axes")).alias("_c")).select(id_col, "_c.*")


def crossing(spec: dict) -> tuple[int, int] | None:
    """(first, second) periods of a document that is in from where one plain average of closes crosses above another to where it crosses below; None for all others."""

    def averages(x: dict, direction: str) -> tuple[int, int] | None:
        sides = [x.get("series", {}), x.get("threshold", {})]
        plain = all(s.get("kind") == "indicator" and s.get("name") == "sma" and s.get("params", {}).get("source", "close") == "close" for s in sides)
        if x.get("type") != "crossover" or x.get("direction") != direction or not plain or x.get("timeframe"):
            return None
        return sides[0]["params"].get("period"), sides[1]["params"].get("period")

    exits = spec.get("exit", {}).get("exits", [])
    into = averages(spec.get("entry", {}).get("condition", {}), "above")
    out = averages(exits[0].get("condition", {}), "below") if len(exits) == 1 and exits[0].get("type") == "condition" else None
    plain = spec.get("direction", "long") == "long" and not spec.get("filters")
    return into if plain and into is not None and into == out and into[0] != into[1] else None


def with_crossings(cells: DataFrame) -> DataFrame:
    """``cells`` whose document is a crossing of two averages, with their periods ``fast`` and ``slow``; cells that don't hold together (equal periods) go."""

    @F.pandas_udf("fast int, slow int")
    def read(texts: pd.Series) -> pd.DataFrame:
        found = [crossing(json.loads(t)) or (None, None) for t in texts]
        return pd.DataFrame(found, columns=["fast", "slow"]).astype("Int32")

    return cells.withColumn("_p", read("document")).select("*", "_p.*").drop("_p").where("fast IS NOT NULL")


def period_sums(bars: DataFrame, periods: DataFrame) -> DataFrame:
    """(symbol, ts, open, i, n, total): the sum of the last n closes of each bar that has so many, for each n of ``periods``.

    A prefix sum less that of n rows before: a join on row numbers, whatever the length.
    """
    day = F.unix_date(F.to_date("ts")) / 64
    rows = bars.select("symbol", "ts", "open", F.round(F.col("close") * SCALE).cast("long").alias("x"), F.floor(day).alias("_chunk"))
    rows = chunked.numbered(chunked.running_sum(rows, ["symbol"], "_chunk", ["ts"], F.col("x"), "upto"), ["symbol"], "_chunk", ["ts"], "i")
    rows = written(rows.select("symbol", "ts", "open", "i", "upto"), "prefix")
    before = rows.select("symbol", (F.col("i") + 1).alias("_from"), F.col("upto").alias("_upto"))  # sums up to the row in front of _from
    each = rows.join(periods.select("n")).withColumn("_from", F.col("i") - F.col("n") + 1).where("_from >= 0")
    both = each.join(before, ["symbol", "_from"], "left")
    return both.select("symbol", "ts", "open", "i", "n", (F.col("upto") - F.coalesce("_upto", F.lit(0))).alias("total"))


def crossing_runs(bars: DataFrame, pairs: DataFrame, per_side_bps: float) -> DataFrame:
    """(fast, slow, symbol, total): the net return of each pair of averages, each run once.

    Averages are compared as whole numbers, so no rounding decides a crossing.
    """
    pairs = written(pairs.select("fast", "slow").distinct(), "pairs")
    periods = pairs.select(F.col("fast").alias("n")).unionByName(pairs.select(F.col("slow").alias("n"))).distinct()
    sums = written(period_sums(bars, periods), "sums")
    fast = sums.select("symbol", "i", F.col("n").alias("fast"), F.col("total").alias("tf"))
    slow = sums.select("symbol", "i", F.col("n").alias("slow"), F.col("total").alias("ts_"))
    both = pairs.join(fast, "fast").join(slow, ["symbol", "i", "slow"])
    # a bar that lacks one of the averages has no comparison, but it is a bar of the run
    grid = pairs.join(bars.select("symbol").distinct()).join(sums.select("symbol", "i", "ts", "open").distinct(), "symbol")
    x = grid.join(both, ["fast", "slow", "symbol", "i"], "left")
    side = F.signum(F.col("tf") * F.col("slow") - F.col("ts_") * F.col("fast"))
    w = Window.partitionBy("fast", "slow", "symbol").orderBy("ts")
    x = x.withColumn("_side", side).withColumn("_was", F.lag("_side").over(w))
    turn = F.when((F.col("_was") <= 0) & (F.col("_side") > 0), 1).when((F.col("_was") >= 0) & (F.col("_side") < 0), 0)
    x = x.withColumn("pos", F.coalesce(F.last(turn, ignorenulls=True).over(running(w)), F.lit(0)))
    return run_return(G.vector_backtest(x, per_side_bps, keys=("fast", "slow", "symbol")), ["fast", "slow", "symbol"])


def rolled_up(cells: DataFrame, runs: DataFrame, id_col: str) -> DataFrame:
    """(id, symbol, cells, best, worst, own, neighbour_avg, peakiness) of each document's grid.

    ``own`` is what the document earned itself; ``peakiness`` how far that stands out of its
    neighbours: 0 at or below their average, 1 far above it.
    """
    each = cells.join(runs, ["fast", "slow"])
    own, near = F.max(F.when(F.col("away") == 0, F.col("total"))), F.avg(F.when(F.col("away") == 1, F.col("total")))
    told = each.groupBy(id_col, "symbol").agg(F.count("*").alias("cells"), F.max("total").alias("best"), F.min("total").alias("worst"), own.alias("own"), near.alias("neighbour_avg"))
    apart = (F.col("own") - F.col("neighbour_avg")) / F.greatest(F.abs("own"), F.lit(0.01))
    return told.withColumn("peakiness", F.greatest(F.lit(0.0), F.least(F.lit(1.0), apart)))


def document_sweep(documents: DataFrame, id_col: str, json_col: str, bars: DataFrame, per_side_bps: float, most: int = MOST_CELLS) -> DataFrame:
    """What ``rolled_up`` gives for each document and symbol. Equal documents are swept once."""
    named = documents.select(id_col, F.sha2(json_col, 256).alias("_key"), F.col(json_col).alias("_doc"))
    distinct = written(named.groupBy("_key").agg(F.first("_doc").alias("_doc")), "documents")
    cells = written(with_crossings(sweep_cells(distinct, "_key", "_doc", most)).drop("document"), "cells")
    told = rolled_up(cells, crossing_runs(bars, cells, per_side_bps), "_key")
    return named.select(id_col, "_key").join(told, "_key").drop("_key")
