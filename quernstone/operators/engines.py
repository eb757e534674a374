"""Backtest engines that windows alone can express.

Signals are decided at a bar's close and filled at the next bar's open. Costs are charged
on every side. A position is 0 or 1, or a weight, decided at a bar; held from the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.indicators import running


def vector_backtest(signals: DataFrame, per_side_bps: float, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars with a 0/1 column ``pos`` -> held, r (net return), equity and the flips, bar by bar."""
    w = Window.partitionBy(*keys).orderBy("ts")
    cost = per_side_bps * 1e-4
    held = signals.withColumn("held", F.coalesce(F.lag("pos").over(w), F.lit(0))).withColumn("_next", F.lead("open").over(w))
    flips = held.withColumn("_was", F.coalesce(F.lag("held").over(w), F.lit(0)))
    flips = flips.withColumn("entered", (F.col("held") == 1) & (F.col("_was") == 0)).withColumn("left", (F.col("held") == 0) & (F.col("_was") == 1))
    gross = F.when((F.col("held") == 1) & F.col("_next").isNotNull(), F.col("_next") / F.col("open")).otherwise(F.lit(1.0))
    growth = gross * F.when(F.col("entered"), F.lit(1 / (1 + cost))).otherwise(F.lit(1.0)) * F.when(F.col("left"), F.lit(1 - cost)).otherwise(F.lit(1.0))
    growth = growth * F.when(F.col("_next").isNull() & (F.col("held") == 1), F.lit(1 - cost)).otherwise(F.lit(1.0))
    out = flips.withColumn("r", growth - 1)
    return out.withColumn("equity", F.exp(F.sum(F.ln(F.col("r") + 1)).over(running(w)))).drop("_next", "_was")


def vector_trades(run: DataFrame, per_side_bps: float, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The trades of a vector run: from the entry flip's open to the exit flip's (or the last bar's) open, net."""
    w = Window.partitionBy(*keys).orderBy("ts")
    cost = per_side_bps * 1e-4
    numbered = run.withColumn("trade", F.sum(F.col("entered").cast("int")).over(running(w))).where((F.col("held") == 1) | F.col("left"))
    trades = numbered.groupBy(*keys, "trade").agg(
        F.min("ts").alias("entry_ts"),
        F.max("ts").alias("exit_ts"),
        (F.min_by("open", "ts") * (1 + cost)).alias("entry_price"),
        (F.max_by("open", "ts") * (1 - cost)).alias("exit_price"),
    )
    return trades.withColumn("ret", F.col("exit_price") / F.col("entry_price") - 1)


def portfolio_backtest(weights: DataFrame, per_side_bps: float) -> DataFrame:
    """(symbol, ts, open, w) -> (ts, gross, cost, r): weights of the bar before, turnover at cost, missing opens flat."""
    w = Window.partitionBy("symbol").orderBy("ts")
    applied = weights.withColumn("a", F.coalesce(F.lag("w").over(w), F.lit(0.0))).withColumn("move", F.coalesce(F.lead("open").over(w) / F.col("open") - 1, F.lit(0.0)))
    turned = applied.withColumn("turn", F.abs(F.col("a") - F.coalesce(F.lag("a").over(w), F.lit(0.0))))
    daily = turned.groupBy("ts").agg(F.sum(F.col("a") * F.col("move")).alias("gross"), (F.sum("turn") * (per_side_bps * 1e-4)).alias("cost"))
    return daily.withColumn("r", F.col("gross") - F.col("cost"))


def target_weights(signals: DataFrame, vol: str, target_vol: float, cap: float, gross_cap: float) -> DataFrame:
    """Volatility-targeted weights of symbols in position, each capped, scaled down where a time's sum passes the gross cap."""
    known = F.nullif(F.col(vol), F.lit(0.0)).isNotNull()  # least() would pass over a missing one
    raw = F.when((F.col("pos") == 1) & known, F.least(F.lit(target_vol) / F.nullif(F.col(vol), F.lit(0.0)), F.lit(cap))).otherwise(F.lit(0.0))
    out = signals.withColumn("w", raw)
    total = F.sum("w").over(Window.partitionBy("ts"))
    return out.withColumn("w", F.when(total > gross_cap, F.col("w") * gross_cap / total).otherwise(F.col("w")))
