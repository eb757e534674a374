"""Small tabular steps between the large operators: axis choice, cost lookups, level matching, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.joins import asof

# Commission in basis points where no tier is listed, by asset class.
CLASS_FEE_BPS = {"crypto_spot": 10.0, "fx_spot": 0.0, "metals_spot": 0.0}
#: Least differences that a verdict takes for one: of return, Sharpe ratio, drawdown.
SAME_RETURN, SAME_SHARPE, SAME_DRAWDOWN = 0.005, 0.05, 0.02


def distinct_places(df: DataFrame, keys: list[str], value: str, order: str, places: int = 4) -> DataFrame:
    """One value for each that rounds alike, the last by ``order``."""
    return df.groupBy(*keys, F.round(value, places).alias("_place")).agg(F.max_by(value, order).alias(value)).drop("_place")


def pruned_axes(axes: DataFrame, keys: list[str], rank: str, n: str, most: int) -> DataFrame:
    """``axes`` with ``kept``: by rank as many as keep the product of their sizes within ``most`` cells."""
    w = Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return axes.withColumn("cells", F.round(F.exp(F.sum(F.log(n)).over(w))).cast("long")).withColumn("kept", F.col("cells") <= most)


def exchange_key(exchange: Column) -> Column:
    """The cost table's name for a document's exchange; others pass as they are."""
    return F.when(exchange == "binance", "binance_spot").otherwise(exchange)


def costed(specs: DataFrame, tiers: DataFrame, side: str = "taker") -> DataFrame:
    """``specs`` with the commission of their tier (exchange, symbol, side), or else of their asset class.

    ``tiers`` is a dimension of a row for each venue's listed pair; Spark broadcasts it if it is small.
    """
    own = tiers.where(F.col("side") == side).select(F.col("exchange").alias("_exchange"), F.col("symbol").alias("_symbol"), "bps")
    joined = specs.join(own, (exchange_key(F.col("exchange")) == F.col("_exchange")) & (F.col("symbol") == F.col("_symbol")), "left")
    fallback = F.lit(None).cast("double")
    for name, bps in CLASS_FEE_BPS.items():
        fallback = F.when(F.coalesce("asset_class", F.lit("crypto_spot")) == name, bps).otherwise(fallback)
    return joined.withColumn("commission", F.coalesce("bps", fallback) / 10_000).drop("_exchange", "_symbol", "bps")


def close_prices(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two positive prices agree within a share of the larger."""
    return (a > 0) & (b > 0) & (F.abs(a - b) <= tolerance * F.greatest(a, b))


def nearest_bar(events: DataFrame, bars: DataFrame, keys: list[str], ts: str, out: str) -> DataFrame:
    """``events`` with the place (from 0) of the bar nearest to ``ts``; of two as near, the later."""
    w = Window.partitionBy(*keys).orderBy("ts")
    placed = bars.select(*keys, "ts", (F.row_number().over(w) - 1).alias("_at"), F.col("ts").alias("_before"), F.lead("ts").over(w).alias("_after"))
    found = asof(events, placed, keys, ts, "ts", ["_at", "_before", "_after"])
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    later = F.coalesce(us("_after") - us(ts) <= us(ts) - us("_before"), F.lit(False))
    return found.withColumn(out, F.coalesce(F.col("_at") + later.cast("int"), F.lit(0))).drop("_at", "_before", "_after")


def verdict(own: dict[str, Column], hold: dict[str, Column], trades: Column) -> list[Column]:
    """Return, risk and depth of a strategy against holding, each as a word."""
    alpha, sharpe, depth = own["ret"] - hold["ret"], own["sharpe"] - hold["sharpe"], own["drawdown"] - hold["drawdown"]
    told = lambda c: F.when(trades > 0, c)
    result = F.when(trades == 0, "no_trades").when(F.abs(alpha) < SAME_RETURN, "matched").when(alpha > 0, "outperformed").otherwise("underperformed")
    risk = F.when(F.abs(own["sharpe"]) + F.abs(hold["sharpe"]) > 0, F.when(sharpe > SAME_SHARPE, "better").when(sharpe < -SAME_SHARPE, "worse").otherwise("similar"))
    deep = F.when(depth < -SAME_DRAWDOWN, "avoided").when(depth > SAME_DRAWDOWN, "deeper")
    return [result.alias("result"), told(risk).alias("risk"), told(deep).alias("depth")]


def recent(df: DataFrame, keys: list[str], ts: str, n: int) -> DataFrame:
    """The last ``n`` times of each key in ascending order, as an array."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).groupBy(*keys).agg(F.sort_array(F.collect_list(ts)).alias("times"))
