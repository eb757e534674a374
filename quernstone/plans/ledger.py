"""The paper trader's ledger: fills, snapshots, window losses, stops, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators import chunked


def fills(orders: DataFrame, slip_bps: float, fee_bps: float) -> DataFrame:
    """Orders (side, quantity, price) with fill price, notional and fee in decimals."""
    px = F.col("price").cast("decimal(20,8)")
    slip = F.lit(slip_bps / 10_000).cast("decimal(10,8)")
    fill = F.bround(px * F.when(F.col("side") == "buy", 1 + slip).otherwise(1 - slip), 8)
    out = orders.withColumn("fill_price", fill.cast("decimal(20,8)"))
    out = out.withColumn("notional", F.bround(F.col("fill_price") * F.col("quantity").cast("decimal(14,4)"), 8).cast("decimal(28,8)"))
    return out.withColumn("fee", F.bround(F.col("notional") * F.lit(fee_bps / 10_000).cast("decimal(10,8)"), 8).cast("decimal(28,8)"))


def snapshots(flows: DataFrame, start: float, keys: tuple[str, ...]) -> DataFrame:
    """Cash flows over time -> equity, its peak and drawdown at each. Series are walked a month at a time, side by side."""
    month, order = (F.year("ts") * 12 + F.month("ts")), ["ts", "id"]
    eq = chunked.running_sum(flows.withColumn("_month", month), list(keys), "_month", order, F.col("flow"), "_cash").withColumn("equity", start + F.col("_cash"))
    eq = chunked.running_max(eq, list(keys), "_month", order, "equity", "_top").withColumn("peak", F.greatest(F.lit(start), "_top"))
    return eq.withColumn("drawdown", 1 - F.col("equity") / F.col("peak")).drop("_month", "_cash", "_top")


def window_pnl(curve: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Each snapshot against the last one at or before its anchor time."""
    marked = chunked.asof(anchors, curve.select(*keys, "ts", F.col("equity").alias("anchor_equity")), keys, "anchor", "ts", ["anchor_equity"], F.year("_t") * 12 + F.month("_t"))
    return marked.withColumn("pnl", F.col("equity") / F.col("anchor_equity") - 1)


def health(events: Column, errors: Column, stale: Column) -> Column:
    return F.when(events == 0, "offline").when(stale, "stale").when(errors / events > 0.25, "degraded").otherwise("healthy")
