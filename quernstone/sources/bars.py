"""OHLCV bars: the universal input, from tick-like tables.

A bar is (symbol, ts, open, high, low, close, volume); ``ts`` is the bar's open time and
the bar covers [ts, ts + timeframe). Empty bins have no row. Open and close are the first
and last tick by a total order, so results don't depend on the layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of each timeframe.
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "6h": 21600, "1d": 86400}
OHLCV = ["symbol", "ts", "open", "high", "low", "close", "volume"]


def scan(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of the driver's data; only ``columns`` are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bin_start(ts: Column, seconds: int) -> Column:
    """Start of the UTC bin of so many seconds that holds ``ts``."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(F.floor(micros / (seconds * 1_000_000)).cast("long") * (seconds * 1_000_000)).cast("timestamp_ntz")


def packed(ts: Column, seconds: int, order: list[tuple[str, int]]) -> Column:
    """Place inside the bin, then ``order`` columns of so many digits each, as one number.

    A number can be kept in place while rows are hashed together; a struct would have Spark
    sort all ticks before it combines them. The order must tell ticks of one instant apart.
    """
    digits = len(str(seconds * 1_000_000)) + sum(n for _, n in order)
    if digits > 38:
        raise ValueError(f"the order takes {digits} digits; a decimal holds 38")
    out = (F.unix_micros(ts.cast("timestamp")) % (seconds * 1_000_000)).cast("decimal(38,0)")
    for name, n in order:
        out = (out * F.lit(10**n).cast("decimal(38,0)") + F.col(name)).cast("decimal(38,0)")
    return out


def ticks_to_bars(ticks: DataFrame, seconds: int, order: list[tuple[str, int]]) -> DataFrame:
    """Bars of (symbol, ts, price, volume) ticks; ``order`` (column, digits) breaks ties of ts. One shuffle, combined before it."""
    binned = ticks.withColumn("_bin", bin_start(F.col("ts"), seconds)).withColumn("_at", packed(F.col("ts"), seconds, order))
    return (
        binned.groupBy("symbol", F.col("_bin").alias("bar"))
        .agg(
            F.min_by("price", "_at").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "_at").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select("symbol", F.col("bar").alias("ts"), "open", "high", "low", "close", "volume")
    )


def resample(bars: DataFrame, seconds: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars of a longer timeframe: left-closed, left-labelled, empty bins dropped."""
    binned = bars.withColumn("_bin", bin_start(F.col("ts"), seconds))
    return (
        binned.groupBy(*keys, "_bin")
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("_bin", "ts")
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of lineitem: a symbol for each return flag and line status, price per unit."""
    ticks = scan(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )
    return ticks_to_bars(ticks, TIMEFRAMES["1d"], [("l_orderkey", 13), ("l_linenumber", 1), ("l_partkey", 12)])


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of orders: a symbol for each priority, total price, volume one for each order."""
    ticks = scan(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"), "o_orderkey"
    )
    return ticks_to_bars(ticks, TIMEFRAMES["1d"], [("o_orderkey", 18)])


def event_bars(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    """Intraday bars of events: a symbol for each event type."""
    ticks = scan(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"), "event_id")
    return ticks_to_bars(ticks, TIMEFRAMES[timeframe], [("event_id", 18)])


# The same bars in SQL, for the oracle.
DAILY = """bars AS (SELECT l_returnflag || l_linestatus AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
  first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS close,
  sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""
ORDERS = """bars AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
  first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2)"""


def events_sql(seconds: int, name: str = "bars") -> str:
    return f"""{name} AS (SELECT event_type AS symbol, time_bucket(INTERVAL '{seconds} seconds', ts)::TIMESTAMP AS ts,
  first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
  count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"""


HOURLY = events_sql(3600)
