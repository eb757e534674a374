"""Stored bar series and other tables: scans, upserts, manifests, and durable intermediate tables."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.sources.bars import TIMEFRAMES

SYMBOL_PATTERN = r"^[A-Z0-9]{2,10}/[A-Z0-9]{2,10}$"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one under a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.parquet(path) if partition_by else df.sparkSession.read.schema(df.schema).parquet(path)


def dirname(symbol: Column) -> Column:
    """A symbol as a folder name."""
    return F.regexp_replace(F.upper(symbol), "[^A-Z0-9]+", "_")


def valid_symbol(symbol: Column) -> Column:
    return F.coalesce(symbol.rlike(SYMBOL_PATTERN), F.lit(False))


def valid_timeframe(timeframe: Column) -> Column:
    return F.coalesce(timeframe.isin(*TIMEFRAMES), F.lit(False))


def asset_class(symbol: Column) -> Column:
    """Two three-letter currencies are forex; what is quoted in a coin or dollar token is crypto; the rest equity."""
    base, quote = F.split_part(symbol, F.lit("/"), F.lit(1)), F.split_part(symbol, F.lit("/"), F.lit(2))
    money = ["USD", "EUR", "GBP", "JPY", "CHF", "AUD", "CAD", "NZD"]
    return F.when(base.isin(money) & quote.isin(money), "forex").when(F.contains(symbol, F.lit("/")), "crypto").otherwise("equity")


def span(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Bars of [start, end): a filter on the plain column, so it reaches the scan."""
    return bars.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))


def merge_fetched(cached: DataFrame, fetched: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """Cached rows, and fetched ones whose keys the cache lacks: the first by ``arrival`` of each key."""
    return cached.unionByName(absent(fetched, cached, keys, arrival).select(*cached.columns))


def first_of(rows: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """The first row of each key. Rows that agree in ``arrival`` too are told apart by a hash of the row, so a rerun keeps the same."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    place = F.struct(*arrival, F.xxhash64(whole))
    return rows.groupBy(*keys).agg(F.min_by(whole, place).alias("_r")).select("_r.*")


def absent(new: DataFrame, existing: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """New rows whose keys are not there yet, the first by ``arrival`` of each key: insert-if-absent."""
    return first_of(new, keys, arrival).join(existing.select(*keys), keys, "left_anti")


def covered_spans(cached: DataFrame, keys: list[str], bar_seconds: int) -> DataFrame:
    """(keys, start, end): the spans [start, end) that cached bars fill without a gap, as islands of neighbouring bars."""
    w = Window.partitionBy(*keys).orderBy("ts")
    step = F.make_dt_interval(secs=F.lit(bar_seconds))
    begins = F.coalesce(F.col("ts") > F.lag("ts").over(w) + step, F.lit(True))
    island = F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return cached.select(*keys, "ts").distinct().withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("ts").alias("start"), (F.max("ts") + step).alias("end")).drop("_island")


def missing_spans(wished: DataFrame, cached: DataFrame, keys: list[str], bar_seconds: int) -> DataFrame:
    """(keys, start, end): of the ``wished`` spans (keys, start, end; end excluded), what the cache doesn't cover: only that is to be fetched.

    Ends of wishes and of covered spans are events on a line; where a wish is open and nothing
    covers it, a span is missing. Wishes of a key may overlap, and touching spans are one.
    """
    turn = lambda df, wish, covers: df.select(*keys, F.explode(F.array(
        F.struct(F.col("start").alias("at"), F.lit(wish).alias("wish"), F.lit(covers).alias("covers")),
        F.struct(F.col("end").alias("at"), F.lit(-wish).alias("wish"), F.lit(-covers).alias("covers")),
    )).alias("_e")).select(*keys, "_e.*")
    wanted = wished.where("start < end")
    covered = covered_spans(cached, keys, bar_seconds).join(wanted.select(*keys).distinct(), keys, "left_semi")
    turns = turn(wanted, 1, 0).unionByName(turn(covered, 0, 1)).groupBy(*keys, "at").agg(F.sum("wish").alias("wish"), F.sum("covers").alias("covers"))
    w = Window.partitionBy(*keys).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    lacks = (F.sum("wish").over(upto) > 0) & (F.sum("covers").over(upto) == 0)
    parts = turns.withColumn("_lacks", lacks).withColumn("end", F.lead("at").over(w)).withColumn("_before", F.coalesce(F.lag("_lacks").over(w), F.lit(False)))
    spans = parts.where("_lacks").withColumn("_span", F.sum((~F.col("_before")).cast("int")).over(upto))
    return spans.groupBy(*keys, "_span").agg(F.min("at").alias("start"), F.max("end").alias("end")).drop("_span")


def fetch_missing(wished: DataFrame, cached: DataFrame, source: DataFrame, keys: list[str], bar_seconds: int) -> DataFrame:
    """Rows of ``source`` in the missing spans: a range join on each key's few spans, so nothing covered is read again."""
    gaps = missing_spans(wished, cached, keys, bar_seconds)
    return source.join(gaps, keys).where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))).select(*source.columns)


def from_epoch_ms(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Fetched rows with ``ts_ms`` as UTC time, the first to arrive of each key."""
    at = rows.withColumn("ts", F.timestamp_millis(F.col("ts_ms").cast("long")).cast("timestamp_ntz"))
    struct = F.struct(*[F.col(c) for c in at.columns])
    return at.groupBy(*keys, "ts").agg(F.min_by(struct, arrival).alias("_r")).select("_r.*")


def manifest(bars: DataFrame, keys: list[str]) -> DataFrame:
    """What was fetched: rows, first and last time, and an order-free fingerprint of the values."""
    row = F.xxhash64(*[F.col(c) for c in sorted(bars.columns)])
    return bars.groupBy(*keys).agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.bit_xor(row).alias("fingerprint"))


def main_text(html: Column) -> Column:
    """Readable text of an HTML page: no scripts, styles, navigation or tags; entities and blanks reduced."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|head)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


#: exchange -> symbol -> side -> [[tier_min, bps]]
COSTS = "map<string, map<string, map<string, array<array<double>>>>>"


def cost_rows(documents: DataFrame, text: str = "value") -> DataFrame:
    """(exchange, symbol, side, tier_min, bps) of nested JSON cost tables, one document a row."""
    rows = documents.select(F.explode(F.from_json(text, COSTS)).alias("exchange", "_s")).select("exchange", F.explode("_s").alias("symbol", "_d"))
    rows = rows.select("exchange", "symbol", F.explode("_d").alias("side", "_t")).select("exchange", "symbol", "side", F.explode("_t").alias("_r"))
    return rows.select("exchange", "symbol", "side", F.get("_r", F.lit(0)).alias("tier_min"), F.get("_r", F.lit(1)).alias("bps"))


def cost_table(spark: SparkSession, nested: dict) -> DataFrame:
    """A nested table as rows."""
    return cost_rows(spark.createDataFrame([(json.dumps(nested),)], "value string"))


def load_cost_table(spark: SparkSession, path: str) -> DataFrame:
    """The same from a folder of JSON documents, one a line; any store Spark reads will do."""
    return cost_rows(spark.read.text(path))
