"""Streams: the same operators on Structured Streaming.

A kernel of ``ordered_scan`` runs over a stream as it does over a table: its state is kept
for each key between micro-batches in the checkpointed state store, so a restart goes on
where the last committed batch ended, and replaying a table in batches gives what the
table gives at once.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernstone.sources.store import shared_dir, written


#: Files of each part of a staged table, and so of each micro-batch that reads it.
FILES = 4


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which typed state variables and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = FILES) -> DataFrame:
    """A folder of parquet files as a stream, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling_bars(ticks: DataFrame, seconds: int, margin: str = "30 seconds") -> DataFrame:
    """Closed bars of (symbol, ts, id, price, volume) ticks: a bar is given out once time has passed its end by the margin."""
    at = F.struct("ts", "id")
    return (
        ticks.withWatermark("ts", margin)
        .groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def first_write_wins(rows: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Duplicates that come within the delay are ignored."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def stream_scan(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], kernel: Callable, schema: str) -> DataFrame:
    """``ordered_scan`` over a stream; the kernel's state is pickled into the state store between batches.

    Rows of a batch are walked in order, ties too; rows not newer than the last one of
    earlier batches are ignored, so a candle that comes again later acts once.
    """
    key_schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *[p.strip().split(" ")[0].strip("`") for p in schema.split(",")]]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, last = pickle.loads(state.get[0]) if state.exists else (kernel(key), None)
        batch = pd.concat(list(batches)).sort_values(order, kind="stable")
        out, done = [], last
        for at, row in zip(zip(*[batch[c].tolist() for c in order]), zip(*[batch[c].tolist() for c in columns])):
            if done is not None and at <= done:
                continue
            last = at
            out += [(*key, *x) for x in own.push(row)]
        state.update((pickle.dumps((own, last)),))
        yield pd.DataFrame(out, columns=names)

    out_type = T._parse_datatype_string(f"{key_schema}, {schema}")
    state_type = T.StructType([T.StructField("blob", T.BinaryType())])
    used = list(dict.fromkeys([*keys, *order, *columns]))
    return rows.select(*used).groupBy(*keys).applyInPandasWithState(run, out_type, state_type, "append", GroupStateTimeout.NoTimeout)


def drain(rows: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there now into a table of the shared folder."""
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = rows.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    query = (writer.partitionBy(*partition_by) if partition_by else writer).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/table")


def staged(df: DataFrame, name: str, order: str, parts: int) -> tuple[str, T.StructType]:
    """A table as a folder of ``parts`` times ``FILES`` files, the parts in the order of a column and written one after the other.

    The table is computed once, into a folder for each part; each part is then landed by tasks of its own.
    """
    spark = df.sparkSession
    bounds = df.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    span = (bounds["b"] - bounds["a"]) / parts
    place = F.lit(0)
    for i in range(1, parts):
        place = place + (F.col(order) >= F.lit(bounds["a"] + i * span)).cast("int")
    cut = written(df.withColumn("_part", place), f"{name}-parts", ["_part"])
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for i in range(parts):
        cut.where(F.col("_part") == i).drop("_part").repartition(FILES).write.mode("append").parquet(path)
    return path, df.schema
