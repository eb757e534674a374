"""What several operators share: reading tables, durable intermediate tables, word counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what ends a word (space and \t \n \v \f \r), as the operators' contracts have it.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Equal rows that are dealt out together.
CHUNK = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(column: str, salt: str) -> Column:
    """md5 of salt and id as lowercase hex: the same on every engine. A null id hashes as the empty string."""
    return F.md5(F.concat(F.lit(salt), F.coalesce(F.col(column).cast("string"), F.lit(""))).cast("binary"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it until no column of ``df`` is called so (case does not matter)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(holds_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and holds_map(kind.elementType)


def comparable(df: DataFrame) -> list[Column]:
    """The columns of ``df`` as rows can be hashed and grouped by them: what holds a map, which Spark can do neither with, as JSON."""
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))) if holds_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema]


def equal_rows(rows: DataFrame) -> tuple[DataFrame, str]:
    """Rows, and the column with their number from 0 among those that agree in all others: these are counted, and dealt out again in chunks."""
    count, part, number, row = (free_name(rows, n) for n in ("_equal_count", "_equal_part", "_equal_number", "_equal_row"))
    whole = F.first(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias(row)
    keys = [c.alias(f"_{i}") for i, c in enumerate(comparable(rows))]
    counted = rows.groupBy(*keys).agg(whole, F.count("*").alias(count)).select(f"{row}.*", count)
    chunks = counted.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(CHUNK).cast("long")))).repartition(part)
    return chunks.withColumn(number, F.explode(F.sequence(F.col(part), F.least(F.col(part) + CHUNK, F.col(count)) - 1))).drop(count, part), number
