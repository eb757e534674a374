"""Exact quantiles by nested histograms: memory does not depend on the number of rows or of distinct values.

A double's bits, with the sign turned round, are a whole number that orders as the double
does. Its first 16 bits are counted for each key; the bucket that holds a wanted rank is the
only one whose next 16 bits are counted, and so on: after four rounds the value is known to
the last bit. A round's histogram has 65,536 rows a bucket at most, combined before they are
shuffled, and rows outside the buckets looked at are filtered before that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.sources.store import written

DIGIT, ROUNDS = 16, 4


@F.pandas_udf(T.LongType())
def order_bits(values: pd.Series) -> pd.Series:
    """A number that orders as the doubles do: NaN last, the two zeros alike."""
    x = values.to_numpy(np.float64, na_value=np.nan) + 0.0
    bits = np.where(np.isnan(x), np.float64("nan"), x).view(np.int64)
    return pd.Series(np.where(bits < 0, ~bits ^ np.int64(-(2**63)), bits))


@F.pandas_udf(T.DoubleType())
def from_bits(bits: pd.Series) -> pd.Series:
    b = bits.to_numpy(np.int64)
    return pd.Series(np.where(b < 0, ~(b ^ np.int64(-(2**63))), b).view(np.float64))


def digit(bits: Column, round_: int) -> Column:
    """The ``round_``-th 16 bits, the sign turned so that digits order as numbers do."""
    unsigned = F.shiftrightunsigned(bits.bitwiseXOR(F.lit(-(2**63))), 64 - DIGIT * (round_ + 1))
    return unsigned.bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")


def exact_quantiles(rows: DataFrame, keys: list[str], value: Column, wanted: dict[str, float]) -> DataFrame:
    """(keys, a column for each of ``wanted``): quantiles with linear interpolation, as ``percentile`` gives them.

    Nulls don't count; a key without any value has no row. Without ``keys`` there is one row, if there is a value.
    """
    own = [*keys, "_key"] if not keys else list(keys)
    some = rows.select(*keys, value.cast("double").alias("_v")).where("_v IS NOT NULL")
    bits = some.withColumn("_bits", order_bits("_v")).drop("_v")
    if not keys:
        bits = bits.withColumn("_key", F.lit(0))
    bits = written(bits, "bits")  # read once a round
    prefix = [f"_d{i}" for i in range(ROUNDS)]
    hot = bits.withColumns({p: digit(F.col("_bits"), i) for i, p in enumerate(prefix)}).drop("_bits")
    counts = hot.groupBy(*own, prefix[0]).agg(F.count("*").alias("_n"))
    totals = counts.groupBy(*own).agg(F.sum("_n").alias("_total"))
    places = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in wanted.items()])
    asked = totals.select(*own, "_total", F.explode(places).alias("_w")).select(*own, "_w.name", ((F.col("_total") - 1) * F.col("_w.q")).alias("_at"))
    asked = asked.withColumn("_share", F.col("_at") - F.floor("_at"))
    asked = asked.withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_rank", (F.floor("_at") + F.when(F.col("_share") > 0, F.col("_side")).otherwise(0)).cast("long"))
    for i, p in enumerate(prefix):
        found = prefix[:i]
        if i:  # only rows in buckets that hold a wanted rank
            open_ = asked.select(*own, *found).distinct()
            counts = hot.join(open_, [*own, *found]).groupBy(*own, *found, p).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*own, *found).orderBy(p).rowsBetween(Window.unboundedPreceding, 0))
        buckets = counts.withColumn("_upto", upto)
        inside = (F.col("_rank") >= F.col("_upto") - F.col("_n")) & (F.col("_rank") < F.col("_upto"))
        met = asked.join(buckets, [*own, *found]).where(inside)
        asked = met.withColumn("_rank", F.col("_rank") - (F.col("_upto") - F.col("_n"))).drop("_n", "_upto")
        asked = written(asked, "ranks")  # a row or two for each key and quantile
    whole = F.lit(0).cast("long")
    for p in prefix:
        whole = F.shiftleft(whole, DIGIT).bitwiseOR(F.col(p).cast("long"))
    values = asked.withColumn("_x", F.coalesce(from_bits(whole.bitwiseXOR(F.lit(-(2**63)))), F.lit(float("nan"))))  # pandas has no NaN beside null
    low, high = (F.max(F.when(F.col("_side") == side, F.col("_x"))) for side in (0, 1))
    each = values.groupBy(*own, "name", "_share").agg(low.alias("_low"), high.alias("_high"))
    each = each.withColumn("_q", F.when(F.col("_share") == 0, F.col("_low")).otherwise((1 - F.col("_share")) * F.col("_low") + F.col("_share") * F.col("_high")))
    return each.groupBy(*own).agg(*[F.max(F.when(F.col("name") == name, F.col("_q"))).alias(name) for name in wanted]).drop("_key")
