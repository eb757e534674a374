"""Correlations of every two series by blocked products of matrices: no row for each pair and time.

Symbols are dealt to tiles, times to buckets. Two tiles in a bucket are two small matrices, and
their products give, for every pair at once, the counts and sums of what both have; these are
added up over the buckets. A row is copied once for each tile, not for each other symbol.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILES, BUCKET_DAYS = 8, 256
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def products(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts and sums of each pair (a < b) of symbols of one tile, or of one tile with the other."""
    wide = rows.pivot(index="ts", columns="symbol", values="r")
    tile = rows.drop_duplicates("symbol").set_index("symbol")["tile"].reindex(wide.columns).to_numpy()
    x = wide.to_numpy()
    there = (~np.isnan(x)).astype(float)
    x = np.nan_to_num(x)
    n, sx, sxx, sxy = there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x
    one = rows["low"].iloc[0] == rows["high"].iloc[0]
    a, b = np.nonzero(np.triu(np.ones_like(n), 1) * (n > 0) * (one | (tile[:, None] != tile[None, :])))
    names = wide.columns.to_numpy()
    return pd.DataFrame({"a": names[a], "b": names[b], "n": n[a, b], "sx": sx[a, b], "sy": sx[b, a], "sxx": sxx[a, b], "syy": sxx[b, a], "sxy": sxy[a, b]})


def pair_correlations(returns: DataFrame) -> DataFrame:
    """(a, b, rho) for every two symbols (symbol, ts, r) with a common time, a before b; null where one of them doesn't vary there. One row a symbol and time."""
    tile = F.pmod(F.xxhash64("symbol"), F.lit(TILES)).cast("int")
    bucket = F.floor(F.unix_date(F.to_date("ts")) / BUCKET_DAYS).cast("long")
    some = returns.where("r IS NOT NULL").select("symbol", "ts", "r", tile.alias("tile"), bucket.alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(TILES - 1))).alias("other"))
    pairs = some.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("other")
    schema = "a string, b string, " + ", ".join(f"{c} double" for c in SUMS)
    added = pairs.groupBy("bucket", "low", "high").applyInPandas(products, schema).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in SUMS])
    spread = lambda s, q: F.greatest(F.col(q) - F.col(s) * F.col(s) / F.col("n"), F.lit(0.0))
    both = F.sqrt(spread("sx", "sxx") * spread("sy", "syy"))
    return added.select("a", "b", ((F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.nullif(both, F.lit(0.0))).alias("rho"))
