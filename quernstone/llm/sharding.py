"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Each row gets a global row number, gapless from 0; a keyed permutation of
0..n-1 turns the number into a position; ``position % shards`` is the shard and
``position // shards`` the slot. So shard and slot of any row number can be
computed (``locate``) without reading the data, shards differ by at most one
row, and slots have no gaps.

Row numbers follow the md5 of the id and what breaks its ties. Its first three hex digits cut that order
into 4096 runs; runs are numbered side by side and offset by the counts of the
runs before them, so no task ever sorts more than a few runs and what the
driver collects is 4096 counts, however many rows there are. Rows that agree in everything
would all lie in one run: where that makes a run large they are counted, numbered behind
the run's other rows and dealt out again in chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import comparable, equal_rows, free_name, table

#: Runs of the md5 order: three hex digits.
RUNS = 4096
#: A run is large if it has so many times the mean of all runs, and so many rows.
LARGE, LEAST_LARGE = 4, 10_000
ROUNDS = 6
#: Fixed value: the prime 2**31 - 1, modulus of the round function.
PRIME = 2_147_483_647


def round_keys(seed: int) -> list[tuple[int, int]]:
    """A multiplier and an addend for each round, from the seed alone."""
    draw = np.random.Generator(np.random.PCG64(seed))
    return [(int(a), int(c)) for a, c in zip(draw.integers(1, PRIME, ROUNDS), draw.integers(0, PRIME, ROUNDS))]


def half_bits(n: int) -> int:
    """Bits of either half of the smallest even-width domain that holds 0..n-1."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _once(x: np.ndarray, half: int, keys: list[tuple[int, int]]) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    left, right = x >> shift, x & mask
    for a, c in keys:
        mixed = (right % np.uint64(PRIME) * np.uint64(a) + np.uint64(c)) % np.uint64(PRIME)
        mixed = (mixed ^ (mixed >> np.uint64(13))) * np.uint64(a) % np.uint64(PRIME)
        left, right = right, left ^ (mixed & mask)
    return left << shift | right


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Positions of row numbers under the permutation of 0..n-1 that the seed names.

    A Feistel network permutes the power of four above n; what lands at n or
    beyond goes through it again until it is inside (cycle walking). As the
    cycle returns to its start, which is inside, this ends.
    """
    half, keys = half_bits(n), round_keys(seed)
    out = _once(np.asarray(numbers).astype(np.uint64), half, keys)
    while (outside := np.flatnonzero(out >= n)).size:
        out[outside] = _once(out[outside], half, keys)
    return out.astype(np.int64)


def locate(number: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of one row number, without any data."""
    position = int(permute(np.array([number]), n, seed)[0])
    return position % shards, position // shards


def permuted(number: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def position(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    return position(number)


def number_rows(docs: DataFrame, id_col: str = "doc_id", out: str = "row_number") -> tuple[DataFrame, int]:
    """``docs`` with a gapless global row number from 0, and the number of rows.

    Rows are numbered by the md5 of their id and a hash of the whole row, so that rows of
    one id spread over the runs, then by these themselves. Rows that agree in everything
    take neighbouring numbers.
    """
    key, run, row = free_name(docs, "_row_md5"), free_name(docs, "_row_run"), free_name(docs, "_row_hash")
    keyed = docs.withColumn(row, F.xxhash64(*comparable(docs)))
    keyed = keyed.withColumn(key, F.md5(F.concat_ws("|", F.lit("row"), F.col(id_col).cast("string"), F.col(row).cast("string")).cast("binary")))
    keyed = keyed.withColumn(run, F.conv(F.substring(key, 1, 3), 16, 10).cast("int"))
    counts = dict(keyed.groupBy(run).count().collect())  # at most RUNS rows
    total = sum(counts.values())
    bound = max(LEAST_LARGE, LARGE * total // RUNS)
    large = [r for r, n in counts.items() if n > bound]
    # in large runs, keys that fill half of the bound: no more than 2 * total / bound, so at most RUNS / 2
    repeated = dict(keyed.where(F.col(run).isin(large)).groupBy(key).count().where(F.col("count") > bound // 2).collect()) if large else {}
    starts, behind, at = [], {}, 0
    for i in range(RUNS):
        starts.append(at)
        own = sorted(k for k in repeated if int(k[:3], 16) == i)
        at += counts.get(i, 0) - sum(repeated[k] for k in own)
        for k in own:
            behind[k] = at
            at += repeated[k]
    order = Window.partitionBy(run).orderBy(key, id_col, row)
    start = F.element_at(F.lit(starts).cast("array<long>"), F.col(run) + 1)
    single = keyed.where(~F.col(key).isin([*repeated])) if repeated else keyed
    numbered = single.withColumn(out, start + F.row_number().over(order) - 1).drop(key, run, row)
    if not repeated:
        return numbered, total
    # distinct rows of one key are a collision of the row hash, but would be told apart here
    equal, number = equal_rows(keyed.where(F.col(key).isin([*repeated])))
    first = F.create_map(*[x for k, v in behind.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    several = equal.withColumn(out, F.element_at(first, F.col(key)) + F.col(number)).drop(key, run, row, number)
    return numbered.unionByName(several), total


def shard(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Deal the rows of ``docs`` into shards whose sizes differ by one at most.

    Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).
    An empty table gives an empty table. A null id is one like others; repeated rows each
    get their own slot, and which of them gets which makes no difference; texts of any
    length count by their hash; columns already named like an added one are replaced.
    """
    docs = docs.drop(shard_col, slot_col)
    number, position = free_name(docs, "_number"), free_name(docs, "_position")
    numbered, n = number_rows(docs, id_col, number)
    placed = numbered.withColumn(position, permuted(F.col(number), n, seed))
    return (
        placed.withColumn(shard_col, (F.col(position) % shards).cast("int"))
        .withColumn(slot_col, F.floor(F.col(position) / shards).cast("long"))
        .drop(number, position)
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by law ``rows``: counts are at most one apart."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    facts = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    return shard(facts, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
