"""Near-dedup whose every link is verified on the two texts.

Fingerprints only name candidates: the SimHash groups of distinct words, and MinHash bands of
five-word shingles, which find what SimHash loses (inserted and dropped runs of words). A pair
is linked if the texts share ``ALIKE`` of their shingles. For pairs with fingerprints within the
radius another share can be asked for.

All pairs of a small bucket are candidates. A large bucket gives each member's pair with its
least one first; only if that leaves it in several groups are its members dealt to cells, block
against block, in which all pairs across groups are looked at. So no pair of a bucket is left
out, and a large group of near copies is not compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm import simhash
from quernstone.llm.common import free_name, written

SHINGLE = 5
#: Share of all shingles of two texts that a near copy has in common.
ALIKE = 0.8
#: Bands, and MinHash values of each: a pair alike in 0.8 meets in one of 24 bands but for 7 in 100,000.
BANDS, ROWS = 24, 5
#: Members up to which all pairs of a bucket are candidates, and members of a block of a larger one.
SMALL, BLOCK = 8, 4000
#: Values of the sketch by which a cell rejects pairs; ``SLACK`` is some four standard deviations.
SKETCH, SLACK = 128, 0.16
#: Shingles hashed at once.
SLICE = 100_000

_draw = np.random.default_rng(42)
_MIX = _draw.integers(0, 2**64, (2, max(BANDS * ROWS, SKETCH)), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    return np.array(sorted(simhash.shingle_hashes(text, SHINGLE, repeats=False)), dtype=np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity; 1 for two texts without words."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def near(a: np.ndarray, b: np.ndarray, bits: int, radius: int, shared: float) -> bool:
    return similarity(a, b) >= (shared if bits <= radius else ALIKE)


def minhashes(sets: list[np.ndarray], k: int) -> np.ndarray:
    """The least value of each set under each of k mixings; the greatest number for an empty set."""
    out = np.full((len(sets), k), np.iinfo(np.uint64).max, dtype=np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    upto = np.cumsum([len(sets[i]) for i in full])
    cuts = [0, *np.unique(np.searchsorted(upto, np.arange(SLICE, upto[-1], SLICE))).tolist(), len(full)] if full else [0]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        own = full[a:b]
        h = np.concatenate([sets[i] for i in own])
        start = np.cumsum([0, *(len(sets[i]) for i in own[:-1])])
        for c in range(k):
            out[own, c] = np.minimum.reduceat((h ^ _MIX[0, c]) * _MIX[1, c], start)
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """One bucket number for each band."""
    values = minhashes(sets, BANDS * ROWS).reshape(len(sets), BANDS, ROWS)
    out = np.zeros((len(sets), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = (out ^ values[:, :, r]) * _MIX[1, 0]
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def candidates(text: Column) -> Column:
    """(key, fp, bands): key is equal for texts of the same words, A-Z lower-cased; no words have no bands."""

    @F.pandas_udf("key long, fp long, bands array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        plain = [t if isinstance(t, str) else None for t in texts]
        words = [b" ".join(t.encode("utf-8", "surrogatepass").lower().split()) if t else b"" for t in plain]
        sets = [shingles(t) for t in plain]
        return pd.DataFrame(
            {
                "key": np.array([xxhash.xxh64_intdigest(w, simhash.SEED + 1) for w in words], dtype=np.uint64).view(np.int64),
                "fp": simhash.fingerprints(plain, 1, repeats=False).view(np.int64),
                "bands": [b if len(s) else [] for b, s in zip(bands(sets), sets)],
            }
        )

    return of(text)


def verified(pairs: DataFrame, texts: DataFrame, radius: int, shared: float) -> DataFrame:
    """(fp, root), the keys of those pairs (a, b) that are near."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            ok = []
            for a, b, x, y, bits in zip(batch["a"], batch["b"], batch["x"], batch["y"], batch["bits"]):
                for key, text in ((a, x), (b, y)):
                    if key not in known:
                        known[key] = shingles(text)
                ok.append(near(known[a], known[b], bits, radius, shared))
            yield batch.loc[np.array(ok, dtype=bool), ["a", "b"]].set_axis(["fp", "root"], axis=1)

    one, other = texts.toDF("a", "f", "x"), texts.toDF("b", "g", "y")
    both = pairs.join(one, "a").join(other, "b")
    return both.select("a", "b", "x", "y", F.bit_count(F.col("f").bitwiseXOR(F.col("g"))).alias("bits")).mapInPandas(run, "fp long, root long")


def cell_links(cell: pd.DataFrame, radius: int, shared: float) -> tuple[list[int], list[int]]:
    """Links across the groups of a cell; with two blocks those of one with the other. Pairs that have met are left out."""
    keys, fp, block = cell["key"].to_numpy(), cell["fp"].to_numpy().view(np.uint64), cell["block"].to_numpy()
    sets = [shingles(t) for t in cell["text"]]
    sketch = minhashes(sets, SKETCH).astype(np.uint8)
    label = np.unique(cell["comp"].to_numpy(), return_inverse=True)[1]
    two = block.min() != block.max()
    out: tuple[list[int], list[int]] = ([], [])
    for i in range(len(keys) - 1):
        bits = np.bitwise_count(fp[i + 1 :] ^ fp[i])
        least = (np.where(bits <= radius, shared, ALIKE) - SLACK) * SKETCH
        maybe = (label[i + 1 :] != label[i]) & ((sketch[i + 1 :] == sketch[i]).sum(axis=1) >= least)
        if two:
            maybe &= block[i + 1 :] != block[i]
        for j in (np.flatnonzero(maybe) + i + 1).tolist():
            if label[j] != label[i] and near(sets[i], sets[j], int(bits[j - i - 1]), radius, shared):
                out[0].append(int(keys[j]))
                out[1].append(int(keys[i]))
                label[label == label[j]] = label[i]
    return out


def cells(radius: int, shared: float):
    """For mapInPandas over rows sorted by (bucket, low, high): the links of each cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def links(rows: pd.DataFrame) -> pd.DataFrame:
            found: tuple[list[int], list[int]] = ([], [])
            for _, cell in rows.groupby(["bucket", "low", "high"], sort=False):
                for to, more in zip(found, cell_links(cell, radius, shared)):
                    to += more
            return pd.DataFrame({"fp": np.array(found[0], dtype=np.int64), "root": np.array(found[1], dtype=np.int64)})

        name = ["bucket", "low", "high"]
        for batch in batches:
            if not len(batch):
                continue
            last = (batch[name] == batch[name].iloc[-1]).all(axis=1)  # this cell may go on in the next batch
            if held and last.all() and (held[0][name].iloc[0] == batch[name].iloc[0]).all():
                held.append(batch)
                continue
            yield links(pd.concat([*held, batch[~last]]))
            held = [batch[last]]
        if held:
            yield links(pd.concat(held))

    return run


def components(tagged: DataFrame, key: str, fp: str, own_bands: str, text_col: str, tag: str, radius: int, shared: float) -> DataFrame:
    """(fp, root) of every key that is linked with another; ``fp`` is the key."""
    rows = tagged.select(F.col(key).alias("key"), F.col(fp).alias("fp"), F.col(own_bands).alias("bands"), F.col(tag).alias("tag"))
    one = written(rows.groupBy("key").agg(F.min_by(F.struct("fp", "bands", "tag"), "tag").alias("r")).select("key", "r.*"), "near-keys")
    prints = written(one.select("fp").distinct(), "near-prints")
    close = simhash.linked(prints, radius).toDF("fp", "close")
    by_print = one.join(close, "fp", "left").select("key", F.xxhash64(F.lit("print"), F.coalesce("close", "fp")).alias("bucket"))
    dealt = written(one.select("key", F.explode("bands").alias("bucket")).unionByName(by_print), "near-dealt")
    size = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("hub")).where("n > 1")
    members = written(dealt.join(size, "bucket"), "near-buckets")

    wanted = one.join(members.select("key").distinct(), "key").select("key", "fp", "tag")
    source = tagged.select(F.col(tag).alias("tag"), F.col(text_col).alias("text"))
    texts = written(source.join(wanted, "tag").select("key", "fp", "text"), "near-texts")

    few = members.where(F.col("n") <= SMALL)
    pairs = few.select("bucket", F.col("key").alias("a")).join(few.select("bucket", F.col("key").alias("b")), "bucket").where("a > b").select("a", "b")
    stars = members.where((F.col("n") > SMALL) & (F.col("key") != F.col("hub"))).select(F.col("key").alias("a"), F.col("hub").alias("b"))
    sure = written(verified(pairs.unionByName(stars).distinct(), texts, radius, shared), "near-links")
    met = simhash.contract(sure)

    many = members.where(F.col("n") > SMALL).join(met.toDF("key", "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    many = written(many, "near-many")
    open_ = many.groupBy("bucket").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c <> d").select("bucket")
    blocks = F.ceil(F.col("n") / BLOCK)
    cell = many.join(open_, "bucket").withColumn("block", F.pmod(F.xxhash64("key"), blocks)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    cell = cell.join(texts, "key").select("bucket", F.least("block", "o").alias("low"), F.greatest("block", "o").alias("high"), "block", "key", "comp", "fp", "text")
    cell = cell.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "key")
    more = written(cell.mapInPandas(cells(radius, shared), "fp long, root long"), "near-links")
    return simhash.contract(sure.unionByName(more)) if more.limit(1).count() else met


def dedup(docs: DataFrame, radius: int, id_col: str = "doc_id", text_col: str = "text", shared: float = ALIKE) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the least id, then of the least row tag.

    Texts of the same words are copies, texts without any (null, empty or blank) too. Groups are joined by verified links only.
    ``shared`` is the share of shingles asked of pairs within the radius; by default there is one threshold for all. Whole texts
    of any length are compared. A null id comes after all others, of rows of one id (repeated ones too) that of the least tag stays,
    an empty table stays empty, and columns of any name and type are kept as they are.
    """
    tag, own = free_name(docs, "_tag"), free_name(docs, "_own")
    tagged = docs.withColumn(own, candidates(F.col(text_col))).withColumn(tag, F.monotonically_increasing_id())
    key, fp, own_bands = free_name(docs, "_key"), free_name(docs, "_fp"), free_name(docs, "_bands")
    flat = [F.col(f"{own}.{n}").alias(a) for n, a in (("key", key), ("fp", fp), ("bands", own_bands))]
    tagged = written(tagged.select(*[F.col(f"`{c}`") for c in docs.columns], *flat, tag), "near-tagged")
    found = components(tagged, key, fp, own_bands, text_col, tag, radius, shared).toDF("k", "root")
    rows = tagged.select(F.col(key).alias("k"), F.col(id_col).alias("id"), F.col(tag).alias("tag")).join(found, "k", "left").withColumn("root", F.coalesce("root", "k"))
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("tag"))
    kept = rows.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.tag").alias(tag))
    gone = written(rows.select(F.col("tag").alias(tag)).join(kept, tag, "left_anti"), "near-gone")
    return tagged.join(gone, tag, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
