"""SimHash near-dedup with BK-trees.

A text's fingerprint has bit b set if most of its shingle hashes have. Two fingerprints link
if they differ in at most ``radius`` bits. The bits are cut into ``radius + spare`` blocks, of
which that many differing bits leave ``spare`` untouched; so each distinct fingerprint goes to
the shards named by ``spare`` of its blocks and their bits, and any link lies in one of
these. The more fingerprints, the more blocks are left untouched (``spare_for``): trees stay
small, and links are the same. Each shard is a BK-tree: a node's children are keyed by their
Hamming distance to it, and a query follows only the edges within the radius of its own
distance. All trees of a batch are built and searched together, level by level, with array
operations.

A shard gives a link to the root of each local group, never all its pairs, and a search
leaves out subtrees whose nodes have all joined the query's own group, so a large group of
near copies is not compared pair by pair. Groups are joined across shards by star
contraction on written tables. Copies meet as one fingerprint before any of this.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import free_name, table, written

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints that a tree may be expected to hold; what is left untouched is chosen so that shards stay below it.
TREE = 4096
#: Edges of a node from one in so many of all edges on: such nodes are no more than this, and are joined apart.
HUBS = 1000
#: First fingerprints of each shard that are searched before all others, so that large groups meet early.
LEADERS = 16
#: Shingles hashed at once, and (query, node) pairs followed at once.
SLICE_SHINGLES, SLICE_PAIRS = 500_000, 2_000_000

#: For each byte its bits, one to a byte of a 64-bit word: sums of up to 255 of them can't overflow.
SPREAD = np.array([sum(1 << (8 * k) for k in range(8) if v >> k & 1) for v in range(256)], dtype=np.uint64)


def shingle_hashes(text: str | None, n: int = SHINGLE, repeats: bool = True) -> list[int]:
    """XXH64 of each run of n words, A-Z lower-cased and joined by blanks; of all words if there are fewer.

    Without ``repeats`` equal runs count once.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = [*itertools.accumulate(len(w) + 1 for w in words)]
    starts = [0, *ends[: len(words) - n]]
    runs = (joined[a : b - 1] for a, b in zip(starts, ends[n - 1 :]))
    return [digest(r, SEED) for r in (runs if repeats else set(runs))]


def fingerprints(texts: list[str | None], n: int = SHINGLE, repeats: bool = True) -> np.ndarray:
    """Fingerprints as unsigned 64-bit numbers; zero for texts without words."""
    out = np.zeros(len(texts), dtype=np.uint64)
    batch: list[tuple[int, int]] = []
    hashes: list[int] = []
    for i, text in enumerate(texts):
        got = shingle_hashes(text, n, repeats)
        if got:
            batch.append((i, len(got)))
            hashes += got
        if batch and (len(hashes) >= SLICE_SHINGLES or i == len(texts) - 1):
            out[[b[0] for b in batch]] = _majorities(np.array(hashes, dtype=np.uint64), np.array([b[1] for b in batch]))
            batch, hashes = [], []
    return out


def _majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    pieces = -(-sizes // 255)
    of = np.repeat(np.arange(len(sizes)), pieces)
    within = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.cumsum(sizes) - sizes
    cuts = begin[of] + 255 * within
    first = np.cumsum(pieces) - pieces
    out = np.zeros(len(sizes), dtype=np.uint64)
    columns = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        partial = np.add.reduceat(SPREAD[columns[:, byte]], cuts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(partial.astype(np.int64), first, axis=0)
        bits = (2 * counts > sizes[:, None]).astype(np.uint64)
        for k in range(8):
            out |= bits[:, k] << np.uint64(8 * byte + k)
    return out


def fingerprint(text: Column, n: int = SHINGLE, repeats: bool = True) -> Column:
    """The fingerprint as a signed long with the same 64 bits. A null text counts as empty."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints([t if isinstance(t, str) else None for t in texts], n, repeats).view(np.int64))

    return of(text)


class Forest:
    """One BK-tree for each run of equal shard numbers. Fingerprints of a shard are distinct.

    The first of a shard is its root, and each node comes before its children.
    """

    def __init__(self, prints: np.ndarray, shard: np.ndarray):
        self.prints = prints
        new = np.append(True, shard[1:] != shard[:-1])
        self.root = np.flatnonzero(new)[np.cumsum(new) - 1]
        node, waiting = self.root.copy(), np.flatnonzero(~new)
        keys, kids = [], []
        while waiting.size:  # all that reach a node by the same edge: the first is its child there, the others go on below it
            edge = node[waiting] * 65 + np.bitwise_count(prints[waiting] ^ prints[node[waiting]])
            found, first, back = np.unique(edge, return_index=True, return_inverse=True)
            child = waiting[first]
            keys.append(found)
            kids.append(child)
            node[waiting] = child[back]
            waiting = np.delete(waiting, first)
        #: Parents and children of each depth.
        self.depths = [(k // 65, c) for k, c in zip(keys, kids)]
        keys = np.concatenate(keys) if keys else np.array([], dtype=np.int64)
        kids = np.concatenate(kids) if kids else np.array([], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.kids = keys[order], kids[order]

    def common(self, label: np.ndarray) -> np.ndarray:
        """For each node the label that its whole subtree has, or -1."""
        low, high = label.copy(), label.copy()
        for parent, child in reversed(self.depths):
            np.minimum.at(low, parent, low[child])
            np.maximum.at(high, parent, high[child])
        return np.where(low == high, low, -1)

    def within(self, queries: np.ndarray, radius: int, label: np.ndarray, earlier: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) at most ``radius`` bits apart, level by level, without a query itself.

        Subtrees all of the query's own label are left out; with ``earlier`` so are nodes
        behind the query.
        """
        common = self.common(label)
        q, node = queries, self.root[queries]
        q, node = (x[common[node] != label[q]] for x in (q, node))
        while q.size:
            d = np.bitwise_count(self.prints[q] ^ self.prints[node]).astype(np.int64)
            near = (d <= radius) & (q != node)
            yield q[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right") - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            q, node = np.repeat(q, n), self.kids[at]
            go = common[node] != label[q]
            if earlier:
                go &= node < q
            q, node = q[go], node[go]


def local_roots(prints: np.ndarray, shard: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the place of the first one of its group, by links inside its shard.

    Each shard's leaders look at all of it; all others, a growing share at a time, look
    only at those before them, and by then most of a large group has met.
    """
    label = np.arange(len(prints))
    forest = Forest(prints, shard)
    new = np.append(True, shard[1:] != shard[:-1])
    size = np.bincount(np.cumsum(new) - 1)
    rank = np.arange(len(prints)) - np.repeat(np.flatnonzero(new), size)
    turn = np.zeros(len(prints), dtype=np.int64)
    turn[rank >= LEADERS] = 1 + np.log2(rank[rank >= LEADERS] // LEADERS).astype(np.int64)
    of = np.repeat(size, size)
    for t in range(int(turn.max()) + 1):
        own = np.flatnonzero(turn == t)
        work = np.cumsum(of[own])
        cuts = [0, *np.searchsorted(work, np.arange(SLICE_PAIRS, work[-1], SLICE_PAIRS)).tolist(), len(own)]
        for a, b in zip(cuts, cuts[1:]):
            for x, y in forest.within(own[a:b], radius, label.copy(), t > 0) if a < b else ():
                while (apart := label[x] != label[y]).any():
                    x, y = x[apart], y[apart]
                    lx, ly = label[x], label[y]
                    np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
                    while (up := label[label] != label).any():
                        label[up] = label[label[up]]
    return label


def shard_links(radius: int):
    """For mapInPandas over (shard, fp) sorted by shard: (fp, root) of fingerprints that aren't their group's first."""

    def links(shard: np.ndarray, prints: np.ndarray) -> pd.DataFrame:
        several = np.flatnonzero(np.append(shard[1:] == shard[:-1], False))
        keep = np.unique(np.concatenate([several, several + 1])) if several.size else several
        if not keep.size:
            return pd.DataFrame({"fp": np.array([], dtype=np.int64), "root": np.array([], dtype=np.int64)})
        own, numbers = shard[keep], prints[keep]
        label = local_roots(numbers.view(np.uint64), own, radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"fp": numbers[moved], "root": numbers[label[moved]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the shard that may go on in the next batch
        for batch in batches:
            shard, prints = batch["shard"].to_numpy(), batch["fp"].to_numpy()
            if not len(shard):
                continue
            if held and shard[-1] == held[0][0][0]:
                held.append((shard, prints))
                continue
            cut = int(np.searchsorted(shard, shard[-1]))
            ready = [*held, (shard[:cut], prints[:cut])]
            held = [(shard[cut:], prints[cut:])]
            yield links(np.concatenate([x[0] for x in ready]), np.concatenate([x[1] for x in ready]))
        if held:
            yield links(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))

    return run


def spare_for(n: int, radius: int) -> int:
    """Blocks to leave untouched so that shards of n evenly spread fingerprints stay below ``TREE``; two at least."""
    spare = 2
    while radius + spare < 32 and n >> (64 * spare // (radius + spare)) > TREE:
        spare += 1
    return spare


def shard_keys(fp: Column, radius: int = RADIUS, spare: int = 2) -> Column:
    """The shard numbers of a fingerprint: the bits of ``spare`` blocks hashed with which blocks they are."""
    cuts = [64 * i // (radius + spare) for i in range(radius + spare + 1)]
    block = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    return F.array(*[F.xxhash64(F.lit(k), *[block[i] for i in chosen]) for k, chosen in enumerate(itertools.combinations(range(radius + spare), spare))])


def least_neighbours(pairs: DataFrame, edges: int) -> DataFrame:
    """(u, v, m): each pair with the least of u and all its neighbours.

    A node with more than ``edges / HUBS`` of the pairs is a hub. There are at most ``HUBS``
    of these, so they are broadcast and their pairs stay where they are; all other nodes
    are joined by shuffle, and none of them fills a task.
    """
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))  # combined before the shuffle
    bound = max(edges // HUBS, 1)
    hubs = F.broadcast(low.where(F.col("n") > bound).select("u", "m"))
    hot = pairs.join(hubs, "u").select("u", "v", "m")
    rest = pairs.join(hubs, "u", "left_anti").join(low.where(F.col("n") <= bound).select("u", "m"), "u").select("u", "v", "m")
    return hot.unionByName(rest).withColumn("m", F.least("u", "m"))


def contract(edges: DataFrame) -> DataFrame:
    """(fp, root) for each node of the graph: root is the least node of its component.

    Alternates large stars (larger neighbours move to the least neighbour) and small stars
    (smaller ones do) until nothing moves. Only counts and sums of edges reach the driver.
    """
    measure = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = edges.select(F.greatest("fp", "root").alias("u"), F.least("fp", "root").alias("v")).where("u <> v").distinct()
    edges = written(edges, "sim-edges")
    told = measure(edges)
    while told[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least_neighbours(both, 2 * told[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "sim-stars")
        small = least_neighbours(large, told[0])
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "sim-edges")
        now = measure(edges)
        if now == told:
            break
        told = now
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def linked(one: DataFrame, radius: int) -> DataFrame:
    """(fp, root) of the distinct fingerprints of ``one`` that have a link."""
    if not 0 <= radius <= 30:
        raise ValueError(f"a radius of 0 to 30 bits is what shards of untouched blocks serve, not {radius}")
    spare = spare_for(one.count(), radius)
    dealt = one.select("fp", F.explode(shard_keys(F.col("fp"), radius, spare)).alias("shard")).repartition("shard").sortWithinPartitions("shard", "fp")
    return contract(dealt.select("shard", "fp").mapInPandas(shard_links(radius), "fp long, root long"))


def groups(prints: DataFrame, id_col: str, fp: str, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component) of every fingerprint that more than one row has or that has a link.

    ``component`` is the least id of all rows that links reach, null ids left aside.
    """
    one = written(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("least"), F.count("*").alias("rows")), "sim-prints")
    joined = linked(one, radius)
    rooted = one.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # the root itself has no edge of its own; what no edge names is its own group
    least = rooted.groupBy("root").agg(F.min("least").alias("component"), F.sum("rows").alias("group_rows")).where("group_rows > 1")
    # written, so that the join below has a shuffle of its own whose large groups Spark can split
    return rooted.join(written(least, "sim-groups"), "root").select("fp", "root", "component")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, repeats: bool = True) -> DataFrame:
    """(id, fp, component_id) for each row of ``docs``.

    Texts without words have fingerprint zero and link like any other. Rows of one
    fingerprint are one group, so repeated rows are; a row whose group has no id has a null
    component. An empty table gives an empty one.
    """
    fp = free_name(docs, "_fp")
    prints = written(docs.select(F.col(id_col), fingerprint(F.col(text_col), shingle, repeats).alias(fp)), "sim-docs")
    found = groups(prints, id_col, fp, radius)
    return prints.join(found, prints[fp] == found["fp"], "left").select(F.col(id_col), prints[fp].alias("fp"), F.coalesce("component", F.col(id_col)).alias("component_id"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
