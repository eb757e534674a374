"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that occurs in a text with at most k edits shares at least
m - q + 1 - k*q of its q-grams with the text, all on diagonals (place in the text minus
place in the passage) that differ by k at most. So shared q-grams are counted in
overlapping bands of diagonals; bands that reach the bound are verified by an alignment
that never leaves its band.

Letters are compared in lower case and white space as blanks. The benchmark goes to the
tasks in blocks of bounded size, one after the other, so what is broadcast does not grow
with it. If it takes more than one block, a bitmap of all its q-grams picks, in one pass,
the documents that can hold anything at all; the blocks then read only these. Items are cut
into long segments, which allow for edits anywhere, and into short overlapping ones, of
which any quotation of ``SHORT + STEP - 1`` characters holds one whole. Items under
``WHOLE`` characters, which edits can't tell from chance, are sought verbatim as whole words.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quernstone.llm.common import free_name, table, written

Q = 10
#: Edits allowed, as a share of a segment's characters.
EDIT_SHARE = 0.08
#: Items of fewer characters are matched verbatim only, and as whole words.
WHOLE = 40
#: Characters of a segment; a longer item is cut into overlapping ones.
SEGMENT = 240
#: Characters of a short segment, and the step from one to the next.
SHORT, STEP = 60, 20
#: Step from band to band; a band is this and the edit budget wide.
BAND = 16
#: Characters of benchmark text that one pass broadcasts.
BLOCK_CHARS = 2_000_000
#: Characters of documents, and shared q-grams, handled at once.
SLICE_CHARS, SLICE_PAIRS = 1_000_000, 1_000_000
#: Alignments that go side by side.
ALIGNED = 512
#: Most bits, as a power of two, of the bitmap that is broadcast for a benchmark of several blocks: 64 MB.
MOST_BITS = 29
_BITS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def folded(text: str) -> str:
    """Lower case with blanks for white space, one character for each of the text's."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def codes(text: str) -> np.ndarray:
    out = np.frombuffer(folded(text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where((out >= 9) & (out <= 13), np.uint32(32), out)


def gram_hashes(c: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q-gram at each place, by doubling: of 1, 2, 4 ... characters, then what is missing."""
    powers, h = {1: c.astype(np.uint64) + np.uint64(1)}, None
    factor, width = {1: _BASE}, 1
    with np.errstate(over="ignore"):
        while width * 2 <= q:
            a = powers[width]
            powers[width * 2] = a[:-width] * factor[width] + a[width:] if len(a) > width else a[:0]
            factor[width * 2] = factor[width] * factor[width]
            width *= 2
        done = 0
        for w in sorted(powers, reverse=True):
            if q & w:
                part = powers[w][done:]
                h = part if h is None else h[: len(part)] * factor[w] + part[: len(h)]
                done += w
        h = h[: max(0, len(c) - q + 1)]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def segments_of(item_id, text: str | None) -> list[tuple]:
    """(item, place in the item, codes) of each segment: the long ones, then the short ones.

    Long ones are whole items up to ``SEGMENT`` characters; so are short ones up to
    ``SHORT``. An item under ``WHOLE`` characters is one segment, without blanks around it.
    """
    whole = codes(text or "")
    if len(whole) < WHOLE:
        own = np.flatnonzero(whole != 32)
        return [(item_id, int(own[0]), whole[own[0] : own[-1] + 1])] if own.size else []
    spans = [(s, size) for size, step in ((SEGMENT, SEGMENT // 2), (SHORT, STEP)) for s in _starts(len(whole), size, step)]
    return [(item_id, s, whole[s : s + size]) for s, size in dict.fromkeys((s, min(size, len(whole))) for s, size in spans)]


def text_of(c: np.ndarray) -> str:
    return c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _starts(length: int, size: int, step: int) -> list[int]:
    return [*range(0, length - size, step), max(0, length - size)]


def _whole_words(plain: list[str]):
    """An automaton of the segments under ``WHOLE`` characters, each with the numbers of its segments; None without any."""
    import ahocorasick

    numbers: dict[str, list[int]] = {}
    for i, t in enumerate(plain):
        if len(t) < WHOLE:
            numbers.setdefault(t, []).append(i)
    found = ahocorasick.Automaton()
    for t, own in numbers.items():
        found.add_word(t, (len(t), own))
    if numbers:
        found.make_automaton()
    return found if numbers else None


class Index:
    """The q-grams of one block of segments: a bitmap to reject by, and sorted postings."""

    def __init__(self, segments: list[tuple], edit_share: float):
        self.segments = segments
        #: Bytes of each segment, to look for plain copies first.
        self.plain = [text_of(s[2]) for s in segments]
        self.words = _whole_words(self.plain)
        self.lengths = np.array([len(s[2]) for s in segments], dtype=np.int64)
        self.budget = np.minimum((self.lengths * edit_share).astype(np.int64), (self.lengths - Q) // Q)
        #: At least a budget wide, so that a band and its overlap hold every diagonal of a match.
        self.band = max(BAND, int(self.budget.max()) + 1)
        self.need = self.lengths - Q + 1 - self.budget * Q
        grams = [gram_hashes(s[2]) if len(s[2]) >= WHOLE else np.array([], dtype=np.uint64) for s in segments]
        h = np.concatenate(grams)
        owner = np.repeat(np.arange(len(segments)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(h, kind="stable")
        self.owner, self.place = owner[order].astype(np.int64), place[order].astype(np.int64)
        self.keys, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h)).astype(np.int64)
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[self.keys >> np.uint64(64 - _BITS)] = True

    def shared(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text whose q-gram the block has, and the place of that q-gram among the keys."""
        at = np.flatnonzero(self.bitmap[h >> np.uint64(64 - _BITS)])
        if not at.size:
            return at, at
        key = np.searchsorted(self.keys, h[at])
        key[key == len(self.keys)] = 0
        real = self.keys[key] == h[at]
        return at[real], key[real]

    def bands(self, at: np.ndarray, key: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, segment, band) with enough shared q-grams. ``start``: where each document begins."""
        n = self.first[key + 1] - self.first[key]
        counts: dict[tuple[int, int, int], int] = {}
        upto = np.cumsum(n)
        cuts = [0, *np.searchsorted(upto, np.arange(SLICE_PAIRS, upto[-1], SLICE_PAIRS)).tolist(), len(at)] if len(at) else [0]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            m = n[a:b]
            post = np.repeat(self.first[key[a:b]] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
            seg, where = self.owner[post], np.repeat(at[a:b], m)
            doc = np.searchsorted(start, where, side="right") - 1
            diagonal = where - start[doc] - self.place[post] + SEGMENT
            band = diagonal // self.band
            low = (diagonal % self.band <= self.budget[seg]) & (band > 0)  # also in the band before, which reaches so far over
            rows = np.stack([np.append(doc, doc[low]), np.append(seg, seg[low]), np.append(band, band[low] - 1)])
            order = np.lexsort(rows[::-1])
            rows = rows[:, order]
            new = np.flatnonzero(np.append(True, (np.diff(rows) != 0).any(axis=0))) if rows.shape[1] else np.array([], dtype=int)
            runs = np.diff(np.append(new, rows.shape[1]))
            if len(cuts) == 2:
                enough = runs >= self.need[rows[1, new]]
                new, runs = new[enough], runs[enough]
            for i, c in zip(new, runs):
                if len(cuts) > 2:  # a band may go on in the next slice
                    k = (int(rows[0, i]), int(rows[1, i]), int(rows[2, i]))
                    counts[k] = counts.get(k, 0) + int(c)
                else:
                    counts[int(rows[0, i]), int(rows[1, i]), int(rows[2, i])] = int(c)
        return [k for k, c in counts.items() if c >= self.need[k[1]]]


def align(found: list[tuple[np.ndarray, np.ndarray, int, int, int]]) -> list[tuple[int, int, int] | None]:
    """Fewest edits of each pattern to a stretch of its text, on diagonals ``first`` to ``last`` only.

    Takes (pattern, text, first, last, most), gives (start, end, edits) if edits <= most. The start
    may be on any diagonal of the band, and so may the end. ``ALIGNED`` of similar length go
    side by side, with one vector step for each character of the longest pattern.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(found)
    order = sorted(range(len(found)), key=lambda i: len(found[i][0]))
    for at in range(0, len(order), ALIGNED):
        some = order[at : at + ALIGNED]
        for i, near in zip(some, _aligned([found[i] for i in some])):
            out[i] = near
    return out


def _aligned(found: list[tuple[np.ndarray, np.ndarray, int, int, int]]) -> list[tuple[int, int, int] | None]:
    """The same for a few at once: columns of tables with a row for each diagonal."""
    out: list[tuple[int, int, int] | None] = [None] * len(found)
    row = np.arange(len(found))
    sizes, widths = np.array([len(f[0]) for f in found]), np.array([f[3] - f[2] + 1 for f in found])
    most = np.array([f[4] for f in found], dtype=np.int32)
    far, wide = most + 1, int(widths.max())
    steps = np.arange(wide, dtype=np.int32)[:, None]
    # the text from its first diagonal on, and what a place beyond its ends costs
    letters, beyond = np.zeros((len(found), int(sizes.max()) + wide), dtype=np.uint32), np.ones((len(found), int(sizes.max()) + wide), dtype=np.int32)
    patterns = np.zeros((len(found), int(sizes.max())), dtype=np.uint32)
    for i, (pattern, text, first, _, _) in enumerate(found):
        patterns[i, : len(pattern)] = pattern
        a, b = max(0, first), min(len(text), first + letters.shape[1])
        if a < b:
            letters[i, a - first : b - first], beyond[i, a - first : b - first] = text[a:b], 0
    letters, patterns, beyond = letters.T.copy(), patterns.T.copy(), beyond.T * far
    firsts, ends = np.array([f[2] for f in found]), np.array([len(f[1]) for f in found])
    diag = firsts + steps
    cost = np.where((diag >= 0) & (diag <= ends), 0, far).astype(np.int32)
    outside = steps >= widths  # narrower bands end before
    narrow = bool(outside.any())
    origin = np.broadcast_to(steps, cost.shape)
    shift = np.int32(wide.bit_length())
    low = (np.int32(1) << shift) - np.int32(1)
    for i in range(len(patterns)):
        if narrow:
            cost[outside] = np.broadcast_to(far, cost.shape)[outside]
        put = cost + (letters[i : i + wide] != patterns[i]) + beyond[i : i + wide]
        gone = np.concatenate([cost[1:], far[None]]) + 1  # the pattern's character is missing in the text
        start = np.where(put <= gone, origin, np.concatenate([origin[1:], origin[:1]]))
        # characters of the text that the pattern lacks: along the diagonals, one edit each, from the nearest of equals
        slack = np.minimum(put, gone) - steps + wide
        run = np.minimum.accumulate(((slack << shift | wide - steps) << shift) | start, axis=0)
        cost, origin = (run >> shift + shift) + steps - wide, run & low
        over = sizes == i + 1
        if over.any() or i % 16 == 15:
            least = np.where(outside, np.iinfo(np.int32).max, cost)
            end = least.argmin(axis=0)
            edits = least[end, np.arange(len(row))]
            for k in np.flatnonzero(over & (edits <= most)).tolist():
                out[row[k]] = int(firsts[k] + origin[end[k], k]), int(firsts[k] + end[k] + sizes[k]), int(edits[k])
            left = ~over & (edits <= most)
            if not left.any():
                break
            if not left.all():
                row, sizes, most, far, firsts = row[left], sizes[left], most[left], far[left], firsts[left]
                letters, beyond, patterns, cost, origin, outside = (x[:, left] for x in (letters, beyond, patterns, cost, origin, outside))
    return out


def search(texts: list[str | None], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, segment, start, end, edits) of each match; matches of one segment in one text don't overlap."""
    out: list[tuple[int, int, int, int, int]] = []
    for batch in _slices(texts):
        out += _search_slice(texts, batch, index)
    return out


def _slices(texts: list[str | None]) -> Iterator[list[int]]:
    """The places of the texts that aren't empty, so many that their characters fill a slice."""
    batch: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if t:
            batch.append(i)
            size += len(t)
            if size >= SLICE_CHARS:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def _codes_of(texts: list, batch: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts of a slice as codes, with a mark between them; where each begins; how long it is."""
    low = [folded(texts[i]) for i in batch]
    c = np.frombuffer("\x00".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where((c >= 9) & (c <= 13), np.uint32(32), c)
    sizes = np.array([len(t) for t in low], dtype=np.int64)
    return c, np.concatenate(([0], np.cumsum(sizes[:-1] + 1))), sizes


def _search_slice(texts: list, batch: list[int], index: Index) -> list[tuple[int, int, int, int, int]]:
    c, start, sizes = _codes_of(texts, batch)
    found: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
    edited: list[tuple[set, tuple]] = []
    for doc, seg, band in index.bands(*index.shared(gram_hashes(c)), start):
        text = c[start[doc] : start[doc] + sizes[doc]]
        pattern, plain = index.segments[seg][2], index.plain[seg]
        first = band * index.band - SEGMENT
        last = first + index.band + int(index.budget[seg])
        a, b = max(0, first), min(len(text), last + len(pattern))
        window = text_of(text[a:b])
        at = window.find(plain)
        got = found.setdefault((doc, seg), set())
        if at < 0:
            edited.append((got, (pattern, text, first, last, int(index.budget[seg]))))
        while at >= 0:
            got.add((0, a + at, a + at + len(plain)))
            at = window.find(plain, at + len(plain))
    for (got, _), near in zip(edited, align([e[1] for e in edited])):
        if near:
            got.add((near[2], near[0], near[1]))
    if index.words is not None:
        for doc in range(len(batch)):
            text = text_of(c[start[doc] : start[doc] + sizes[doc]])
            for last, (size, segs) in index.words.iter(text):
                first = last + 1 - size
                if not (_joined(text, first) or _joined(text, last + 1)):
                    for seg in segs:
                        found.setdefault((doc, seg), set()).add((0, first, last + 1))
    out = []
    for (doc, seg), spans in found.items():
        kept: list[tuple[int, int]] = []
        for edits, a, b in sorted(spans):  # the nearest first
            if all(b <= x or y <= a for x, y in kept):
                kept.append((a, b))
                out.append((batch[doc], seg, a, b, edits))
    return out


def _joined(text: str, at: int) -> bool:
    """Whether a word goes on from the place before ``at`` to it."""
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


def segments(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple]:
    """The benchmark's segments, row by row, never all at once."""
    rows = benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator(prefetchPartitions=False)
    for item, text in rows:
        yield from segments_of(item, text)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple]]:
    """The benchmark's segments in blocks of bounded size."""
    block, size = [], 0
    for seg in segments(benchmark, item_col, text_col):
        block.append(seg)
        size += len(seg[2])
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def may_hold(benchmark: DataFrame, item_col: str, text_col: str, edit_share: float):
    """A user function that is false only for texts without any match, from a bitmap of all q-grams of the benchmark.

    Segments without q-grams of their own leave every text in question.
    """
    n = sum(len(s[2]) for s in segments(benchmark, item_col, text_col))
    bits = min(MOST_BITS, max(_BITS, int(n).bit_length() + 4))
    marked, least = np.zeros(1 << (bits - 3), dtype=np.uint8), None
    for _, _, c in segments(benchmark, item_col, text_col):
        own = len(c) - Q + 1 - min(int(len(c) * edit_share), (len(c) - Q) // Q) * Q if len(c) >= WHOLE else 0
        least = own if least is None else min(least, own)
        at = gram_hashes(c) >> np.uint64(64 - bits) if own else np.array([], dtype=np.uint64)
        np.bitwise_or.at(marked, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
    shipped = benchmark.sparkSession.sparkContext.broadcast((marked, bits, least or 0))

    @F.pandas_udf("boolean")
    def may(texts: pd.Series) -> pd.Series:
        marked, bits, least = shipped.value
        told = [t if isinstance(t, str) else None for t in texts]
        out = np.zeros(len(told), dtype=bool)
        for batch in _slices(told):
            c, start, _ = _codes_of(told, batch)
            at = gram_hashes(c) >> np.uint64(64 - bits)
            hit = marked[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            sums = np.concatenate(([0], np.cumsum(hit)))
            ends = np.minimum(np.append(start[1:], len(c)), len(hit))
            out[batch] = sums[ends] - sums[np.minimum(start, len(hit))] >= least
        return pd.Series(out)

    return may


def _matched(docs: DataFrame, id_col: str, text_col: str, block: list[tuple], item_type, names: list[str], schema: str, edit_share: float) -> DataFrame:
    """The matches of one block; ids stay in Arrow, which keeps them as they are."""
    shipped = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shipped.value, edit_share)
        for batch in batches:
            hits = search(batch.column(1).to_pylist(), index)
            if hits:
                found = [batch.column(0).take(pa.array([h[0] for h in hits])), pa.array([index.segments[h[1]][0] for h in hits], type=item_type)]
                found += [pa.array([h[i] for h in hits], type=pa.int64()) for i in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays(found, names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item_id, start, end, edits) for each place where a benchmark segment is found in a document.

    Ends are exclusive code points of the whole text, however long. Documents without a
    match have no row; null and empty texts match nothing, and neither do null and blank
    items. Repeated documents and items each give their own rows, ids of any type and size
    stay as they are, and other columns are left aside, whatever they are called. An empty
    benchmark or table gives an empty result.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    names = ["id", "item", "start", "end", "edits"]
    schema = f"id {id_type.simpleString()}, item {item_type.simpleString()}, start long, end long, edits long"
    out, texts = spark.createDataFrame([], schema), docs.select(F.col(id_col), F.col(text_col))
    todo = blocks(benchmark, item_col, item_text, block_chars)
    ready = [b for b in (next(todo, None), next(todo, None)) if b]
    if len(ready) > 1:
        texts = written(texts.where(may_hold(benchmark, item_col, item_text, edit_share)(F.col(text_col))), "bench-candidates")
    for block in itertools.chain(ready, todo):
        out = out.unionByName(_matched(texts, id_col, text_col, block, to_arrow_type(item_type), names, schema, edit_share))
    return out.toDF(id_col, item_col, "start", "end", "edits")


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", item_col: str = "item_id", edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS, flag: str = "contaminated") -> DataFrame:
    """``docs`` with a boolean ``flag`` that tells which texts hold a benchmark segment.

    The verdict is a function of the text alone, so repeated rows and repeated or null ids
    need no care. One block flags rows where they stand; of several, each looks at the
    documents in question only, which are told apart by a row tag.
    """
    todo = blocks(benchmark, item_col, item_text, block_chars)
    first, second = next(todo, None), next(todo, None)
    if first is None:
        return docs.withColumn(flag, F.lit(False))
    if second is None:
        return docs.withColumn(flag, _holds(docs.sparkSession.sparkContext.broadcast(first), edit_share)(F.col(text_col)))
    tag, may = free_name(docs, "_bench_tag"), free_name(docs, "_bench_may")
    tagged = docs.drop(flag).withColumn(may, may_hold(benchmark, item_col, item_text, edit_share)(F.col(text_col))).withColumn(tag, F.monotonically_increasing_id())
    tagged = written(tagged, "bench-tagged")
    found = matches(tagged.where(may), benchmark, tag, text_col, item_col, item_text, edit_share, block_chars).select(tag).distinct()
    found = written(found, "bench-found").withColumn(flag, F.lit(True))
    return tagged.join(found, tag, "left").withColumn(flag, F.coalesce(flag, F.lit(False))).select(*[F.col(f"`{c}`") for c in docs.columns if c != flag], flag)


def _holds(shipped, edit_share: float):
    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(shipped.value, edit_share)
        for texts in batches:
            hit = np.zeros(len(texts), dtype=bool)
            hit[[h[0] for h in search([t if isinstance(t, str) else None for t in texts], index)]] = True
            yield pd.Series(hit)

    return holds


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark passage."""
    flag = free_name(docs, "_contaminated")
    return contaminated(docs, benchmark, text_col, flag=flag).where(~F.col(flag)).drop(flag)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage found in any document: a row for each document and segment."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("start", "doc_start").withColumnRenamed("end", "doc_end")
