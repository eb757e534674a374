"""Phrase collocation mining by pivot partitioning.

Every n-gram belongs to its rarest word, the leftmost of equally rare ones: its pivot. A first
pass counts words. A second one rewrites each piece of text for each frequent word in it: what
is left is the word with the words around it that an n-gram of that pivot can hold, so nothing
beyond a rarer word. Equal fragments of a batch travel once, with a weight, to the partition
of their pivot, where its n-grams are mined; fragments are cut so that each n-gram occurrence
lies in exactly one, and only n-grams that hold the pivot are emitted. Pivots with many
occurrences are dealt over several partitions by their fragments, and the partial counts of
their n-grams are summed.

How rare a word is, is read from a table of ``BUCKETS`` numbers: the count of the most frequent
word that hashes there. Words share buckets when there are many, which makes one look more
frequent than it is: that moves the pivot of some n-grams and keeps some words that could have
been left out, but no count depends on it, as equal words are in one bucket everywhere. The
table is the only thing that is broadcast, and its size does not depend on the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import table, written

LONGEST, LEAST = 4, 30
#: A candidate goes if a longer one that holds it has this share (in percent) of its occurrences.
COVERED = 80
TOP = 2_000
#: Entries of the table of word counts (8 bytes each).
BUCKETS = 1 << 22
#: A pivot is dealt over one partition more for each so-manieth part of all words that it makes up.
SPLIT = 4_096
#: Phrases of a language are ranked in so many parts before their best meet.
RANK_PARTS = 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A word, or a run of what ends a piece. Bytes of characters beyond ASCII are parts of words.
TOKEN = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]+")
END = re.compile(rb"[.,;:!?\x0A-\x0D]")
#: Bytes of text that are held as words at once, and fragments that are mined at once.
SLICE, BUFFER = 4_000_000, 200_000
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?\n\v\f\r")] = True


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Words of lower-cased text in order as codes, -1 where a piece ends, and the distinct words."""
    codes, words = pd.factorize(np.array(TOKEN.findall(text), dtype=object))
    ends = np.fromiter((ENDS[w[0]] for w in words), bool, len(words))
    renumbered = np.where(ends, -1, np.cumsum(~ends) - 1).astype(np.int32)
    return renumbered[codes], words[~ends]


def slices(texts: list[bytes]) -> Iterator[bytes]:
    """Texts joined to stretches of about ``SLICE`` bytes, lower-cased; a long text is cut where a piece ends."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        start = 0
        while len(text) - start > SLICE and (end := END.search(text, start + SLICE)):
            yield text[start : end.start()].translate(LOWER)
            start = end.end()
        held.append(text[start:])
        size += len(held[-1])
        if size >= SLICE:
            yield b"\n".join(held).translate(LOWER)
            held, size = [], 0
    if held:
        yield b"\n".join(held).translate(LOWER)


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Stretches of the texts of a batch of (lang, text), each of one language."""
    lang, text = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
    groups: dict[str, list[int]] = {}
    for i, name in enumerate(lang):
        groups.setdefault(name, []).append(i)
    for name, rows in groups.items():
        for stretch in slices([text[i].as_py() for i in rows]):
            yield name, stretch


def repeated(value: str, n: int) -> pa.Array:
    return pa.array([value]).take(pa.array(np.zeros(n, np.int32)))


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, stretch in by_language(batch):
            codes, words = tokens(stretch)
            counts = np.bincount(codes[codes >= 0], minlength=len(words))
            if len(words):
                yield pa.RecordBatch.from_arrays(
                    [repeated(lang, len(words)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
                    ["lang", "word", "n"],
                )


def buckets_of(lang: str, words: np.ndarray, buckets: int) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)) & np.uint64(buckets - 1)


def frequency_table(words: DataFrame, least: int, buckets: int) -> np.ndarray:
    """For each bucket the count of its most frequent word, 0 if that is below ``least``. At most ``buckets`` rows leave the executors."""
    bucket = F.xxhash64("lang", "word").bitwiseAND(F.lit(buckets - 1)).cast("int").alias("bucket")
    rows = words.where(F.col("n") >= least).groupBy(bucket).agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def distinct_rows(columns: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of one of each kind of rows, and the number of its kind for each row; values lie below ``width``."""
    ids, bound = columns[0].astype(np.int64), width
    for column in columns[1:]:
        if bound * width >= 2**62:  # numbers of kinds are smaller than the keys they replace
            ids = np.unique(ids, return_inverse=True)[1]
            bound = len(ids) + 1
        ids, bound = ids * width + column, bound * width
    _, first, kind = np.unique(ids, return_index=True, return_inverse=True)
    return first, kind


def fragments_of(codes: np.ndarray, frequency: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fragments as rows of codes (-1: nothing), the pivot in the middle column; words on its left; weights.

    On the left a fragment holds words more frequent than its pivot, on the right words at
    least as frequent, ``longest - 1`` of each at most. An n-gram belongs to the leftmost of
    its rarest words, so each occurrence of an n-gram lies whole in one fragment alone.
    """
    reach, n = longest - 1, len(codes)
    padded = np.full(n + 2 * reach, -1, np.int64)
    padded[reach : reach + n] = np.where(codes >= 0, frequency[codes], 0)  # a bucket of infrequent words has 0
    padded[padded == 0] = -1
    own = padded[reach : reach + n]
    wide = np.full(n + 2 * reach, -1, np.int32)
    wide[reach : reach + n] = codes
    holds = {0: own > 0}
    for k in range(1, reach + 1):
        left, right = padded[reach - k : reach - k + n], padded[reach + k : reach + k + n]
        holds[-k] = holds[1 - k] & (left > own)
        holds[k] = holds[k - 1] & (right >= own)
    at = np.flatnonzero(holds[-1] | holds[1])
    columns = [np.where(holds[k][at], wide[at + reach + k], -1) for k in range(-reach, reach + 1)]
    if not len(at):
        return np.zeros((0, len(columns)), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, kind = distinct_rows([c + 1 for c in columns], int(codes.max()) + 2)
    rows = np.stack([c[first] for c in columns], 1)
    return rows, (rows[:, :reach] >= 0).sum(1), np.bincount(kind)


def fragment_batches(batches: Iterator[pa.RecordBatch], table_of_counts: np.ndarray, total: int, longest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, stretch in by_language(batch):
            codes, words = tokens(stretch)
            if not len(words):
                continue
            frequency = table_of_counts[buckets_of(lang, words, len(table_of_counts)).astype(np.int64)]
            rows, left, weight = fragments_of(codes, frequency, longest)
            if not len(rows):
                continue
            there = rows >= 0
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum(there.sum(1), out=offsets[1:])
            names = pa.array(words, pa.binary()).cast(pa.string())
            pivots = rows[:, longest - 1]
            yield pa.RecordBatch.from_arrays(
                [
                    repeated(lang, len(rows)),
                    names.take(pa.array(pivots)),
                    pa.array(1 + frequency[pivots] * SPLIT // total, pa.int64()),
                    pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(rows[there]))), " "),
                    pa.array(left, pa.int32()),
                    pa.array(weight, pa.int64()),
                ],
                ["lang", "pivot", "parts", "fragment", "left", "weight"],
            )


def counted(fragments: pa.Table, whole: np.ndarray, least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, k, a): n-grams that hold the pivot of their fragment; of pivots that are ``whole``, only frequent ones."""
    lists = pc.split_pattern(fragments.column("fragment"), " ").combine_chunks()
    lang = fragments.column("lang").combine_chunks().dictionary_encode()
    words = lists.values.dictionary_encode()
    codes, at = words.indices.to_numpy(), lists.offsets.to_numpy()
    size, left, weight = np.diff(at), fragments.column("left").to_numpy(), fragments.column("weight").to_numpy()
    place = lang.indices.to_numpy()
    width = max(len(words.dictionary), len(lang.dictionary))
    for k in range(2, longest + 1):
        rows, starts = [], []
        for before in range(k):  # words of the n-gram in front of the pivot
            good = np.flatnonzero((left >= before) & (left - before + k <= size))
            rows.append(good)
            starts.append(at[good] + left[good] - before)
        row, start = np.concatenate(rows), np.concatenate(starts)
        if not len(row):
            continue
        first, kind = distinct_rows([place[row], *[codes[start + i] for i in range(k)]], width)
        a = np.bincount(kind, weights=weight[row]).astype(np.int64)  # exact: far below 2**53 in one buffer
        kept = np.flatnonzero((a >= least) | ~whole[row[first]])
        told = codes[start[first[kept]][:, None] + np.arange(k)].ravel()
        offsets = pa.array(np.arange(0, len(told) + 1, k, dtype=np.int32))
        phrases = pc.binary_join(pa.ListArray.from_arrays(offsets, words.dictionary.take(pa.array(told))), " ")
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(place[row[first[kept]]])), phrases, pa.array(np.full(len(kept), k, np.int32)), pa.array(a[kept])], ["lang", "phrase", "k", "a"]
        )


def mine_batches(batches: Iterator[pa.RecordBatch], least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Mine fragments sorted by pivot, whole pivots at a time; a pivot that fills a buffer alone is cut into partial counts."""
    held: list[pa.RecordBatch] = []
    cut = None  # the pivot whose first fragments have been counted

    def keys(rows: pa.Table) -> tuple[np.ndarray, list]:
        """Number of each row's pivot, counted from 0, and the first and last pivot."""
        pivot, lang = (rows.column(c).combine_chunks().dictionary_encode() for c in ("pivot", "lang"))
        both = pivot.indices.to_numpy().astype(np.int64) * len(lang.dictionary) + lang.indices.to_numpy()
        name = lambda i: (rows.column("pivot")[i].as_py(), rows.column("lang")[i].as_py())
        return np.concatenate([[0], np.cumsum(both[1:] != both[:-1])]), [name(0), name(-1)]

    def mined(rows: pa.Table, group: np.ndarray, first: tuple, open_end: bool) -> Iterator[pa.RecordBatch]:
        whole = rows.column("parts").to_numpy() == 1
        if first == cut:
            whole &= group > 0
        if open_end:
            whole &= group < group[-1]
        yield from counted(rows, whole, least, longest)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < BUFFER:
            continue
        rows = pa.Table.from_batches(held)
        group, (first, last) = keys(rows)
        if group[-1] == 0:
            yield from mined(rows, group, first, True)
            cut, held = last, []
        else:
            end = int(np.searchsorted(group, group[-1]))
            yield from mined(rows.slice(0, end), group[:end], first, False)
            held = rows.slice(end).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        group, (first, _) = keys(rows)
        yield from mined(rows, group, first, False)


def mined(fragments: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, phrase, k, a): the n-grams of 2 to ``longest`` words that occur ``least`` times or more.

    Fragments go to the partition of their pivot (of a large one: to that of their share of
    it), where the n-grams that hold the pivot are counted. Rare n-grams of a pivot that is
    there as a whole end there.
    """
    share = F.pmod(F.xxhash64("fragment", "left"), "parts")
    routed = fragments.repartition("lang", "pivot", share).sortWithinPartitions("pivot", "lang")
    local = routed.mapInArrow(lambda batches: mine_batches(batches, least, longest), "lang string, phrase string, k int, a long")
    return local.groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(phrases: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """``phrases`` with l, r and score of their lowest-scoring cut."""
    counts = words.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(
        phrases.where(F.col("k") < longest).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    )
    parts = F.split("phrase", " ")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("i"))
    cuts = cuts.withColumn("first", F.array_join(F.slice(parts, F.lit(1), F.col("i")), " ")).withColumn("rest", F.array_join(F.slice(parts, F.col("i") + 1, F.col("k") - F.col("i")), " "))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"]).drop("first")
    cuts = cuts.join(counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).drop("rest")
    score = F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 div (CAST(l AS DECIMAL(20, 0)) + r)")
    best = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "i", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "k", "a", "cut.l", "cut.r", "cut.score")


def covered(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, f): for phrases inside longer ones, the largest count of these."""
    parts = F.split("phrase", " ")
    inner = lambda start: F.transform(F.sequence(F.lit(2), F.least(F.col("k") - 1, F.col("k") - start)), lambda size: F.array_join(F.slice(parts, start + 1, size), " "))
    held = phrases.where("k > 2").select("lang", F.col("a").alias("f"), F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("k") - 2), inner))).alias("phrase"))
    return held.groupBy("lang", "phrase").agg(F.max("f").alias("f"))


def ranked(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language by score, occurrences and phrase; a language is ranked in parts first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    in_part = Window.partitionBy("lang", "part").orderBy(*order)
    parts = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    best = parts.withColumn("rank", F.row_number().over(in_part)).where(F.col("rank") <= top).drop("part", "rank")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, buckets: int = BUCKETS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    A null text is empty, a null language ``und``, like a language of that name. Repeated rows
    count as often as they occur; ids and other columns are not read, whatever their names.
    Texts may be of any length; an empty table, or one without frequent phrases, gives an
    empty one. Ties are broken by the phrase, in the order of its UTF-8 bytes.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    words = written(narrow.mapInArrow(count_batches, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = max(words.agg(F.sum("n")).first()[0] or 0, 1)
    shared = spark.sparkContext.broadcast(frequency_table(words, least, buckets))
    schema = "lang string, pivot string, parts long, fragment string, left int, weight long"
    fragments = narrow.mapInArrow(lambda batches: fragment_batches(batches, shared.value, total, longest), schema)
    phrases = written(mined(fragments, least, longest), "phrases")
    inside = 100 * F.col("f").cast("decimal(20,0)") >= COVERED * F.col("a").cast("decimal(20,0)")
    kept = phrases.join(covered(phrases), ["lang", "phrase"], "left").where(~F.coalesce(inside, F.lit(False))).select("lang", "phrase", "k", "a")
    # parts of a phrase are looked up among all phrases, dropped or not
    found = scored(phrases, words.where(F.col("n") >= least), longest).join(kept.select("lang", "phrase"), ["lang", "phrase"], "left_semi")
    return ranked(found, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, unnest([1, 2, 3, 4]) AS t(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 30),
cut AS (
  SELECT c.lang, c.phrase, c.a, i, l.a AS l, r.a AS r, 2000000 * c.a // (l.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:i], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[i + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, i) = 1),
sub AS (SELECT DISTINCT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, a AS f FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM c, unnest([2, 3]) AS t(s) WHERE s < k)),
kept AS (SELECT * FROM cut WHERE NOT EXISTS (SELECT 1 FROM sub WHERE sub.lang = cut.lang AND sub.phrase = cut.phrase AND 100 * sub.f >= 80 * cut.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
