"""Phrase mining against counting every n-gram."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import phrases
from tests.llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, top):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            found = counts.setdefault(lang or "und", Counter())
            found.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        hidden = {g[i:j] for g, a in candidates.items() for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g) and 100 * a >= 80 * f[g[i:j]]}
        best = []
        for g, a in candidates.items():
            if g not in hidden:
                score, _, l, r = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), l, r))
        for i, (score, a, phrase, l, r) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("buckets", [1 << 22, 16, 1])
def test_against_counting(spark, buckets):
    """The result is the same however many words share a bucket of the table of counts."""
    rng = np.random.default_rng(3)
    words = ["a", "b", "the", "The", "x y", "é", "zz", "q", "of, the", "end.", "tab\tbed", "new\nline", "b b b"]
    rows = [(("en", "de", None, "und")[i % 4], " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = told(phrases.collocations(docs, least=3, top=25, buckets=buckets))
    assert got == brute(rows, 3, 4, 25)
    assert len(got) > 50


def test_split_pivots(spark, monkeypatch):
    """Pivots that are dealt over many partitions give the same counts."""
    monkeypatch.setattr(phrases, "SPLIT", 10_000_000)
    rows = [("en", f"x y w{i % 7} x y z, x y y x y") for i in range(200)]
    assert told(phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5)) == brute(rows, 5, 4, 2000)


def test_small_slices_and_buffers():
    """Texts cut where pieces end, and pivots that fill several buffers, give the same n-grams."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["a", "b", "c", "d.", "e"], rng.integers(0, 60))).encode() for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en" if i % 3 else "de" for i in range(40)]), pa.array([t.decode() for t in texts])], ["lang", "text"])
    frequency = np.full(16, 50)

    def grams(slice_, buffer, least):
        phrases.SLICE, before = slice_, phrases.SLICE
        phrases.BUFFER, kept = buffer, phrases.BUFFER
        try:
            table = pa.Table.from_batches(phrases.fragment_batches([batch], frequency, 10**6, 4)).sort_by([("pivot", "ascending"), ("lang", "ascending")])
            out = Counter()
            for b in phrases.mine_batches(iter(table.to_batches(max_chunksize=3)), least, 4):
                for row in b.to_pylist():
                    out[row["lang"], row["phrase"]] += row["a"]
            return out
        finally:
            phrases.SLICE, phrases.BUFFER = before, kept

    every = grams(10**6, 10**6, 1)
    for slice_, buffer in ((7, 1), (30, 4), (200, 9), (10**6, 50)):
        assert grams(slice_, buffer, 1) == every
        got = grams(slice_, buffer, 10)
        assert {g: a for g, a in got.items() if a >= 10} == {g: a for g, a in every.items() if a >= 10}


def test_arithmetic_is_exact(spark):
    """Counts whose products pass 64 bits."""
    big = 4_000_000_000_000_000_000
    found = spark.createDataFrame([("en", "a b", 2, big)], "lang string, phrase string, k int, a long")
    words = spark.createDataFrame([("en", "a", big), ("en", "b", big + 1)], "lang string, word string, n long")
    row = phrases.scored(found, words, 4).first()
    assert (row.l, row.r, row.score) == (big, big + 1, 2_000_000 * big // (2 * big + 1))
    held = spark.createDataFrame([("en", "a b c", 3, big)], "lang string, phrase string, k int, a long")
    assert told(phrases.covered(held)) == [("en", "a b", big), ("en", "b c", big)]


def test_each_ngram_lies_in_one_fragment():
    """Every occurrence of an n-gram of frequent words holds the pivot of exactly one fragment."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        codes = rng.integers(-1, 6, rng.integers(1, 40))
        frequency = rng.choice([0, 30, 31, 32], 6)
        rows, left, weight = phrases.fragments_of(codes, frequency, 4)
        got = Counter()
        for row, before, times in zip(rows, left, weight):
            words = [int(x) for x in row if x >= 0]
            for i in range(before + 1):
                for j in range(max(before, i + 1), min(i + 4, len(words))):
                    got[tuple(words[i : j + 1])] += int(times)
        good = [int(c) if c >= 0 and frequency[c] else None for c in codes]
        want = Counter(tuple(g) for k in (2, 3, 4) for i in range(len(good) - k + 1) if None not in (g := good[i : i + k]))
        assert got == want


def test_odd_rows(spark):
    rows = [(r[2], r[1]) for r in cases.ODD]
    want = brute(rows, 1, 4, 2000)
    assert told(phrases.collocations(cases.odd(spark), least=1)) == want
    assert told(phrases.collocations(cases.clashing(spark, "word", "n", "phrase", "a.b", "part", "fragment"), least=1)) == want
    extra = cases.odd(spark).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert told(phrases.collocations(extra, least=1)) == want
    assert told(phrases.collocations(cases.none(spark), least=1)) == []
    assert told(phrases.collocations(cases.odd(spark), least=10**6)) == []
