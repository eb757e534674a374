import random

import numpy as np

from quernstone.llm import neardup, simhash
from tests.llm.cases import ODD, clashing, none


def five(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a, b):
    return len(five(a) & five(b)) / len(five(a) | five(b))


def bits(a, b):
    x, y = simhash.fingerprints([a, b], 1, repeats=False).tolist()
    return (x ^ y).bit_count()


def left(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["doc_id"] for r in neardup.dedup(df, 6).orderBy("doc_id").collect()]


def edits(draw, say):
    """Texts with a copy that has one run of words inserted or dropped, alike in 0.8 or more."""
    while True:
        words = say(draw.randrange(30, 400))
        n, at = draw.randrange(1, max(2, len(words) // 6)), draw.randrange(len(words))
        other = words[:at] + say(n) + words[at:] if draw.random() < 0.5 else words[:at] + words[at + n :]
        a, b = " ".join(words), " ".join(other)
        if a != b and alike(a, b) >= 0.8:
            yield a, b


def test_inserted_and_dropped_runs_are_caught(spark):
    draw = random.Random(3)
    pairs = [next(edits(draw, lambda n: [f"w{draw.randrange(3000)}" for _ in range(n)])) for _ in range(150)]
    assert sum(bits(a, b) > 6 for a, b in pairs) > 30  # beyond the SimHash search
    assert left(spark, [t for p in pairs for t in p]) == [*range(0, 300, 2)]


def test_near_prints_of_other_texts_stay(spark):
    """Texts of the same words in another order have one fingerprint and no common shingle."""
    words = [f"w{i}" for i in range(60)]
    other = words[::-1]
    assert bits(" ".join(words), " ".join(other)) == 0
    assert left(spark, [" ".join(words), " ".join(other), " ".join([*words, "w0"]), " ".join(words).upper()]) == [0, 1]


def test_one_threshold_for_all_pairs(spark):
    """A copy with a few words replaced is near in words only; it stays, unless less is asked of texts with near fingerprints."""
    words = [f"w{i}" for i in range(200)]
    other = [f"x{i}" if i in (30, 60, 90, 120, 150, 180) else w for i, w in enumerate(words)]
    some = [f"y{i}" if i == 70 else w for i, w in enumerate(words)]
    texts = [" ".join(w) for w in (words, other, some)]
    assert 0.5 <= alike(*texts[:2]) < 0.8 <= alike(texts[0], texts[2]) and bits(*texts[:2]) <= 6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert left(spark, texts) == [0, 1]
    assert [r["doc_id"] for r in neardup.dedup(df, 6, shared=0.5).collect()] == [0]


def test_large_buckets_against_all_pairs(spark, monkeypatch):
    """Two families around one passage share buckets: neither is lost behind the other's first text."""
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    draw = random.Random(5)
    common = [f"c{i}" for i in range(60)]
    texts = []
    for f in range(6):
        own = [f"f{f}x{i}" for i in range(30)]
        for _ in range(8):
            tail = list(own)
            tail[draw.randrange(30)] = f"y{draw.randrange(10**6)}"
            texts.append(" ".join(common + tail))
    draw.shuffle(texts)
    for shared in (0.8, 0.5):
        label = np.arange(len(texts))
        ok = [[alike(a, b) >= (shared if bits(a, b) <= 6 else 0.8) for b in texts] for a in texts]
        while (new := np.array([label[np.flatnonzero(r)].min() for r in ok])).tolist() != label.tolist():
            label = new
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert sorted(r["doc_id"] for r in neardup.dedup(df, 6, shared=shared).collect()) == sorted(set(label.tolist()))


def test_odd_rows(spark):
    rows = neardup.dedup(clashing(spark, "_key", "_fp", "_tag", "_own", "_bands", "root", "bucket"), 6).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 1), (False, 2), (False, 7), (False, 8), (False, 9), (True, 0)]
    assert {r["_tag"] for r in rows} == {"kept _tag"} and len(ODD) == 10
    assert neardup.dedup(none(spark), 6).collect() == []
