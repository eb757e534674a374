import math
import random

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import langid
from tests.llm.cases import ODD, clashing, none, odd


def test_automaton_holds_exactly_the_substrings():
    draw = random.Random(4)
    codes = [draw.randrange(1, 4) for _ in range(60)]
    step = langid.automaton(codes, 4)
    inside = {tuple(codes[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for n in range(1, 7):
        for x in np.ndindex(*[3] * n):
            word, state = tuple(v + 1 for v in x), 1
            for c in word:
                state = step[state, c]
            assert (state > 0) == (word in inside)


def greedy(text, model, haystacks):
    """Phrases of one text in each language, by searching strings."""
    letters = model.letters[[ord(c) for c in text.lower()]]
    out = []
    for k, hay in enumerate(haystacks):
        codes = "".join(chr(c) for c in model.own[letters, k])
        n, at = 0, 0
        while at < len(codes):
            size = 1
            while at + size < len(codes) and codes[at : at + size + 1] in hay:
                size += 1
            n, at = n + 1, at + size
        out.append(n)
    return out


def haystacks(texts, model):
    out = []
    for k, lang in enumerate(model.languages):
        joined = "\n".join(sorted(set(texts[lang]), key=lambda t: (len(t), t))).lower()
        out.append("".join(chr(c) for c in model.own[model.letters[[ord(c) for c in joined]], k]))
    return out


def test_phrases_against_greedy_parsing(monkeypatch):
    monkeypatch.setattr(langid, "SEGMENT", 7)  # so that phrases cross segments
    texts = {"a": ["abracadabra alakazam", "αβγ abra"], "b": ["hocus pocus fidibus"], "c": ["αλφα βητα"]}
    model = langid.build(texts)
    draw = random.Random(8)
    told = ["abra cadabra", "hocus fidibus pocus", "zzzz", "", None, "abracadabra alakazam", "x1 2 ü", "aa" * 40, "𝒳 日本", "İstanbul abra"]
    told += ["".join(draw.choice("abrcdklzm hopusfi αβ") for _ in range(draw.randrange(1, 90))) for _ in range(60)]
    told += [(draw.choice(["abra", "pocus ", "αβ"]) * 30)[: draw.randrange(1, 100)] for _ in range(20)]
    counts, lettered = langid.phrases(told, model)
    for i, t in enumerate(told):
        assert counts[i].tolist() == (greedy(t, model, haystacks(texts, model)) if t else [0, 0, 0]), t
    assert lettered.tolist() == [any(c.isalpha() for c in t or "") for t in told]


def test_query_against_greedy_parsing(spark, monkeypatch):
    """Every prediction and score of the query by string search, on all documents; languages in one part or in several agree."""
    sf, kept = "/root/testdata/sf0.001", {}
    real = langid.parts
    monkeypatch.setattr(langid, "parts", lambda texts: kept.setdefault("models", real(kept.setdefault("texts", texts))))
    rows = {r["doc_id"]: r for r in langid.op9_language_id(spark, sf).collect()}
    (model,) = kept["models"]
    hay = haystacks(kept["texts"], model)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(rows) == sorted(docs)
    for i, t in docs.items():
        want, score = "und", 0.0
        if any(c.isalpha() for c in t):
            n = len(t.lower())
            entropy = sorted((p * math.log(n + 1) / n, lang) for p, lang in zip(greedy(t, model, hay), model.languages))
            want, score = entropy[0][1], 1 - entropy[0][0] / entropy[1][0]
        assert rows[i]["lang_pred"] == want and abs(rows[i]["score"] - score) < 1e-12
    monkeypatch.setattr(langid, "GROUP_BYTES", 1)
    monkeypatch.setattr(langid, "parts", real)
    again = {r["doc_id"]: r for r in langid.op9_language_id(spark, sf).collect()}
    assert again == rows


def test_many_languages(spark):
    """There is no limit to their number, and scripts are told apart."""
    alphabets = [[chr(0x3400 + 40 * k + i) for i in range(30)] for k in range(90)]
    draw = random.Random(3)
    rows = [(f"l{k:02}", "".join(draw.choice(a) for _ in range(120))) for k, a in enumerate(alphabets)]
    model = langid.build({lang: [t] for lang, t in rows})
    counts, _ = langid.phrases([t[30:90] for _, t in rows], model)
    assert counts.argmin(axis=1).tolist() == [*range(90)]


def test_sample_is_whole_rows(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(langid, "parts", lambda texts: kept.update(texts) or [])
    rows = [(i, "short one " + str(i), "a") for i in range(5)] + [(9, "x" * 3000, "a"), (10, "y" * 2500, "b"), (11, "z" * 2600, "b"), (12, None, "a"), (13, "w", None)]
    langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert {k: sorted(v) for k, v in kept.items()} == {"a": [f"short one {i}" for i in range(5)], "b": ["y" * 2500]}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = langid.op9_language_id(spark, sf).join(truth, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_short_texts_are_told_apart():
    draw = random.Random(6)
    words = {"en": "the of and that with from this have".split(), "de": "der und nicht mit sich auch eine wird".split()}
    say = lambda k, n: " ".join(draw.choice(words[k]) for _ in range(n))
    model = langid.build({k: [say(k, 400)] for k in words})
    told = [(k, say(k, 6)) for k in words for _ in range(30)]
    counts, _ = langid.phrases([t for _, t in told], model)
    got = [model.languages[k] for k in counts.argmin(axis=1)]
    assert got == [k for k, _ in told]


def test_odd_rows(spark):
    model = langid.learn(odd(spark), F.lit(True))
    rows = clashing(spark, "lang_pred", "score").withColumn("p", langid.predict(odd(spark), model)).collect()
    assert len(rows) == len(ODD)
    assert all((r["p"]["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in rows)
    assert langid.learn(none(spark), F.lit(True)) == [] and none(spark).select(langid.predict(none(spark), model)).collect() == []
    assert {r["p"]["lang_pred"] for r in odd(spark).withColumn("p", langid.predict(odd(spark), [])).collect()} == {"und"}
