import math
import random
import re
import zlib

from pyspark.sql import functions as F

from quernstone.llm import toxicity
from tests.llm.cases import ODD, clashing, none, odd


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    terms = ["horrid", "stupid", "moron*", "fool"]
    lexicon = toxicity.Lexicon(terms, [3.0, 2.5, 2.0, 1.0], [2, 1, 0, 0]).build()
    draw = random.Random(2)
    words = ["horrid", "stupid", "moronic", "fool", "fools", "morn", "horid", "horriid", "xhorrid", "stupit"]
    for _ in range(400):
        w = list(draw.choice(terms).rstrip("*"))
        for _ in range(draw.randrange(3)):
            at = draw.randrange(len(w) + 1)
            w[at : at + draw.randrange(2)] = draw.choice(["", "o", "z"])
        words.append("".join(w) or "q")
    got = {i: m for i, _, m in toxicity.scan(words, lexicon)}
    for i, w in enumerate(words):
        want = set()
        for t, term in enumerate(terms):
            if term.endswith("*"):
                want |= {2 * t} if w.startswith(term[:-1]) else set()
            elif w == term:
                want.add(2 * t)
            elif edits(w, term) <= lexicon.edits[t]:
                want.add(2 * t + 1)
        hits = [h for h, _, _ in got[i]]
        assert (not want and not hits) or (len(hits) == 1 and hits[0] in want), w


def test_context_separates_quotation_from_abuse():
    plain, quoted, reported, direct = 'a b idiot c', 'a "idiot" b', 'he said "idiot" then', "you idiot"
    weigh = lambda t: toxicity.context(t, t.index("idiot"), t.index("idiot") + 5)
    assert weigh(reported) < weigh(quoted) < weigh(plain) < weigh(direct)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    hit = sum(r["predicted"] for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    wrong = sum(r["predicted"] for r in rows if not r["toxic"]) / sum(1 - r["toxic"] for r in rows)
    assert hit > 0.9 and wrong < 0.01 and all(0 <= r["score"] <= 1 for r in rows)


def brute_score(text, model, known):
    """A document's score with a full edit table for each word and term."""
    lx, low = model.lexicon, (text or "").lower()
    value, seen = [], set()
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", low)]
    for w, a, b in words:
        if w not in known:
            hits = [0.0]
            for term, weight, most in zip(lx.terms, lx.weights, lx.edits):
                if w.startswith(term[:-1]) if term.endswith("*") else w == term:
                    hits.append(weight)
                elif most and abs(len(w) - len(term)) <= most and edits(w, term) <= most:
                    hits.append(weight * toxicity.MISSPELLED)
            known[w] = max(hits)
        if known[w]:
            near = set(re.findall(r"[^\W_]+", low[max(0, a - 60) : a])) | set(re.findall(r"[^\W_]+", low[b : b + 60]))
            quoted = all(any(q in part for q in toxicity.QUOTES) for part in (low[max(0, a - 60) : a], low[b : b + 60]))
            factor = (0.3 if near & toxicity.REPORTING else 0.6) if quoted else 1.2 if near & toxicity.ADDRESS else 1.0
            value.append(known[w] * factor)
            seen.add(w)
    total = sum(value)
    x = [math.log(1 + total), max(value, default=0.0), min(len(seen), 10) / 5, min(total / math.sqrt(len(words) / 50 + 1), 10.0)]
    if not value:
        x = [0.0] * 4
    z = model.coefficients[0] + sum(a * b for a, b in zip(model.coefficients[1:], x))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_query_against_brute_force(spark, monkeypatch):
    sf, kept, real = "/root/testdata/sf0.01", {}, toxicity.learn
    monkeypatch.setattr(toxicity, "learn", lambda *a: kept.setdefault("model", real(*a)))
    rows = {r["doc_id"]: r for r in toxicity.op8_toxicity(spark, sf).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(rows) == sorted(docs)
    known = {}
    for i, text in docs.items():
        want = brute_score(text, kept["model"], known)
        assert abs(rows[i]["score"] - want) < 1e-9 and rows[i]["predicted"] == (want >= 0.5)
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_ablation_of_the_method(spark):
    """Held-out toxic documents with their words misspelled or quoted: automata find the former, contexts spare the latter."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(docs, labels, toxicity.fold("doc_id", 5) != 0)
    plain = toxicity.Model(toxicity.Lexicon(model.lexicon.terms, model.lexicon.weights, [0] * len(model.lexicon.terms)).build(), model.coefficients)
    fuzzy = [t for t, e in zip(model.lexicon.terms, model.lexicon.edits) if e]
    word = re.compile("|".join(fuzzy), re.IGNORECASE)
    texts = [r["text"] for r in docs.join(labels, "doc_id").where((toxicity.fold("doc_id", 5) == 0) & (F.col("toxic") == 1)).select("text").collect()]
    texts = [t for t in texts if len(word.findall(t)) >= 2 and not re.search("moron|scum", t, re.IGNORECASE)]  # words too short or too like others to be misspelled

    def caught(m, told):
        return sum(m.score(toxicity.features(told[i], n, hits, m.lexicon)) >= 0.5 for i, n, hits in toxicity.scan(told, m.lexicon))

    misspelled = [word.sub(lambda m: m.group()[:2] + "q" + m.group()[3:], t) for t in texts]
    quoted = [word.sub(lambda m: f'they said "{m.group()}" there', t) for t in texts]
    assert len(texts) > 15 and caught(model, texts) == len(texts)
    assert caught(model, misspelled) >= 0.95 * len(texts) and caught(plain, misspelled) <= 0.3 * len(texts)
    mean = lambda told: sum(model.score(toxicity.features(told[i], n, hits, model.lexicon)) for i, n, hits in toxicity.scan(told, model.lexicon)) / len(told)
    print("ablation:", len(texts), caught(model, misspelled), caught(plain, misspelled), caught(model, quoted), mean(texts), mean(quoted))
    assert mean(quoted) < mean(texts) and caught(model, quoted) < len(texts)


def test_lexicon_keeps_the_general_terms():
    found = [("moron*", 40, 4.0), ("moronic", 20, 4.2), ("morons", 15, 4.1), ("idiots*", 11, 4.0), ("idiotsx", 10, 4.1), ("fool", 9, 3.0)]
    assert [t for t, _, _ in toxicity.general(found)] == ["moron*", "idiotsx", "fool"]


def test_letters_beyond_the_first_plane():
    lexicon = toxicity.Lexicon(["𝒳𝒴𝒵𝒳", "scum"], [2.0, 1.0], [0, 0]).build()
    assert [[h for h, _, _ in m] for _, _, m in toxicity.scan(["a 𝒳𝒴𝒵𝒳 b", "𝒳scum", "scum"], lexicon)] == [[0], [], [2]]


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, 0), (8, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.learn(odd(spark), labels, F.lit(True))
    rows = odd(spark).withColumn("score", toxicity.score(odd(spark), model)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.reject_toxic(none(spark), model).collect() == []
    unlearned = toxicity.learn(none(spark), labels.where("false"), F.lit(True))
    assert toxicity.reject_toxic(clashing(spark, "_toxicity", "toxic", "score"), unlearned).where("_toxicity = 'kept _toxicity'").count() == len(ODD)
