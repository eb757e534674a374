"""Toxicity by Levenshtein automata over a lexicon trie, weighed by context.

The lexicon is learned from labelled rows: words, and stems (beginnings of words), that
toxic documents hold far more often than others, each with its log odds as weight. Of a
stem and the words it begins only the more general stays, so the terms are few. Words that
many toxic documents share may be misspelled: the Levenshtein automaton of each is
intersected with the lexicon's trie, and the product is made deterministic once on the
driver, so a worker follows one table for all words of a batch. The window around a match
tells quotation (quote marks, words of reporting) from abuse (direct address) and scales
its weight. A logistic model over a document's matches gives the score.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import free_name, id_hash, table

#: Labelled rows, about, that the model learns from; a share by hash of the id if there are more.
SAMPLE = 8000
#: Least log odds of a term, and least of them in standard errors.
LEAST_ODDS, LEAST_SURE = 2.0, 2.5
#: Shortest word and stem, and longest stem.
WORD, STEM, LONG_STEM = 4, 5, 8
#: Lengths from which a word may have one misspelling and two, and the share of toxic rows that must hold it as it is.
FUZZY, FUZZIER, COMMON = 5, 9, 0.02
#: What a misspelled match counts of a plain one.
MISSPELLED = 0.8
#: A term's misspellings count only if fewer clean sample documents than this share hold one.
STRAY = 0.002
SLICE_CHARS = 2_000_000

# Quote marks, words of reporting, and words of direct address.
QUOTES = "\"“”„«»‹›‘’"
REPORTING = frozenset("said says wrote writes called quote quoted quotes reported sagte schrieb nannte zitat dit écrit appelé citation dijo escribió llamó cita".split())
ADDRESS = frozenset("you your du dich dein tu toi vous ton eres usted tú".split())


@dataclass
class Lexicon:
    """Terms with their weights and the edits each may have, and the product automaton as tables."""

    terms: list[str]
    weights: list[float]
    edits: list[int]
    classes: np.ndarray = field(default=None)
    step: np.ndarray = field(default=None)
    at_end: np.ndarray = field(default=None)
    at_stem: np.ndarray = field(default=None)

    def build(self) -> "Lexicon":
        """Trie, its product with the Levenshtein automata, and subsets of that as states.

        A state is a set of (trie node, errors). State 0 is dead, state 1 the start. ``at_end``
        and ``at_stem`` hold term * 2 + misspelled, or -1: what a word that ends here is, and
        what stem has just been read.
        """
        kids: list[dict[str, int]] = [{}]
        own: list[list[int]] = [[]]
        may: list[int] = [0]  # the most edits of a term at or below the node
        for t, term in enumerate(self.terms):
            node, path = 0, [0]
            for c in term.rstrip("*"):
                if c not in kids[node]:
                    kids[node][c] = len(kids)
                    kids.append({})
                    own.append([])
                    may.append(0)
                node = kids[node][c]
                path.append(node)
            own[node].append(t)
            for n in path:
                may[n] = max(may[n], self.edits[t])
        letters = sorted({c for k in kids for c in k})
        self.classes = np.zeros(0x110000, dtype=np.uint16)
        self.classes[[p for p in range(0x110000) if chr(p).isalnum()]] = 1
        self.classes[[ord(c) for c in letters]] = np.arange(2, 2 + len(letters))

        def close(states: set[tuple[int, int]]) -> frozenset:
            least: dict[int, int] = {}
            todo = list(states)
            while todo:
                n, e = todo.pop()
                if e <= may[n] and e < least.get(n, e + 1):
                    least[n] = e
                    todo += [(k, e + 1) for k in kids[n].values()]  # a letter of the term is missing in the word
            return frozenset(least.items())

        def follow(states: frozenset, c: str | None) -> frozenset:
            out = set()
            for n, e in states:
                if c is not None and c in kids[n]:
                    out.add((kids[n][c], e))
                if e < may[n]:
                    out.add((n, e + 1))  # a letter too many
                    out |= {(k, e + 1) for x, k in kids[n].items() if x != c}  # another letter
            return close(out)

        start = close({(0, 0)})
        number, queue, rows, ends, stems = {frozenset(): 0, start: 1}, deque([start]), [[0] * (2 + len(letters))], [-1], [-1]
        place = {c: 2 + i for i, c in enumerate(letters)}

        def best(states: frozenset, stem: bool) -> int:
            hits = [(self.value(t * 2 + (e > 0)), t * 2 + (e > 0)) for n, e in states for t in own[n] if self.terms[t].endswith("*") == stem and e <= self.edits[t]]
            return max(hits)[1] if hits else -1

        while queue:
            states = queue.popleft()
            rest = follow(states, None)
            row = [0] * (2 + len(letters))
            special = {c for n, _ in states for c in kids[n]}
            for c in [None, *sorted(special)]:
                to = rest if c is None else follow(states, c)
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
                if c is None:
                    row[1:] = [number[to]] * (1 + len(letters))
                else:
                    row[place[c]] = number[to]
            rows.append(row)
            ends.append(best(states, False))
            stems.append(best(states, True))
        self.step = np.array(rows, dtype=np.int32)
        self.at_end, self.at_stem = np.array(ends, dtype=np.int32), np.array(stems, dtype=np.int32)
        return self

    def value(self, hit: int) -> float:
        return self.weights[hit >> 1] * (MISSPELLED if hit & 1 else 1.0)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def scan(texts: list[str | None], lexicon: Lexicon) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(text, number of words, matches) of each text, a match being (hit, start, end)."""
    batch, size = [], 0
    for i, t in enumerate(texts):
        batch.append(i)
        size += len(t or "")
        if size >= SLICE_CHARS:
            yield from _scan_slice(texts, batch, lexicon)
            batch, size = [], 0
    if batch:
        yield from _scan_slice(texts, batch, lexicon)


def _scan_slice(texts: list, batch: list[int], lx: Lexicon) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    low = [(texts[i] or "").lower() for i in batch]
    c = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    k = lx.classes[c]
    letter = np.concatenate(([0], (k > 0).view(np.int8), [0]))
    edge = np.diff(letter)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in low])))
    first = np.searchsorted(start, offsets)
    hit = np.full(len(start), -1, dtype=np.int64)
    values = np.array([lx.value(h) for h in range(2 * len(lx.terms))] or [0.0])
    alive, state, pos = np.arange(len(start)), np.ones(len(start), dtype=np.int32), start.copy()
    while alive.size:
        state = lx.step[state, k[pos]]
        keep = state > 0
        alive, state, pos = alive[keep], state[keep], pos[keep] + 1
        over = pos == end[alive]
        for told, which in ((lx.at_stem, slice(None)), (lx.at_end, over)):
            got = told[state[which]]
            yes = got >= 0
            at, new = alive[which][yes], got[yes]
            better = (hit[at] < 0) | (values[new] > values[hit[at]])
            hit[at[better]] = new[better]
        alive, state, pos = alive[~over], state[~over], pos[~over]
    found = np.flatnonzero(hit >= 0)
    cut = np.searchsorted(found, first)
    for j, i in enumerate(batch):
        own = found[cut[j] : cut[j + 1]]
        yield i, int(first[j + 1] - first[j]), [(int(hit[w]), int(start[w] - offsets[j]), int(end[w] - offsets[j])) for w in own]


def context(text: str, start: int, end: int) -> float:
    """How much a match counts: less inside quotation, least where it is reported, more in direct address."""
    before, after = text[max(0, start - 60) : start], text[end : end + 60]
    near = set(words_of(before)) | set(words_of(after))
    quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
    if quoted:
        return 0.3 if near & REPORTING else 0.6
    return 1.2 if near & ADDRESS else 1.0


def features(text: str | None, n: int, matches: list[tuple[int, int, int]], lexicon: Lexicon) -> list[float]:
    """Of a document's matches: log of the summed weight, the largest weight, the number of different terms, weight per root of length."""
    text = (text or "").lower()
    value = [lexicon.value(h) * context(text, a, b) for h, a, b in matches]
    total = sum(value)
    return [math.log1p(total), max(value, default=0.0), min(len({text[a:b] for _, a, b in matches}), 10) / 5, min(total / math.sqrt(n / 50 + 1), 10.0)]


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: list[float]

    def score(self, x: list[float]) -> float:
        z = self.coefficients[0] + sum(a * b for a, b in zip(self.coefficients[1:], x))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Coefficients, the constant first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= change
        if np.abs(change).max() < 1e-8:
            break
    return w


def terms_of(text: str) -> set[str]:
    """A document's words, and the stems of its longer words (with a star)."""
    words = {w for w in words_of(text) if not w.isdigit()}
    stems = {w[:n] + "*" for w in words for n in range(STEM, min(LONG_STEM, len(w) - 1) + 1)}
    return {w for w in words if len(w) >= WORD} | stems


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a in range(0, len(batch), 500):
            part = batch.iloc[a : a + 500]
            pos, neg = Counter(), Counter()
            for text, toxic in zip(part.iloc[:, 0], part.iloc[:, 1]):
                (pos if toxic else neg).update(terms_of(text))
            terms = list(pos | neg)
            if terms:
                yield pd.DataFrame({"term": terms, "pos": [pos[t] for t in terms], "neg": [neg[t] for t in terms]})


def sampled(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(text, toxic) of about ``sample`` labelled rows, chosen by a hash of the id among those that ``learn`` admits."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn).select(id_col, F.col(label_col).cast("int").alias("toxic"))
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    bound = f"{min(int(share * 16**8), 16**8 - 1):08x}"
    few = known.where(F.substring(id_hash(id_col, "tox"), 1, 8) <= bound)
    return docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(F.broadcast(few), id_col).select(text_col, "toxic")


def edits_of(term: str) -> int:
    """Misspellings that a term may have by its length; stems have none."""
    return 0 if term.endswith("*") else (len(term) >= FUZZY) + (len(term) >= FUZZIER)


def general(found: list[tuple[str, int, float]]) -> list[tuple[str, int, float]]:
    """Of (term, toxic rows, log odds) those that no other says as well.

    A stem that little but one word begins gives way to that word; a word or stem gives way
    to a shorter stem that is as telling.
    """
    rows = {t: n for t, n, _ in found}
    longer: dict[str, int] = {}
    for t, n, _ in found:
        for k in range(STEM, min(LONG_STEM, len(t.rstrip("*")) - 1) + 1):
            if not t.endswith("*"):
                longer[t[:k] + "*"] = max(longer.get(t[:k] + "*", 0), n)
    kept: dict[str, float] = {}
    for t, n, odds in sorted(found, key=lambda r: (len(r[0].rstrip("*")), r[0])):
        word = t.rstrip("*")
        if t.endswith("*") and rows[t] <= 1.25 * longer.get(t, 0):
            continue
        if any(kept.get(word[:k] + "*", -math.inf) >= odds - 0.5 for k in range(STEM, len(word) + (not t.endswith("*")))):
            continue
        kept[t] = odds
    return [r for r in found if r[0] in kept]


def learn(docs: DataFrame, labels: DataFrame, learn_where: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Lexicon and model from a bounded sample of labelled rows; the sample is all that is bounded.

    Null texts, ids and labels teach nothing; rows of an id that has several labels count
    for each. Without any toxic or any clean row nothing can be learned and every score is 0.
    """
    rows = sampled(docs, labels, learn_where, id_col, text_col, label_col, sample).cache()
    sizes = dict(rows.groupBy("toxic").count().collect())
    good, bad = sizes.get(0, 0), sizes.get(1, 0)
    if not good or not bad:
        rows.unpersist()
        return Model(Lexicon([], [], []).build(), [-30.0, 0, 0, 0, 0])
    counted = rows.mapInPandas(_term_counts, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    parts = [F.col("pos") + 0.5, bad - F.col("pos") + 0.5, F.col("neg") + 0.5, good - F.col("neg") + 0.5]
    odds = F.log(parts[0] / parts[1]) - F.log(parts[2] / parts[3])
    least = max(3, math.ceil(bad * 0.004))
    telling = counted.where(F.col("pos") >= least).withColumn("odds", odds).withColumn("error", F.sqrt(sum((1 / p for p in parts), F.lit(0.0))))
    telling = telling.where((F.col("odds") >= LEAST_ODDS) & (F.col("odds") >= LEAST_SURE * F.col("error")))
    top = general([(r["term"], r["pos"], r["odds"]) for r in telling.orderBy("term").collect()])  # of the sample, so bounded with it
    terms, weights = [t for t, _, _ in top], [w for _, _, w in top]
    edits = [edits_of(t) if n >= COMMON * bad else 0 for t, n, _ in top]
    lexicon = Lexicon(terms, weights, edits).build()
    shipped = rows.sparkSession.sparkContext.broadcast(lexicon)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, lx = batch.iloc[:, 0].tolist(), shipped.value
            got = [(i, n, m) for i, n, m in scan(texts, lx)]
            yield pd.DataFrame(
                {
                    "toxic": [int(batch.iloc[i, 1]) for i, _, _ in got],
                    "stray": [sorted({h >> 1 for h, _, _ in m if h & 1}) for _, _, m in got],
                    "x": [features(texts[i], n, m, lx) for i, n, m in got],
                    "sure": [features(texts[i], n, [y for y in m if not y[0] & 1], lx) for i, n, m in got],
                }
            )

    seen = rows.mapInPandas(look, "toxic int, stray array<int>, x array<double>, sure array<double>").collect()
    rows.unpersist()
    strays = Counter(t for r in seen if not r["toxic"] for t in r["stray"])
    trusted = [e if strays[t] <= STRAY * good else 0 for t, e in enumerate(edits)]
    x = np.array([r["x"] if all(trusted[t] for t in r["stray"]) else r["sure"] for r in seen])
    w = logistic(x, np.array([r["toxic"] for r in seen], dtype=float))
    if trusted != edits:
        lexicon = Lexicon(terms, weights, trusted).build()
    return Model(lexicon, [float(v) for v in w])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The toxicity of each whole text, however long, 0 to 1. A null text counts as empty.

    Rows are independent: repeated ones get equal scores, an empty table none. Only the
    text is read, whatever other columns are called.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        m = shipped.value
        out = np.zeros(len(texts))
        told = [t if isinstance(t, str) else None for t in texts]
        for i, n, matches in scan(told, m.lexicon):
            out[i] = m.score(features(told[i] if matches else None, n, matches, m.lexicon))
        return pd.Series(out)

    return of(F.col(text_col))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score 0.5 or more. Repeated rows fare alike; an empty table stays empty."""
    name = free_name(docs, "_toxicity")
    return docs.withColumn(name, score(docs, model, text_col)).where(F.col(name) < 0.5).drop(name)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model that saw labels outside fold 0 of 5 only."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = learn(docs, labels, fold("doc_id", 5) != 0)
    scored = docs.select("doc_id", score(docs, model).alias("score"))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
