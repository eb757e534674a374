"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text answers how far a text can be
followed. A text is parsed into phrases, each the longest stretch from its start that the
language's text holds (or one character, if that holds not even this); the number of
phrases, normalised by log of the length over the length, estimates the cross entropy.
The language needing fewest wins.

Texts are cut into segments that walk all automata side by side: one table step for each
character place, over an array of (segment, language) states. A segment begins as if a
phrase did; where one is under way from the segment before, it is walked again from that
state until both walks stand in the same state, which they do after a few phrases. So the
phrases are those of the whole text, whatever its length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import id_hash, table, written
from quernstone.llm.toxicity import fold

#: Labelled rows, about, that each language is learned from, and the most characters of a row that is drawn.
SAMPLE_DOCS, SAMPLE_TEXT = 16, 2_000
#: Letters of a language with a class of their own; its rarer ones share so many classes.
LETTERS, RARE = 60, 16
#: Characters of a segment, and of the texts walked at once.
SEGMENT, SLICE_CHARS = 1024, 2_000_000
#: Bytes of tables that one user function holds; languages beyond them go to another.
GROUP_BYTES = 256_000_000
ALL_CHARACTERS = 0x110000


def automaton(codes: list[int], width: int) -> np.ndarray:
    """The suffix automaton of a sequence as a table state x class -> state. State 0 is dead, 1 the root."""
    step: list[list[int]] = [[0] * width, [0] * width]
    link, length, last = [0, 0], [0, 0], 1
    for c in codes:
        new = len(step)
        step.append([0] * width)
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and not step[p][c]:
            step[p][c] = new
            p = link[p]
        if p:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(step[q][:])
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p and step[p][c] == q:
                    step[p][c] = twin
                    p = link[p]
        last = new
    return np.array(step, dtype=np.int32)


@dataclass
class Model:
    """Languages in order; ``letters`` numbers each character (0: no letter, 1: a letter of no sample).

    ``own`` gives a letter's class in each language (1: a letter that it lacks), ``table``
    the place of the next state's row for the place of a state's row plus class, ``anew``
    that of the state where a phrase stands that begins with a letter. Place 0 is the dead row.
    """

    languages: list[str]
    letters: np.ndarray
    own: np.ndarray
    table: np.ndarray
    anew: np.ndarray


def numbered(texts: dict[str, list[str]]) -> np.ndarray:
    """Character -> number of the letter."""
    letters = np.zeros(ALL_CHARACTERS, dtype=np.int32)
    letters[[p for p in range(ALL_CHARACTERS) if chr(p).isalpha()]] = 1
    seen = sorted({c for own in texts.values() for t in own for c in t.lower() if c.isalpha()})
    letters[[ord(c) for c in seen]] = np.arange(2, 2 + len(seen))
    return letters


def classes_of(joined: str, letters: np.ndarray) -> dict[int, int]:
    """Letter number -> class in a language whose sample this is: its commonest letters have their own."""
    counts = Counter(c for c in joined if c.isalpha())
    ranked = sorted(counts, key=lambda c: (-counts[c], c))
    return {int(letters[ord(c)]): 2 + i if i < LETTERS else 2 + LETTERS + ord(c) % RARE for i, c in enumerate(ranked)}


def build(texts: dict[str, list[str]]) -> Model:
    """A model from labelled texts: one automaton for each language, over all of its texts in order of length."""
    languages, letters = sorted(texts), numbered(texts)
    n = int(letters.max()) + 1
    own = np.ones((n, len(languages)), dtype=np.int32)
    own[0] = 0
    widest = 2 + LETTERS + RARE
    tables, roots, at = [np.zeros(widest, dtype=np.int32)], [], widest
    for k, lang in enumerate(languages):
        joined = "\n".join(sorted(set(texts[lang]), key=lambda t: (len(t), t))).lower()
        for number, c in classes_of(joined, letters).items():
            own[number, k] = c
        codes = own[letters[_points(joined)], k]
        width = max(2, int(own[:, k].max()) + 1)
        step = automaton(codes.tolist(), width)[1:]
        roots.append(at)
        tables.append(np.where(step > 0, (step - 1) * width + at, 0).astype(np.int32).ravel())
        at += step.size
    flat = np.concatenate(tables)
    return Model(languages, letters, own, flat, flat[np.array(roots) + own].astype(np.int32))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def parts(texts: dict[str, list[str]]) -> list[Model]:
    """Models of the languages in groups whose tables take ``GROUP_BYTES`` at most, one language at least."""
    groups: list[list[str]] = []
    room = 0
    for lang in sorted(texts):
        need = 8 * (2 + LETTERS + RARE) * sum(len(t) + 1 for t in texts[lang])  # at most two states a character
        if not groups or need > room:
            groups.append([])
            room = GROUP_BYTES
        groups[-1].append(lang)
        room -= need
    return [build({k: texts[k] for k in group}) for group in groups]


def phrases(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text in each language, and whether it has a letter."""
    out = np.zeros((len(texts), len(model.languages)), dtype=np.int64)
    lettered = np.zeros(len(texts), dtype=bool)
    most = max(SEGMENT, SLICE_CHARS * 4 // (4 + len(model.languages)))
    batch, size = [], 0
    for i, t in enumerate(texts):
        if t:
            batch.append(i)
            size += len(t)
        if batch and (size >= most or i == len(texts) - 1):
            out[batch], lettered[batch] = _parse([texts[j].lower() for j in batch], model)
            batch, size = [], 0
    return out, lettered


def _parse(low: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    codes = model.letters[_points("".join(low))]
    sizes = np.array([len(t) for t in low], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    some = np.add.reduceat((codes > 0).astype(np.int64), begin) > 0
    pieces = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(low)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begin[owner] + within * SEGMENT
    length = np.minimum(SEGMENT, begin[owner] + sizes[owner] - start)
    count, end = _walk(codes, start, length, model)
    more = np.zeros_like(count)
    alone, entered, goes_on = end.copy(), np.zeros_like(end), np.flatnonzero(within > 0)
    while goes_on.size:  # segments whose first phrase began in the one before
        entry = np.zeros_like(end)
        entry[goes_on] = end[goes_on - 1]
        piece, lang = np.nonzero(entry != entered)
        if not piece.size:
            break
        entered[piece, lang] = entry[piece, lang]
        more[piece, lang], end[piece, lang] = _resume(codes, start[piece], length[piece], lang, entry[piece, lang], alone[piece, lang], model)
    out = np.zeros((len(low), len(model.languages)), dtype=np.int64)
    np.add.at(out, owner, count + more)
    return out, some


def _walk(codes: np.ndarray, start: np.ndarray, length: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that begin in each segment, in each language, if one begins with it; and the state at its end."""
    order = np.argsort(-length, kind="stable")
    first, sizes = start[order], length[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    grid = np.zeros((int(sizes[0]), len(first)), dtype=np.int32)
    for t, n in enumerate(active):
        grid[t, :n] = codes[first[:n] + t]
    state = np.zeros((len(first), len(model.languages)), dtype=np.int32)
    count = np.zeros(state.shape, dtype=np.int32)
    for t, n in enumerate(active):
        g = grid[t, :n]
        now = model.table.take(state[:n] + model.own[g])
        ends = now == 0
        count[:n] += ends
        np.copyto(now, model.anew[g], where=ends)
        state[:n] = now
    back = np.argsort(order)
    return count[back], state[back]


def _resume(codes: np.ndarray, start: np.ndarray, length: np.ndarray, lang: np.ndarray, entry: np.ndarray, alone: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Phrases to add to those of a segment walked alone if it is entered in a state, and the state at its end then."""
    more, end = np.zeros(len(start), dtype=np.int32), alone.copy()
    lane, a, b, t = np.arange(len(start)), entry.copy(), np.zeros_like(entry), 0
    while lane.size:
        g, k = codes[start[lane] + t], lang[lane]
        own, anew = model.own[g, k], model.anew[g, k]
        a, b = model.table.take(a + own), model.table.take(b + own)
        more[lane] += (a == 0).astype(np.int32) - (b == 0)
        a, b = np.where(a == 0, anew, a), np.where(b == 0, anew, b)
        t += 1
        over = t >= length[lane]
        end[lane[over]] = a[over]
        apart = (a != b) & ~over
        lane, a, b = lane[apart], a[apart], b[apart]
    return more, end


def learn(docs: DataFrame, learn_where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, most: int = SAMPLE_TEXT) -> list[Model]:
    """Models from a bounded sample of labelled rows, each taken whole; none if there are none.

    Of each language about ``sample_docs`` rows of ``most`` characters at most are drawn by a
    hash of the id; of a language that has only longer ones, its shortest row. Null texts
    and languages teach nothing; repeated rows count once.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & learn_where)
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.substring(id_hash(id_col, "lang"), 1, 8).alias("h"), F.length(text_col).alias("n"))
    short = (F.col("n") <= most) & (F.trim("text") != "")
    sizes = written(known.groupBy("lang").agg(F.count_if(short).alias("short")), "lang-sizes")  # a row for each language
    share = F.least(F.lit(sample_docs) / F.col("short"), F.lit(1.0))
    bound = F.lpad(F.lower(F.hex(F.least(F.floor(share * 16**8), F.lit(16**8 - 1)).cast("long"))), 8, "0")
    drawn = known.where(short).join(sizes.where("short > 0"), "lang").where(F.col("h") <= bound).select("lang", "text")
    only_long = known.join(sizes.where("short = 0"), "lang").groupBy("lang").agg(F.min_by("text", F.struct("n", "h")).alias("text"))
    texts: dict[str, list[str]] = {}
    for lang, text in drawn.unionByName(only_long).collect():
        texts.setdefault(lang, []).append(text)
    return parts(texts)


def predict(docs: DataFrame, models: list[Model], text_col: str = "text") -> Column:
    """struct(lang_pred, score) of each whole text, however long.

    ``und`` and 0 for a text that is null or has no letter, or without a model. The language
    of least entropy wins, the first by name of equals; the score is one minus its entropy
    over that of the next. Rows are independent: repeated ones get equal answers, an empty
    table none, and only the text is read, whatever other columns are called.
    """
    if not models:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    near = [_nearest(docs.sparkSession.sparkContext.broadcast(m))(F.col(text_col)) for m in models]
    least = F.array_sort(F.flatten(F.array(*near)))  # by entropy, then by name
    best, second = F.get(least, F.lit(0)), F.get(least, F.lit(1))
    score = F.when(second.isNull(), 1.0).when(second["entropy"] > 0, 1 - best["entropy"] / second["entropy"]).otherwise(0.0)
    return F.struct(F.coalesce(best["lang"], F.lit("und")).alias("lang_pred"), F.when(best.isNull(), 0.0).otherwise(score).alias("score"))


def _nearest(shipped):
    @F.pandas_udf("array<struct<entropy:double,lang:string>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """The two languages of least entropy; none for a text without letters."""
        model = shipped.value
        for texts in batches:
            told = [t if isinstance(t, str) else None for t in texts]
            counts, lettered = phrases(told, model)
            out = []
            for i, t in enumerate(told):
                entropy = counts[i] * math.log(len(t.lower()) + 1) / len(t.lower()) if lettered[i] else counts[i][:0]
                out.append([{"entropy": float(entropy[k]), "lang": model.languages[k]} for k in np.argsort(entropy, kind="stable")[:2]])
            yield pd.Series(out, dtype=object)

    return of


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model that saw labels outside fold 2 of 4 only."""
    docs = table(spark, sf_dir, "documents")
    models = learn(docs.select("doc_id", "text", "lang"), fold("doc_id", 4) != 2)
    told = docs.select("doc_id", predict(docs, models).alias("p"))
    return told.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "p.lang_pred", "p.score")
