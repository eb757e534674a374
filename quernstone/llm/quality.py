"""Quality rules: a threshold table compiled into one projection, without user functions.

``METRICS`` names what can be measured of a text as native expressions, ``RULES`` is the
table of thresholds, and ``judge`` turns both into columns of a single projection: no
join, no shuffle, no Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import SPACE_CLASS, free_name, table

# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on with as be at by this are or from "
    "der die das und ist zu den von mit nicht ein eine im für auf dem des sich auch "
    "le la les et de des est que un une pour dans qui pas sur au avec du en "
    "el los las y del se por con no su al lo más como una"
).split()
SYMBOLS = "#*$%&|<>"
#: Words of a window in which repetition is looked for.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= metric <= high``; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. The first two are the base that no other rule can overrule.
BASE = (
    Rule("enough_words", "n_words", low=20),
    Rule("little_repetition", "repeat_percent", high=30),
)
RULES = (
    Rule("word_length", "mean_word_chars", low=2.0, high=12.0),
    Rule("few_symbols", "symbols_per_word", high=0.1),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("few_dup_lines", "dup_line_ratio", high=0.3),
    Rule("few_bullets", "bullet_line_ratio", high=0.9),
    Rule("few_ellipses", "ellipsis_line_ratio", high=0.3),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def with_window_hashes(df: DataFrame, words: str, out: str, n: int = WINDOW) -> DataFrame:
    """``df`` with ``out``: a 64-bit hash for each run of n words (a power of two).

    Runs are joined pairwise, log2(n) times. Each pass is a column of its own, as an
    expression that reads the one before it thrice would compute it thrice.
    """
    df, width = df.withColumn(out, F.transform(words, lambda w: F.xxhash64(w))), 1
    while width < n:
        left = F.greatest(F.size(out) - width, F.lit(0))
        df = df.withColumn(out, F.zip_with(F.slice(out, 1, left), F.slice(out, width + 1, left), lambda a, b: F.xxhash64(a, b)))
        width *= 2
    return df


def in_order(hashes: Column) -> Column:
    """Hashes with their places, in order, where one occurs twice; null where none does."""
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(placed))


def repeated_starts(at: Column) -> Column:
    """Places of the hashes that occur twice or more. ``at`` must be a column of its own, as it is read for each element."""
    last = F.size(at) - 1
    twice = lambda x, k: (
        ((k > 0) & (F.get(at, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])) | ((k < last) & (F.get(at, F.least(k + 1, last))["h"] == x["h"]))
    )
    return F.sort_array(F.transform(F.filter(at, twice), lambda x: x["i"]))


def covered_words(starts: Column, n: int = WINDOW) -> Column:
    """Words that windows of n words at these places cover."""
    none = F.struct(F.lit(-n).alias("before"), F.lit(0).alias("words"))
    step = lambda acc, i: F.struct(i.alias("before"), (acc["words"] + F.least(F.lit(n), i - acc["before"])).alias("words"))
    return F.coalesce(F.aggregate(starts, none, step)["words"], F.lit(0))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts every metric is made of. A null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts, lines, windows, at, starts = (free_name(docs, n) for n in ("_words", "_lines", "_windows", "_at", "_starts"))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    out = docs.withColumn(parts, F.array_remove(F.split(text, SPACE_CLASS + "+"), "")).withColumn(lines, F.filter(F.split(text, "\n"), has_word))
    out = with_window_hashes(out, parts, windows)
    out = out.withColumn(at, in_order(F.col(windows))).withColumn(starts, repeated_starts(F.col(at)))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.withColumns(
        {
            "n_words": count(F.size(parts)),
            "word_chars": count(F.length(F.array_join(parts, ""))),
            "n_symbols": count(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))),
            "n_lines": count(F.size(lines)),
            "n_dup_lines": count(F.size(lines) - F.size(F.array_distinct(lines))),
            "n_repeat_words": count(covered_words(F.col(starts))),
            "n_stop_words": count(F.size(F.filter(parts, lambda w: F.lower(w).isin(STOP_WORDS)))),
            "n_bullet_lines": count(F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]")))),
            "n_ellipsis_lines": count(F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09]*$")))),
        }
    ).drop(parts, lines, windows, at, starts)


METRICS = {
    "n_words": lambda: F.col("n_words"),
    "repeat_percent": lambda: _ratio(100 * F.col("n_repeat_words"), F.col("n_words")),
    "mean_word_chars": lambda: _ratio(F.col("word_chars"), F.col("n_words")),
    "symbols_per_word": lambda: _ratio(F.col("n_symbols"), F.col("n_words")),
    "stop_word_ratio": lambda: _ratio(F.col("n_stop_words"), F.col("n_words")),
    "dup_line_ratio": lambda: _ratio(F.col("n_dup_lines"), F.col("n_lines")),
    "bullet_line_ratio": lambda: _ratio(F.col("n_bullet_lines"), F.col("n_lines")),
    "ellipsis_line_ratio": lambda: _ratio(F.col("n_ellipsis_lines"), F.col("n_lines")),
}


def fails(rule: Rule) -> Column:
    metric = METRICS[rule.metric]()
    low = metric < rule.low if rule.low is not None else F.lit(False)
    high = metric > rule.high if rule.high is not None else F.lit(False)
    return low | high


def judge(docs: DataFrame, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``failed`` (names of the rules broken) and ``kept``.

    A null or empty text has no words and fails the base. Each row is judged by
    itself, on its whole text of any length: repeated rows get equal verdicts, an
    empty table gives an empty one, and columns named like an added one are replaced.
    Spark computes a column that a filter names once more for the filter, so write the
    verdicts before filtering by several of them.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines", "base_failed", "failed", "kept"]
    counted = measured(docs.drop(*[c for c in added if c != text_col]), text_col)
    base_failed = F.lit(False)
    for rule in base:
        base_failed = base_failed | fails(rule)
    broken = F.array_compact(F.array(*[F.when(fails(r), F.lit(r.name)) for r in (*base, *rules)]))
    return counted.withColumn("base_failed", base_failed).withColumn("failed", broken).withColumn("kept", F.size("failed") == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the default threshold table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, sum(least(8, i - p))::BIGINT AS n FROM (SELECT doc_id, i, lag(i, 1, -8) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM rep) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({', '.join("'" + x + "'" for x in STOP_WORDS)})))::BIGINT AS n_stop,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]')))::BIGINT AS n_bullet,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09]*$')))::BIGINT AS n_ellipsis
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 12.0 AND n_symbols / n_words <= 0.1 AND n_stop / n_words >= 0.02
       AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.3) AND (n_lines = 0 OR n_bullet / n_lines <= 0.9)
       AND (n_lines = 0 OR n_ellipsis / n_lines <= 0.3) AS kept
FROM b
"""
