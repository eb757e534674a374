"""Filter interaction audit: what each filter removes, alone and behind others, for every order of them.

Whether a row fails a filter does not depend on the other filters, so all orders follow
from one number for each row: the mask of the filters that it fails. Rows of a part with the
same mask are counted, and the counts (32 a part at most, for five filters) are all that the
orders are computed from.

Duplicates are found by sorting: rows are dealt to ranges of (fingerprint, doc_id), sorted
by fingerprint, full text and doc_id, and each is compared with its predecessor. A group of
copies of any size is spread over as many ranges as it fills. Where a range begins within a
group, its first rows can't know the group's first id; each range therefore leaves the text
(as its fingerprint) and the first id of its last group, one row a range, and the first
groups are decided by them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernstone.llm.common import SPACE_CLASS, table, written

#: Filters that look at a row alone: letter -> whether the row fails, by text, number of words and of distinct words.
Test = Callable[[Column, Column, Column], Column]
TESTS: dict[str, Test] = {
    "A": lambda text, words, distinct: words < 200,
    "B": lambda text, words, distinct: 100 * distinct < 50 * words,
    "C": lambda text, words, distinct: 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 3 * F.length(text),
    "D": lambda text, words, distinct: text.rlike(r"[#$%&*|]"),
}
#: The filter of texts that a smaller id has too.
DUPLICATE = "E"


def narrow(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, text). Null texts are empty, null parts the empty string."""
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def with_mask(rows: DataFrame, tests: dict[str, Test]) -> DataFrame:
    """``rows`` with mask: bit i is set if the row fails the i-th test."""
    counted = rows.withColumn("_words", F.array_remove(F.split("text", SPACE_CLASS + "+"), ""))
    text, words, distinct = F.col("text"), F.size("_words"), F.size(F.array_distinct("_words"))
    mask = F.lit(0)
    for i, test in enumerate(tests.values()):
        mask = mask.bitwiseOR(F.when(test(text, words, distinct), 1 << i).otherwise(0))
    return counted.withColumn("mask", mask).drop("_words")


def compared(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows (print, text, id, part, mask) of one range, each compared with its predecessor.

    ``later`` says that an earlier row has the same text and another id. Rows of the range's
    first group also carry the text's fingerprint, as their group may have begun before; the
    last row, ``tail``, tells the last group's fingerprint and first id.
    """
    before = first = None  # fingerprint and text of the row before, first id of its group
    opening = True  # still in the first group of the range
    for batch in batches:
        if not batch.num_rows:
            continue
        prints, texts, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("print", "text", "id"))
        told = prints.to_pylist()
        later, keys = [], []
        for i, fingerprint in enumerate(told):
            same = before is not None and fingerprint == before[0] and texts[i].as_py() == before[1]
            one = ids[i].as_py()
            if not same:
                opening = before is None
                first = one
                before = (fingerprint, texts[i].as_py())
            later.append(one != first)
            keys.append(fingerprint if opening else None)
        n = len(told)
        columns = [ids, batch.column(batch.schema.get_field_index("part")), batch.column(batch.schema.get_field_index("mask"))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(later, pa.bool_()), pa.array(keys, pa.binary()), pa.array(np.zeros(n, bool))], schema=schema)
    if before is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((first, None, None, None, before[0], True), schema)], schema=schema)


def masked(rows: DataFrame, tests: dict[str, Test]) -> DataFrame:
    """(id, part, mask) of ``narrow`` rows: the bits of ``tests``, and the next one where a smaller id has the same text.

    A null id is larger than all others; rows of one id are no duplicates of each other.
    The tests run on the sorted rows: the sample that cuts the ranges reads all rows once more, and needs none of them.
    """
    bit = len(tests)
    id_type = rows.schema["id"].dataType
    told = T.StructType(
        [T.StructField("id", id_type), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType())]
        + [T.StructField("later", T.BooleanType()), T.StructField("key", T.BinaryType()), T.StructField("tail", T.BooleanType())]
    )
    arrow = to_arrow_schema(told)
    order = [F.col("print"), F.col("text"), F.asc_nulls_last("id")]
    dealt = rows.withColumn("print", F.unhex(F.sha2("text", 256))).repartitionByRange(F.col("print"), F.asc_nulls_last("id")).sortWithinPartitions(*order)
    # written, as both the rows and the ends of the ranges are read, and ranges may be cut differently when computed again
    seen = written(with_mask(dealt, tests).mapInArrow(lambda batches: compared(batches, arrow), told), "audit")
    ends = seen.where("tail").groupBy("key").agg(F.min("id").alias("least"))  # one row a range at most
    pending = seen.where("NOT tail AND key IS NOT NULL").join(F.broadcast(ends), "key", "left")
    smaller = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))
    decided = seen.where("NOT tail AND key IS NULL").select("id", "part", "mask", "later")
    every = decided.unionByName(pending.select("id", "part", "mask", (F.col("later") | smaller).alias("later")))
    return every.select("id", "part", F.col("mask").bitwiseOR(F.when(F.col("later"), 1 << bit).otherwise(0)).alias("mask"))


def mask_counts(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """(part, mask, n, good, toxic): additive counters. A row is good or toxic if any label row of its id says so."""
    marks = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    all_rows = rows.groupBy("part", "mask").agg(F.count("*").alias("n"))
    # equal ids are counted before they meet their label
    by_id = rows.where("id IS NOT NULL").groupBy("id", "part", "mask").agg(F.count("*").alias("n"))
    labelled = by_id.join(marks.where("good = 1 OR toxic = 1"), "id").groupBy("part", "mask")
    marked = labelled.agg(F.sum(F.expr("n * good")).alias("good"), F.sum(F.expr("n * toxic")).alias("toxic"))
    zero = F.lit(0).cast("long")
    every = all_rows.select("*", zero.alias("good"), zero.alias("toxic")).unionByName(marked.select("part", "mask", zero.alias("n"), "good", "toxic"))
    return every.groupBy("part", "mask").agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("n", "good", "toxic")])


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step, from the counts of masks."""
    orders = ["".join(p) for p in permutations(letters)]
    bit = lambda c: sum((F.when(c.contains(x), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    steps = counts.select("*", F.explode(F.lit(orders)).alias("filter_order"), F.bit_count("mask").alias("_failed"))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    own = bit(F.substr("filter_order", "step", F.lit(1)))
    earlier = bit(F.substr("filter_order", F.lit(1), F.col("step") - 1))
    steps = steps.withColumn("_fails", F.col("mask").bitwiseAND(own) > 0).withColumn("_gone", F.col("mask").bitwiseAND(earlier) > 0)
    fails, gone, total = F.col("_fails"), F.col("_gone"), lambda when, what: F.sum(F.when(when, what).otherwise(0)).cast("long")
    here = fails & ~gone
    # of a row that fails k filters, each of them comes first in one k-th of all orders
    share = F.col("n") * F.expr(f"{len(orders)} div greatest(_failed, 1)")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone, F.col("n")).alias("kept"),
        total(here, F.col("n")).alias("removed"),
        total(fails & gone, F.col("n")).alias("redundant"),
        total(fails & (F.col("_failed") == 1), F.col("n")).alias("unique_fails"),
        total(here, F.col("good")).alias("good_lost"),
        total(here, F.col("toxic")).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, tests: dict[str, Test] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """What every filter removes in every order of ``tests`` and the duplicate filter, by part.

    A null text is empty (no words: it fails A, and is a copy of other empty texts), a null part
    the empty string, which it shares with parts that are empty. A null id counts as larger than
    all others and has no labels; repeated rows of one id are not copies of each other, and all
    count. Texts may be of any length; an empty table gives an empty one. Other columns are not
    read, whatever their names. Several label rows of one id count as one that has any of their marks.
    """
    tests = TESTS if tests is None else tests
    rows = masked(narrow(docs, id_col, text_col, part_col), tests)
    return interactions(mask_counts(rows, labels, id_col), "".join(tests) + DUPLICATE)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters in all 120 orders over all documents."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (
  SELECT w.doc_id, part,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(doc_id > least, least IS NOT NULL) THEN 'E' ELSE '' END AS failed,
    coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1) l USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS t(x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM o, unnest([1, 2, 3, 4, 5]) AS t(step) WHERE length(filter_order) = 5),
f AS (SELECT *, contains(failed, own) AS fails, len(list_intersect(string_split(failed, ''), string_split(earlier, ''))) > 0 AND failed <> '' AND earlier <> '' AS gone FROM c, s),
r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM f GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
