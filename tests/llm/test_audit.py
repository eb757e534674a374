"""The filter audit against removing rows one filter after the other."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from quernstone.llm import audit
from tests.llm import cases

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failed(rows):
    """The letters that each (id, text, lang) row fails."""
    least = {}
    for i, text, _ in rows:
        key = text or ""
        if i is not None:
            least[key] = min(i, least.get(key, i))
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        marks = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": text in least and (i is None or i > least[text]),
        }
        yield lang or "", "".join(k for k, v in marks.items() if v)


def brute(rows, labels):
    """Rows are taken through each order one filter at a time."""
    every = [(part, marks, labels.get(row[0], (0, 0))) for row, (part, marks) in zip(rows, failed(rows))]
    out, removed_of = [], Counter()
    for part in sorted({p for p, _, _ in every}):
        own = [(m, l) for p, m, l in every if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                fails = sum(x in m for m, _ in own)
                removed_of[part, x] += len(gone)
                out.append([part, order, step, len(left), len(gone), fails - len(gone), sum(m == x for m, _ in own), sum(l[0] for _, l in gone), sum(l[1] for _, l in gone)])
    return sorted((*r, removed_of[r[0], r[1][r[2] - 1]]) for r in out)


def told(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def labels_of(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (7, 1, 1), (7, 1, 0), (None, 1, 1), (99, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


LABELS = {1: (1, 0), 3: (0, 1), 7: (1, 1), 99: (1, 1)}


def test_against_removing(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [long, long + " #", long.upper(), "a b c", "SHOUT", "x " * 300, "x " * 300 + "$", None, ""]
    rows = [(i if i % 17 else None, texts[i * i % 9], ("en", "de", "", None)[i % 4]) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    assert told(audit.audit(docs, labels_of(spark))) == brute(rows, LABELS)


def test_one_group_fills_many_ranges(spark):
    """A text that two thirds of the rows share, over more ranges than it has distinct neighbours."""
    rows = [(i, "copy" if i % 3 else f"t{i}", "en") for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        marked = audit.masked(audit.narrow(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang"), {})
        assert sorted(r.id for r in marked.where("mask = 1").collect()) == [i for i, t, _ in rows if t == "copy" and i > 1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_rows(spark):
    rows = [(r[0], r[1], r[2]) for r in cases.ODD]
    want = brute(rows, LABELS)
    assert told(audit.audit(cases.odd(spark), labels_of(spark))) == want
    extra = cases.clashing(spark, "part", "mask", "id", "a.b", "later").withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert told(audit.audit(extra, labels_of(spark))) == want
    assert told(audit.audit(cases.none(spark), labels_of(spark))) == []
    assert told(audit.audit(cases.odd(spark), labels_of(spark).limit(0))) == brute(rows, {})


def test_ids_may_be_strings(spark):
    rows = [("b", "t"), ("a", "t"), ("a", "t"), (None, "t"), (None, "u"), (None, "u")]
    marked = audit.masked(audit.narrow(spark.createDataFrame(rows, "doc_id string, text string").withColumn("lang", F.lit("en")), "doc_id", "text", "lang"), {})
    assert Counter((r.id, r["mask"]) for r in marked.collect()) == {("a", 0): 2, ("b", 1): 1, (None, 1): 1, (None, 0): 2}
