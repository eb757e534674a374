import random
import re

from quernstone.llm import quality
from tests.llm.cases import ODD, clashing, none, odd

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice(["ab ", "c ", "d\n", "# ", "é😀 ", "\n"]) for _ in range(draw.choice([0, 5, 40, 300]))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.judge(df).collect():
        n, chars, symbols, dups, repeats = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dups, repeats)
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n)
        assert not (r["base_failed"] and r["kept"])


def test_odd_rows(spark):
    rows = quality.judge(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert all(r["base_failed"] and not r["kept"] for r in rows if not (r["text"] or "").strip())
    assert all((r["n_words"], r["n_repeat_words"]) == (brute(r["text"])[0], brute(r["text"])[4]) for r in rows)


def test_empty_and_clashing(spark):
    assert quality.judge(none(spark)).collect() == []
    rows = quality.judge(clashing(spark, "_words", "_lines", "_windows", "_at", "_starts", "kept", "N_Words")).collect()
    assert {r["_words"] for r in rows} == {"kept _words"} and all(isinstance(r["kept"], bool) for r in rows)


def test_plan_has_no_python_and_no_shuffle(spark):
    plan = quality.op2_quality(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
