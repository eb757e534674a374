import random

import numpy as np

from quernstone.llm import decontam
from tests.llm.cases import ODD, clashing, none, odd


def fewest_edits(pattern, text):
    """Edits of the pattern to its nearest stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(draw, text, edits):
    out = list(text)
    for _ in range(edits):
        at = draw.randrange(len(out))
        kind = draw.randrange(3)
        if kind == 0:
            out[at] = draw.choice("xyz")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, draw.choice("xyz"))
    return "".join(out)


def fixture():
    draw = random.Random(11)
    say = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    items = [(i, say(draw.choice([45, 90, 150, 400]))) for i in range(8)]
    texts = []
    for i in range(60):
        _, item = draw.choice(items)
        kind = i % 4
        part = item if kind < 2 else item[20 : 20 + draw.choice([60, 260])]
        body = edited(draw, part, draw.choice([0, 1, 3, 6, 12])) if kind else ""
        texts.append((i, say(draw.choice([0, 30, 500])) + body.upper() + say(50)))
    return items, texts


def test_search_against_the_full_table():
    items, texts = fixture()
    segments = [s for i, t in items for s in decontam.segments_of(i, t)]
    index = decontam.Index(segments, decontam.EDIT_SHARE)
    got = {}
    for d, s, _, _, e in decontam.search([t for _, t in texts], index):
        got[d, s] = min(e, got.get((d, s), e))
    want = {}
    for d, (_, text) in enumerate(texts):
        low = decontam.folded(text)
        for s, plain in enumerate(index.plain):
            if (e := fewest_edits(plain, low)) <= index.budget[s]:
                want[d, s] = e
    assert got == want and len(want) > 15 and any(want.values())


def test_alignments_go_side_by_side(monkeypatch):
    """Edited passages of one slice are aligned in walks of many, with the edits that the full table gives."""
    draw, walks = random.Random(23), []
    one = decontam._aligned
    monkeypatch.setattr(decontam, "_aligned", lambda found: walks.append(len(found)) or one(found))
    say = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    items = [say(n) for n in (45, 70, 170, 240)]
    segments = [s for i, t in enumerate(items) for s in decontam.segments_of(i, t)]
    texts = [say(draw.randrange(30)) + edited(draw, draw.choice(items), draw.randrange(12)) + say(draw.randrange(30)) for _ in range(120)]
    for side in (decontam.ALIGNED, 7):
        monkeypatch.setattr(decontam, "ALIGNED", side)
        index = decontam.Index(segments, decontam.EDIT_SHARE)
        got = {}
        for d, s, _, _, e in decontam.search(texts, index):
            got[d, s] = min(e, got.get((d, s), e))
        want = {(d, s): e for d, t in enumerate(texts) for s, plain in enumerate(index.plain) if (e := fewest_edits(plain, t)) <= index.budget[s]}
        assert got == want and sum(map(bool, want.values())) > 50
        assert walks and max(walks) <= side and len(walks) == -(-sum(walks) // side)
        walks.clear()


def test_spans_hold_what_was_found(spark):
    items, texts = fixture()
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.matches(docs, bench).collect()
    low = {i: t.lower() for i, t in texts}
    for r in rows:
        if r["edits"] == 0:
            assert low[r["doc_id"]][r["start"] : r["end"]] in dict(items)[r["item_id"]]
    blocks = decontam.matches(docs, bench, block_chars=300).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, blocks))  # blocks change nothing
    kept = {r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()}
    assert kept == set(low) - {r["doc_id"] for r in rows}
    flagged = decontam.contaminated(docs, bench, block_chars=300)
    assert flagged.columns == ["doc_id", "text", "contaminated"]
    assert {r["doc_id"] for r in flagged.collect() if not r["contaminated"]} == kept


def test_every_occurrence_is_told(spark):
    item = "a passage of some sixty characters that a text may hold twice, or more often"
    text = f"start {item} and {item.upper()} middle {'x' * 70} {item[:30]}!{item[30:]} end"
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, item[:58])], "item_id long, text string")
    rows = decontam.matches(docs, bench).orderBy("start").collect()
    assert [r["edits"] for r in rows] == [0, 0, 1] and all(a["end"] <= b["start"] for a, b in zip(rows, rows[1:]))


def test_short_items_as_whole_words(spark):
    items = [(1, "42"), (2, " Blue Whale "), (3, "an exact answer of 38 characters here"), (4, " ")]
    texts = [(1, "it is 42."), (2, "it is 420"), (3, "a blue\twhale, a Blue Whale"), (4, "blue whales"), (5, "so: An exact answer of 38 characters here"), (6, "an exact answer of 38 characterz here"), (7, "42")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (10**6, 30):
        rows = decontam.matches(docs, bench, block_chars=size).collect()
        assert sorted((r["doc_id"], r["item_id"], r["start"], r["end"]) for r in rows) == [(1, 1, 6, 8), (3, 2, 2, 12), (3, 2, 16, 26), (5, 3, 4, 41), (7, 1, 0, 2)]


def test_large_ids_beside_null(spark):
    """Ids that a double can't hold stay as they are, in documents and in items."""
    big = 2**53 + 1
    item = "a passage that is long enough to be found with its q-grams, and then some"
    docs = spark.createDataFrame([(big, item), (None, item), (big + 2, "x " + item)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(big, item), (None, item)], "item_id long, text string").coalesce(1)
    rows = decontam.matches(docs, bench).select("doc_id", "item_id").distinct().collect()
    assert {tuple(r) for r in rows} == {(d, i) for d in (big, None, big + 2) for i in (big, None)}


def test_query_against_all_places(spark):
    """The query on all documents: exact matches at every place of every segment by string search, and no segment missing."""
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: decontam.text_of(decontam.codes(r["text"] or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    segments = [s for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for s in decontam.segments_of(r["item_id"], r["text"])]
    rows = decontam.op4_decontamination(spark, sf).collect()
    want = set()
    for item, _, c in segments:
        plain = decontam.text_of(c)
        for i, t in docs.items():
            at = t.find(plain)
            while at >= 0:
                want.add((i, item, at, at + len(plain)))
                at = t.find(plain, at + len(plain))
    assert {(r["doc_id"], r["item_id"], r["doc_start"], r["doc_end"]) for r in rows if not r["edits"]} == want and want
    lengths = {}
    for item, _, c in segments:
        lengths.setdefault(item, []).append(c)
    for r in rows:
        if r["edits"]:
            part = docs[r["doc_id"]][r["doc_start"] : r["doc_end"]]
            assert min(fewest_edits(decontam.text_of(c), part) for c in lengths[r["item_id"]]) <= r["edits"]


def test_gram_hashes_tell_equal_grams():
    c = decontam.codes("abcabcabcabcabcabc xyz")
    h = decontam.gram_hashes(c)
    grams = [bytes(c[i : i + decontam.Q]) for i in range(len(c) - decontam.Q + 1)]
    assert len(h) == len(grams) and len(np.unique(h)) == len(set(grams))


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox and that lazy dog of this town"), (2, None), (3, ""), (4, "short")], "item_id long, text string")
    left = decontam.decontaminate(odd(spark), bench).collect()
    assert len(left) == len(ODD) - 3 and not {1, 7} & {r["doc_id"] for r in left}  # the item "short" is a word of both texts of id 1
    assert decontam.decontaminate(odd(spark), bench.where("false")).count() == len(ODD)
    assert decontam.decontaminate(none(spark), bench).collect() == [] and decontam.matches(none(spark), bench).collect() == []
    rows = decontam.decontaminate(clashing(spark, "_contaminated", "item_id", "start"), bench).collect()
    assert {r["_contaminated"] for r in rows} == {"kept _contaminated"}


def test_quotations_at_any_place(spark):
    """Any quotation of SHORT + STEP - 1 characters is found, from short and long items alike; so is a whole item with edits."""
    draw = random.Random(17)
    say = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    least = decontam.SHORT + decontam.STEP - 1
    items = [(i, say(n)) for i, n in enumerate([95, 150, 233, 240, 241, 400, 900, 1501])]
    texts = []
    for _ in range(150):
        _, item = draw.choice(items)
        n = draw.randrange(least, min(len(item), 360) + 1)
        at = draw.randrange(len(item) - n + 1)
        texts.append((len(texts), say(draw.randrange(80)) + item[at : at + n].upper() + say(draw.randrange(80))))
    texts.append((len(texts), say(40) + items[2][1][:200] + say(40)))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.decontaminate(docs, bench).collect() == []
    assert {r["doc_id"] for r in decontam.matches(docs, bench).collect()} == {i for i, _ in texts}
