"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quernstone.llm import pieces
from tests.llm import cases

SF = "/root/testdata/sf0.001"
MODEL = pieces.read_model(public_tokenizers.path(pieces.MODEL))
PARTS = list("abc the▁  \n\té😀梦ﬁ\u0000.,!'12345ing") + ["▁▁", "  ", "    ", "the", "ation", "<s>", "</s>", "<unk>", "<0x41>", "\r\n", "́", "‍"]


@pytest.fixture(scope="module")
def own():
    return pieces.Vocabulary(MODEL)


@pytest.fixture(scope="module")
def library():
    return pieces.library(MODEL)


def test_texts_agree(own, library):
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30)))
        ids = library.encode(text, add_eos=True)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)


def test_any_ids_decode_alike(own, library):
    """Also ids that no text gives: broken characters, control pieces within, the unknown piece."""
    draw = random.Random(2)
    for _ in range(5000):
        ids = [draw.choice([0, 1, 2, 3, 195, 172, 243, 259, 260, 29871, 300, draw.randint(3, 258), draw.randint(259, 31999)]) for _ in range(draw.randint(0, 9))]
        assert own.decode(ids) == library.decode(ids)


def test_long_stretches(own, library):
    """One word of 200,000 letters, and spaces without end."""
    for text in ("a" * 200_000, "ab" * 50_000 + "c", " " * 30_000, "\n" * 5_000, "no cut " * 10_000):
        assert own.encode(text) == library.encode(text, add_eos=True)


def test_cache_turns_over(own, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED", 3)
    text = " ".join(f"word{i % 5} x{i}" for i in range(200))
    assert own.encode(text) == library.encode(text, add_eos=True)
    assert len(own.cache) <= 403


def test_query_against_library(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) for r in pieces.op13_sentencepiece(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for row in docs:
        ids = library.encode(row.text or "", add_eos=True)
        assert got[row.doc_id] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), True)
    assert len(got) == len(docs)


def test_query_decodes_where_it_encodes(spark):
    """A second Python step would be a second worker with a vocabulary and a cache of its own for each task."""
    plan = pieces.op13_sentencepiece(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_decoded_beside_ids(spark, monkeypatch):
    """Encoding gives the texts that decoding gives, over several slices of a batch, and under any name."""
    monkeypatch.setattr(pieces, "AT_ONCE", 50)
    docs = cases.clashing(spark, "ids", "decoded", "_encoded")
    rows = pieces.decode(pieces.encode(docs, MODEL, decoded_col="back"), MODEL).collect()
    assert len(rows) == len(cases.ODD) and all(r.back == r.decoded and r.back is not None for r in rows)
    assert pieces.encode(cases.none(spark), MODEL, decoded_col="decoded").collect() == []


def test_odd_rows(spark, library):
    docs = cases.clashing(spark, "ids", "agrees", "decoded", "_encoded", "a.b").withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    rows = pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()
    assert len(rows) == len(cases.ODD)
    for row in rows:
        ids = library.encode(row.text or "", add_eos=True)
        assert (row.ids, row.agrees, row.decoded, row["_encoded"], row["a.b"]) == (ids, True, library.decode(ids), "kept _encoded", "kept a.b")
    assert pieces.encode(cases.none(spark), MODEL).collect() == []
    nothing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert sorted(pieces.decode(nothing, MODEL).select("decoded").collect(), key=str) == [("",), (None,)]


def test_other_vocabularies_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(MODEL)
    spec.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError, match="merge type"):
        pieces.Vocabulary(spec.SerializeToString())


def test_without_bytes_unknown_symbols_are_one_piece():
    """A vocabulary without byte pieces: neighbouring unknown symbols, also across cuts, are one unknown piece."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(MODEL)
    kept = [p for p in spec.pieces if p.type != p.BYTE]
    del spec.pieces[:]
    spec.pieces.extend(kept)
    spec.trainer_spec.byte_fallback = False
    model = spec.SerializeToString()
    own, library = pieces.Vocabulary(model), pieces.library(model)
    for text in ("a 𐎀𐎁 𐎂b", "𐎀", "𐎀𐎁𐎂 𐎃", "x\n\ny", "the 𐎀the"):
        ids = library.encode(text, add_eos=True)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)
