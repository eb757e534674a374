"""SentencePiece encoding and decoding with merge-type (BPE) vocabularies.

A text is normalised (spaces become ``▁``, one more in front), cut into symbols of one
character, and the adjacent pair of symbols whose joint piece has the highest score is
merged, again and again. An agenda holds the pairs in the order of their scores, the
leftmost of equals first; a merge links its neighbours anew and puts at most two more pairs
on it, so a text of n characters takes O(n log n) steps. What no piece covers falls back to
its UTF-8 bytes.

Merges never cross a place where no piece of the vocabulary has its two characters side by
side, so a text is first cut at such places: in common vocabularies before each run of ``▁``,
long stretches also elsewhere. Short stretches that are new are encoded together: those of one
length are rows of a table of symbols, beside it a table with the cost of each neighbouring
pair, which is their agenda, and each step merges the first of all rows' agendas. Their ids
are kept in a bounded cache.

In each Arrow batch, all stretches that were not in the cache are also encoded by the
sentencepiece library, and each row tells whether the ids of all its stretches agree. The
model file is read on the driver and its bytes are broadcast: their number does not depend on
the data.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import add

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from quernstone.llm.common import free_name, table

MODEL = "piece_bpe_32k.model"
#: What the format itself fixes: the sign for a space, and what stands for an unknown piece.
SPACE, UNKNOWN = "▁", " ⁇ "
#: Stretches kept with their ids in each of two generations, and the characters of one that is kept.
CACHED, SHORT = 200_000, 48
#: Characters of texts whose ids are held as Python numbers at once.
AT_ONCE = 2_000_000
#: Stretches that are compared with the library as one text.
COMPARED = 200
NONE = np.int64(1) << 62
BPE = proto.TrainerSpec.BPE
KIND = proto.ModelProto.SentencePiece


class Vocabulary:
    """Pieces, their scores and what follows from them."""

    def __init__(self, model: bytes):
        spec = proto.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != BPE:
            raise ValueError("the vocabulary is not of the merge type")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only vocabularies that leave characters and spaces as they are can be read")
        if any(p.type in (KIND.USER_DEFINED, KIND.UNUSED) for p in spec.pieces):
            raise ValueError("pieces defined by users or unused ones are not supported")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in spec.pieces]
        self.id = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == KIND.NORMAL}
        #: the best score comes first
        self.cost = {p.piece: -p.score for p in spec.pieces if p.type == KIND.NORMAL}
        self.control = {i for i, p in enumerate(spec.pieces) if p.type == KIND.CONTROL}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == KIND.UNKNOWN)
        bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == KIND.BYTE}
        self.byte_of = {i: b for b, i in bytes_.items()}
        self.byte_id = [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None
        self.end = next(i for i, p in enumerate(spec.pieces) if p.piece == (spec.trainer_spec.eos_piece or "</s>"))
        #: what decoding gives for each piece that is text
        self.shown = [p.replace(SPACE, " ") for p in self.pieces]
        several = Counter(self.cost.values())
        #: characters of pieces that cost the same as others: of these the leftmost merge comes first, whichever it is
        self.tied = {c for p, cost in self.cost.items() if several[cost] > 1 for c in p}
        self.beyond = len(self.pieces)
        #: the symbol of each character: its id, or its code beyond all ids
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.beyond
        for p, i in self.id.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        name = lambda p: self.id.get(p, int(self.symbol[ord(p)]) if len(p) == 1 else None)
        order = {c: i for i, c in enumerate(sorted(several))}
        pairs = {a << 21 | b: order[self.cost[p]] << 21 | i for p, i in self.id.items() for k in range(1, len(p)) if (a := name(p[:k])) is not None and (b := name(p[k:])) is not None}
        #: pairs of neighbours as left * 2**21 + right, and what their merge costs with its id, the cost first
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merge = np.array([pairs[k] for k in self.pairs.tolist()] + [NONE], np.int64)
        self.special = self.control | {self.unknown}
        #: pieces as decoding joins them: bytes beyond ASCII as single surrogates, which no text holds
        self.joined = [(chr(b) if b < 128 else chr(0xDC00 + b)) if (b := self.byte_of.get(i)) is not None else t for i, t in enumerate(self.shown)]
        #: stretches on which the library was found to differ
        self.disputed: set[str] = set()
        self.beside = {a + b for p in self.id for a, b in zip(p, p[1:])}
        inside = any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if not inside else re.compile(r"(?s).+")
        #: whether a text without runs of spaces has one stretch for each word
        self.words = self.prefix and not inside
        #: ids (4 bytes each) of short stretches met lately, and of those met before them: what is asked for stays, the rest goes
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        return ((SPACE if self.prefix else "") + text.replace(" ", SPACE)) if text else ""

    def cost_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 21 | right
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == key, self.merge[at], NONE)

    def merged_rows(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of one length that hold one character of ``tied`` pieces at most."""
        symbols = self.symbol[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1)]
        agenda = self.cost_of(symbols[:, :-1], symbols[:, 1:])
        out: list[bytes] = [b""] * len(texts)
        row = np.arange(len(texts))
        while len(row):
            width = symbols.shape[1]
            if width > 1:
                at = agenda.argmin(1)
                best = agenda[np.arange(len(row)), at]
                going = best != NONE
            else:
                going = np.zeros(len(row), bool)
            done = np.flatnonzero(~going)
            told, step = symbols[done].astype(np.int32).tobytes(), 4 * width
            for i, r in enumerate(row[done].tolist()):
                out[r] = told[i * step : (i + 1) * step]
            for r in row[done[symbols[done].max(1) >= self.beyond]].tolist() if len(done) else ():
                ids = np.frombuffer(out[r], np.int32).tolist()
                out[r] = packed(self.ids_of([self.pieces[x] if x < self.beyond else chr(x - self.beyond) for x in ids]))
            if not going.any():
                break
            row, symbols, agenda, at, best = row[going], symbols[going], agenda[going], at[going], best[going]
            every, joint = np.arange(len(row)), best & 0x1FFFFF
            symbols[every, at] = joint
            behind = np.arange(width - 1)
            symbols = np.take_along_axis(symbols, behind + (behind > at[:, None]), 1)
            left = behind[: width - 2]
            agenda = np.take_along_axis(agenda, left + (left >= at[:, None]), 1)
            some = np.flatnonzero(at > 0)
            agenda[some, at[some] - 1] = self.cost_of(symbols[some, at[some] - 1], joint[some])
            some = np.flatnonzero(at < width - 2)
            agenda[some, at[some]] = self.cost_of(joint[some], symbols[some, at[some] + 1])
        return out

    def merged(self, text: str) -> list[str]:
        """Symbols of a stretch after all merges."""
        symbols: list[str] = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        cost = self.cost.get
        agenda = [(c, i, i + 1, joint) for i, joint in enumerate(map(add, text, text[1:])) if (c := cost(joint)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, joint = heapq.heappop(agenda)
            # a pair of which a symbol has grown or gone since is out of date
            if after[left] != right or symbols[left] + symbols[right] != joint:
                continue
            symbols[left], symbols[right] = joint, ""
            behind, ahead = after[right], before[left]
            after[left], after[right] = behind, -2
            if behind >= 0:
                before[behind] = left
                longer = joint + symbols[behind]
                if (c := cost(longer)) is not None:
                    heapq.heappush(agenda, (c, left, behind, longer))
            if ahead >= 0:
                longer = symbols[ahead] + joint
                if (c := cost(longer)) is not None:
                    heapq.heappush(agenda, (c, ahead, left, longer))
        return [s for s in symbols if s]

    def ids_of(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            i = self.id.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in s.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)  # neighbouring unknown symbols are one piece
        return out

    def alone(self, text: str) -> list[int]:
        """Ids of one stretch of any length."""
        text = self.full(text)
        cuts = [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in self.beside]
        found: list[int] = []
        for start, end in zip([0, *cuts], [*cuts, len(text)]):
            self.join(found, self.ids_of(self.merged(text[start:end])))
        return found

    def prepare(self, stretches: set[str]) -> list[str]:
        """Put the ids of these stretches, which the cache lacks, into it; gives those that are new, but for long ones, which it never holds."""
        older, new = self.older, []
        for s in stretches:
            ids = older.get(s)
            if ids is not None:
                self.cache[s] = ids
            elif len(s) <= SHORT:
                new.append(s)
        groups: dict[int, list[str]] = {}
        for s in new:
            if self.one_tied(s):
                groups.setdefault(len(s), []).append(s)
            else:
                self.cache[s] = packed(self.alone(s))
        for names in groups.values():
            words = [s for s in names if not s.startswith(SPACE)]
            whole = [s for s in names if s.startswith(SPACE)]
            if words:
                self.cache.update(zip(words, self.merged_rows([SPACE + w for w in words] if self.words else words)))
            if whole:
                self.cache.update(zip(whole, self.merged_rows(whole)))
        return new

    def one_tied(self, stretch: str) -> bool:
        if self.tied == {SPACE}:
            return stretch.count(SPACE) <= stretch.startswith(SPACE)
        return sum(map(self.full(stretch).count, self.tied)) < 2

    def full(self, stretch: str) -> str:
        """A stretch with the sign for a space in front, which is left out where each has just one."""
        return SPACE + stretch if self.words and not stretch.startswith(SPACE) else stretch

    def join(self, out: list[int], ids: list[int]) -> None:
        """Put ids behind others; without byte pieces, unknown symbols on both sides of a cut are one piece."""
        out += ids[1:] if not self.byte_id and out and out[-1] == self.unknown == ids[0] else ids

    def stretches(self, text: str) -> list[str]:
        """The stretches of a text, without the sign for a space in front where each has just one."""
        if self.words and text and SPACE not in text:
            words = text.split(" ")
            if "" not in words:
                return words
        return self.stretch.findall(self.normal(text))

    def encode_all(self, texts: list[str], library: sentencepiece.SentencePieceProcessor | None = None) -> tuple[np.ndarray, list[int]]:
        """Ids of whole texts, one after the other and each with the end id behind it, and how many each has."""
        cut = [self.stretches(t) for t in texts]
        lacks = {s for stretches in cut for s in stretches if s not in self.cache}
        if len(self.cache) + len(lacks) > CACHED:  # what this turns over is looked up again
            self.cache, self.older = {}, self.cache
            lacks = set(chain.from_iterable(cut))
        new = self.prepare(lacks)
        if library is not None:
            self.compare(new + [s for s in lacks if len(s) > SHORT], library)
        end, out, counts, found = packed([self.end]), [], [], self.cache.__getitem__
        for stretches in cut:
            try:
                parts = list(map(found, stretches))
            except KeyError:  # a long one
                parts = [self.cache.get(s) or packed(self.alone(s)) for s in stretches]
            told = b"".join(parts) if self.byte_id else packed(self.joined_up(parts))
            out += (told, end)
            counts.append(len(told) // 4 + 1)
        return np.frombuffer(b"".join(out), np.int32), counts

    def joined_up(self, parts: list[bytes]) -> list[int]:
        out: list[int] = []
        for part in parts:
            self.join(out, np.frombuffer(part, np.int32).tolist())
        return out

    def compare(self, stretches: list[str], library: sentencepiece.SentencePieceProcessor) -> None:
        """Stretches one after the other are a text, which the library must encode alike; where it doesn't, each is looked at alone."""
        told = lambda some: "".join(map(self.full, some))[self.prefix :].replace(SPACE, " ")
        own = lambda s: self.cache.get(s) or packed(self.alone(s))
        open_ended = [s for s in stretches if s.endswith(SPACE)]  # the next stretch would go on with it
        closed = [s for s in stretches if not s.endswith(SPACE)] if open_ended else stretches
        doubtful = open_ended
        for i in range(0, len(closed), COMPARED):
            some = closed[i : i + COMPARED]
            parts = [own(s) for s in some]
            ids = b"".join(parts) if self.byte_id else packed(self.joined_up(parts))
            if np.asarray(library.encode_as_numpy(told(some)), np.int32).tobytes() != ids:
                doubtful = doubtful + some
        word = packed(self.alone(self.normal("x")))  # spaces alone are no text to the library, but behind a word they are
        behind = lambda s: packed(library.encode("x" + self.full(s).replace(SPACE, " "), num_threads=1))
        self.disputed |= {s for s in doubtful if self.full(s).startswith(SPACE) and behind(s) != word + own(s)}

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text with the end id behind them."""
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD one by one."""
        ended = ids[:-1] if ids and ids[-1] == self.end else ids
        if self.special.isdisjoint(ended):
            text = "".join(map(self.joined.__getitem__, ended))
            try:
                text.encode()
            except UnicodeEncodeError:  # it holds bytes beyond ASCII
                try:
                    text = text.encode(errors="surrogateescape").decode()
                except UnicodeDecodeError:
                    return self.decode_each(ids)
            return text[1:] if self.prefix and text.startswith(" ") and ended[0] not in self.byte_of else text
        return self.decode_each(ids)

    def decode_all(self, ids: np.ndarray, counts: list[int]) -> Iterator[str]:
        """Texts of ids one after the other, as ``encode_all`` gives them."""
        end = 0
        for count in counts:
            end += count
            yield self.decode(ids[end - count : end].tolist())

    def decode_each(self, ids: list[int]) -> str:
        """The same id by id, for control and unknown pieces and for bytes that are no UTF-8."""
        out, run, shown, byte_of = [], bytearray(), self.shown, self.byte_of
        at_start, empty = True, True
        for i in ids:
            b = byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(utf8(bytes(run)))
                run.clear()
                at_start = empty = False
            if i in self.control:
                continue
            text = UNKNOWN if i == self.unknown else shown[i]
            if at_start and i != self.unknown and self.prefix and text.startswith(" "):
                text = text[1:]
                at_start = False
            if text:
                empty = False
            at_start = at_start and empty
            out.append(text)
        if run:
            out.append(utf8(bytes(run)))
        return "".join(out)


def packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def utf8(run: bytes) -> str:
    """Bytes as text, one U+FFFD for each byte that is not part of a well-formed character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            width = 1 if run[i] < 0x80 else 2 if run[i] >> 5 == 6 else 3 if run[i] >> 4 == 14 else 4 if run[i] >> 3 == 30 else 1
            try:
                out.append(run[i : i + width].decode())
                i += width
            except UnicodeDecodeError:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    """One vocabulary a worker process and model."""
    return Vocabulary(model)


@lru_cache(maxsize=2)
def library(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encoded(spark: SparkSession, text: Column, model: bytes, back: bool = False) -> Column:
    """Struct of ``ids`` (with the end id) and ``agrees``: whether the library gives the same ids; with ``back`` also ``decoded``, the text of the ids.

    A user function after another is a second Python worker for each task, with a vocabulary and
    words of its own: what is wanted back is decoded where it was encoded.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<ids: array<int>, agrees: boolean" + ", decoded: string" * back + ">")
    def encode(texts: pa.Array) -> pa.Array:
        own, other = vocabulary(shared.value), library(shared.value)
        flat, lengths, agrees, decoded = [], [], [], []
        start = size = 0
        for i, length in enumerate(pc.utf8_length(texts).to_pylist()):
            size += length or 0
            if size >= AT_ONCE or i == len(texts) - 1:
                part = [t or "" for t in texts[start : i + 1].to_pylist()]
                ids, ends = own.encode_all(part, other)
                flat.append(ids)
                lengths += ends
                if back:
                    decoded.append(pa.array(own.decode_all(ids, ends), pa.string()))
                # a text is disputed if it holds a disputed stretch; there is none as long as both agree
                agrees += [not own.disputed or own.disputed.isdisjoint(own.stretches(t)) for t in part]
                start, size = i + 1, 0
        offsets = np.zeros(len(lengths) + 1, np.int32)
        np.cumsum(lengths, out=offsets[1:])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
        if back:
            texts_back = pa.concat_arrays(decoded) if decoded else pa.array([], pa.string())
            return pa.StructArray.from_arrays([ids, pa.array(agrees, pa.bool_()), texts_back], ["ids", "agrees", "decoded"])
        return pa.StructArray.from_arrays([ids, pa.array(agrees, pa.bool_())], ["ids", "agrees"])

    return encode(text)


def decoded(spark: SparkSession, ids: Column, model: bytes) -> Column:
    """Text of an array of ids."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        own = vocabulary(shared.value)
        flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
        each = (own.decode(flat[a:b].tolist()) if there else None for a, b, there in zip(at, at[1:], lists.is_valid().to_pylist()))
        return pa.array(each, pa.string())

    return decode(ids)


def encode(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", agrees_col: str = "agrees", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text and whether the library agrees; with a ``decoded_col`` also the text that ``decode`` gives for the ids.

    A null text counts as empty, which gives the end id alone. Rows are encoded one by one:
    repeated rows get equal ids, null ids are nothing special, an empty table gives an empty
    one, texts may be of any length (the agenda of a stretch without a cut is as long as the
    stretch). Columns already named like an added one are replaced.
    """
    names = {ids_col: "ids", agrees_col: "agrees"} | ({decoded_col: "decoded"} if decoded_col else {})
    docs = docs.drop(*[c for c in names if c != text_col])
    both = free_name(docs, "_encoded")
    out = docs.withColumn(both, encoded(docs.sparkSession, F.col(f"`{text_col}`"), model, bool(decoded_col)))
    return out.withColumns({c: F.col(both)[field] for c, field in names.items()}).drop(both)


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; no ids give no text (null), no id at all the empty text."""
    return rows.drop(out).withColumn(out, decoded(rows.sparkSession, F.col(f"`{ids_col}`"), model))


def digests(rows: DataFrame) -> list[Column]:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("agrees")]


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded; ``agrees`` tells whether the library gave the same ids."""
    model = read_model(public_tokenizers.path(MODEL))
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded_col="decoded")
    return rows.select("doc_id", *digests(rows))
