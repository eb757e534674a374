"""Personal data by anchor expansion.

Two Aho-Corasick automata find anchors in a text: at-signs, schemes, plus signs, digits,
country codes and the beginnings of well-known keys in the text as it stands, and words
that announce an identifier in its lower case. Around an anchor a small parser takes the
longest stretch of its kind, checks it (label rules, number ranges, Luhn, length by
country, mod 97) and gives a span. Each stretch is parsed once, so the time is linear in
the text even where it is all digits or all at-signs.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.common import table

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds the method adds: URLs with their address, IBANs, announced account numbers, keys and announced secrets.
MORE_KINDS = ("url", "iban", "account", "secret")
KINDS = BASE_KINDS + MORE_KINDS

# Words that announce an account number or a secret, in lower case, and words that may stand
# between an announcement and its number.
ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "compte", "cuenta", "iban")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "access-key")
FILLERS = ("account", "number", "nummer", "numéro", "número", "num", "nr", "no", "is", "ist", "est", "es", "iban")
# Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}
# How well-known keys begin, and what follows.
KEY_SHAPES = {
    "AKIA": r"[0-9A-Z]{16}", "ASIA": r"[0-9A-Z]{16}", "AIza": r"[A-Za-z0-9_-]{35}", "ghp_": r"[A-Za-z0-9]{36}", "gho_": r"[A-Za-z0-9]{36}",
    "ghs_": r"[A-Za-z0-9]{36}", "glpat-": r"[A-Za-z0-9_-]{20}", "xoxb-": r"[A-Za-z0-9-]{20,}", "xoxp-": r"[A-Za-z0-9-]{20,}",
    "-----BEGIN ": r"[A-Z ]*PRIVATE KEY-----(?:(?!-----)[\s\S])*(?:-----END [A-Z ]*PRIVATE KEY-----)?",
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
SCHEME = LETTERS | frozenset("0123456789+.-")
LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS_DOTS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_REST = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
#: What may stand between an announcement and its number: marks and filler words, as many as there are.
GAP = re.compile(r"(?:[\s:#=.-]|(?:" + "|".join(sorted(FILLERS, key=len, reverse=True)) + r")(?![A-Za-z0-9]))*", re.IGNORECASE)
ACCOUNT = re.compile(r"[0-9](?:[\x20.-]?[0-9])*")
ACCOUNT_DIGITS = (6, 30)
SECRET = re.compile(r"[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_+/=-]{16,})")
NOT_ASCII_DIGIT = re.compile(r"[^0-9]")
ASCII_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@functools.cache
def automata():
    """Anchors of the text as it stands, and of its lower case."""
    import ahocorasick

    plain, low = ahocorasick.Automaton(), ahocorasick.Automaton()
    for mark in ("@", "://", "+", *"0123456789"):
        plain.add_word(mark, ("digit" if mark.isdigit() else mark, len(mark)))
    for country in IBAN_LENGTHS:
        plain.add_word(country, ("iban", 2))
    for begin in KEY_SHAPES:
        plain.add_word(begin, ("key", len(begin)))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            low.add_word(cue, (kind, len(cue)))
    plain.make_automaton()
    low.make_automaton()
    return plain, low


@functools.cache
def iban_of(country: str) -> re.Pattern:
    return re.compile(country + r"[0-9]{2}(?:\x20?[A-Z0-9]){" + str(IBAN_LENGTHS[country] - 4) + r"}(?![A-Za-z0-9])")


@functools.cache
def key_of(begin: str) -> re.Pattern:
    return re.compile(re.escape(begin) + KEY_SHAPES[begin] + ("" if begin.startswith("-") else r"(?![A-Za-z0-9])"))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def iban_ok(told: str) -> bool:
    flat = told.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def word_before(text: str, at: int) -> bool:
    """Whether a letter or digit stands right before ``at``, so that no word begins there."""
    return at > 0 and text[at - 1].isalnum()


def _email(text: str, at: int, done: int) -> tuple[int, int] | None:
    start = at
    while start > done and text[start - 1] in LOCAL:
        start -= 1
    labels = LABELS.match(text, at + 1) if start < at else None
    return (start, labels.end()) if labels else None


def _ips(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Addresses in the chain of digit groups and dots that starts here, four groups each, and its end."""
    chain = DIGITS_DOTS.match(text, at)
    groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", chain.group())] if "." in chain.group() else []
    out = []
    for i in range(0, len(groups) - 3, 4):
        four = groups[i : i + 4]
        parts = [chain.group()[a:b].lstrip("0") for a, b in four]
        if all(len(p) <= 3 and (not p or int(p) <= 255) for p in parts):
            out.append((at + four[0][0], at + four[3][1]))
    return out, chain.end()


def _url(text: str, at: int, done: int) -> tuple[int, int] | None:
    """The address around ``://``: a scheme that begins with a letter, and what follows up to the last character that isn't punctuation."""
    start = at
    while start > done and text[start - 1] in SCHEME:
        start -= 1
    while start < at and text[start] not in LETTERS:
        start += 1
    rest = URL_REST.match(text, at + 3) if start < at else None
    end = at + 3 + len(rest.group().rstrip(".,;:!?)")) if rest else 0
    return (start, end) if end > at + 3 else None


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in one text, in code points, end exclusive, in order."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return spans
    plain, low = automata()
    done = dict.fromkeys(("email", "ip", "card", "url", "iban", "account", "secret"), 0)
    for last, (anchor, length) in plain.iter(text):
        at = last - length + 1
        if anchor == "digit":
            if at >= done["ip"]:
                got, done["ip"] = _ips(text, at)
                spans["ip"] += got
            if at >= done["card"]:
                got = CARD.match(text, at)
                done["card"] = got.end() if got else at + 1
                if got and 16 <= len(d := NOT_ASCII_DIGIT.sub("", got.group())) <= 19 and luhn(d):
                    spans["card"].append(got.span())
        elif anchor == "@":
            if got := _email(text, at, done["email"]):
                spans["email"].append(got)
                done["email"] = got[1]
        elif anchor == "+":
            got = PHONE.match(text, at)
            if got and 8 <= len(NOT_ASCII_DIGIT.sub("", got.group())) <= 15:
                spans["phone"].append(got.span())
        elif anchor == "://":
            if at >= done["url"] and (got := _url(text, at, done["url"])):
                spans["url"].append(got)
                done["url"] = got[1]
        elif anchor == "iban":
            if at >= done["iban"] and not word_before(text, at) and (got := iban_of(text[at : at + 2]).match(text, at)) and iban_ok(got.group()):
                spans["iban"].append(got.span())
                done["iban"] = got.end()
        elif at >= done["secret"] and not word_before(text, at) and (got := key_of(text[at : last + 1]).match(text, at)):
            spans["secret"].append(got.span())
            done["secret"] = got.end()
    # keys by their shape, in order; announced ones come in order too, and both are merged at the end
    keys, told_keys, next_key, taken, upto = spans["secret"], [], 0, {a for a, _ in spans["iban"]}, 0
    lower = text.lower()
    for last, (anchor, length) in low.iter(lower if len(lower) == len(text) else text.translate(ASCII_LOWER)):
        at, end = last - length + 1, last + 1
        if anchor == "account":
            if at < done["account"] or word_before(text, at) or text[end : end + 1].isalnum():
                continue
            begin = GAP.match(text, end).end()
            number = ACCOUNT.match(text, begin) if begin > end and begin not in taken else None
            done["account"] = number.end() if number else begin
            if number and ACCOUNT_DIGITS[0] <= len(NOT_ASCII_DIGIT.sub("", number.group())) <= ACCOUNT_DIGITS[1] and not text[number.end() : number.end() + 1].isalpha():
                spans["account"].append(number.span())
        elif at >= upto and (got := SECRET.match(text, end)):
            upto = got.end()
            while next_key < len(keys) and keys[next_key][1] <= got.start(1):
                next_key += 1
            if next_key == len(keys) or got.end(1) <= keys[next_key][0]:
                told_keys.append(got.span(1))
    spans["secret"] = list(heapq.merge(keys, told_keys))
    return spans


def told(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


#: Columns that are added, and their types.
FACTS = {"n_email": pa.int64(), "n_ip": pa.int64(), "n_card": pa.int64(), "n_phone": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "n_spans": pa.int64()}


def facts(text: str | None) -> tuple:
    """The values of ``FACTS`` for one text."""
    spans = find(text)
    base, more = told(spans, BASE_KINDS), told(spans, MORE_KINDS)
    counts = tuple(len(spans[k]) for k in BASE_KINDS)
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for x in (base, more) if x), sum(map(len, spans.values())))


def detect(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` with counts, digest and spans of personal data.

    ``spans`` lists kind:start:end by kind, then start; ``n_spans`` counts all of them. A null
    or empty text has none. Whole texts are searched, whatever their length; rows are
    independent, repeated rows give equal results, an empty table an empty one. Columns
    stay in Arrow as they are, and those named like an added one are replaced.
    """
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in FACTS]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} {'long' if t == pa.int64() else 'string'}" for c, t in FACTS.items()])
    place = kept.index(text_col) if text_col in kept else len(kept)
    columns = kept if text_col in kept else [*kept, text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [facts(t) for t in batch.column(place).to_pylist()]
            added = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(FACTS.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *added], names=[*kept, *FACTS])

    return docs.select(*[f"`{c}`" for c in columns]).mapInArrow(run, schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    return detect(table(spark, sf_dir, "documents"), keep=["doc_id"])
