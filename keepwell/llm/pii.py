"""Operator 2: personal data by proposal, validation and context.

Regular expressions propose spans, checksum validators confirm them (Luhn for
cards, mod 97 for IBANs) and words nearby adjust a score.  The four base kinds
are fixed by their validators alone and always stay; the kinds that the method
adds are kept from a score of ``min_score`` on.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from keepwell.llm.common import map_batches

# The kinds in output order, base first.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "card_short")

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile("[0-9]")
SEPARATORS = str.maketrans("", "", " -().+")

# IBAN lengths by country, the whole registry.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18,
    "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23,
    "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

# Words that speak for or against a kind, within CONTEXT characters.
CONTEXT = 48
FOR = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "sozial", "seguridad"),
    "card_short": ("card", "visa", "amex", "credit", "carte", "karte", "tarjeta", "pay"),
}
AGAINST = ("isbn", "issn", "doi", "version", "serial", "order", "invoice", "sku")
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "card_short": 0.35}
MIN_SCORE = 0.5


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part's characters exclude '@', so each '@' decides alone; looking for those is linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            done = m.end()
            yield start, done
        at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            yield m.span()


def cards(text: str, low: int = 16, high: int = 19) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if low <= m.end() - m.start():
            digits = m[0].translate(SEPARATORS)
            if low <= len(digits) <= high and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= len(m[0].translate(SEPARATORS)) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        length = IBAN_LENGTH.get(plain[:2])
        if length and len(plain) > length:  # a group of the following text was taken along
            keep, seen = 0, 0
            for keep, c in enumerate(m[0], 1):
                seen += c != " "
                if seen == length:
                    break
            if m[0][keep : keep + 1] == " " and mod97(plain[:length]):
                yield m.start(), m.start() + keep
        elif length == len(plain) and mod97(plain):
            yield m.span()


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def free_of(taken: list[tuple[int, int]]):
    """Whether a span overlaps none of ``taken``: with their union in order, only the last that starts before its end can."""
    starts, ends = [], []
    for s, e in sorted(taken):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def free(x: tuple[int, int]) -> bool:
        i = bisect_left(starts, x[1]) - 1
        return i < 0 or ends[i] <= x[0]

    return free


def context_score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT) : start].lower() + " " + text[end : end + CONTEXT // 2].lower()
    words = set(re.findall(r"[a-zà-ÿ]+", near))
    score = PRIOR[kind]
    if any(w.startswith(p) for w in words for p in FOR[kind]):
        score += 0.3
    if any(w in AGAINST for w in words):
        score -= 0.3
    return min(1.0, max(0.0, round(score, 2)))


def find(text: str | None, min_score: float = MIN_SCORE) -> list[Span]:
    """All spans of a text in order of kind, then start (code points, end exclusive); of null and empty texts none."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [("email", *x) for x in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *x) for x in ips(text)]
        numbers = list(cards(text))
        out += [("card", *x) for x in numbers]
        if "+" in text:
            out += [("phone", *x) for x in phones(text)]
        free = free_of([(s, e) for _, s, e in out])
        out += [("iban", *x) for x in ibans(text)]
        out += [("ssn", *x) for x in ssns(text) if free(x)]
        out += [("card_short", *x) for x in cards(text, 13, 15) if free(x)]
    spans = [Span(kind, s, e, context_score(text, kind, s, e)) for kind, s, e in out]
    return [x for x in spans if x.kind in BASE or x.score >= min_score]


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind that starts first."""
    out, at = [], 0
    for x in sorted(spans, key=lambda x: (x.start, -x.end)):
        if x.start >= at:
            out += [text[at : x.start], f"[{x.kind.upper()}]"]
        at = max(at, x.end)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def detect(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, spans (kind, start, end, score), one row for each row of ``docs``, which has doc_id and text.

    Null and empty texts have no spans; equal texts have equal spans; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            found = [[x._asdict() for x in find(t, min_score)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, SPAN_TYPE)], ["doc_id", "spans"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) with each span masked and n_chars counted anew; null texts stay null."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = docs.select(*names)

    def run(batches):
        for b in batches:
            texts = [t and masked(t, find(t, min_score)) for t in b.column("text").to_pylist()]
            n = pa.array([old if t is None else len(t) for t, old in zip(texts, b.column("n_chars").to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), b.column("lang"), b.column("source"), n], names)

    return map_batches(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, lang string, source string, n_chars bigint")


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base kinds, all spans, and their scores in the same order, for each row of ``docs``.

    Null and empty texts have no spans: counts of 0, the digest of the empty
    text, and empty strings.  Equal texts have equal values, repeated rows each
    have their row, other columns are ignored, and an empty table has no rows.
    """
    counts = [f"n_{k}" for k in BASE]

    def run(batches):
        for b in batches:
            spans = [find(t) for t in b.column("text").to_pylist()]
            cols = [b.column("doc_id"), *[pa.array([sum(x.kind == k for x in s) for s in spans], pa.int64()) for k in BASE]]
            cols.append(pa.array([hashlib.sha256(spelled([x for x in s if x.kind in BASE]).encode()).hexdigest() for s in spans]))
            cols.append(pa.array(list(map(spelled, spans)), pa.string()))
            cols.append(pa.array([",".join(f"{x.score:.2f}" for x in s) for s in spans], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *counts, "base_sha256", "spans", "scores"])

    kinds = ", ".join(f"{c} bigint" for c in counts)
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}, base_sha256 string, spans string, scores string")
