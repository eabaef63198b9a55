"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Base kinds are email, ip, card and phone; a base span that its own rule confirms always stays. The method adds
``iban`` (mod-97) and ``ssn`` (accepted only with a context word beside it) where the score reaches ``threshold``.
Matching takes linear time in a text's length: emails are found from their ``@`` outwards, digit runs are entered
at their start only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.common import arrow_map

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
THRESHOLD = 0.5
#: Characters on either side of a span in which context words count.
CONTEXT = 40
#: Words that make a kind likelier nearby.
WORDS = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "telephone", "call", "tel", "mobile", "telefon", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "insurance"),
}
#: A pattern's own worth, and what a passed checksum and a context word add.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.2, "ssn": 0.3}
CHECKED, NEARBY = 0.5, 0.25

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
NEARBY_WORD = {kind: re.compile(rf"(?<!\w)(?:{'|'.join(words)})(?!\w)", re.IGNORECASE) for kind, words in WORDS.items()}
DIGITS = re.compile(r"[^0-9]+")
DIGIT = re.compile("[0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The first four characters go to the end, letters become numbers from 10, and the remainder must be 1."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping ``local@domain``: each ``@`` with a domain after it and the longest local part before."""
    free, at = 0, text.find("@")
    while at >= 0:
        nxt = at + 1
        if at > free and text[at - 1] in LOCAL and (m := DOMAIN.match(text, at + 1)):
            start = at - 1
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            yield start, m.end()
            free = nxt = m.end()
        at = text.find("@", nxt)


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed base spans, by kind and start. A match that fails its rule is dropped whole."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text) if "." in text else ():
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := DIGITS.sub("", m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(DIGITS.sub("", m[0])) <= 15:
            yield "phone", *m.span()


def _nearby(text: str, kind: str, a: int, b: int) -> bool:
    """A context word of the kind, whole and in any case, within CONTEXT characters of a span."""
    near = NEARBY_WORD[kind]
    if near.search(text, max(0, a - CONTEXT), a):
        return True
    m = near.search(text, b, b + CONTEXT + 1)
    return m is not None and m.end() <= b + CONTEXT


def find(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of a text (null: none) in the order of KINDS and then of starts; ends are exclusive."""
    if not text:
        return []
    out = []
    for kind, a, b in base_spans(text):
        score = PRIOR[kind] + (CHECKED if kind == "card" else 0) + NEARBY * _nearby(text, kind, a, b)
        out.append(Span(kind, a, b, min(1.0, score)))
    if DIGIT.search(text):
        for kind, pattern, check in (("iban", IBAN, mod97), ("ssn", SSN, None)):
            for m in pattern.finditer(text):
                score = PRIOR[kind] + (CHECKED if check and check(m[0]) else 0) + NEARBY * _nearby(text, kind, *m.span())
                if (check is None or score >= PRIOR[kind] + CHECKED) and score >= threshold:
                    out.append(Span(kind, *m.span(), min(1.0, score)))
    return out


def redact(text: str | None, spans: list[Span]) -> str | None:
    """Each span replaced by its kind in angle brackets; overlapping ones by the first kind."""
    if not spans:
        return text
    parts, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind))):
        if s.start >= at:
            parts += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join([*parts, text[at:]])


def detect(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, spans array<struct<kind,start,end,score>>)`` of every row; a null text has no spans."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[s._asdict() for s in find(t, threshold)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, spans)], ["doc_id", "spans"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def mask(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with redacted texts and, where there is a column n_chars, their new lengths; null texts stay null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column("text").to_pylist()
            new = [redact(t, find(t, threshold)) for t in old]
            cols = {n: b.column(n) for n in names} | {"text": pa.array(new, pa.string())}
            if "n_chars" in cols:
                kept = cols["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([k if x == y else len(y) for k, x, y in zip(kept, old, new, strict=True)], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return arrow_map(docs, run, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of each document's spans, from ``detect``, a row each, repeated rows included.

    A null or empty text has no spans; an empty table gives no rows; columns other than doc_id and text are ignored.
    """
    found = detect(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    text = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    counts = [count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
