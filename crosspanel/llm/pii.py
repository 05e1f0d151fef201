"""Personal data: expressions propose spans, checksums confirm them, nearby words move the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_records, query, table

# The kinds in the order spans are listed, the base ones first.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
_ORDER = {k: i for i, k in enumerate(KINDS)}

# Confidence of a confirmed span, and words nearby that raise it.
START_SCORE = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "credit", "payment", "tarjeta", "carte", "karte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
}
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.3
# a span of a kind outside the base is kept from this score on
KEEP_SCORE = 0.5

# A match of digits always starts where a run of digits starts, which keeps long runs linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The account-number check of ISO 13616: letters count 10 to 35, four first characters last, remainder 1."""
    rest = 0
    for c in code[4:] + code[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every local part reaches back from its @, as far as its characters go, but not into the match before."""
    low = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            low = m.end()
            yield start, low


def _propose(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of each kind that its own check confirms."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            yield "iban", m.start(), m.end()
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield "ssn", m.start(), m.end()


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - CONTEXT_CHARS):start]} {text[end:end + CONTEXT_CHARS // 2]}".lower()
    helped = not set(CONTEXT[kind]).isdisjoint(_WORD.findall(near))
    return min(1.0, START_SCORE[kind] + CONTEXT_GAIN * helped)


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed; code points, end exclusive."""
    if not text:
        return []
    found = [(k, a, b, _score(text, k, a, b)) for k, a, b in _propose(text)]
    return sorted((s for s in found if s[0] in BASE_KINDS or s[3] >= KEEP_SCORE), key=lambda s: (s[1], _ORDER[s[0]]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, spans array<struct<kind, start, end, score>>.

    A null or empty text has no spans, repeated rows give repeated results, an
    empty table an empty one; other columns are not read. One pass, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"

    def run(rows):
        for key, text in rows:
            yield key, [dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(text)]

    return map_records(docs.select(id_col, text_col), run, schema)


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, hash of the base spans, list of all spans, highest score."""
    named = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return find_pii(docs).select(
        "doc_id",
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.concat_ws(",", F.transform(of(*BASE_KINDS), named)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", named)).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii_digest(table(spark, sf_dir, "documents"))
