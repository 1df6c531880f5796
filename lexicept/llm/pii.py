"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (e-mail, IPv4, payment card, phone) follow fixed patterns and
validators (octet range, Luhn, digit count). The method adds IBANs confirmed
by the mod-97 check, and national numbers written 3-2-4 that only count next
to a word that names them. Every span gets a score: a prior per kind, raised
when a context word of the kind stands within ``CONTEXT_CHARS`` characters
before it and lowered after a word like "example" or "version".

Offsets are code points, end exclusive. Defined cases: null text is empty and
has no spans; whole texts are searched whatever their length (all patterns
are linear in the text); repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_struct

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national")
CONTEXT_CHARS = 40
MIN_SCORE = 0.5

# Prior score per kind, context words that raise or lower it.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.95, "national": 0.3}
RAISING = {
    "email": ("mail", "contact", "write to", "courriel"), "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"), "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national": ("ssn", "social security", "national id", "tax id"),
}
LOWERING = ("example", "version", "isbn", "order no", "invoice")


def _whole(words: tuple[str, ...]) -> re.Pattern:
    """Any of the words, standing alone (an added s or number is part of it)."""
    return re.compile(r"(?<![^\W_])(?:" + "|".join(words) + r")s?(?![^\W\d_])")


_RAISES, _LOWERS = {k: _whole(w) for k, w in RAISING.items()}, _whole(LOWERING)

# Possessive runs keep each scan linear and match what the plain greedy pattern matches.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
RESULT = "array<struct<kind:string,start:int,end:int,score:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost e-mail matches: the run of local characters before an @, then the domain."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)  # no match can cross an @ that was not one itself
        at = text.find("@", done)
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans, by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = (text[max(0, start - CONTEXT_CHARS):start] + " | " + text[end:end + CONTEXT_CHARS]).lower()
    s = PRIOR[kind]
    if _RAISES[kind].search(near):
        s = min(1.0, s + 0.3)
    if _LOWERS.search(near):
        s -= 0.3
    return round(max(0.0, s), 2)


def find(text: str | None, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float]]:
    """All spans with scores: base spans always, added kinds when their score reaches ``min_score``."""
    if not text:
        return []
    out = [(k, s, e, _score(k, text, s, e)) for k, s, e in base_spans(text)]
    added = [("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m[0])]
    added += [("national", *m.span()) for m in _NATIONAL.finditer(text)]
    out += [(k, s, e, v) for k, s, e in added if (v := _score(k, text, s, e)) >= min_score]
    return out


def spans(text_col: str, min_score: float = MIN_SCORE) -> Column:
    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("kind", "start", "end", "score")
        for texts in batches:
            yield pa.array([[dict(zip(names, x, strict=True)) for x in find(t.as_py(), min_score)] for t in texts], pa.list_(_SPAN))

    return run(F.col(text_col))


def detect(docs: DataFrame, text_col: str = "text", out_col: str = "pii", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with an array column of spans (kind, start, end, score); no shuffle, one result per row."""
    return add_struct(docs, out_col, spans(text_col, min_score))


def digest(docs: DataFrame, id_col: str = "doc_id", pii_col: str = "pii") -> DataFrame:
    """Counts per base kind, SHA-256 of the base spans, and all spans as text."""
    text = lambda a: F.array_join(
        F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    n = lambda k: F.size(F.filter(pii_col, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(pii_col, lambda s: s["kind"].isin(*BASE_KINDS))
    best = F.coalesce(F.array_max(F.transform(pii_col, lambda s: s["score"])), F.lit(0.0)).alias("top_score")
    return docs.select(id_col, *[n(k) for k in BASE_KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col(pii_col)).alias("spans"), best)


def digest_of(text: str | None) -> str:
    """The digest's base hash for one text (used by tests)."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text or "")).encode()).hexdigest()
