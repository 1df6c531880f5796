"""Secret scans with multipart credential linking.

Three base kinds (assignments, access identifiers, long hex runs) are found
by fixed patterns. The method looks for the parts of a credential: access
identifiers, secrets and endpoints, some of them too weak to report alone
(short assigned values, mixed-class random tokens, user names, URLs with a
host). Within a scope (a paragraph, and at most ``REACH`` characters away)
parts are joined as intervals: a weak part is reported only when a part of a
complementary kind lies within reach, and both are given the same link. A plain
web address completes a named secret or a token of all character classes, not
a hex run or another unnamed token, which in prose are commits and slugs; an
unnamed token must hold a run that looks random. Linked
parts do not overlap, and an unnamed token inside an endpoint is a piece of it
and no part; a token in the user part of a URL (before "@") is one, and the
endpoint is then what follows it. The join is one sorted sweep per document
that keeps the nearest partner of each kind, so its output is linear in the
number of parts.

Offsets are code points, end exclusive. Defined cases: null text is empty and
has no spans; whole texts of any length are searched; repeated rows get equal
results; of two added spans that overlap both may be reported, and redaction
covers their union; a column named like the result is replaced, others stay.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_struct

BASE_KINDS = ("assign", "access", "hex")
#: Kinds by number: base, then parts that need a partner: user names, unnamed tokens, endpoints with a credential of their
#: own or a service scheme, plain web addresses, short assigned values, unnamed tokens that no slug or digest looks like.
KINDS = (*BASE_KINDS, "user", "weak", "endpoint", "endpoint", "weak", "weak")
USER, TOKEN, ENDPOINT, SITE, SHORT, STRONG = 3, 4, 5, 6, 7, 8
REACH = 300
MIN_ENTROPY = 3.2
REDACTED = "[REDACTED]"

_ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_HEX_BYTES = bytes(0x78 if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x66 else 0x20 for c in range(256))
_HEX_RUN = b"x" * 24
# weak parts
_USER = re.compile(r"(?:user(?:name)?|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@+/_.-]{3,})", re.IGNORECASE | re.ASCII)
_WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
_DIGIT = re.compile(r"[0-9]")
_ENDPOINT = re.compile(r"(?:https?|jdbc:[a-z0-9]{1,20}|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+")
_USER_PART = re.compile(r"[a-z0-9]+(?::[a-z0-9]+)?://[^\s\"'<>/?#@]*@")
#: A web address that asks for a secret or names one.
_KEY_PARAMETER = re.compile(r"[?&;](?:access_?key|api_?key|key|token|secret|sig(?:nature)?|auth|password|pwd)=", re.IGNORECASE)
#: Runs without joints; one that is long and mixes letters and digits looks drawn at random.
_RUN = re.compile(r"[A-Za-z0-9+=]{12,}+")
_LOWER, _UPPER = re.compile(r"[a-z]"), re.compile(r"[A-Z]")
_BREAK = re.compile(r"\n[\x20\t\r]*\n")
#: Parts that complete each other.
PARTNERS = {"id": ("secret", "named"), "secret": ("id", "endpoint"), "named": ("id", "endpoint", "site"), "endpoint": ("secret", "named"), "site": ("named",)}
#: Roles by kind number, and by kind name for the first number of each.
ROLES = ("named", "id", "secret", "id", "secret", "endpoint", "site", "named", "named")
ROLE = dict(zip(KINDS[:6], ROLES, strict=False))
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("link", pa.int32())])
RESULT = "array<struct<kind:string,start:int,end:int,link:int>>"


def _assigned(text: str, lower: str) -> list[re.Match]:
    return list(_ASSIGN.finditer(text)) if any(k in lower for k in ("password", "passwd", "secret", "token", "api")) else []


def _base(text: str, assigned: list[re.Match]) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in assigned if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if _HEX_RUN in text.encode("utf-8", "replace").translate(_HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans as (start, kind rank, end), sorted."""
    return _base(text, _assigned(text, text.lower()))


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def token_kind(token: str) -> int | None:
    """STRONG, TOKEN, or None for an unnamed token that does not look like a secret; linear in the token."""
    mixed = [r for r in _RUN.findall(token) if _DIGIT.search(r) and (_LOWER.search(r) or _UPPER.search(r))]
    if not mixed or entropy(token) < MIN_ENTROPY:
        return None
    return STRONG if any(len(r) >= 16 and _LOWER.search(r) and _UPPER.search(r) for r in mixed) else TOKEN


def weak_parts(text: str, lower: str, assigned: list[re.Match], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that need a partner, outside the base spans."""
    found = []
    if any(k in lower for k in ("user", "login", "client", "account")):
        found += [(m.start(), USER, m.end(1)) for m in _USER.finditer(text)]
    # a short password may be any word; the other names also stand in prose ("secret: yes")
    found += [(m.start(), SHORT, m.end()) for m in assigned if len(m[1]) < 6 and (m[0][:4].lower() == "pass" or _DIGIT.search(m[1]))]
    urls = [m.span() for m in _ENDPOINT.finditer(text)] if "://" in text else []
    tokens = []
    if found or urls or any(k == 1 for _, k, _ in base):  # an unnamed token can only complete an identifier or an endpoint
        tokens = [(*m.span(), k) for m in _WEAK.finditer(text) if (k := token_kind(m[0]))]
    at = 0
    for s, e in urls:
        user = _USER_PART.match(text, s, e)
        host = user.end() if user else s
        while at < len(tokens) and tokens[at][1] <= s:
            found.append((tokens[at][0], tokens[at][2], tokens[at][1]))
            at += 1
        start = s
        plain = text.startswith("http", s) and not user and not _KEY_PARAMETER.search(text, s, e)
        while at < len(tokens) and tokens[at][0] < e:
            if tokens[at][1] <= host and tokens[at][0] > s:
                found.append((tokens[at][0], tokens[at][2], tokens[at][1]))
                start = host
            at += 1
        if start < e:
            found.append((start, SITE if plain else ENDPOINT, e))
    found += [(s, k, e) for s, e, k in tokens[at:]]
    starts = [s for s, _, _ in base]
    ends, most = [], 0
    for _, _, e in base:  # base spans may overlap: running maxima of their ends
        most = max(most, e)
        ends.append(most)
    free = []
    for s, k, e in sorted(found):
        i = bisect_left(starts, e)
        if not (i and ends[i - 1] > s):
            free.append((s, k, e))
    return free


def link(parts: list[tuple[int, int, int]], breaks: list[int], reach: int = REACH) -> list[int]:
    """For each part (sorted by start) the index of its nearest complementary part within reach and scope that does not overlap it, or -1.

    To the left the part of a role that ends last before the start (one sweep by ends), to the right the one that starts
    first after the end. Parts hold no scope break, so a nearest part in another scope has none of this scope behind it.
    """
    scope = [bisect_left(breaks, s) for s, _, _ in parts]
    role = [ROLES[k] for _, k, _ in parts]
    starts: dict[str, list[int]] = {r: [] for r in PARTNERS}
    order: dict[str, list[int]] = {r: [] for r in PARTNERS}
    for i, (s, _, _) in enumerate(parts):
        starts[role[i]].append(s)
        order[role[i]].append(i)
    by_end = sorted(range(len(parts)), key=lambda i: (parts[i][2], i))
    last: dict[str, int] = {}
    found, at = [], 0
    for i, (s, _, e) in enumerate(parts):
        while at < len(parts) and parts[by_end[at]][2] <= s:
            last[role[by_end[at]]] = by_end[at]
            at += 1
        best = (reach + 1, -1)
        for r in PARTNERS[role[i]]:
            j = last.get(r, -1)
            if j >= 0 and scope[j] == scope[i] and s - parts[j][2] < best[0]:
                best = (s - parts[j][2], j)
            k = bisect_left(starts[r], e)
            if k < len(order[r]) and scope[j := order[r][k]] == scope[i] and starts[r][k] - e < best[0]:
                best = (starts[r][k] - e, j)
        found.append(best[1])
    return found


def find(text: str | None, reach: int = REACH) -> list[tuple[str, int, int, int]]:
    """All reported spans by start, then kind: (kind, start, end, start of the linked part or -1)."""
    if not text:
        return []
    lower = text.lower()
    assigned = _assigned(text, lower)
    base = _base(text, assigned)
    parts = sorted(base + weak_parts(text, lower, assigned, base))
    if not parts:
        return []
    partner = link(parts, [m.start() for m in _BREAK.finditer(text)], reach)
    return [(KINDS[k], s, e, parts[j][0] if j >= 0 else -1) for (s, k, e), j in zip(parts, partner, strict=True) if k < 3 or j >= 0]


def spans(text_col: str, reach: int = REACH) -> Column:
    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("kind", "start", "end", "link")
        for texts in batches:
            yield pa.array([[dict(zip(names, x, strict=True)) for x in find(t.as_py(), reach)] for t in texts], pa.list_(_SPAN))

    return run(F.col(text_col))


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "secrets", reach: int = REACH) -> DataFrame:
    """``docs`` with an array column of spans (kind, start, end, link); no shuffle, one result per row."""
    return add_struct(docs, out_col, spans(text_col, reach))


def redacted(text: str | None, reach: int = REACH) -> str | None:
    """The text with every reported span replaced by ``REDACTED`` (overlapping spans once)."""
    parts, at = [], 0
    for _, s, e, _ in find(text, reach):
        if s >= at:
            parts += [text[at:s], REDACTED]
        at = max(at, e)
    return "".join(parts) + text[at:] if at else text


def redact(docs: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` with secrets replaced in the text; found and replaced in one pass, so a task needs one Python worker."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([redacted(t.as_py(), reach) for t in texts], pa.string())

    return docs.withColumn(text_col, run(F.col(text_col)))


def digest(docs: DataFrame, id_col: str = "doc_id", secrets_col: str = "secrets") -> DataFrame:
    """Counts per base kind, SHA-256 of the base spans, and all spans as text."""
    text = lambda a: F.array_join(
        F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    n = lambda k: F.size(F.filter(secrets_col, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(secrets_col, lambda s: s["kind"].isin(*BASE_KINDS))
    linked = F.size(F.filter(secrets_col, lambda s: s["link"] >= 0)).cast("long").alias("n_linked")
    return docs.select(id_col, *[n(k) for k in BASE_KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col(secrets_col)).alias("spans"), linked)
