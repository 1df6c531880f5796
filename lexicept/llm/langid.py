"""Language identification by compression.

Each language is a zstandard raw-content dictionary: up to ``DICT_BYTES`` of
training text, case and punctuation folded. A folded text is cut into pieces of at most ``PIECE`` bytes (all of
them, to the end) and every piece is compressed with every dictionary; the
language whose dictionary gives the fewest bytes in total wins. Pieces keep
the dictionary in play however long the text is. When the runner-up needs
less than ``MIN_MARGIN`` more bytes than the winner, or the text has no
letter, the result is marked rejected.

The dictionaries come from a bounded sample of labelled rows: about
``SAMPLE_DOCS`` different texts per language, chosen by a hash of the text, a
window of at most ``SAMPLE_BYTES`` bytes of each, placed anywhere by another
hash. The texts of a language are counted over all training rows, copies once,
so a language held by few texts keeps all of them.

Defined cases: null, empty or letterless text is ``und`` with score 0 and
rejected; rows with null lang or text teach nothing; without any training row
every text is ``und``; equal sizes are settled by the language name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import collect_bounded
from .common import add_struct

SAMPLE_DOCS = 256
SAMPLE_BYTES = 2048
DICT_BYTES = 1 << 17
MAX_LANGUAGES = 512
#: zstandard search: lazy matching finds the dictionary's longer repeats without the cost of optimal parsing.
SEARCH = {"window_log": 18, "chain_log": 16, "hash_log": 17, "search_log": 3, "min_match": 4, "target_length": 16,
          "strategy": zstandard.STRATEGY_LAZY2}
PIECE = 4096
MIN_MARGIN = 0.02
UNKNOWN = "und"
_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
RESULT = "struct<lang_pred:string,score:double,margin:double,rejected:boolean>"


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionary per language from labelled rows (null labels and texts are left out)."""
    rows = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    different = rows.groupBy(lang_col).agg(F.approx_count_distinct(F.xxhash64(text_col)))  # copies teach once
    counts = {r[0]: max(1, r[1]) for r in collect_bounded(different, MAX_LANGUAGES, "language list")}
    if not counts:
        return {}
    rate = F.coalesce(
        *[F.when(F.col(lang_col) == F.lit(k), F.lit(min(1.0, SAMPLE_DOCS / n))) for k, n in sorted(counts.items())]
    )
    u = F.pmod(F.xxhash64(text_col), F.lit(1 << 30))
    data = F.encode(text_col, "utf-8")
    start = F.pmod(F.xxhash64(text_col, F.lit(5)), F.greatest(F.lit(1), F.octet_length(data) - SAMPLE_BYTES + 1))
    sample = rows.filter(u < rate * F.lit(1 << 30)).select(
        F.col(lang_col).alias("lang"), F.substring(data, (start + 1).cast("int"), F.lit(SAMPLE_BYTES)).alias("t"), u.alias("u")
    ).distinct()
    parts: dict[str, list[bytes]] = {}
    for r in sorted(collect_bounded(sample, 4 * SAMPLE_DOCS * len(counts), "language sample"), key=lambda r: (r["lang"], r["u"])):
        parts.setdefault(r["lang"], []).append(folded(bytes(r["t"]).decode("utf-8", "ignore")))
    return {k: b"".join(v)[:DICT_BYTES] for k, v in parts.items()}


def compressors(model: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    search = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **SEARCH)
    for lang, data in sorted(model.items()):
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=search)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=search)))
    return out


def folded(text: str) -> bytes:
    """Letters only: lower case, one space for every run of ASCII non-letters, a space at both ends."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "


def classify(text: str | None, packers: list, min_margin: float = MIN_MARGIN) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected) of one text."""
    if not text or not packers or not any(c.isalpha() for c in text):
        return UNKNOWN, 0.0, 0.0, True
    data = folded(text)
    pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
    sizes = sorted((sum(len(p.compress(x)) for x in pieces), lang) for lang, p in packers)
    best, lang = sizes[0]
    if len(sizes) == 1:
        return lang, 1.0, 1.0, False
    margin = (sizes[1][0] - best) / best
    # share of the winner when each saved byte doubles the odds
    score = 1.0 / sum(2.0 ** -min(1000, n - best) for n, _ in sizes)
    return lang, score if math.isfinite(score) else 0.0, margin, margin < min_margin


def language(text_col: str, model: dict[str, bytes], min_margin: float = MIN_MARGIN) -> Column:
    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packers = compressors(model)
        for texts in batches:
            rows = [classify(t.as_py(), packers, min_margin) for t in texts]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.StructArray.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())],
                names=["lang_pred", "score", "margin", "rejected"],
            )

    return run(F.col(text_col))


def identify(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", out_col: str = "language",
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with a struct column (lang_pred, score, margin, rejected); no shuffle, one result per row."""
    return add_struct(docs, out_col, language(text_col, model, min_margin))
