"""Text preparation: tokens with positions, contraction expansion, keyword helpers.

All of it is native string/regex/array expressions evaluated row by row
(no shuffle); only ``subword_tokens`` runs Python, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizing import MODEL_MAX_ROWS, collect_bounded

# Fixed value: word-token pattern (letters in any script).
TOKEN_PATTERN = r"\p{L}+"

#: Texts that a Python worker turns into tokens, vectors or hits before it hands them on: bounds its memory, whatever the batch.
TEXTS_AT_A_TIME = 256


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def contraction_rules(contractions: DataFrame | list | None) -> list[tuple[str, str]]:
    if contractions is None:
        return []
    if isinstance(contractions, DataFrame):
        rows = collect_bounded(contractions.select("contraction", "expansion"), MODEL_MAX_ROWS, "contraction table")
        return [(r[0].lower(), r[1].lower()) for r in rows]
    return [(a.lower(), b.lower()) for a, b in contractions]


def expand_contractions_expr(text, rules: list[tuple[str, str]]) -> Column:
    """Rewrite whole-word contractions (on already lower-cased text).

    Rules are literal text. Each contraction first becomes a marker (its rule
    number between two private-use characters) and all markers are expanded
    at the end, so no rule sees another rule's expansion. Plain searches and
    one combined ``rlike`` test gate the work.
    """
    t = _c(text)
    if not rules:
        return t
    literal = [r"\b\Q" + src.replace(r"\E", r"\E\\E\Q") + r"\E\b" for src, _ in rules]
    out = t
    for i, p in enumerate(literal):
        out = F.regexp_replace(out, F.lit(p), F.lit(f"\ue000{i}\ue001"))
    for i, (_, dst) in enumerate(rules):
        out = F.replace(out, F.lit(f"\ue000{i}\ue001"), F.lit(dst))
    # a plain search first: most texts hold no contraction, and the combined pattern is slow to find none
    held = reduce(lambda a, b: a | b, [t.contains(src) for src, _ in rules])
    return F.when(held, F.when(t.rlike("|".join(literal)), out).otherwise(t)).otherwise(t)


def prepared_text(text, max_chars: int | None = None, contractions=None) -> Column:
    """lower(text), optional first-``max_chars`` window, optional contraction expansion.

    A null text yields null, which tokenises to no tokens.
    """
    t = _c(text)
    if max_chars is not None:
        t = F.substring(t, 1, int(max_chars))
    t = F.lower(t)
    return expand_contractions_expr(t, contraction_rules(contractions))


def token_array(text, pattern: str = TOKEN_PATTERN, max_chars: int | None = None, contractions=None) -> Column:
    return F.regexp_extract_all(prepared_text(text, max_chars, contractions), F.lit(pattern), 0)


def tokenize(df: DataFrame, id_col: str, text_col: str, pattern: str = TOKEN_PATTERN, max_chars: int | None = None,
             contractions=None, keep: list[str] | None = None) -> DataFrame:
    """(id..., pos, token): one row per token occurrence, 0-based position, map-side only.

    ``id_col`` is a column name or a list of key columns.
    """
    keep = keep or []
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    arr = token_array(text_col, pattern, max_chars, contractions)
    return df.select(*ids, *keep, F.posexplode(arr).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


def tokenize_prefix(df: DataFrame, id_col: str, text_col: str, max_chars: int = 512, pattern: str = TOKEN_PATTERN) -> DataFrame:
    """Tokens of the first ``max_chars`` characters (the encoder's input window)."""
    return tokenize(df, id_col, text_col, pattern, max_chars=max_chars)


def expand_contractions(df: DataFrame, text_col: str, contractions, out_col: str | None = None) -> DataFrame:
    rules = contraction_rules(contractions)
    return df.withColumn(out_col or text_col, expand_contractions_expr(F.lower(F.col(text_col)), rules))


def keyword_filter(df: DataFrame, text_col: str, keyword: str) -> DataFrame:
    """Rows whose text contains the keyword (case-insensitive), text lower-cased."""
    low = F.lower(F.col(text_col))
    return df.filter(low.contains(keyword.lower())).withColumn(text_col, low)


def keyword_append(df: DataFrame, text_col: str, keyword: str, id_col: str | None = None) -> DataFrame:
    """Add the bare keyword as one more row (its id is null)."""
    spark = df.sparkSession
    schema = df.select(*( [id_col] if id_col else []), text_col).schema
    extra = spark.createDataFrame([tuple([None] * (1 if id_col else 0) + [keyword.lower()])], schema)
    return df.select(*([id_col] if id_col else []), text_col).unionByName(extra)


def first_keyword_token(df: DataFrame, id_col: str, text_col: str, keyword: str, pattern: str = TOKEN_PATTERN) -> DataFrame:
    """Per text, the first token that contains the keyword, with its position.

    A per-row array expression: no explode, no shuffle.
    """
    toks = token_array(text_col, pattern)
    indexed = F.transform(toks, lambda t, i: F.struct(i.cast("long").alias("pos"), t.alias("token")))
    hit = F.try_element_at(F.filter(indexed, lambda s: s["token"].contains(keyword.lower())), F.lit(1))
    return df.select(id_col, hit.alias("hit")).filter(F.col("hit").isNotNull()).select(id_col, "hit.pos", "hit.token")


def space_length(text) -> Column:
    """Number of single-space chunks (empty chunks included)."""
    return F.size(F.split(_c(text), " ", -1)).cast("long")


def subword_tokens(df: DataFrame, id_col: str, text_col: str, pieces: DataFrame, piece_col: str = "piece",
                   pattern: str = TOKEN_PATTERN, unknown: str = "[UNK]", max_chars: int | None = None) -> DataFrame:
    """Greedy longest-match subword split over a user piece list (continuations carry '##').

    Words come from the native tokenizer; only the per-word greedy split runs in
    an Arrow UDF, some texts at a time, against a size-checked broadcast piece set.
    """
    spark = df.sparkSession
    vocab = frozenset(r[0] for r in collect_bounded(pieces.select(piece_col), 1_000_000, "piece list"))
    bc = spark.sparkContext.broadcast(vocab)

    def split_one(w: str, v: frozenset) -> list:
        start, parts = 0, []
        while start < len(w):
            end = len(w)
            piece = None
            while end > start:
                cand = w[start:end] if start == 0 else "##" + w[start:end]
                if cand in v:
                    piece = cand
                    break
                end -= 1
            if piece is None:
                return [unknown]
            parts.append(piece)
            start = end
        return parts

    def split(words: pa.Array, v: frozenset) -> pa.Array:
        # one split per distinct word of the texts at hand; the pieces are dealt out by position, not as Python strings
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        found = [split_one(w, v) for w in coded.dictionary.to_pylist()]
        counts = np.array([len(p) for p in found], np.int64)
        first, many = (np.cumsum(counts) - counts)[codes], counts[codes]
        ends = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat(first - ends[:-1], many) + np.arange(ends[-1])
        pieces = pa.array([p for parts in found for p in parts], pa.string()).take(pa.array(at, pa.int64()))
        return pa.ListArray.from_arrays(pa.array(ends[np.concatenate([[0], np.cumsum(sizes)])], pa.int32()), pieces)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = bc.value
        for whole in batches:
            for at in range(0, len(whole), TEXTS_AT_A_TIME):
                yield split(whole.slice(at, TEXTS_AT_A_TIME), v)

    arr = split_words(token_array(text_col, pattern, max_chars))
    return df.select(id_col, F.posexplode(arr).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
