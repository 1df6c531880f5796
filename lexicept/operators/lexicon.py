"""Lexicon matching and per-text category counts.

Matching rule (ours; the reference delegates it to an external parser): a
pattern ``p*`` matches every token starting with ``p``; any other pattern
matches the token exactly; a token takes the union of the categories of all
patterns it matches, once per (token position, category).

Plan. The lexicon is a user dictionary: it is size-checked and broadcast.
It is first *minimised*: a (pattern, category) row is dropped when a prefix
pattern of the same category already covers it (``in*`` covers ``into``
and ``int*``). After that, a token matches at most one pattern per
category, so joining token occurrences with the lexicon yields each
(position, category) exactly once and no ``distinct`` (no shuffle of hit
rows) is needed. Prefix patterns are matched by generating, per token, the
candidate prefixes of the few prefix lengths the lexicon uses, and probing
the broadcast hash table with them.

Counting stays in the text's row: an Arrow UDF probes the distinct tokens of
a batch and adds up their hits per text and category, so no token or hit
becomes a row; one aggregate folds repeated ids in the only shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizing import MODEL_MAX_ROWS, collect_bounded, lookup_join, maybe_broadcast
from ..functions.vectors import l2_normalize, vector_sum
from ..sources.readers import read_lexicon
from .text import TEXTS_AT_A_TIME, TOKEN_PATTERN, token_array, tokenize


CONDITIONAL_COUNT_MAX_CATEGORIES = 64


def category_subset(lexicon: DataFrame, min_ord: int = 21, categories: list[str] | None = None) -> DataFrame:
    """Keep categories from position ``min_ord`` on (the reference drops the first 21), or a given list."""
    if categories is not None:
        return lexicon.filter(F.col("category").isin(categories))
    return lexicon.filter(F.col("ord") >= min_ord)


_COMPILED_SCHEMA = "category string, pattern string, is_prefix boolean, stem string"


def _minimise_rows(rows: list) -> list:
    """Drop (pattern, category) rows covered by another prefix pattern of the same category (bounded lexicon rows)."""
    stems: dict = {}
    for r in rows:
        if r["is_prefix"]:
            stems.setdefault(r["category"], set()).add(r["stem"])
    kept = []
    for r in rows:
        own = stems.get(r["category"], set())
        s = r["stem"]
        # a prefix pattern is covered by a strictly shorter stem, an exact word by any stem it starts with
        top = len(s) if r["is_prefix"] else len(s) + 1
        if not any(s[:i] in own for i in range(top)):
            kept.append(r)
    return kept


def compile_lexicon(lexicon: DataFrame, minimise: bool = True) -> tuple[DataFrame, list[int]]:
    """A lexicon ready to probe: (broadcastable table, prefix lengths in use).

    The dictionary is brought to the driver once through a bounded collect
    (that collect is its size check), minimised there, and rebuilt as a
    local table, so the main query broadcasts a relation of proven size and
    the prefix lengths come without another job.
    """
    lex = read_lexicon(lexicon) if "is_prefix" not in lexicon.columns else lexicon
    rows = collect_bounded(lex.select("category", "pattern", "is_prefix", "stem"), MODEL_MAX_ROWS, "lexicon")
    if minimise:
        rows = _minimise_rows(rows)
    lens = sorted({len(r["stem"]) for r in rows if r["is_prefix"]})
    table = lexicon.sparkSession.createDataFrame([tuple(r) for r in rows], _COMPILED_SCHEMA)
    return table, lens


def _candidates(token_col: str, lens: list[int]):
    """Array of (is_prefix, key) probes for one token."""
    t = F.col(token_col)
    exact = F.array(F.struct(F.lit(False).alias("is_prefix"), t.alias("key")))
    if not lens:
        return exact
    lens_arr = F.array(*[F.lit(n) for n in lens])
    pref = F.transform(
        F.filter(lens_arr, lambda n: n <= F.length(t)),
        lambda n: F.struct(F.lit(True).alias("is_prefix"), F.substring(t, F.lit(1), n).alias("key")),
    )
    return F.concat(exact, pref)


def _probe(rows: DataFrame, token_col: str, table: DataFrame, lens: list[int], extra: list[str]) -> DataFrame:
    probes = rows.withColumn("_probe", F.explode(_candidates(token_col, lens)))
    side = F.broadcast(table.select(F.col("is_prefix").alias("_ip"), F.col("stem").alias("_key"), *extra))
    hit = probes.join(side, (F.col("_probe.is_prefix") == F.col("_ip")) & (F.col("_probe.key") == F.col("_key")))
    return hit.drop("_probe", "_ip", "_key")


def match_tokens(tokens: DataFrame, lexicon: DataFrame, token_col: str = "token") -> DataFrame:
    """Token rows x minimised lexicon -> one row per (token row, category) hit."""
    table, lens = compile_lexicon(lexicon)
    return _probe(tokens, token_col, table, lens, ["category"])


def pattern_matches(words: DataFrame, lexicon: DataFrame, word_col: str = "word") -> DataFrame:
    """(word, category, pattern) for every pattern a word matches (lexicon not minimised)."""
    table, lens = compile_lexicon(lexicon, minimise=False)
    rows = words.select(F.col(word_col).alias("word"))
    return _probe(rows, "word", table, lens, ["category", "pattern"]).select("word", "category", "pattern")


def word_categories(words: DataFrame, lexicon: DataFrame, word_col: str = "word") -> DataFrame:
    """Vocabulary word -> its categories, (word, category), each pair once."""
    return match_tokens(words.select(F.col(word_col).alias("token")), lexicon).select(
        F.col("token").alias("word"), "category"
    )


def category_words(word_cats: DataFrame, word_vectors: DataFrame, token_col: str = "token") -> DataFrame:
    """(category, word) restricted to words that have a vector (left semi join)."""
    vocab = word_vectors.select(F.col(token_col).alias("word"))
    return lookup_join(word_cats, vocab, "word", ["word", "category"], "left_semi").select("category", "word")


def _stem_probes(table: list, lens: list[int], targets: Callable) -> list[tuple]:
    """(prefix length or None, stems, first place in ``which`` per stem, which): what a stem's rows stand for, by length."""
    probes = []
    for n in [None, *lens]:
        found: dict[str, list[int]] = {}
        for r in table:
            if (len(r["stem"]) if r["is_prefix"] else None) == n:
                found.setdefault(r["stem"], []).extend(targets(r))
        if found:
            counts = [len(v) for v in found.values()]
            probes.append((n, list(found), np.array([0, *np.cumsum(counts)]), np.concatenate([*found.values()]).astype(np.int64)))
    return probes


def _probed(words: pa.Array, codes: np.ndarray, probes: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token, what its stem stands for) of all hits, as two arrays per probe; the distinct ``words`` are probed once."""
    for n, stems, first, which in probes:
        keys = words if n is None else pc.utf8_slice_codeunits(words, 0, n)
        stem = pc.fill_null(pc.index_in(keys, value_set=pa.array(stems, words.type)), -1).to_numpy(zero_copy_only=False)[codes]
        hit = np.flatnonzero(stem >= 0)
        stem, many = stem[hit], first[stem[hit] + 1] - first[stem[hit]]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        yield np.repeat(hit, many), which[np.repeat(first[stem], many) + step]


def _count_matches(table: list, lens: list[int], categories: list[str]):
    """UDF: a text's tokens -> hits per category, and as last element the hits of all categories together.

    A batch's tokens are encoded by their distinct values once; the values are probed like rows (whole, and by their prefixes of
    the lengths in use) and the hits counted by text in one pass.
    """
    place = {c: i for i, c in enumerate(categories)}
    width = len(categories) + 1
    probes = _stem_probes(table, lens, lambda r: [place[r["category"]], width - 1] if r["category"] in place else [width - 1])

    def count(tokens: pa.Array) -> np.ndarray:
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        text = np.repeat(np.arange(len(tokens)), sizes) * width
        out = np.zeros(len(tokens) * width, np.int64)
        for hit, what in _probed(words, codes, probes):
            out += np.bincount(text[hit] + what, minlength=len(out))
        return out

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            for at in range(0, len(whole), TEXTS_AT_A_TIME):
                tokens = whole.slice(at, TEXTS_AT_A_TIME)
                ends = pa.array(np.arange(len(tokens) + 1) * width, pa.int32())
                yield pa.ListArray.from_arrays(ends, pa.array(count(tokens), pa.int64()))

    return counts


def packed_hits(tokens: Column, lexicon: DataFrame) -> Column:
    """A text's token array -> its hits as (category, word, places) entries, one for each category and word it holds.

    ``places`` are the word's positions in the text, ascending. Hits stay in their text's row; each (position, category) is there once.
    """
    table, lens = compile_lexicon(lexicon)
    table = list({(r["category"], r["is_prefix"], r["stem"]): r for r in table.collect()}.values())  # a row may come twice
    categories = sorted({r["category"] for r in table})
    place = {c: i for i, c in enumerate(categories)}
    probes = _stem_probes(table, lens, lambda r: [place[r["category"]]])

    def find(tokens: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        found = [*_probed(words, codes, probes), (np.zeros(0, np.int64), np.zeros(0, np.int64))]
        at, cat = (np.concatenate(x) for x in zip(*found, strict=True))
        text, pos = np.repeat(np.arange(len(tokens)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((at, codes[at], cat, text[at]))
        at, cat = at[order], cat[order]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(text[at]) != 0) | (np.diff(cat) != 0) | (np.diff(codes[at]) != 0)
        first = np.flatnonzero(new)
        entries = pa.StructArray.from_arrays(
            [pa.array(categories, pa.string()).take(pa.array(cat[first], pa.int64())), words.take(pa.array(codes[at[first]], pa.int64())),
             pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(pos[at], pa.int32()))],
            names=["category", "word", "places"])
        per_text = np.bincount(text[at[first]], minlength=len(tokens))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32()), entries)

    @F.arrow_udf("array<struct<category: string, word: string, places: array<int>>>")
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            for at in range(0, len(whole), TEXTS_AT_A_TIME):
                yield find(whole.slice(at, TEXTS_AT_A_TIME))

    return hits(tokens)


def lexicon_hits(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 pattern: str = TOKEN_PATTERN, contractions=None, max_chars: int | None = None) -> DataFrame:
    """(id, pos, token, category) for every lexicon hit in every text."""
    toks = tokenize(docs, id_col, text_col, pattern, max_chars=max_chars, contractions=contractions)
    return match_tokens(toks, lexicon)


def lexicon_counts_wide(docs: DataFrame, lexicon: DataFrame, categories: list[str], id_col: str = "doc_id",
                        text_col: str = "text", binary: bool = False, pattern: str = TOKEN_PATTERN,
                        contractions=None, keep: list[str] | None = None, max_chars: int | None = None,
                        fill_missing: bool = True) -> DataFrame:
    """One row per text, one count column per category (0 when absent), lexicon order.

    ``fill_missing=False`` leaves out texts without any hit.
    """
    keep = keep or []
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    table, lens = compile_lexicon(lexicon)
    counts = _count_matches(table.collect(), lens, categories)  # local rows, bounded by the compile
    # every text is counted in its row: one narrow row per text meets the aggregate, which folds repeated ids
    rows = docs.select(*ids, counts(token_array(text_col, pattern, max_chars, contractions)).alias("_n"))
    if not fill_missing:
        rows = rows.filter(F.col("_n")[len(categories)] > 0)
    wide = rows.groupBy(*ids).agg(*[F.sum(F.col("_n")[i]).alias(c) for i, c in enumerate(categories)])
    if binary:
        wide = wide.select(*ids, *[(F.col(c) > 0).cast("long").alias(c) for c in categories])
    if keep:  # ids may be null or repeated: every input row gets its own counts
        right = wide.select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)], *categories)
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_id{i}")) for i, c in enumerate(ids)])
        wide = docs.select(*ids, *keep).join(right, same, "left").select(*ids, *keep, *categories)
    return wide


def lexicon_counts(docs: DataFrame, lexicon: DataFrame, categories: list[str], id_col: str = "doc_id",
                   text_col: str = "text", binary: bool = False, pattern: str = TOKEN_PATTERN,
                   contractions=None, value_col: str = "n") -> DataFrame:
    """Long, zero-filled ``(id, category, n)``: the wide counts unpivoted map-side."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    wide = lexicon_counts_wide(docs, lexicon, categories, ids, text_col, binary, pattern, contractions)
    return wide.unpivot(ids, categories, "category", value_col)


def category_vectors(lexicon: DataFrame, word_vectors: DataFrame, token_col: str = "token",
                     vec_col: str = "embedding") -> DataFrame:
    """Per category, the sum of unit vectors of its in-vocabulary words: (category, cluster 0, centroid)."""
    wv = word_vectors.select(F.col(token_col).alias("word"), l2_normalize(vec_col).alias("u"))
    wc = word_categories(wv.select("word"), lexicon)
    joined = wc.join(wv, "word")
    return joined.groupBy("category").agg(vector_sum("u").alias("centroid")).select(
        "category", F.lit(0).alias("cluster"), "centroid"
    )


def token_category_scores(lexicon: DataFrame, categories: DataFrame, word_vectors: DataFrame,
                          token_col: str = "token", vec_col: str = "embedding") -> tuple[DataFrame, list[str]]:
    """S[t, c] = unit(t) . (sum of unit vectors of c's words), one row per vocabulary token, one column per category."""
    from .represent import concept_matrix, ordered_categories

    cats = ordered_categories(categories)
    wv = word_vectors.select(F.col(token_col).alias("token"), l2_normalize(vec_col).alias("u"))
    cat_vec = category_vectors(lexicon, word_vectors, token_col, vec_col)
    return concept_matrix(wv, cat_vec, categories, "token", "u", metric="dot"), cats


def soft_lexicon_counts_wide(docs: DataFrame, lexicon: DataFrame, categories: DataFrame, word_vectors: DataFrame,
                             id_col: str = "doc_id", text_col: str = "text", pattern: str = TOKEN_PATTERN,
                             contractions=None, token_col: str = "token", vec_col: str = "embedding") -> DataFrame:
    """Sum over tokens and over a category's words of cosine(token vector, word vector), wide.

    Rewritten as sum over tokens of S[t, c] with S = unit(t) . sum_w unit(w):
    the vocabulary-sized table S is computed once, joined to the token
    occurrences (broadcast when size-checked small, else a shuffle join), and
    each text sums C plain doubles -- no token x vocabulary product, no
    d-dimensional aggregation. An out-of-vocabulary token contributes 0; a
    text without in-vocabulary tokens scores 0 everywhere.
    """
    scores, cats = token_category_scores(lexicon, categories, word_vectors, token_col, vec_col)
    toks = tokenize(docs.select(id_col, text_col), id_col, text_col, pattern, contractions=contractions)
    if len(cats) <= CONDITIONAL_COUNT_MAX_CATEGORIES:
        scores = scores.persist(StorageLevel.MEMORY_AND_DISK)  # sized, then joined: score the vocabulary once
        hits = lookup_join(toks, scores, "token", [id_col, "pos"]).select(id_col, *cats)
        base = docs.select(id_col, *[F.lit(None).cast("double").alias(c) for c in cats])
        summed = hits.unionByName(base).groupBy(id_col).agg(*[F.sum(c).alias(c) for c in cats])
        return summed.select(id_col, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cats])
    # wide lexicons: each token carries its C scores as one vector, summed per id in one buffer; like above, a zero row
    # per text keeps ids without hits, and null or repeated ids make one group each
    vec = scores.select("token", F.array(*[F.col(c) for c in cats]).alias("s")).persist(StorageLevel.MEMORY_AND_DISK)
    hits = lookup_join(toks, vec, "token", [id_col, "pos"]).select(id_col, "s")
    base = docs.select(id_col, F.array_repeat(F.lit(0.0), len(cats)).alias("s"))
    per_text = hits.unionByName(base).groupBy(id_col).agg(vector_sum("s").alias("s"))
    return per_text.select(id_col, *[F.col("s")[i].alias(c) for i, c in enumerate(cats)])


def soft_lexicon_counts(docs: DataFrame, lexicon: DataFrame, categories: DataFrame, word_vectors: DataFrame,
                        id_col: str = "doc_id", text_col: str = "text", pattern: str = TOKEN_PATTERN,
                        contractions=None, token_col: str = "token", vec_col: str = "embedding",
                        value_col: str = "score") -> DataFrame:
    """Long form ``(id, category, score)`` of ``soft_lexicon_counts_wide`` (map-side unpivot)."""
    from .represent import ordered_categories

    wide = soft_lexicon_counts_wide(docs, lexicon, categories, word_vectors, id_col, text_col, pattern, contractions,
                                    token_col, vec_col)
    return wide.unpivot([id_col], ordered_categories(categories), "category", value_col)


def counts_with_targets(wide_counts: DataFrame, targets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Wide count table with the label columns attached by key (texts without labels keep nulls)."""
    return wide_counts.join(targets, id_col, "left")

