"""Reference corpus: lexicon hits in a corpus, and the weights they give each corpus row.

The reference builds ``(category, word, word_idx, sentence)`` pairs,
de-duplicates them, then merges them back onto the corpus *by sentence
text*. A corpus row therefore weighs (distinct hit positions of its text in
the category) x (number of rows carrying that exact text). Grouping the
hits of every row by its own key gives the same weights without ever
joining on long text values: identical texts have identical hits, so the
per-row count already equals the de-duplicated hits that the text merge
would hand to each of those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centroids import mean_centroids
from ..sources.readers import read_lexicon
from .lexicon import lexicon_counts_wide, lexicon_hits, match_tokens, packed_hits
from .text import TOKEN_PATTERN, token_array, tokenize


def reference_pairs(corpus: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    max_chars: int | None = None, pattern: str = TOKEN_PATTERN, with_text: bool = False,
                    packed: bool = False) -> DataFrame:
    """(id, category, word, word_idx, sentence_key): one row per (token position, category) hit.

    ``sentence_key`` is a SHA-256 digest of the text, computed once per text
    and carried through tokenising, so a hit row holds 32 bytes instead of
    the sentence and no join back to the texts is needed. ``with_text=True``
    attaches the sentence by key. ``max_chars`` reproduces an encoder input
    window (the reference uses 512); the default reads whole texts.
    ``packed=True`` leaves the hits in their text's row: (id, sentence_key, hits), every row of the corpus once, its hits as in
    ``packed_hits``; ``dedupe_pairs`` takes both forms.
    """
    keyed = corpus.select(id_col, text_col).withColumn("sentence_key", F.sha2(F.col(text_col), 256))
    if packed:
        hits = packed_hits(token_array(text_col, pattern, max_chars), lexicon).alias("hits")
        return keyed.select(id_col, "sentence_key", hits, *([F.col(text_col).alias("sentence")] if with_text else []))
    toks = tokenize(keyed, id_col, text_col, pattern, max_chars=max_chars, keep=["sentence_key"])
    pairs = match_tokens(toks, lexicon).select(
        id_col, "category", F.col("token").alias("word"), F.col("pos").alias("word_idx"), "sentence_key"
    )
    if with_text:
        pairs = pairs.join(keyed.select(id_col, F.col(text_col).alias("sentence")), id_col)
    return pairs


def dedupe_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct (category, word, word_idx, sentence), compared through the sentence key.

    Packed pairs (of one lexicon, pattern and window) meet by text: a text's hits are the same in all its copies and distinct
    among themselves, so one row per text is kept, copies leave map-side first, and hits become rows behind the shuffle.
    """
    if "hits" in pairs.columns:
        once = pairs.select("sentence_key", "hits").filter(F.size("hits") > 0).dropDuplicates(["sentence_key"])
        words = once.select("sentence_key", F.inline("hits"))
        flat = words.select("category", "word", F.explode("places").alias("word_idx"), "sentence_key")
        return flat.withColumn("word_idx", F.col("word_idx").cast("long"))
    return pairs.dropDuplicates(["category", "word", "word_idx", "sentence_key"])


def pair_weights(corpus: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_chars: int | None = None, pattern: str = TOKEN_PATTERN) -> DataFrame:
    """(id, category, weight): hits per corpus row and category, aggregated map-side first."""
    hits = lexicon_hits(corpus.select(id_col, text_col), lexicon, id_col, text_col, pattern, max_chars=max_chars)
    return hits.groupBy(id_col, "category").agg(F.count("*").alias("weight"))


def attach_embeddings(weights: DataFrame, vectors: DataFrame, id_col: str = "doc_id",
                      vec_col: str = "embedding") -> DataFrame:
    """(id, category, weight, embedding, ...): weights joined to the corpus vectors by key.

    Rows with any null (no vector) are dropped, as the reference drops them
    before computing centroids.
    """
    return weights.join(vectors, id_col).na.drop("any")


def reference_centroids(corpus: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        vec_col: str = "embedding", max_chars: int | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Weighted mean vector per category over the reference corpus.

    Hits are counted per corpus row into one row of C counts (a single
    shuffle keyed by the row id, after map-side folding), that row meets the
    row's vector in one join on the id (only the vector side moves), and an
    ``unpivot`` turns it into (category, weight, vector) rows for a weighted
    ``Summarizer`` per category. Rows without a vector or without hits drop out. ``vectors`` (id, vector) are the corpus rows'
    vectors when they stand in a table of their own, so that texts need not pass the joins that made them.
    """
    from .represent import ordered_categories

    cats = ordered_categories(read_lexicon(lexicon).select("category", "ord"))
    counts = lexicon_counts_wide(corpus.select(id_col, text_col), lexicon, cats, id_col, text_col,
                                 max_chars=max_chars, fill_missing=False)
    joined = counts.join((corpus if vectors is None else vectors).select(id_col, vec_col).na.drop(), id_col)
    long = joined.unpivot([id_col, vec_col], cats, "category", "weight").filter(F.col("weight") > 0)
    return mean_centroids(long, "category", vec_col, "weight")
