"""The callable flagship: texts in, one interpretable vector per text out.

``embed`` = encode every distinct text once, derive (or take) a centroid per
lexicon category, score every text against every category, zero where a
category has no centroid, one column per category in lexicon order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import read_lexicon
from .centroids import kmeans_centroids
from .embed import encode_distinct, encode_texts
from .lexicon import lexicon_counts_wide
from .refcorpus import reference_centroids
from .represent import concept_matrix, ordered_categories
from .restarts import kmeans_restarts


def encode(texts: DataFrame, encoder_factory: Callable, id_col: str = "doc_id", text_col: str = "text",
           encoder_id: str | None = None) -> DataFrame:
    """(id, text, embedding): each distinct text meets the encoder once."""
    return encode_distinct(texts, lambda t: encode_texts(t, text_col, encoder_factory, encoder_id=encoder_id), id_col, text_col)


def category_centroids(corpus: DataFrame, lexicon: DataFrame, k: int = 1, id_col: str = "doc_id", text_col: str = "text",
                       vec_col: str = "embedding", seed: int = 230706, starts: int = 1, vectors: DataFrame | None = None) -> DataFrame:
    """Centroids of the reference corpus: the weighted mean per category, or K cluster means of its hit texts.

    ``vectors`` (id, vector) may be a table of its own, one row per corpus row. With several ``starts`` every category keeps the best of them (``kmeans_restarts``).
    """
    if k == 1:
        return reference_centroids(corpus, lexicon, id_col, text_col, vec_col, vectors=vectors)
    cats = ordered_categories(read_lexicon(lexicon).select("category", "ord"))
    counts = lexicon_counts_wide(corpus.select(id_col, text_col), lexicon, cats, id_col, text_col, fill_missing=False)
    long = counts.unpivot([id_col], cats, "category", "weight").filter("weight > 0")
    points = long.join((corpus if vectors is None else vectors).select(id_col, vec_col).na.drop(), id_col)
    if starts > 1:
        return kmeans_restarts(points, {"all": (k, None)}, starts, seed, key_col=id_col, vec_col=vec_col)["all"].select("category", "cluster", "centroid")
    return kmeans_centroids(points, k, seed, key_col=id_col, vec_col=vec_col)


def embed(texts: DataFrame, lexicon: DataFrame, encoder_factory: Callable, reference: DataFrame | None = None,
          centroids: DataFrame | None = None, k: int = 1, metric: str = "cosine", id_col: str = "doc_id", text_col: str = "text",
          encoder_id: str | None = None, starts: int = 1) -> DataFrame:
    """Wide concept representation of ``texts``.

    ``reference`` is the corpus the centroids come from (by default the texts
    themselves), ``centroids`` skips that step. A null text scores 0
    everywhere; every input row gets a row. Hits are counted on the texts where they lie; of the encoded rows only ids and
    vectors go on, kept when they serve both the centroids and the scores.
    """
    encoded = lambda rows: encode(rows.select(id_col, text_col), encoder_factory, id_col, text_col, encoder_id).select(id_col, "embedding")
    vectors = encoded(texts)
    if centroids is None:
        if reference is None:
            vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
        corpus, own = (texts, vectors) if reference is None else (reference, encoded(reference))
        centroids = category_centroids(corpus, lexicon, k, id_col, text_col, starts=starts, vectors=own)
    categories = read_lexicon(lexicon).select("category", F.col("ord")).distinct()
    return concept_matrix(vectors, centroids, categories, id_col, metric=metric)
