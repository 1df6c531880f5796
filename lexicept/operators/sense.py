"""Word-sense analysis: keyword-in-context vectors compared with reference words of two senses.

Context vectors are static: the mean of the word vectors in a window around
the first token containing the keyword. The window is cut out of each
text's token array by a per-row ``slice`` (no join of tokens with keyword
positions), exploded, looked up in the size-checked word-vector table, and
pooled with one partial aggregate per text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import lookup_join
from ..functions.stats import paired_t_test
from .embed import mean_pool
from .represent import concept_matrix
from .scaling import apply_columns, fit_columns, row_standardize
from .text import TOKEN_PATTERN, token_array


def keyword_context_vectors(docs: DataFrame, word_vectors: DataFrame, keyword: str, window: int = 2,
                            id_col: str = "doc_id", text_col: str = "text", pattern: str = TOKEN_PATTERN,
                            token_col: str = "token", vec_col: str = "embedding") -> DataFrame:
    """(id, embedding): mean word vector of the tokens within ``window`` of the first keyword token."""
    kw = keyword.lower()
    toks = token_array(text_col, pattern)
    positions = F.filter(F.transform(toks, lambda t, i: F.when(t.contains(kw), i)), lambda i: i.isNotNull())
    k = F.try_element_at(positions, F.lit(1))
    start = F.greatest(k - window, F.lit(0))
    ctx = F.slice(toks, start + 1, k + window - start + 1)
    rows = docs.select(id_col, ctx.alias("ctx")).filter(F.col("ctx").isNotNull())
    ex = rows.select(id_col, F.posexplode("ctx").alias("pos", "token"))
    wv = word_vectors.select(F.col(token_col).alias("token"), F.col(vec_col).alias("v"))
    return mean_pool(lookup_join(ex, wv, "token", [id_col, "pos"]).withColumnRenamed("v", vec_col), id_col, vec_col)


def sense_word_vectors(senses: DataFrame, word_vectors: DataFrame, token_col: str = "token",
                       vec_col: str = "embedding") -> DataFrame:
    """(category = sense, cluster = word index, centroid): each reference word as one 'cluster'."""
    wv = word_vectors.select(F.col(token_col).alias("word"), F.col(vec_col).alias("centroid"))
    j = senses.join(wv, "word")
    return j.select(F.col("sense").alias("category"), F.xxhash64("word").alias("cluster"), "centroid", "word")


def sense_similarity(ctx: DataFrame, senses: DataFrame, word_vectors: DataFrame, sense_names: list[str],
                     id_col: str = "doc_id", vec_col: str = "embedding") -> DataFrame:
    """Per context vector: mean cosine to each sense's reference words, and the difference of the first two."""
    model = sense_word_vectors(senses, word_vectors)
    cats = ctx.sparkSession.createDataFrame([(s, i) for i, s in enumerate(sense_names)], "category string, ord int")
    wide = concept_matrix(ctx, model, cats, id_col, vec_col, reduce="mean")
    a, b = sense_names[0], sense_names[1]
    return wide.withColumn("diff", F.col(a) - F.col(b))


def sense_group_means(sims: DataFrame, truth: DataFrame, a: str, b: str, id_col: str = "doc_id",
                      sense_col: str = "true_sense", with_p: bool = False) -> DataFrame:
    """By true sense: mean similarity to both senses and a paired t-test between them."""
    j = sims.join(truth, id_col)
    means = j.groupBy(sense_col).agg(F.avg(a).alias(f"mean_{a}"), F.avg(b).alias(f"mean_{b}"))
    return means.join(paired_t_test(j, a, b, [sense_col], with_p), sense_col)


def same_vs_opposite(sims: DataFrame, truth: DataFrame, senses: list[str], id_col: str = "doc_id",
                     sense_col: str = "true_sense", with_p: bool = False) -> DataFrame:
    """Pooled same-sense vs opposite-sense similarity, their ratio and a paired t-test."""
    a, b = senses
    j = sims.join(truth, id_col)
    same = F.when(F.col(sense_col) == a, F.col(a)).otherwise(F.col(b))
    opp = F.when(F.col(sense_col) == a, F.col(b)).otherwise(F.col(a))
    pairs = j.select(same.alias("same"), opp.alias("opposite"))
    means = [F.avg("same").alias("same_mean"), F.avg("opposite").alias("opposite_mean")]
    test = paired_t_test(pairs, "same", "opposite", [], with_p, extra_aggs=means)
    return test.withColumn("ratio", F.col("same_mean") / F.col("opposite_mean"))


def sense_representation(vectors: DataFrame, centroids: DataFrame, categories: DataFrame, cat_names: list[str],
                         corpus_matrix: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Concept representation of vectors, columns scaled by a corpus fit, then rows standardised."""
    rep = concept_matrix(vectors, centroids, categories, id_col, vec_col)
    scaled = apply_columns(rep, fit_columns(corpus_matrix, cat_names), cat_names)
    return row_standardize(scaled, cat_names)


def concept_space(ctx: DataFrame, words: DataFrame, centroids: DataFrame, categories: DataFrame, cat_names: list[str],
                  corpus_matrix: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Context vectors (id, vector) and words (token, vector) in the scaled concept space: the same two shapes, C values each.

    Both go through one representation pass; an id is written as text with a leading letter for its side.
    """
    sides = ctx.select(F.concat(F.lit("c"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("id"), vec_col).unionByName(
        words.select(F.concat(F.lit("w"), "token").alias("id"), vec_col))
    rep = sense_representation(sides, centroids, categories, cat_names, corpus_matrix, "id", vec_col)
    vec = F.array(*[F.col(c) for c in cat_names]).alias(vec_col)
    key = F.expr("substring(id, 2)")
    return (
        rep.filter(F.col("id").startswith("c")).select(F.nullif(key, F.lit("")).cast(ctx.schema[id_col].dataType).alias(id_col), vec),
        rep.filter(F.col("id").startswith("w")).select(key.alias("token"), vec),
    )
