"""Queries: centroids and concept representation over the embedding points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import explode_vector
from ..operators.centroids import align_centroids, centroid_headers, kmeans_centroids, mean_centroids
from ..operators.represent import concept_matrix, concept_similarity, score_blocks
from ..sources import fixtures as fx
from ..sources.readers import centroids_long_to_wide, centroids_wide_to_long
from .common import POINT_CATEGORIES, long_, r6, sql_centroid_lists, sql_long_mean_centroids, sql_r6
from .registry import query

PTS = fx.CENTROID_POINTS_SQL
PCATS = fx.POINT_CATEGORIES_SQL
W = fx.with_ctes


def _points(spark, sf):
    return fx.fx_centroid_points(spark, sf)


def _vectors(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", "embedding")


def _centroid_long(cent):
    return explode_vector(cent.select("category", long_("cluster", "cluster"), "centroid"), ["category", "cluster"], "centroid")


@query(
    "mean_centroids",
    W(PTS)
    + f"SELECT category, CAST(0 AS BIGINT) AS cluster, CAST(i - 1 AS BIGINT) AS dim, {sql_r6('x')} AS x "
    f"FROM ({sql_long_mean_centroids()})",
)
def q_mean_centroids(spark, sf):
    return _centroid_long(mean_centroids(_points(spark, sf)))


@query(
    "centroids_wide_to_long",
    W(PTS) + f"SELECT category, CAST(i - 1 AS BIGINT) AS dim, {sql_r6('x')} AS x FROM ({sql_long_mean_centroids()})",
)
def q_centroids_wide_to_long(spark, sf):
    cats = [c for c in POINT_CATEGORIES if c != "c_empty"]
    wide = centroids_long_to_wide(mean_centroids(_points(spark, sf)), cats)
    back = centroids_wide_to_long(wide, "dim", cats)
    return explode_vector(back, ["category"], "centroid")


@query(
    "align_centroids",
    W(PTS, PCATS)
    + f"SELECT m.category, CAST(k.ord AS BIGINT) AS ord, CAST(0 AS BIGINT) AS cluster, CAST(i - 1 AS BIGINT) AS dim, "
    f"{sql_r6('x')} AS x FROM ({sql_long_mean_centroids()}) m JOIN fx_point_categories k ON k.category = m.category "
    "WHERE k.ord >= 2",
)
def q_align_centroids(spark, sf):
    cats = fx.fx_point_categories(spark, sf).filter(F.col("ord") >= 2)
    al = align_centroids(mean_centroids(_points(spark, sf)), cats)
    return explode_vector(al.select("category", long_("ord", "ord"), long_("cluster", "cluster"), "centroid"),
                          ["category", "ord", "cluster"], "centroid")


_SIM_SQL = (
    W(PTS, PCATS, f"cent AS ({sql_centroid_lists()})")
    + "SELECT e.vec_id, k.category, "
    + sql_r6("coalesce(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c), 0)")
    + " AS similarity FROM embeddings e CROSS JOIN fx_point_categories k LEFT JOIN cent c ON c.category = k.category"
)


def _similarity_long(spark, sf):
    pts = _points(spark, sf)
    return concept_similarity(_vectors(spark, sf), mean_centroids(pts), fx.fx_point_categories(spark, sf), "vec_id")


@query("concept_similarity", _SIM_SQL)
def q_concept_similarity(spark, sf):
    return _similarity_long(spark, sf).select("vec_id", "category", r6("similarity", "similarity"))


@query(
    "zero_fill",
    "SELECT category, CAST(count(*) AS BIGINT) AS n_texts, CAST(count_if(similarity = 0) AS BIGINT) AS n_zero, "
    + sql_r6("avg(similarity)") + " AS mean_similarity FROM (" + _SIM_SQL + ") GROUP BY category",
)
def q_zero_fill(spark, sf):
    sims = _similarity_long(spark, sf)
    return sims.groupBy("category").agg(
        F.count("*").alias("n_texts"),
        F.count_if(F.col("similarity") == 0).alias("n_zero"),
        r6(F.avg("similarity"), "mean_similarity"),
    )


@query(
    "concept_matrix",
    "SELECT vec_id, "
    + ", ".join(f"{sql_r6(f'max(CASE WHEN category = {chr(39)}{c}{chr(39)} THEN similarity END)')} AS {c}" for c in POINT_CATEGORIES)
    + " FROM (" + _SIM_SQL + ") GROUP BY vec_id",
)
def q_concept_matrix(spark, sf):
    wide = concept_matrix(_vectors(spark, sf), mean_centroids(_points(spark, sf)), fx.fx_point_categories(spark, sf), "vec_id")
    return wide.select("vec_id", *[r6(c, c) for c in POINT_CATEGORIES])


@query(
    "kernel_similarity",
    W(PTS, PCATS, f"cent AS ({sql_centroid_lists()})")
    + "SELECT e.vec_id, k.category, "
    + sql_r6("coalesce(exp(-list_distance(CAST(e.embedding AS DOUBLE[]), c.c) / len(e.embedding)), 0)") + " AS sim_l2, "
    + sql_r6("coalesce(exp(-(SELECT sum(abs(CAST(e.embedding[j] AS DOUBLE) - c.c[j])) FROM generate_series(1, len(e.embedding)) t(j)) / len(e.embedding)), 0)")
    + " AS sim_l1 FROM embeddings e CROSS JOIN fx_point_categories k LEFT JOIN cent c ON c.category = k.category",
)
def q_kernel_similarity(spark, sf):
    pts = _points(spark, sf)
    cent = mean_centroids(pts)
    cats = fx.fx_point_categories(spark, sf)
    # both kernels on the same row: one pass over the vectors, no join of long results
    l2, by_l2 = score_blocks(_vectors(spark, sf), cent, cats, metric="l2", prefix="_l2_")
    both, by_l1 = score_blocks(l2, cent, cats, metric="l1", prefix="_l1_")
    entries = F.array(*[F.struct(F.lit(c).alias("category"), v.alias("sim_l2"), by_l1[(c, k)].alias("sim_l1")) for (c, k), v in by_l2.items()])
    long = both.select("vec_id", F.inline(entries))
    return long.select("vec_id", "category", r6("sim_l2", "sim_l2"), r6("sim_l1", "sim_l1"))


@query(
    "centroid_headers",
    W(PTS) + "SELECT DISTINCT category, CAST(c AS BIGINT) AS cluster, category || '_c' || CAST(c AS VARCHAR) AS header "
    "FROM (SELECT category, unnest([0, 1]) AS c FROM (SELECT category, count(*) AS n FROM fx_centroid_points GROUP BY category) WHERE n >= 2)",
)
def q_centroid_headers(spark, sf):
    cent = kmeans_centroids(_points(spark, sf), k=2, seed=7, key_col="key")
    return centroid_headers(cent, 2).select("category", long_("cluster", "cluster"), "header")
