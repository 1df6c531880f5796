"""Queries: grouped k-means and standardisation (step 7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import stable_hash, stable_hash_sql
from ..functions.vectors import explode_vector
from ..operators import scaling as S
from ..operators.centroids import kmeans_centroids
from ..operators.represent import concept_matrix, concept_similarity
from ..operators.restarts import kmeans_restarts
from ..sources import fixtures as fx
from .common import POINT_CATEGORIES, long_, r6, sql_centroid_lists, sql_r6
from .registry import query

W = fx.with_ctes
K, SEED = 3, 7
# more steps than the provided tables need; further ones leave settled centres where they are
ORACLE_STEPS = 12
SPLIT_SEED, TRAIN_PCT = 11, 80


def kmeans_sql(points: str = "fx_centroid_points", k: int = K, seed: int = SEED, iterations: int = ORACLE_STEPS) -> list[str]:
    """CTEs for grouped Lloyd's k-means unrolled ``iterations`` times; result CTE ``km``."""

    def assign(src: str, out: str) -> str:
        return (
            f"{out} AS (SELECT p.category, p.key, p.v, c.cluster FROM kp p JOIN {src} c ON c.category = p.category "
            "QUALIFY row_number() OVER (PARTITION BY p.category, p.key ORDER BY list_distance(p.v, c.c), c.cluster) = 1)"
        )

    def means(src: str, out: str) -> str:
        return (
            f"{out} AS (SELECT category, cluster, list(x ORDER BY i) AS c FROM (SELECT category, cluster, i, avg(v[i]) AS x "
            f"FROM (SELECT category, cluster, v, unnest(generate_series(1, len(v))) AS i FROM {src}) "
            "GROUP BY category, cluster, i) GROUP BY category, cluster)"
        )

    ctes = [
        f"kp AS MATERIALIZED (SELECT category, key, CAST(embedding AS DOUBLE[]) AS v, {stable_hash_sql('key', seed)} AS hv FROM {points})",
        f"c0 AS MATERIALIZED (SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY hv, key) - 1 AS INTEGER) AS cluster, v AS c "
        f"FROM kp QUALIFY row_number() OVER (PARTITION BY category ORDER BY hv, key) <= {k})",
    ]
    for t in range(iterations):
        ctes.append(assign(f"c{t}", f"a{t}"))
        ctes.append(means(f"a{t}", f"m{t + 1}"))
        ctes.append(
            f"c{t + 1} AS MATERIALIZED (SELECT o.category, o.cluster, coalesce(m.c, o.c) AS c FROM c{t} o "
            f"LEFT JOIN m{t + 1} m ON m.category = o.category AND m.cluster = o.cluster)"
        )
    ctes.append(assign(f"c{iterations}", "af"))
    ctes.append(means("af", "km"))
    return ctes


def _points(spark, sf):
    return fx.fx_centroid_points(spark, sf)


@query(
    "kmeans_centroids",
    W(fx.CENTROID_POINTS_SQL, *kmeans_sql())
    + f"SELECT category, CAST(cluster AS BIGINT) AS cluster, CAST(i - 1 AS BIGINT) AS dim, {sql_r6('c[i]')} AS x "
    "FROM (SELECT category, cluster, c, unnest(generate_series(1, len(c))) AS i FROM km)",
)
def q_kmeans_centroids(spark, sf):
    cent = kmeans_centroids(_points(spark, sf), k=K, seed=SEED, key_col="key")
    return explode_vector(cent.select("category", long_("cluster", "cluster"), "centroid"), ["category", "cluster"], "centroid")


@query("kmeans_restarts")
def q_kmeans_restarts(spark, sf):
    """Best of four starts per category, three of them seeded by distance; tested against exhaustive search."""
    cent = kmeans_restarts(_points(spark, sf), {"all": (K, None)}, starts=4, seed=SEED, key_col="key")["all"]
    kept = ["category", long_("cluster", "cluster"), "size", long_("start", "start"), r6("objective", "objective"), "centroid"]
    return explode_vector(cent.select(*kept), ["category", "cluster", "size", "start", "objective"], "centroid")


@query(
    "concept_similarity_max",
    W(fx.CENTROID_POINTS_SQL, fx.POINT_CATEGORIES_SQL, *kmeans_sql())
    + "SELECT e.vec_id, k.category, " + sql_r6("coalesce(max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), km.c)), 0)")
    + " AS similarity FROM embeddings e CROSS JOIN fx_point_categories k LEFT JOIN km ON km.category = k.category "
    "GROUP BY e.vec_id, k.category",
)
def q_concept_similarity_max(spark, sf):
    cent = kmeans_centroids(_points(spark, sf), k=K, seed=SEED, key_col="key")
    emb = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = concept_similarity(emb, cent, fx.fx_point_categories(spark, sf), "vec_id")
    return out.select("vec_id", "category", r6("similarity", "similarity"))


# ---------------------------------------------------------------- standardisation

_SIMS = W(fx.CENTROID_POINTS_SQL, fx.POINT_CATEGORIES_SQL, f"cent AS ({sql_centroid_lists()})") + (
    "SELECT e.vec_id, k.category, coalesce(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c), 0) AS similarity "
    "FROM embeddings e CROSS JOIN fx_point_categories k LEFT JOIN cent c ON c.category = k.category"
)
_TRAIN = f"({stable_hash_sql('vec_id', SPLIT_SEED)}) % 100 < {TRAIN_PCT}"


def _wide_sql(src: str, value: str, cats: list[str] = POINT_CATEGORIES) -> str:
    cols = ", ".join(f"{sql_r6(f'max(CASE WHEN category = {chr(39)}{c}{chr(39)} THEN {value} END)')} AS {c}" for c in cats)
    return f"SELECT vec_id, {cols} FROM ({src}) GROUP BY vec_id"


def _scale(col: str) -> str:
    return f"(CASE WHEN {col} = 0 THEN 1 ELSE {col} END)"


_ROW_Z = (
    "SELECT vec_id, category, (similarity - avg(similarity) OVER (PARTITION BY vec_id)) / "
    + _scale("stddev_pop(similarity) OVER (PARTITION BY vec_id)") + f" AS z FROM ({_SIMS})"
)


def _col_z(src: str, value: str, fit_filter: str = "TRUE") -> str:
    return (
        f"SELECT s.vec_id, s.category, (s.{value} - f.m) / {_scale('f.sd')} AS z FROM ({src}) s JOIN ("
        f"SELECT category, avg({value}) AS m, stddev_pop({value}) AS sd FROM ({src}) WHERE {fit_filter} GROUP BY category) f "
        "ON f.category = s.category"
    )


def _matrix(spark, sf):
    emb = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return concept_matrix(emb, kmeans_free_centroids(spark, sf), fx.fx_point_categories(spark, sf), "vec_id")


def kmeans_free_centroids(spark, sf):
    from ..operators.centroids import mean_centroids

    return mean_centroids(_points(spark, sf))


def _rounded(df):
    return df.select("vec_id", *[r6(c, c) for c in POINT_CATEGORIES])


def _train(df):
    return df.filter(F.pmod(stable_hash("vec_id", SPLIT_SEED), F.lit(100)) < TRAIN_PCT)


@query("row_standardize", _wide_sql(_ROW_Z, "z"))
def q_row_standardize(spark, sf):
    return _rounded(S.row_standardize(_matrix(spark, sf), POINT_CATEGORIES))


@query("column_standardize", _wide_sql(_col_z(_SIMS, "similarity", _TRAIN), "z"))
def q_column_standardize(spark, sf):
    m = _matrix(spark, sf)
    return _rounded(S.column_standardize(m, POINT_CATEGORIES, fit_on=_train(m)))


@query("row_then_column", _wide_sql(_col_z(_ROW_Z, "z"), "z"))
def q_row_then_column(spark, sf):
    return _rounded(S.row_then_column(_matrix(spark, sf), POINT_CATEGORIES))


_COL_THEN_ROW = (
    "SELECT vec_id, category, (z - avg(z) OVER (PARTITION BY vec_id)) / "
    + _scale("stddev_pop(z) OVER (PARTITION BY vec_id)") + f" AS z2 FROM ({_col_z(_SIMS, 'similarity', _TRAIN)})"
)


@query("column_then_row", _wide_sql(_COL_THEN_ROW, "z2"))
def q_column_then_row(spark, sf):
    m = _matrix(spark, sf)
    return _rounded(S.column_then_row(m, POINT_CATEGORIES, fit_on=_train(m)))


_SUBSET = sorted(c for c in POINT_CATEGORIES if c not in ("c0", "c1"))


@query("select_features", _wide_sql(_SIMS, "similarity", _SUBSET))
def q_select_features(spark, sf):
    m = S.select_features(_matrix(spark, sf), _SUBSET, keep=["vec_id"])
    return m.select("vec_id", *[r6(c, c) for c in _SUBSET])
