"""Shared pieces for the registered queries: rounding, category lists, SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6
# Fixed value: the embedding labels are 0..9 in every provided scale factor.
POINT_LABELS = list(range(10))
POINT_CATEGORIES = [f"c{i}" for i in POINT_LABELS] + ["c_empty"]


def r6(col, alias: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
    return out.alias(alias) if alias else out


def long_(col, alias: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = c.cast("long")
    return out.alias(alias) if alias else out


def sql_r6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {DIGITS}) + 0.0)"


def sql_long_mean_centroids(points_cte: str = "fx_centroid_points") -> str:
    """SQL: (category, i, x) element-wise means, i 1-based."""
    return (
        f"SELECT category, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM ("
        f"SELECT category, embedding, unnest(generate_series(1, len(embedding))) AS i FROM {points_cte}) "
        "GROUP BY category, i"
    )


def sql_centroid_lists(points_cte: str = "fx_centroid_points") -> str:
    return f"SELECT category, list(x ORDER BY i) AS c FROM ({sql_long_mean_centroids(points_cte)}) GROUP BY category"
