"""Category centroids: weighted means and grouped k-means (all categories at once).

Output shape everywhere: ``(category, cluster int, centroid array<double>)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import stable_hash
from ..functions.sizing import MODEL_MAX_ROWS, collect_bounded, maybe_broadcast
from ..functions.vectors import as_double, vector_mean, vector_sum

#: A centre that moves less than this in every coordinate stands still (sums differ in their last bits between runs).
SETTLED = 1e-12

CENTROID_SCHEMA = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("cluster", T.IntegerType()),
        T.StructField("centroid", T.ArrayType(T.DoubleType())),
    ]
)


def mean_centroids(points: DataFrame, category_col: str = "category", vec_col: str = "embedding",
                   weight_col: str | None = None) -> DataFrame:
    """Mean (optionally weighted) vector per category, one cluster (0) each.

    One ``groupBy`` with a partial ``Summarizer`` aggregate: each partition
    folds its rows into one buffer per category before the shuffle, so a
    category holding a third of all rows costs one buffer per partition.
    """
    return points.groupBy(F.col(category_col).alias("category")).agg(
        vector_mean(vec_col, weight_col).alias("centroid")
    ).select("category", F.lit(0).cast("int").alias("cluster"), "centroid")


def centroid_headers(centroids: DataFrame, k: int) -> DataFrame:
    """Wide-output names: the category itself when K = 1, else ``category_cK``."""
    header = F.col("category") if k == 1 else F.format_string("%s_c%d", F.col("category"), F.col("cluster"))
    return centroids.withColumn("header", header)


def align_centroids(centroids: DataFrame, categories: DataFrame) -> DataFrame:
    """Keep centroids of lexicon categories only, carrying the lexicon order."""
    cats = categories.select("category", "ord").distinct()
    return centroids.join(maybe_broadcast(cats, MODEL_MAX_ROWS), "category", "inner")


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of every row's nearest centre; ties go to the lower cluster.

    One matrix product ranks the centres; rows whose two best lie within rounding are compared by their differences.
    """
    best = np.zeros(len(x), int)
    if len(centers) > 1:
        norms = np.einsum("ij,ij->i", centers, centers)
        part = norms - 2 * (x @ centers.T)
        best = part.argmin(axis=1)
        two = np.partition(part, 1, axis=1)[:, :2]
        close = np.flatnonzero(~(two[:, 1] - two[:, 0] > 1e-9 * (np.einsum("ij,ij->i", x, x) + norms.max())))
        if len(close):
            best[close] = np.stack([((x[close] - c) ** 2).sum(axis=1) for c in centers], axis=1).argmin(axis=1)
    diff = x - centers[best]
    return best, np.einsum("ij,ij->i", diff, diff)


def arrow_points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Category names and the (n, d) matrix of a batch of points."""
    names = np.array(batch.column("category").to_pylist(), dtype=object)
    return names, np.asarray(batch.column("vec").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)


def lloyd_sums(rows: DataFrame, centers: dict[str, dict[str, np.ndarray]], flags: dict[str, str] | None = None) -> dict[str, dict[str, np.ndarray]]:
    """Per model and category: clusters x (members, squared distances, vector sum), in one job for all models.

    ``rows`` has (category, vec) and boolean columns; ``flags`` names the column of the rows that take part in a model (by
    default the one called like it). Every task adds up its batches in numpy and sends one row per (model, category) it met.
    """
    spark = rows.sparkSession
    flags = flags or {m: m for m in centers}
    shared = spark.sparkContext.broadcast(centers)

    def run(batches):
        centers = shared.value
        sums: dict = {}
        for b in batches:
            names, x = arrow_points(b)
            for cat in set(names):
                of_cat = names == cat
                for model, by_cat in centers.items():
                    use = of_cat & b.column(flags[model]).to_numpy(zero_copy_only=False)
                    if cat not in by_cat or not use.any():
                        continue
                    xs, c = x[use], by_cat[cat]
                    best, d2 = nearest(xs, c)
                    at = sums.setdefault((model, cat), np.zeros((len(c), 2 + xs.shape[1])))
                    at[:, 0] += np.bincount(best, minlength=len(c))
                    at[:, 1] += np.bincount(best, weights=d2, minlength=len(c))
                    for j in range(len(c)):
                        at[j, 2:] += xs[best == j].sum(axis=0)
        for (model, cat), v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([model]), pa.array([cat], pa.string()), pa.array([v.ravel()], pa.list_(pa.float64()))], names=["model", "category", "v"])

    added = rows.select("category", "vec", *sorted({flags[m] for m in centers})).mapInArrow(run, "model string, category string, v array<double>")
    found = collect_bounded(added.groupBy("model", "category").agg(vector_sum("v").alias("v")), MODEL_MAX_ROWS, "k-means sums")
    shared.unpersist()
    out: dict = {m: {} for m in centers}
    for r in found:
        out[r["model"]][r["category"]] = np.array(r["v"]).reshape(len(centers[r["model"]][r["category"]]), -1)
    return out


def point_rows(points: DataFrame, flags: dict[str, Column | None], category_col: str, key_col: str, vec_col: str) -> DataFrame:
    """(category, key, vec, one boolean column per flag): the rows that have a category and a vector."""
    return points.filter(F.col(category_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(category_col).alias("category"), F.col(key_col).alias("key"), as_double(vec_col).alias("vec"),
        *[F.coalesce(F.lit(True) if flag is None else flag, F.lit(False)).alias(name) for name, flag in flags.items()],
    )


def hash_starts(rows: DataFrame, flag: str, k: int, seed: int, max_centers: int) -> dict[str, np.ndarray]:
    """Per category the vectors of the K rows with the smallest ``stable_hash(key, seed)``."""
    order = Window.partitionBy("category").orderBy(stable_hash("key", seed), "key")  # cut to K rows before the shuffle
    start = rows.filter(flag).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    found = collect_bounded(start.select("category", "_r", "vec"), max_centers, "k-means start rows")
    by_cat: dict = {}
    for r in sorted(found, key=lambda r: (r["category"], r["_r"])):
        by_cat.setdefault(r["category"], []).append(r["vec"])
    return {c: np.array(x, float) for c, x in by_cat.items()}


def settle(rows: DataFrame, centers: dict[str, dict[str, np.ndarray]], flags: dict[str, str], iterations: int) -> dict[str, dict[str, np.ndarray]]:
    """Lloyd steps until every centre stands still; then the sums of ``lloyd_sums`` under the final centres.

    A step is one job for all models and categories; a category that has settled in a model takes no part in further steps.
    An empty cluster keeps its centre. ``centers`` is moved in place.
    """
    active = {m: dict(by_cat) for m, by_cat in centers.items() if by_cat}
    for _ in range(iterations):
        if not active:
            break
        still: dict = {}
        for m, by_cat in lloyd_sums(rows, active, flags).items():
            for cat, s in by_cat.items():
                old, full = centers[m][cat], s[:, 0] > 0
                new = old.copy()
                new[full] = s[full, 2:] / s[full, :1]
                centers[m][cat] = new
                if np.abs(new - old).max(initial=0.0) > SETTLED:
                    still.setdefault(m, {})[cat] = new
        active = still
    return lloyd_sums(rows, centers, flags)


def kmeans_models(points: DataFrame, variants: dict[str, tuple[int, Column | None]], seed: int = 230706, iterations: int = 300,
                  category_col: str = "category", key_col: str = "key", vec_col: str = "embedding",
                  max_centers: int = MODEL_MAX_ROWS) -> dict[str, DataFrame]:
    """Grouped Lloyd's k-means of several variants {name: (K, rows that take part)} in shared passes; centroids per variant.

    * start centres: the K rows with the smallest ``stable_hash(key, seed)`` in each category (a category with fewer than
      K rows gets one cluster per row); ``restarts.kmeans_restarts`` seeds by distance and keeps the best of several starts;
    * Lloyd steps until no centre of any variant moves (``iterations`` is an emergency stop); an empty cluster keeps its
      previous centre;
    * result: members of each cluster under the final centres, averaged.

    A step is one job for all variants and categories: the C*K centres (size-checked) are broadcast, tasks assign whole
    batches with matrix operations and send sums. The points stay distributed and persisted. Rows without a category or
    vector take no part.
    """
    spark = points.sparkSession
    names = {v: f"_in_{i}" for i, v in enumerate(variants)}
    rows = point_rows(points, {names[v]: flag for v, (_, flag) in variants.items()}, category_col, key_col, vec_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centers = {v: hash_starts(rows, names[v], k, seed, max_centers) for v, (k, _) in variants.items()}
        final = settle(rows, centers, names, iterations)
    finally:
        rows.unpersist()
    out = {}
    for v in variants:
        table = []
        for cat, s in final[v].items():
            table += [(cat, j, (row[2:] / row[0]).tolist()) for j, row in enumerate(s) if row[0] > 0]
        out[v] = spark.createDataFrame(table, CENTROID_SCHEMA)
    return out


def kmeans_centroids(points: DataFrame, k: int, seed: int = 230706, iterations: int = 300,
                     category_col: str = "category", key_col: str = "key", vec_col: str = "embedding",
                     max_centers: int = MODEL_MAX_ROWS) -> DataFrame:
    """``kmeans_models`` of one variant: K clusters inside every category."""
    return kmeans_models(points, {"all": (k, None)}, seed, iterations, category_col, key_col, vec_col, max_centers)["all"]


def kmeans_objective(points: DataFrame, centroids: DataFrame, category_col: str = "category",
                     key_col: str = "key", vec_col: str = "embedding") -> float:
    """Sum of squared distances to the nearest centre (a test invariant)."""
    centers: dict = {}
    for r in sorted(collect_bounded(centroids, MODEL_MAX_ROWS), key=lambda r: (r["category"], r["cluster"])):
        centers.setdefault(r["category"], []).append(r["centroid"])
    pts = points.select(F.col(category_col).alias("category"), as_double(vec_col).alias("vec"), F.lit(True).alias("all"))
    sums = lloyd_sums(pts, {"all": {c: np.array(x, float) for c, x in centers.items()}})
    return float(sum(s[:, 1].sum() for s in sums["all"].values()))
