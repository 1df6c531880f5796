"""K-means with distance-weighted seeding and several starts, all categories and starts side by side.

Seeding draws far rows with a higher chance (k-means||, Bahmani et al., 2012): in every round a row enters a race with the
time -ln(u) / d2, d2 being its squared distance to the candidates so far and u a hash of the row, and the first
``OVERSAMPLING`` * K rows of every (model, category) become candidates. A race needs no total of the distances beforehand,
so a round is one job. The candidates, weighted by the rows nearest to them, are thinned to K centres by weighted k-means++;
Lloyd steps follow for all starts together, and every category keeps its best start.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import MODEL_MAX_ROWS, collect_bounded
from .centroids import arrow_points, hash_starts, lloyd_sums, nearest, point_rows, settle

#: Rounds of drawing, and rows drawn a round for each wanted cluster.
SEED_ROUNDS, OVERSAMPLING = 5, 2

RESULT = "category string, cluster int, centroid array<double>, size long, objective double, start int"


def uniform(h: np.ndarray, stream: int) -> np.ndarray:
    """Numbers strictly between 0 and 1 from 64-bit row hashes, another set for each ``stream`` (splitmix64 finaliser)."""
    z = h.astype(np.uint64) + np.uint64((stream + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def first_of_race(times: np.ndarray, h: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``n`` different rows with the smallest times, in order; ties by hash."""
    once = np.unique(h, return_index=True)[1]
    once = once[np.isfinite(times[once])]
    order = once[np.lexsort((h[once], times[once]))][:n]
    return times[order], h[order], x[order]


def draw(rows: DataFrame, candidates: dict[str, dict[str, np.ndarray]], flags: dict[str, str], wanted: dict[str, int],
         streams: dict[str, int], max_centers: int) -> dict[tuple[str, str], np.ndarray]:
    """One round: per (model, category) the new candidates, in one job for all of them.

    Tasks keep the best ``wanted`` rows of each (model, category) while they read; copies of a row are told by their hash
    and merged before the cut, so a hot row cannot crowd out others.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(candidates)

    def run(batches):
        kept: dict = {}
        for b in batches:
            names, x = arrow_points(b)
            h = b.column("h").to_numpy(zero_copy_only=False)
            for cat in set(names):
                of_cat = names == cat
                for model, by_cat in shared.value.items():
                    use = of_cat & b.column(flags[model]).to_numpy(zero_copy_only=False)
                    if cat not in by_cat or not use.any():
                        continue
                    d2 = nearest(x[use], by_cat[cat])[1]
                    with np.errstate(divide="ignore"):
                        new = (-np.log(uniform(h[use], streams[model])) / d2, h[use], x[use])
                    old = kept.get((model, cat))
                    both = new if old is None else tuple(np.concatenate(p) for p in zip(old, new, strict=True))
                    kept[model, cat] = first_of_race(*both, wanted[model])
        for (model, cat), (t, h, x) in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([model] * len(t), pa.string()), pa.array([cat] * len(t), pa.string()), pa.array(t, pa.float64()), pa.array(h, pa.int64()),
                 pa.array(list(x), pa.list_(pa.float64()))], names=["model", "category", "t", "h", "vec"])

    drawn = rows.select("category", "vec", "h", *sorted({flags[m] for m in candidates})).mapInArrow(
        run, "model string, category string, t double, h long, vec array<double>")
    most = max(wanted.values())
    race = Window.partitionBy("model", "category").orderBy("t", "h")  # cut in every task before the shuffle
    first = drawn.dropDuplicates(["model", "category", "h"]).withColumn("r", F.row_number().over(race)).filter(F.col("r") <= most)
    found = collect_bounded(first.select("model", "category", "r", "vec"), max_centers, "k-means candidates")
    shared.unpersist()
    out: dict = {}
    for r in sorted(found, key=lambda r: (r["model"], r["category"], r["r"])):
        if r["r"] <= wanted[r["model"]]:
            out.setdefault((r["model"], r["category"]), []).append(r["vec"])
    return {k: np.array(v, float) for k, v in out.items()}


def thin(candidates: np.ndarray, weights: np.ndarray, k: int, seed: tuple[int, ...]) -> np.ndarray:
    """K of the candidates by weighted k-means++; all that differ when there are no more than K."""
    rng = np.random.default_rng(seed)
    chance = weights.astype(float)
    d2 = np.full(len(candidates), np.inf)
    chosen: list[int] = []
    while len(chosen) < k and chance.sum() > 0:
        i = int(rng.choice(len(candidates), p=chance / chance.sum()))
        chosen.append(i)
        d2 = np.minimum(d2, ((candidates - candidates[i]) ** 2).sum(axis=1))
        chance = weights * d2
    return candidates[chosen]


def kmeans_restarts(points: DataFrame, variants: dict[str, tuple[int, Column | None]], starts: int = 4, seed: int = 230706,
                    iterations: int = 300, category_col: str = "category", key_col: str = "key", vec_col: str = "embedding",
                    max_centers: int = MODEL_MAX_ROWS) -> dict[str, DataFrame]:
    """Best of several k-means runs for each variant {name: (K, rows that take part)} and category.

    Start 0 is that of ``kmeans_models`` (smallest key hashes), so no category ends above it; the other starts are seeded by
    distance. Returns per variant (category, cluster, centroid, size, objective, start): clusters ordered by centroid, the
    category's sum of squared distances to its nearest centres and the start it came from (ties: the first).

    Jobs: one a seeding round, one to weigh the candidates and one a Lloyd step, however many variants, starts and
    categories there are. What reaches the driver is candidates and sums (size-checked); points stay distributed.

    Defined cases: rows without a category or vector take no part; a category of fewer different rows than K gets one
    cluster for each; keys may be of any type, null too; results do not depend on the partitioning.
    """
    spark = points.sparkSession
    flag = {v: f"_in_{i}" for i, v in enumerate(variants)}
    rows = point_rows(points, {flag[v]: f for v, (_, f) in variants.items()}, category_col, key_col, vec_col)
    rows = rows.withColumn("h", F.xxhash64("key", "vec", F.lit(seed))).persist(StorageLevel.MEMORY_AND_DISK)
    model = {(v, s): f"{flag[v]}#{s}" for v in variants for s in range(starts)}
    flags = {m: flag[v] for (v, _), m in model.items()}
    wanted = {m: OVERSAMPLING * variants[v][0] for (v, _), m in model.items()}
    try:
        centers: dict = {model[v, 0]: hash_starts(rows, flag[v], k, seed, max_centers) for v, (k, _) in variants.items()}
        # each seeded start begins with a row of its own, the first by another hash
        seeded = {(v, s): m for (v, s), m in model.items() if s > 0}
        found: dict = {m: hash_starts(rows, flag[v], 1, seed + s, max_centers) for (v, s), m in seeded.items()}
        for round_ in range(SEED_ROUNDS if seeded else 0):
            streams = {m: s * SEED_ROUNDS + round_ for (_, s), m in seeded.items()}
            for (m, cat), new in draw(rows, found, flags, wanted, streams, max_centers).items():
                found[m][cat] = np.vstack([found[m][cat], new])
        if seeded:
            weighed = lloyd_sums(rows, found, flags)
            for (v, s), m in seeded.items():
                centers[m] = {c: thin(found[m][c], w[:, 0], variants[v][0], (seed, s, zlib.crc32(c.encode()))) for c, w in weighed[m].items()}
        final = settle(rows, centers, flags, iterations)
    finally:
        rows.unpersist()
    out = {}
    for v in variants:
        table = []
        for cat in sorted({c for s in range(starts) for c in final[model[v, s]]}):
            cost = [float(final[model[v, s]][cat][:, 1].sum()) for s in range(starts)]
            # starts that reach the same clusters differ by the order of summation only: the first of them counts
            best = next(s for s in range(starts) if cost[s] <= min(cost) + 1e-9 * max(cost))
            sums = final[model[v, best]][cat]
            means = sorted((row[2:] / row[0]).tolist() + [int(row[0])] for row in sums if row[0] > 0)
            table += [(cat, j, c[:-1], c[-1], cost[best], best) for j, c in enumerate(means)]
        out[v] = spark.createDataFrame(table, RESULT)
    return out
