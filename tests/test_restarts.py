"""K-means with several starts: exhaustive optimum, never above one start, independent of partitions, hot copies."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from lexicept.operators.centroids import kmeans_models, kmeans_objective, nearest
from lexicept.operators.restarts import first_of_race, kmeans_restarts, thin, uniform
from lexicept.plans import q_scaling
from lexicept.sources import fixtures as fx

SCHEMA = "category string, key string, embedding array<double>"


def _cost(x, parts):
    return sum(((x[parts == p] - x[parts == p].mean(axis=0)) ** 2).sum() for p in set(parts))


def _best_cost(x, k):
    return min(_cost(x, np.array((0, *p))) for p in product(range(k), repeat=len(x) - 1))


def test_nearest_is_the_plain_argmin():
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(200, 5)) * 1e3, rng.normal(size=(7, 5)) * 1e3
    c[4] = c[2]  # a tie goes to the lower cluster
    x[:7] = c
    plain = np.stack([((x - v) ** 2).sum(axis=1) for v in c], axis=1)
    best, d2 = nearest(x, c)
    assert (best == plain.argmin(axis=1)).all() and np.allclose(d2, plain.min(axis=1))


def test_optimum_of_small_categories(spark):
    rng = np.random.default_rng(3)
    data = {f"c{i}": rng.normal(size=(8, 2)) + 4 * rng.integers(0, 3, (8, 1)) for i in range(5)}
    rows = [(c, f"{c}-{i}", v.tolist()) for c, x in data.items() for i, v in enumerate(x)]
    rows += [("few", "a", [1.0, 2.0]), ("few", "b", [1.0, 2.0]), ("few", None, [3.0, 4.0]), (None, "n", [0.0, 0.0]), ("gone", "n", None)]
    pts = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for n in (1, 5):
        models = kmeans_restarts(pts.repartition(n), {"three": (3, None), "half": (2, F.col("key") < "c3")}, starts=12, seed=4)
        got[n] = {v: sorted((r["category"], r["cluster"], r["size"], r["start"], *np.round(r["centroid"], 9)) for r in d.collect()) for v, d in models.items()}
    assert got[1] == got[5]
    found = {r["category"]: r["objective"] for r in models["three"].collect()}
    for c, x in data.items():
        assert np.isclose(found[c], _best_cost(x, 3)), c
    assert np.isclose(found["few"], 0) and "gone" not in found
    assert sum(r[2] for r in got[5]["three"] if r[0] == "few") == 3
    assert {r[0] for r in got[5]["half"]} == {"c0", "c1", "c2", "few"}  # keys "a" and "b" come before "c3" too
    assert kmeans_restarts(pts.limit(0), {"all": (3, None)})["all"].count() == 0


def test_never_above_one_start_and_no_more_jobs(spark, sf_small):
    pts = fx.fx_centroid_points(spark, sf_small)
    plain = kmeans_models(pts, {"all": (3, None)}, seed=7)["all"]
    cats = [r["category"] for r in plain.select("category").distinct().collect()]
    best = kmeans_restarts(pts, {"all": (3, None)}, starts=4, seed=7)["all"]
    total = {r["category"]: r["objective"] for r in best.collect()}
    assert set(total) == set(cats)
    for c in cats[:3]:
        of = F.col("category") == c
        assert total[c] <= kmeans_objective(pts.filter(of), plain.filter(of)) + 1e-6
        assert np.isclose(total[c], kmeans_objective(pts.filter(of), best.filter(of)))
    out = q_scaling.q_kmeans_restarts(spark, sf_small)
    assert out.columns == ["category", "cluster", "size", "start", "objective", "dim", "x"]


def test_hot_copies_crowd_out_nothing(spark):
    # a third of the rows is one row; two small clusters lie far away from the rest
    rng = np.random.default_rng(9)
    far = [("c", f"f{i}", [100.0 + x, 0.0]) for i, x in enumerate(rng.normal(size=5).tolist())] + [("c", f"g{i}", [0.0, 100.0 + x]) for i, x in enumerate(rng.normal(size=5).tolist())]
    rows = [("c", "hot", [0.0, 0.0])] * 300 + [("c", f"k{i}", rng.normal(size=2).tolist()) for i in range(590)] + far
    out = kmeans_restarts(spark.createDataFrame(rows, SCHEMA).repartition(7), {"all": (3, None)}, starts=2, seed=1)["all"].collect()
    assert sorted(r["size"] for r in out) == [5, 5, 890]


def test_race_and_thinning():
    h = np.arange(4000, dtype=np.int64) * 7919 - 10**15
    u = uniform(h, 0)
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03 and abs(np.corrcoef(u, uniform(h, 1))[0, 1]) < 0.06
    times, hashes, x = np.array([3.0, 1.0, np.inf, 1.0, 2.0]), np.array([5, 9, 1, 9, 4]), np.arange(5.0)[:, None]
    t, g, _ = first_of_race(times, hashes, x, 2)
    assert t.tolist() == [1.0, 2.0] and g.tolist() == [9, 4]
    points = np.array([[0.0], [0.0], [5.0], [9.0]])
    assert sorted(thin(points, np.array([1, 1, 1, 1]), 5, (1, 2, 3)).ravel().tolist()) == [0.0, 5.0, 9.0]
    assert thin(points, np.array([0, 0, 2, 0]), 2, (1,)).ravel().tolist() == [5.0]
