"""Shared-pass fits, k-means steps, order statistics, ICC limits and token spans against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicept.functions.order_stats import exact_median, select_rank
from lexicept.functions.stats import column_summary, f_quantile, icc_bounds
from lexicept.operators import embed as E
from lexicept.operators import evaluate as V
from lexicept.operators import shared_fit as S
from lexicept.operators.centroids import kmeans_models, kmeans_objective
from lexicept.operators.scaling import row_standardize_array
from lexicept.plans import q_eval

FOLDS = 3


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    n = 150
    x = rng.normal(size=(n, 3))
    c = (np.abs(x[:, 0]) + x[:, 1] > 0.8).astype(int) + (x[:, 2] > 0.8)
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] + 0.05 * rng.normal(size=n)
    rows = [(i, x[i].tolist(), (3 * x[i] ** 3 + 1).tolist(), int(c[i]), float(y[i]), i % FOLDS) for i in range(n)]
    rows += [(n, None, [0.0] * 3, 0, 0.0, 0), (n + 1, [0.0] * 3, [0.0] * 3, None, None, 1)]  # take no part
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>, c int, y double, fold int").repartition(3)
    return df, {"a": x, "b": 3 * x**3 + 1}, c, y, np.arange(n) % FOLDS


def _scaled(x, train):
    return (x - x[train].mean(0)) / x[train].std(0)


def _newton_logistic(x, y, steps=60):
    x = np.hstack([x, np.ones((len(x), 1))])
    pen = np.ones(x.shape[1])
    pen[-1] = 0
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(pen), x.T @ (p - y) + pen * w)
    return w


def test_logistic_fits_of_all_sets_and_folds(sample, monkeypatch):
    df, xs, c, _, fold = sample
    passes = []
    one = S._pass
    monkeypatch.setattr(S, "_pass", lambda *a: passes.append(1) or one(*a))
    got = {(r["features"], r["fold"]): r for r in S.evaluate_many(df, ["a", "b"], "c", "fold", [0, 1, 2], S.Loss("logistic"), classes=3).collect()}
    assert len(passes) < 20  # steps, not steps x sets x folds x classes
    for s, x in xs.items():
        for h in range(FOLDS):
            train = fold != h
            z = _scaled(x, train)
            w = np.stack([_newton_logistic(z[train], (c[train] == k).astype(float)) for k in range(3)])
            best = (np.hstack([z, np.ones((len(z), 1))])[~train] @ w.T).argmax(axis=1)
            r = got[s, h]
            assert r["accuracy"] == pytest.approx((best == c[~train]).mean()) and r["gradient"] <= S.TOLERANCE
            assert (r["n_train"], r["n_test"]) == (train.sum(), (~train).sum())


def test_least_squares(sample):
    df, xs, _, y, fold = sample
    got = {(r["features"], r["fold"]): r for r in S.evaluate_many(df, ["a", "b"], "y", "fold", [0, 1, 2], S.Loss("squared")).collect()}
    for s, x in xs.items():
        for h in range(FOLDS):
            train = fold != h
            full = np.hstack([x, np.ones((len(x), 1))])
            miss = y - full @ np.linalg.lstsq(full[train], y[train], rcond=None)[0]
            assert got[s, h]["rmse"] == pytest.approx(np.sqrt((miss[~train] ** 2).mean()))
            assert got[s, h]["r2"] == pytest.approx(1 - (miss[~train] ** 2).sum() / ((y[~train] - y[~train].mean()) ** 2).sum())


def _smo(kernel, y, c=1.0, tol=1e-5):
    """Exact support vector classification: the most violating pair of dual variables moves until none violates."""
    alpha = np.zeros(len(y))
    grad = -np.ones(len(y))
    q = kernel * np.outer(y, y)
    while True:
        up = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0))
        low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
        score = -y * grad
        i = np.flatnonzero(up)[score[up].argmax()]
        j = np.flatnonzero(low)[score[low].argmin()]
        if score[i] - score[j] < tol:
            return alpha * y, (score[i] + score[j]) / 2
        step = (score[i] - score[j]) / max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
        step = min(step, c - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        grad += step * (q[:, i] * y[i] - q[:, j] * y[j])


def test_kernel_svm_agrees_with_the_exact_dual(sample):
    df, xs, c, _, fold = sample
    rows, fits = S.fit_many(df, ["a"], "c", "fold", [0], S.Loss("hinge"), key="id", classes=3, pairs=True, landmarks=1000)
    x, train = xs["a"], fold != 0
    z = _scaled(x, train)
    gamma = 1 / (3 * z[train].var())
    assert fits[0].gamma == pytest.approx(gamma)
    votes = np.zeros((len(x), 3))
    for a, b in ((0, 1), (0, 2), (1, 2)):
        use = train & ((c == a) | (c == b))
        beta, bias = _smo(S.radial(z[use], z[use], gamma), np.where(c[use] == a, 1.0, -1.0))
        votes[np.arange(len(x)), np.where(S.radial(z, z[use], gamma) @ beta + bias > 0, a, b)] += 1
    agree = (fits[0].predict(x) == votes.argmax(axis=1)).mean()
    assert agree >= 0.95 and fits[0].gradient <= S.TOLERANCE
    score = S.held_out_scores(rows, fits)[0]["accuracy"]
    assert score == pytest.approx((fits[0].predict(x)[~train] == c[~train]).mean())
    few = S.evaluate_many(df, ["a"], "c", "fold", [0], S.Loss("hinge"), key="id", classes=3, pairs=True, landmarks=30).first()
    assert few["accuracy"] >= score - 0.15


@pytest.mark.parametrize(("loss", "target", "how"), [("hinge", "c", {"classes": 3, "pairs": True}), ("insensitive", "y", {})])
def test_kernel_machines_start_near_their_end(sample, monkeypatch, loss, target, how):
    df = sample[0]
    passes, one = [], S._pass
    monkeypatch.setattr(S, "_pass", lambda *a: passes.append(1) or one(*a))
    fit = lambda: S.fit_many(df, ["a"], target, "fold", [0, 1, 2], S.Loss(loss), key="id", landmarks=30, **how)[1]
    whole = fit()
    assert len(passes) <= 3  # the start has met every row; without it some dozen passes
    monkeypatch.setattr(S, "START_ROWS", 1)  # then the landmarks alone: the descent over all rows ends at the same place
    few = fit()
    assert len(passes) < 33
    for a, b in zip(whole, few, strict=True):
        assert max(a.gradient, b.gradient) <= S.TOLERANCE and b.loss == pytest.approx(a.loss, rel=1e-6)
        assert np.abs(a.weights - b.weights).max() < 1e-3


def test_a_step_that_overshoots_is_cut_by_its_shares():
    # |w| rounded at 0.05 from far outside: the curvature is the penalty's alone and the whole step overshoots
    loss, phi, y = S.Loss("insensitive", epsilon=0.0), np.ones((40, 1)), np.concatenate([np.linspace(1, 2, 39), [50.0]])
    p = S._Problem(np.zeros(1), np.full(1, 1e-3), 40.0)
    for passes in range(1, 40):
        sums = np.zeros((1, len(S.SHARES) + 3))
        S._add_sums(sums, phi, y, [], p.points()[None], loss, 0.05)
        p.take(sums[0], 1.0)
        if p.worst <= S.TOLERANCE:
            break
    assert passes < 25 and p.best[0] == pytest.approx(np.median(y), abs=0.05)


def test_support_vector_regression_is_optimal(sample):
    df, xs, _, y, fold = sample
    rows, (fit,) = S.fit_many(df, ["a"], "y", "fold", [1], S.Loss("insensitive"), key="id", landmarks=1000)
    train = fold != 1
    phi = fit.map(xs["a"][train])

    def objective(w):
        return 0.5 * w[:-1] @ w[:-1] + np.maximum(np.abs(phi @ w - (y[train] - fit.target_mean)) - 0.1, 0).sum()

    w = fit.weights[0]
    slack = train.sum() * S.DELTAS[-1] / 2
    rng = np.random.default_rng(2)
    tries = [w * (1 + t) for t in (-0.1, -0.01, 0.01, 0.1)] + [w + s * rng.normal(size=len(w)) for s in (1e-3, 1e-2, 0.1) for _ in range(50)]
    assert all(objective(t) >= objective(w) - slack for t in tries) and fit.gradient <= S.TOLERANCE
    assert S.held_out_scores(rows, [fit])[0]["r2"] > 0.6


def test_grid_equals_one_fit_after_the_other(spark, sf_small):
    rows, names = q_eval.grid_scores(spark, sf_small)
    table = {r["vec_id"]: r for r in rows.collect()}
    got = {(r["k"], r["distance"], r["reference"]): r["accuracy"] for r in q_eval.q_experiment_grid(spark, sf_small).collect()}
    label = np.array([r["label"] for r in table.values()])
    train = np.array([r["fold"] for r in table.values()]) == 0
    assert len(got) == 16
    for name, c in list(zip(names, q_eval.GRID, strict=True))[::5]:
        x = np.array([r[name] for r in table.values()])
        spread = x[train].std(0)
        z = (x - x[train].mean(0)) / np.where(spread > 0, spread, 1)
        w = np.stack([_newton_logistic(z[train], (label[train] == k).astype(float)) for k in sorted(set(label))])
        best = np.array(sorted(set(label)))[(np.hstack([z, np.ones((len(z), 1))])[~train] @ w.T).argmax(axis=1)]
        assert got[c["k"], c["distance"], c["reference"]] == pytest.approx((best == label[~train]).mean(), abs=1e-6)


def test_kmeans_models_side_by_side_equal_single_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(f"key{i}", f"c{i % 2}", rng.normal(size=4).tolist()) for i in range(80)] + [("lone", "c9", [1.0, 2.0, 3.0, 4.0]), ("null", None, [0.0] * 4)]
    pts = spark.createDataFrame(rows, "key string, category string, embedding array<double>").repartition(3)
    both = kmeans_models(pts, {"a": (3, None), "b": (2, F.col("key") < "key5")}, seed=4)
    alone = kmeans_models(pts.filter("key < 'key5'"), {"b": (2, None)}, seed=4)["b"]
    as_dict = lambda d: {(r["category"], r["cluster"]): np.array(r["centroid"]) for r in d.collect()}
    got, want = as_dict(both["b"]), as_dict(alone)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert sum(k[0] == "c9" for k in as_dict(both["a"])) == 1
    far = kmeans_objective(pts.filter("category is not null"), pts.filter("category is not null").groupBy("category").agg(F.first("embedding").alias("centroid")).withColumn("cluster", F.lit(0)))
    assert kmeans_objective(pts.filter("category is not null"), both["a"]) < far


def test_order_statistics(spark):
    rng = np.random.default_rng(0)
    hot = [("hot", float(v)) for v in rng.integers(0, 5, 400)] + [("wide", float(v)) for v in rng.normal(size=101) * 10.0 ** rng.integers(-200, 200, 101)]
    hot += [("one", 7.0), ("two", 1.0), ("two", 4.0), (None, -1e308), (None, 1e308), ("none", None), ("one", float("nan"))]
    df = spark.createDataFrame(hot, "g string, v double").repartition(5)
    got = {r["g"]: r["median"] for r in exact_median(df, "v", ["g"]).collect()}
    for g in ("hot", "wide", "one", "two", None):
        assert got[g] == pytest.approx(np.median([v for k, v in hot if k == g and v is not None and not math.isnan(v)]))
    assert "none" not in got
    values = sorted(v for g, v in hot if g == "wide")
    for r in (1, 17, 101):
        found = select_rank(df.filter("g = 'wide'"), "v", F.lit(r)).first()
        assert (found["value"], found["below"], found["equal"]) == (values[r - 1], r - 1, 1)
    assert select_rank(df.filter("g = 'wide'"), "v", F.lit(102)).count() == 0
    summary = {r["g"]: r for r in column_summary(df.filter("not isnan(v) or v is null"), "g", "v").collect()}
    assert summary["two"]["mean"] == 2.5 and summary["two"]["median"] == 2.5 and summary["none"]["median"] is None
    whole = [(i, 2**62 + i) for i in range(50)]  # neighbours that doubles cannot tell apart
    assert select_rank(spark.createDataFrame(whole, "i int, v long"), "v", F.lit(20)).first()["value"] == 2**62 + 19


def test_exact_split(spark):
    for n in (0, 1, 7, 100):
        df = spark.range(n).withColumnRenamed("id", "k").repartition(3)
        got = V.exact_split(df, "k", 3, 0.6)
        assert got.filter("split = 'train'").count() == int(n * 0.6) and got.count() == n


def test_f_quantile_and_icc_limits():
    for p, d1, d2 in ((0.975, 9, 4.3), (0.025, 3, 50), (0.5, 1, 1), (0.975, 2.7, 120)):
        x = f_quantile(p, d1, d2)
        # P(F <= x) by Simpson's rule over u, t = sin(u)^2 of the beta integral
        top = math.asin(math.sqrt(d1 * x / (d1 * x + d2)))
        u = np.linspace(0, top, 200_001)[1:-1]
        f = 2 * np.sin(u) ** (d1 - 1) * np.cos(u) ** (d2 - 1)
        beta = math.exp(math.lgamma(d1 / 2) + math.lgamma(d2 / 2) - math.lgamma((d1 + d2) / 2))
        assert f.sum() * top / 200_000 / beta == pytest.approx(p, abs=1e-4)
    assert f_quantile(0.95, 2, 10) == pytest.approx(4.1028, abs=1e-4)  # printed tables
    # Shrout and Fleiss' ratings (6 objects, 4 raters): average agreement 0.620 with limits 0.071 and 0.927 in the literature
    x = np.array([[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8], [7, 1, 2, 6], [10, 5, 6, 9], [6, 2, 4, 7]], float)
    n, k = x.shape
    g = x.mean()
    msr = k * ((x.mean(1) - g) ** 2).sum() / (n - 1)
    msc = n * ((x.mean(0) - g) ** 2).sum() / (k - 1)
    mse = ((x - x.mean(1, keepdims=True) - x.mean(0) + g) ** 2).sum() / ((n - 1) * (k - 1))
    icc = (msr - mse) / (msr + (msc - mse) / n)
    low, high = icc_bounds(msr, msc, mse, icc, n, k)
    assert icc == pytest.approx(0.620, abs=1e-3) and low == pytest.approx(0.071, abs=2e-3) and high == pytest.approx(0.927, abs=2e-3)
    assert all(math.isnan(v) for v in icc_bounds(1.0, 1.0, 0.0, 1.0, 5, 3))


def test_token_spans(spark):
    texts = [(1, "An island, and the sand."), (2, None), (3, ""), (4, "été! Über-Land 12")]
    spans = E.encode_token_spans(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = span = E.span_rows(spans, "doc_id")
    for r in rows.collect():
        text = dict(texts)[r["doc_id"]]
        assert text[r["start"] : r["end"]] == r["token"] and len(r["embedding"]) == 16
    hit = {r["doc_id"]: r for r in E.keyword_vector(spans, "and").collect()}
    assert (hit[1]["pos"], hit[1]["start"], hit[1]["token"]) == (1, 3, "island") and hit[4]["token"] == "land" and hit[2]["embedding"] is None
    of = {(r["doc_id"], r["pos"]): r["embedding"] for r in span.collect()}
    assert hit[1]["embedding"] == of[1, 1]
    pooled = {r[0]: r[1] for r in spans.select("doc_id", E.pool_spans()).collect()}
    assert pooled[2] is None and np.allclose(pooled[1], np.mean([v for (d, _), v in of.items() if d == 1], axis=0))


def test_row_standardize_array(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([5.0, 5.0, 5.0],), (None,)], "x array<double>")
    got = [r[0] for r in df.select(row_standardize_array("x")).collect()]
    assert np.allclose(got[0], (np.array([1, 2, 3]) - 2) / np.std([1, 2, 3])) and got[1] == [0.0] * 3 and got[2] is None
