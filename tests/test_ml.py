"""Spark ML fits: optimality and thresholds."""

from __future__ import annotations

from lexicept.operators import evaluate as V
from lexicept.plans import q_eval


def test_unconverged_weights_fail_the_certificate(spark, sf_small):
    tr, _ = q_eval._scaled_split(spark, sf_small)
    fitted, mapping = V.fit_model(tr, q_eval.POINT_CATEGORIES, "label", max_iter=1)
    worst = max(abs(r["gradient"]) for r in V.classifier_gradient(fitted, mapping, tr, q_eval.POINT_CATEGORIES, "label").collect())
    assert worst > 1e-3


def test_null_labels(spark):
    df = spark.createDataFrame([(0, 0, 10.0), (1, 0, None), (2, 1, 20.0), (3, 1, 20.0)], "id long, fold int, y double")
    got = {r["fold"]: r["rmse"] for r in V.mean_baseline_cv(df, "y").collect()}
    assert got == {0: 10.0, 1: 10.0}
    folds = V.stratified_folds(spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(12)], "id long, y string"), "id", "y", 2)
    assert sorted((r["y"] or "", r["count"]) for r in folds.groupBy("fold", "y").count().collect()) == [("", 2), ("", 2), ("a", 4), ("a", 4)]
    metrics = V.regression_metrics(spark.createDataFrame([(1e9 + i, 1e9 + i) for i in range(5)] + [(None, 1.0)], "label double, prediction double")).first()
    assert metrics["n"] == 5 and metrics["r2"] == 1.0
