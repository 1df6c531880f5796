"""The run store: reruns replace exactly their runs, broken runs stay invisible."""

from __future__ import annotations

import pytest

from lexicept.sources import runs as R

SCHEMA = "model string, fold string, score double, key long"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rerun_replaces_its_runs_only(spark, tmp_path):
    path = str(tmp_path / "store")
    first = [("svm", "01", 0.5, 1), ("svm", "01", 0.6, 2), ("svm", "1", 0.7, 3), (None, "1", 0.8, 4), ("a=b/c", "1", 0.9, 5)]
    R.store_runs(spark.createDataFrame(first, SCHEMA), path, ["model", "fold"])
    assert _rows(R.stored_runs(spark, path)) == sorted(first, key=repr)  # "01" and "1" are different folds
    again = [("svm", "01", 0.1, 9), (None, "1", 0.2, 10)]
    R.store_runs(spark.createDataFrame(again, SCHEMA), path, ["model", "fold"])
    kept = [("svm", "1", 0.7, 3), ("a=b/c", "1", 0.9, 5)]
    assert _rows(R.stored_runs(spark, path)) == sorted(again + kept, key=repr)
    assert _rows(R.stored_runs(spark, path, model=None)) == [again[1]]
    assert _rows(R.stored_runs(spark, path, model="svm", fold="01")) == [again[0]]
    assert R.stored_runs(spark, path, model="none").count() == 0
    assert sorted((r["model"] or "", r["fold"]) for r in R.superseded(spark, path).collect()) == [("", "1"), ("svm", "01")]


def test_broken_and_empty_runs(spark, tmp_path):
    path = str(tmp_path / "store")
    good = spark.createDataFrame([("m", "1", 0.5, 1), ("m", "2", 0.6, 2)], SCHEMA)
    R.store_runs(good, path, ["model", "fold"])
    R.write_attempt(spark.createDataFrame([("m", "1", 9.9, 7), ("new", "1", 9.9, 8)], SCHEMA), path, ["model", "fold"])
    assert _rows(R.stored_runs(spark, path)) == _rows(good)  # written, never committed
    gone = spark.createDataFrame([("m", "2")], "model string, fold string")
    R.store_runs(good.limit(0), path, ["model", "fold"], empty_runs=gone)
    assert _rows(R.stored_runs(spark, path)) == [("m", "1", 0.5, 1)]
    other = str(tmp_path / "other")
    R.store_runs(good.limit(0), other, ["model", "fold"], empty_runs=gone)
    assert R.stored_runs(spark, other).columns == good.columns
    assert R.stored_runs(spark, other).count() == 0


def test_only_the_wanted_run_is_opened(spark, tmp_path):
    path = str(tmp_path / "store")
    for fold in "123":
        R.store_runs(spark.createDataFrame([("m", fold, 0.5, int(fold))], SCHEMA), path, ["model", "fold"])
    plan = R.stored_runs(spark, path, fold="2")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_refused_inputs(spark, tmp_path):
    df = spark.createDataFrame([("m", "1", 0.5, 1)], SCHEMA)
    with pytest.raises(ValueError):
        R.store_runs(df, str(tmp_path / "a"), ["absent"])
    with pytest.raises(ValueError):
        R.store_runs(df.withColumnRenamed("key", R.ATTEMPT), str(tmp_path / "a"), ["model"])
    R.store_runs(df, str(tmp_path / "a"), ["model"])
    with pytest.raises(ValueError):
        R.stored_runs(spark, str(tmp_path / "a"), colour="red")
