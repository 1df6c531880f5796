"""Hand-computed goldens."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lexicept.functions.stats import icc_average, paired_t_test, t_pvalue_scalar
from lexicept.operators import evaluate as V
from lexicept.operators import survey as U
from lexicept.operators.text import expand_contractions
from lexicept.sources import fixtures as fx


def test_t_pvalues_closed_forms():
    # df = 1 is the Cauchy law: P(|T| > t) = 1 - 2 atan(t) / pi
    assert abs(t_pvalue_scalar(1.0, 1.0) - 0.5) < 1e-12
    # df = 2: P(|T| > t) = 1 - t / sqrt(2 + t^2)
    assert abs(t_pvalue_scalar(1.0, 2.0) - (1 - 1 / math.sqrt(3))) < 1e-12
    # one-sided
    assert abs(t_pvalue_scalar(1.0, 1.0, "greater") - 0.25) < 1e-12
    assert abs(t_pvalue_scalar(-1.0, 1.0, "greater") - 0.75) < 1e-12
    # critical value of the two-sided 5% test with 10 degrees of freedom
    assert abs(t_pvalue_scalar(2.228138851986, 10.0) - 0.05) < 1e-9


def test_paired_t_test_hand_example(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (4.0, 1.0)], "a double, b double")
    r = paired_t_test(df, "a", "b").first()
    # d = 1, 1, 3: mean 5/3, sample sd sqrt(4/3), t = (5/3) / (sqrt(4/3) / sqrt(3)) = 2.5
    assert r["n"] == 3 and abs(r["t"] - 2.5) < 1e-12 and r["df"] == 2.0
    assert abs(r["p_two_sided"] - (1 - 2.5 / math.sqrt(2 + 6.25))) < 1e-12


def test_icc_on_labels_matches_fixture_golden(spark, sf_check):
    out = icc_average(fx.fx_survey_long(spark, sf_check), "object", "rater", "score").first()
    assert abs(out["msr"] - 0.114167) < 5e-7
    assert abs(out["msc"] - 105.388471) < 5e-7
    assert abs(out["mse"] - 0.122140) < 5e-7
    assert abs(out["icc"] - (-0.021091)) < 5e-6


def test_weighted_f1_hand_example(spark):
    # labels/predictions: class 0 -> tp 2, fn 1; class 1 -> tp 1, fp 1
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)], "label long, prediction long")
    r = V.classification_metrics(df).first()
    f1_0 = 2 * 1.0 * (2 / 3) / (1.0 + 2 / 3)
    f1_1 = 2 * 0.5 * 1.0 / 1.5
    assert abs(r["accuracy"] - 0.75) < 1e-12
    assert abs(r["f1_weighted"] - (3 * f1_0 + 1 * f1_1) / 4) < 1e-12


def test_object_key_pads_without_truncating(spark):
    df = spark.createDataFrame([("3_QS1C1_2",), ("12_QS1C1_1",), ("123_QS_1",)], "o string")
    got = [r[0] for r in df.select(U.object_key("o")).collect()]
    assert got == ["03_QS1C1", "12_QS1C1", "123_QS"]


def test_contraction_expansion(spark):
    df = spark.createDataFrame([(1, "I'm sure it's fine, can't you see?"), (2, "Nothing to expand")], "id long, text string")
    out = {r["id"]: r["text"] for r in expand_contractions(df, "text", fx.fx_contractions(spark)).collect()}
    assert out == {1: "i am sure it is fine, cannot you see?", 2: "nothing to expand"}


def test_stratified_allocation_hand_example(spark):
    # 6 rows of class 0 then 4 of class 1, five folds
    bounds = V._stratified_bounds([(0, 6), (1, 4)], 5)
    assert bounds == {0: [2, 3, 4, 5, 6], 1: [0, 1, 2, 3, 4]}
    df = spark.createDataFrame([(i, 0 if i < 6 else 1) for i in range(10)], "k long, y long")
    folds = [r["fold"] for r in V.stratified_folds(df, "k", "y").orderBy("k").collect()]
    assert folds == [0, 0, 1, 2, 3, 4, 1, 2, 3, 4]


def test_majority_tie_goes_to_smallest_label(spark):
    df = spark.createDataFrame([(0, 2), (0, 1), (0, 2), (0, 1), (0, 3)], "fold int, label long")
    r = V.majority_baseline_cv(df, "label").first()
    assert r["majority"] == 1 and abs(r["accuracy"] - 0.4) < 1e-12


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7],), ([0.9, 0.1, 0.0],)], "s array<double>")
    assert [r[0] for r in df.select(V.argmax_prediction("s")).collect()] == [1, 0]


def test_pearson_zero_variance_is_null(spark):
    from lexicept.functions.stats import row_pearson

    df = spark.createDataFrame([(1.0, 2.0, 3.0, 5.0, 5.0, 5.0)], "a1 double, a2 double, a3 double, b1 double, b2 double, b3 double")
    assert df.select(row_pearson(["a1", "a2", "a3"], ["b1", "b2", "b3"])).first()[0] is None


def test_survey_drop_sparse_and_attention(spark):
    wide = spark.createDataFrame(
        [("r1", "Not expressed", None, "Most likely expressed"), ("r2", "Potentially expressed", None, "Not expressed")],
        "QProlificID string, `1_QS1C1_1` string, `2_QS1C1_1` string, `21_QS1C1_1` string",
    )
    kept = U.drop_sparse_columns(wide, 1)
    assert "2_QS1C1_1" not in kept.columns
    att = {r[0]: r[1] for r in U.attention_score(kept).collect()}
    assert att == {"r1": 0, "r2": 1}
    long = {(r["Rater"], r["Object"]): r["Score"] for r in U.survey_to_long(kept).collect()}
    assert long == {("r1", "1_QS1C1_1"): 0, ("r2", "1_QS1C1_1"): 1}


def test_subword_greedy_longest_match(spark):
    from lexicept.operators.text import subword_tokens

    docs = spark.createDataFrame([(1, "Unaffable playing"), (2, "xyz play")], "doc_id long, text string")
    pieces = spark.createDataFrame([(p,) for p in ["un", "##aff", "##able", "play", "##ing", "p", "##lay"]], "piece string")
    got = {}
    for r in subword_tokens(docs, "doc_id", "text", pieces).collect():
        got.setdefault(r["doc_id"], []).append((r["pos"], r["token"]))
    assert [t for _, t in sorted(got[1])] == ["un", "##aff", "##able", "play", "##ing"]
    assert [t for _, t in sorted(got[2])] == ["[UNK]", "play"]


def test_index_labels_unseen_classes(spark):
    import pytest

    df = spark.createDataFrame([("a",), ("z",)], "label string")
    mapping = V.label_index(spark.createDataFrame([("b",), ("a",)], "label string"))
    assert mapping == {"a": 0, "b": 1}
    assert [(r[0], r[1]) for r in V.index_labels(df, mapping).orderBy("label").collect()] == [("a", 0), ("z", None)]
    assert V.index_labels(df, mapping, handle_invalid="skip").count() == 1
    with pytest.raises(Exception):
        V.index_labels(df, mapping, handle_invalid="error").collect()
