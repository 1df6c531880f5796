"""Invariants of the core operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexicept.functions.ranking import global_row_number
from lexicept.functions.vectors import cosine, norm
from lexicept.operators import lexicon as L
from lexicept.operators import scaling as S
from lexicept.operators.centroids import kmeans_centroids, kmeans_objective, mean_centroids
from lexicept.operators.evaluate import contiguous_folds, stratified_folds
from lexicept.operators.represent import concept_matrix, concept_similarity
from lexicept.operators.text import tokenize
from lexicept.sources import fixtures as fx

CATS5 = ["article", "conj", "prep", "th_words", "absent"]


def _points(spark, sf):
    return fx.fx_centroid_points(spark, sf)


def test_similarity_bounds_and_zero_fill(spark, sf_small):
    pts = _points(spark, sf_small)
    emb = fx.table(spark, sf_small, "embeddings").select("vec_id", "embedding")
    sims = concept_similarity(emb, mean_centroids(pts), fx.fx_point_categories(spark, sf_small), "vec_id")
    row = sims.agg(F.min("similarity"), F.max("similarity")).first()
    assert -1.0 - 1e-12 <= row[0] and row[1] <= 1.0 + 1e-12
    empty = sims.filter(F.col("category") == "c_empty").agg(F.max(F.abs("similarity"))).first()[0]
    assert empty == 0.0


def test_one_row_category_has_self_similarity_one(spark):
    pts = spark.createDataFrame(
        [("solo", 1, [0.3, -0.2, 0.5]), ("pair", 2, [1.0, 0.0, 0.0]), ("pair", 3, [0.0, 1.0, 0.0])],
        "category string, key long, embedding array<float>",
    )
    cats = spark.createDataFrame([("solo", 0), ("pair", 1)], "category string, ord int")
    docs = pts.select(F.col("key").alias("doc_id"), "embedding")
    m = {r["doc_id"]: r for r in concept_matrix(docs, mean_centroids(pts), cats).collect()}
    assert abs(m[1]["solo"] - 1.0) < 1e-9


def test_zero_vector_scores_zero(spark):
    pts = spark.createDataFrame([("a", 1, [1.0, 0.0])], "category string, key long, embedding array<float>")
    cats = spark.createDataFrame([("a", 0)], "category string, ord int")
    docs = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "doc_id long, embedding array<float>")
    out = {r["doc_id"]: r["a"] for r in concept_matrix(docs, mean_centroids(pts), cats).collect()}
    assert out == {1: 0.0, 2: 0.0}


def test_kmeans_k1_equals_mean_and_objective_never_rises(spark, sf_small):
    pts = _points(spark, sf_small)
    k1 = {r["category"]: np.array(r["centroid"]) for r in kmeans_centroids(pts, 1, seed=3, iterations=1, key_col="key").collect()}
    mean = {r["category"]: np.array(r["centroid"]) for r in mean_centroids(pts).collect()}
    assert k1.keys() == mean.keys()
    assert max(np.abs(k1[c] - mean[c]).max() for c in k1) < 1e-9
    objs = [kmeans_objective(pts, kmeans_centroids(pts, 3, seed=5, iterations=it, key_col="key"), key_col="key")
            for it in (0, 1, 3)]
    assert objs[0] >= objs[1] - 1e-6 and objs[1] >= objs[2] - 1e-6


def test_category_with_fewer_rows_than_k(spark):
    pts = spark.createDataFrame(
        [("small", 1, [1.0, 0.0]), ("small", 2, [0.0, 1.0]), ("big", 3, [1.0, 1.0]), ("big", 4, [2.0, 2.0]),
         ("big", 5, [5.0, 5.0]), ("big", 6, [6.0, 6.0])],
        "category string, key long, embedding array<float>",
    )
    out = kmeans_centroids(pts, 3, seed=1, iterations=2, key_col="key")
    sizes = {r["category"]: r["n"] for r in out.groupBy("category").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"small": 2, "big": 3}


def test_row_standardize_mean_zero_std_one(spark, sf_small):
    pts = _points(spark, sf_small)
    emb = fx.table(spark, sf_small, "embeddings").select("vec_id", "embedding")
    cats = [f"c{i}" for i in range(10)]
    m = concept_matrix(emb, mean_centroids(pts), fx.fx_point_categories(spark, sf_small), "vec_id").select("vec_id", *cats)
    z = S.row_standardize(m, cats).toPandas()[cats].to_numpy()
    assert np.abs(z.mean(axis=1)).max() < 1e-9
    assert np.abs(z.std(axis=1) - 1).max() < 1e-9


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0), (3, 9.0, 5.0)], "id long, a double, b double")
    out = S.column_standardize(df, ["a", "b"]).toPandas()
    assert (out["b"] == 0.0).all()
    assert abs(out["a"].mean()) < 1e-12 and abs(out["a"].std(ddof=0) - 1) < 1e-12


def test_counts_at_least_flags(spark, sf_small):
    docs = fx.documents(spark, sf_small)
    lex = fx.fx_lexicon(spark)
    c = L.lexicon_counts(docs, lex, CATS5)
    f = L.lexicon_counts(docs, lex, CATS5, binary=True, value_col="flag")
    j = c.join(f, ["doc_id", "category"])
    assert j.filter(F.col("n") < F.col("flag")).count() == 0
    assert j.filter((F.col("n") > 0) != (F.col("flag") == 1)).count() == 0


def test_minimised_lexicon_matches_naive_distinct(spark, sf_small):
    """Each (position, category) is hit once without a distinct, exactly as the naive match + distinct."""
    lex = spark.createDataFrame(
        [("p", 0, "in*"), ("p", 0, "int*"), ("p", 0, "into"), ("p", 0, "in"), ("q", 1, "in*"), ("q", 1, "th*")],
        "category string, ord int, pattern string",
    )
    toks = tokenize(fx.documents(spark, sf_small), "doc_id", "text")
    fast = L.match_tokens(toks, lex).select("doc_id", "pos", "category")
    naive = toks.crossJoin(F.broadcast(lex)).filter(
        F.when(F.col("pattern").endswith("*"), F.col("token").startswith(F.regexp_replace("pattern", r"\*$", "")))
        .otherwise(F.col("token") == F.col("pattern"))
    ).select("doc_id", "pos", "category").distinct()
    assert fast.count() == naive.count()
    assert fast.exceptAll(naive).count() == 0


def test_soft_counts_rewrite_equals_naive_product(spark, sf_small):
    docs = fx.documents(spark, sf_small)
    lex, cats = fx.fx_lexicon(spark), fx.fx_categories(spark)
    wv = fx.fx_word_vectors(spark, sf_small)
    fast = L.soft_lexicon_counts(docs, lex, cats, wv).toPandas().set_index(["doc_id", "category"])["score"]
    # naive: every token vector against every category word vector
    toks = tokenize(docs, "doc_id", "text").join(wv.select("token", F.col("embedding").alias("t")), "token")
    words = L.word_categories(wv.select(F.col("token").alias("word")), lex).join(
        wv.select(F.col("token").alias("word"), F.col("embedding").alias("w")), "word")
    naive = toks.join(F.broadcast(words), how="cross").groupBy("doc_id", "category").agg(F.sum(cosine("t", "w")).alias("s"))
    nv = naive.toPandas().set_index(["doc_id", "category"])["s"]
    joined = fast.to_frame().join(nv, how="left").fillna(0.0)
    assert np.abs(joined["score"] - joined["s"]).max() < 1e-8


def test_fold_sizes_differ_by_at_most_one(spark, sf_small):
    emb = fx.table(spark, sf_small, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    sizes = [r[1] for r in contiguous_folds(emb, "vec_id").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    st = stratified_folds(emb, "vec_id", "label").groupBy("label", "fold").count().toPandas()
    per = st.groupby("label")["count"].agg(["min", "max"])
    assert (per["max"] - per["min"] <= 1).all()


def test_global_row_number_matches_window(spark, sf_small):
    emb = fx.table(spark, sf_small, "embeddings").select("vec_id", "label")
    got = global_row_number(emb, [F.asc("vec_id")], "r", group_cols=["label"], partitions=3)
    want = emb.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    assert got.select("vec_id", "label", "r").exceptAll(want.select("vec_id", "label", F.col("r").cast("long"))).count() == 0
    assert got.count() == emb.count()


def test_null_and_empty_text_give_no_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "The cat")], "doc_id long, text string")
    toks = tokenize(df, "doc_id", "text").collect()
    assert [(r["doc_id"], r["pos"], r["token"]) for r in toks] == [(3, 0, "the"), (3, 1, "cat")]
    counts = L.lexicon_counts(df, spark.createDataFrame([("article", 0, "the")], "category string, ord int, pattern string"), ["article"])
    assert sorted((r["doc_id"], r["n"]) for r in counts.collect()) == [(1, 0), (2, 0), (3, 1)]


def test_vector_helpers(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(norm("a").alias("n"), cosine("a", "b").alias("c")).collect()
    assert r[0]["n"] == 5.0 and abs(r[0]["c"] - 1.0) < 1e-12 and r[1]["c"] == 0.0


def test_salted_lookup_join_equals_broadcast_join(spark, sf_small):
    from lexicept.functions.sizing import lookup_join

    toks = tokenize(fx.documents(spark, sf_small), "doc_id", "text")
    wv = fx.fx_word_vectors(spark, sf_small).select("token", "rank")
    fast = lookup_join(toks, wv, "token", ["doc_id", "pos"])
    salted = lookup_join(toks, wv, "token", ["doc_id", "pos"], bound=0, buckets=7)
    assert salted.count() == fast.count()
    assert salted.select(*fast.columns).exceptAll(fast).count() == 0


def test_wide_lexicon_pivot_path_equals_conditional_counts(spark, sf_small, monkeypatch):
    docs = fx.documents(spark, sf_small)
    lex = fx.fx_lexicon(spark)
    a = L.lexicon_counts_wide(docs, lex, CATS5)
    monkeypatch.setattr(L, "CONDITIONAL_COUNT_MAX_CATEGORIES", 2)
    b = L.lexicon_counts_wide(docs, lex, CATS5)
    assert a.count() == b.count()
    assert a.select("doc_id", *CATS5).exceptAll(b.select("doc_id", *CATS5)).count() == 0


def test_wide_lexicon_soft_vector_path_equals_column_sums(spark, sf_small, monkeypatch):
    docs = fx.documents(spark, sf_small)
    lex, cats, wv = fx.fx_lexicon(spark), fx.fx_categories(spark), fx.fx_word_vectors(spark, sf_small)
    a = L.soft_lexicon_counts_wide(docs, lex, cats, wv).toPandas().set_index("doc_id").sort_index()
    monkeypatch.setattr(L, "CONDITIONAL_COUNT_MAX_CATEGORIES", 2)
    b = L.soft_lexicon_counts_wide(docs, lex, cats, wv).toPandas().set_index("doc_id").sort_index()
    assert a.shape == b.shape
    assert float((a[CATS5] - b[CATS5]).abs().max().max()) < 1e-9


def test_long_form_variants_match_wide(spark):
    from lexicept.functions.stats import pearson_agg, row_pearson

    wide = spark.createDataFrame([(1, 1.0, 2.0, 4.0), (2, 3.0, 3.0, 0.0), (3, 5.0, 1.0, 2.0)], "doc_id long, a double, b double, c double")
    cols = ["a", "b", "c"]
    long = wide.unpivot(["doc_id"], cols, "category", "v")
    rw = {r["doc_id"]: r for r in S.row_standardize(wide, cols).collect()}
    for r in S.row_standardize_long(long, "doc_id", "v", "z").collect():
        assert abs(r["z"] - rw[r["doc_id"]][r["category"]]) < 1e-12
    fitted = {r["category"]: (r["mean"], r["std"]) for r in S.fit_columns_long(long, "category", "v").collect()}
    assert all(abs(fitted[c][0] - m) < 1e-12 and abs(fitted[c][1] - s) < 1e-12 for c, (m, s) in S.fit_columns(wide, cols).items())
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, 5.0), (4.0, 9.0)], "x double, y double")
    r_agg = pairs.agg(pearson_agg("x", "y")).first()[0]
    one_row = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 2.0, 4.5, 5.0, 9.0)], "x1 double, x2 double, x3 double, x4 double, y1 double, y2 double, y3 double, y4 double")
    r_row = one_row.select(row_pearson(["x1", "x2", "x3", "x4"], ["y1", "y2", "y3", "y4"])).first()[0]
    assert abs(r_agg - r_row) < 1e-12 and abs(r_agg - float(np.corrcoef([1, 2, 3, 4], [2, 4.5, 5, 9])[0, 1])) < 1e-12


def test_blocked_model_scoring_equals_single_block(spark, sf_small, monkeypatch):
    from lexicept.operators import represent as RP

    pts = _points(spark, sf_small)
    emb = fx.table(spark, sf_small, "embeddings").select("vec_id", "embedding")
    cats = fx.fx_point_categories(spark, sf_small)
    cent = kmeans_centroids(pts, 2, seed=5, iterations=1, key_col="key")
    names = ["vec_id"] + [f"c{i}" for i in range(10)] + ["c_empty"]
    one = RP.concept_matrix(emb, cent, cats, "vec_id").select(*names).toPandas().set_index("vec_id").sort_index()
    long_one = RP.concept_similarity(emb, cent, cats, "vec_id").toPandas()
    monkeypatch.setattr(RP, "MAX_MODEL_CELLS", 64 * 3)  # at most three centroids per broadcast block
    many = RP.concept_matrix(emb, cent, cats, "vec_id").select(*names).toPandas().set_index("vec_id").sort_index()
    long_many = RP.concept_similarity(emb, cent, cats, "vec_id").toPandas()
    assert float((one - many).abs().max().max()) < 1e-12
    key = ["vec_id", "category"]
    m = long_one.merge(long_many, on=key, how="outer", suffixes=("_a", "_b"))
    assert len(long_many) == len(long_one) == len(m)
    assert float((m["similarity_a"] - m["similarity_b"]).abs().max()) < 1e-12
