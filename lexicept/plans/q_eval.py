"""Queries: folds, splits, baselines, metrics, Spark ML fits and sources/sinks."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash, stable_hash_sql
from ..operators import evaluate as V
from ..operators import lexicon as L
from ..operators import scaling as S
from ..operators.centroids import kmeans_models, mean_centroids
from ..operators.represent import concept_matrix, score_blocks
from ..operators.shared_fit import Loss, evaluate_many
from ..session import table_path
from ..sources import fixtures as fx
from ..sources.readers import sample_n, select_run, write_result
from ..sources.runs import current_runs, store_runs, stored_runs, write_attempt
from .common import POINT_CATEGORIES, long_, r6, sql_centroid_lists, sql_r6
from .q_lexicon import EXPANDED_TOKENS, LEX_CATS, _counts_sql
from .fit_sql import logistic_sql, regression_sql
from .registry import query

W = fx.with_ctes
FOLD_SEED, SPLIT_SEED, SAMPLE_SEED = 3, 203948, 220511
#: Rows that stand for the kernel's span.
LANDMARKS = 96


def _emb(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))


def _features(spark, sf):
    """Concept matrix of the embedding points with their label."""
    emb = _emb(spark, sf)
    pts = fx.fx_centroid_points(spark, sf)
    return concept_matrix(emb, mean_centroids(pts), fx.fx_point_categories(spark, sf), "vec_id", keep=["label", "embedding"])


# ---------------------------------------------------------------- folds and splits

_STRAT_SQL = (
    "cnt AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)",
    "cs AS (SELECT label, n, sum(n) OVER (ORDER BY label) - n AS s FROM cnt)",
    "alloc AS (SELECT label, r.i, CAST(floor((s + n - 1 - r.i) / 5.0) - floor((s - 1 - r.i) / 5.0) AS BIGINT) AS a "
    "FROM cs, range(5) r(i))",
    "cum AS (SELECT label, i, sum(a) OVER (PARTITION BY label ORDER BY i) AS c FROM alloc)",
    "pos AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p FROM embeddings)",
    "sfolds AS (SELECT pos.vec_id, CAST(pos.label AS BIGINT) AS label, CAST((SELECT count(*) FROM cum WHERE cum.label = pos.label "
    "AND cum.c <= pos.p) AS BIGINT) AS fold FROM pos)",
)


@query("contiguous_folds", "SELECT vec_id, CAST(ntile(5) OVER (ORDER BY vec_id) - 1 AS BIGINT) AS fold FROM embeddings")
def q_contiguous_folds(spark, sf):
    return V.contiguous_folds(_emb(spark, sf), "vec_id").select("vec_id", long_("fold", "fold"))


@query("stratified_folds", W(*_STRAT_SQL) + "SELECT vec_id, label, fold FROM sfolds")
def q_stratified_folds(spark, sf):
    return V.stratified_folds(_emb(spark, sf), "vec_id", "label").select("vec_id", "label", long_("fold", "fold"))


@query(
    "random_split",
    f"SELECT doc_id, CASE WHEN ({stable_hash_sql('doc_id', SPLIT_SEED)}) % 100 < 75 THEN 'train' ELSE 'validation' END AS split "
    "FROM documents",
)
def q_random_split(spark, sf):
    return V.random_split(fx.documents(spark, sf), "doc_id", SPLIT_SEED).select("doc_id", "split")


@query(
    "exact_split",
    f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY ({stable_hash_sql('doc_id', SPLIT_SEED)}), doc_id) <= floor(0.75 * count(*) OVER ()) "
    "THEN 'train' ELSE 'validation' END AS split FROM documents",
)
def q_exact_split(spark, sf):
    return V.exact_split(fx.table(spark, sf, "documents").select("doc_id"), "doc_id", SPLIT_SEED)


@query(
    "clean_targets",
    "SELECT d.doc_id, CAST(l.quality AS BIGINT) AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id "
    "WHERE d.text IS NOT NULL AND l.quality IS NOT NULL",
)
def q_clean_targets(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    lab = fx.table(spark, sf, "labels").select("doc_id", long_("quality", "quality"))
    return V.clean_targets(docs.join(lab, "doc_id", "left"), "quality", "text").select("doc_id", "label")


@query(
    "index_labels",
    "WITH tr AS (SELECT lang FROM documents WHERE (" + stable_hash_sql("doc_id", SPLIT_SEED) + ") % 100 < 75), "
    "idx AS (SELECT lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS BIGINT) AS label_idx FROM (SELECT DISTINCT lang FROM tr)) "
    "SELECT d.doc_id, d.lang, idx.label_idx FROM documents d LEFT JOIN idx ON idx.lang = d.lang",
)
def q_index_labels(spark, sf):
    docs = V.random_split(fx.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", SPLIT_SEED)
    mapping = V.label_index(docs.filter(F.col("split") == "train"), "lang")
    return V.index_labels(docs, mapping, "lang").select("doc_id", "lang", "label_idx")


@query(
    "majority_baseline",
    W(*_STRAT_SQL, "fc AS (SELECT fold, label, count(*) AS n FROM sfolds GROUP BY fold, label)")
    + "SELECT fold, label AS majority, " + sql_r6("n / sum(n) OVER (PARTITION BY fold)") + " AS accuracy FROM fc "
    "QUALIFY row_number() OVER (PARTITION BY fold ORDER BY n DESC, label ASC) = 1",
)
def q_majority_baseline(spark, sf):
    folds = V.stratified_folds(_emb(spark, sf), "vec_id", "label")
    out = V.majority_baseline_cv(folds, "label")
    return out.select(long_("fold", "fold"), "majority", r6("accuracy", "accuracy"))


@query(
    "mean_baseline",
    W("f AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS y, ntile(5) OVER (ORDER BY doc_id) - 1 AS fold FROM documents)",
      "st AS (SELECT fold, sum(y) AS s, count(*) AS n FROM f GROUP BY fold)",
      "fm AS (SELECT fold, ((SELECT sum(s) FROM st) - s) / ((SELECT sum(n) FROM st) - n) AS m_train, s / n AS m_test FROM st)")
    + "SELECT CAST(f.fold AS BIGINT) AS fold, " + sql_r6("1 - sum((y - m_train) ^ 2) / sum((y - m_test) ^ 2)") + " AS r2, "
    + sql_r6("sqrt(sum((y - m_train) ^ 2) / count(*))") + " AS rmse FROM f JOIN fm ON fm.fold = f.fold GROUP BY f.fold",
)
def q_mean_baseline(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    out = V.mean_baseline_cv(V.contiguous_folds(docs, "doc_id"), "n_chars")
    return out.select(long_("fold", "fold"), r6("r2", "r2"), r6("rmse", "rmse"))


_PRED_SQL = W(fx.CENTROID_POINTS_SQL, fx.POINT_CATEGORIES_SQL, f"cent AS ({sql_centroid_lists()})") + (
    "SELECT e.vec_id, CAST(e.label AS BIGINT) AS label, CAST(row_number() OVER (PARTITION BY e.vec_id ORDER BY "
    "coalesce(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c), 0) DESC, k.ord ASC) AS BIGINT) AS rk, "
    "CAST(k.ord AS BIGINT) AS ord FROM embeddings e CROSS JOIN fx_point_categories k LEFT JOIN cent c ON c.category = k.category"
)
# category position in output order: c0..c9 -> 0..9, c_empty -> 10
_PREDICTIONS = f"SELECT vec_id, label, CASE WHEN ord = 1000 THEN 10 ELSE ord END AS prediction FROM ({_PRED_SQL}) WHERE rk = 1"


def _predictions(spark, sf):
    m = _features(spark, sf)
    scores = F.array(*[F.col(c) for c in POINT_CATEGORIES])
    return m.select("vec_id", "label", V.argmax_prediction(scores).alias("prediction"))


@query("argmax_prediction", _PREDICTIONS.replace("SELECT vec_id, label,", "SELECT vec_id,", 1))
def q_argmax_prediction(spark, sf):
    return _predictions(spark, sf).select("vec_id", "prediction")


@query(
    "metrics",
    W(f"p AS ({_PREDICTIONS})",
      "conf AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY label, prediction)",
      "cls AS (SELECT label AS c FROM conf UNION SELECT prediction FROM conf)",
      "per AS (SELECT cls.c, coalesce((SELECT sum(n) FROM conf WHERE label = cls.c), 0) AS support, "
      "coalesce((SELECT sum(n) FROM conf WHERE prediction = cls.c), 0) AS npred, "
      "coalesce((SELECT sum(n) FROM conf WHERE label = cls.c AND prediction = cls.c), 0) AS tp FROM cls)",
      "f AS (SELECT support, tp, CASE WHEN npred = 0 THEN 0 ELSE tp / npred END AS pr, "
      "CASE WHEN support = 0 THEN 0 ELSE tp / support END AS rc FROM per)")
    + "SELECT CAST(sum(support) AS BIGINT) AS n, " + sql_r6("sum(tp) / sum(support)") + " AS accuracy, "
    + sql_r6("sum(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END * support) / sum(support)") + " AS f1_weighted, "
    + sql_r6("(SELECT sqrt(avg((label - prediction) ^ 2)) FROM p)") + " AS rmse, "
    + sql_r6("(SELECT 1 - sum((label - prediction) ^ 2) / (sum(label * label) - sum(label) * sum(label) / count(*)) FROM p)")
    + " AS r2 FROM f",
)
def q_metrics(spark, sf):
    p = _predictions(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)  # read by both metric families
    c = V.classification_metrics(p, "label", "prediction")
    r = V.regression_metrics(p, "label", "prediction")
    # both are single-row aggregates: the regression pair rides along as scalar subqueries
    return c.select(long_("n", "n"), r6("accuracy", "accuracy"), r6("f1_weighted", "f1_weighted"),
                    r6(r.select("rmse").scalar(), "rmse"), r6(r.select("r2").scalar(), "r2"))


# ---------------------------------------------------------------- Spark ML fits


def _split_features(spark, sf):
    m = V.random_split(_features(spark, sf), "vec_id", SPLIT_SEED).persist(StorageLevel.MEMORY_AND_DISK)
    return m.filter(F.col("split") == "train"), m.filter(F.col("split") == "validation")


def _scaled_split(spark, sf):
    tr, te = _split_features(spark, sf)
    sc = S.fit_columns(tr, POINT_CATEGORIES)
    return S.apply_columns(tr, sc, POINT_CATEGORIES), S.apply_columns(te, sc, POINT_CATEGORIES)


_TRAIN_SQL = f"tr AS (SELECT label, ({stable_hash_sql('vec_id', SPLIT_SEED)}) % 100 < 75 AS train FROM embeddings)"
_FEATURES_SQL = "f(feature) AS (VALUES " + ", ".join(f"('{c}')" for c in [*POINT_CATEGORIES, "intercept"]) + ")"


@query(
    "fit_classifier",
    W(_TRAIN_SQL, _FEATURES_SQL)
    + "SELECT CAST(label AS BIGINT) AS class, feature, 0.0::DOUBLE AS gradient, CAST((SELECT count(*) FROM tr WHERE train) AS BIGINT) AS n_train "
    "FROM (SELECT DISTINCT label FROM tr WHERE train) CROSS JOIN f",
)
def q_fit_classifier(spark, sf):
    """The fitted weights' certificate: the objective's gradient vanishes in every class and feature."""
    tr, _ = _scaled_split(spark, sf)
    fitted, mapping = V.fit_model(tr, POINT_CATEGORIES, "label")
    g = V.classifier_gradient(fitted, mapping, tr, POINT_CATEGORIES, "label")
    return g.select("class", "feature", (F.round("gradient", 3) + F.lit(0.0)).alias("gradient"), F.lit(tr.count()).cast("long").alias("n_train"))


def _arrays(df, cols, *keep):
    return df.select(*keep, F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))


def _class_numbers(df):
    """Rows with the number of their class, and how many classes there are."""
    mapping = V.label_index(df, "label")
    return V.index_labels(df, mapping, "label", "y"), len(mapping)


def _majority(df):
    """(fold, baseline): the accuracy of the test fold's own majority."""
    return V.majority_baseline_cv(df, "label").select(F.col("fold").cast("int").alias("fold"), r6("accuracy", "baseline"))


def _held_split(spark, sf):
    """The split as folds: training rows 0, validation rows 1."""
    m = V.random_split(_features(spark, sf), "vec_id", SPLIT_SEED)
    return m.withColumn("fold", F.when(F.col("split") == "train", 0).otherwise(1))


@query("fit_svm")
def q_fit_svm(spark, sf):
    """Linear support vector machines, one against the rest: held-out accuracy and the gradient left at the solution."""
    rows, n = _class_numbers(_arrays(_held_split(spark, sf), POINT_CATEGORIES, "vec_id", "label", "fold"))
    res = evaluate_many(rows, ["x"], "y", "fold", [1], Loss("hinge"), classes=n)
    return res.select("n_train", "n_test", r6("accuracy", "accuracy"), (F.round("gradient", 6) + F.lit(0.0)).alias("gradient"))


@query("fit_kernel_svm")
def q_fit_kernel_svm(spark, sf):
    """Radial-kernel support vector machines, pairs of classes voting, five stratified folds against the folds' majority."""
    folds = V.stratified_folds(_features(spark, sf), "vec_id", "label")
    rows, n = _class_numbers(_arrays(folds, POINT_CATEGORIES, "vec_id", "label", "fold"))
    res = evaluate_many(rows, ["x"], "y", "fold", list(range(5)), Loss("hinge"), classes=n, pairs=True, landmarks=LANDMARKS, key="vec_id")
    out = res.join(_majority(folds), "fold")
    return out.select(long_("fold", "fold"), "n_train", "n_test", "baseline", r6("accuracy", "accuracy"), (F.round("gradient", 6) + F.lit(0.0)).alias("gradient"))


_REGRESSION_SPLIT_SQL = f"({stable_hash_sql('doc_id', SPLIT_SEED)}) % 100 < 75"


def _regression_rows(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"))
    return L.lexicon_counts_wide(docs, fx.fx_lexicon(spark), LEX_CATS, keep=["n_chars"])


@query(
    "fit_regressor",
    "WITH f(feature) AS (VALUES " + ", ".join(f"('{c}')" for c in [*LEX_CATS, "intercept"]) + ") SELECT feature, 0.0::DOUBLE AS moment, "
    f"CAST((SELECT count(*) FROM documents WHERE {_REGRESSION_SPLIT_SQL}) AS BIGINT) AS n_train FROM f",
)
def q_fit_regressor(spark, sf):
    """The least-squares certificate: training residuals are orthogonal to every feature and the constant."""
    tr = V.random_split(_regression_rows(spark, sf), "doc_id", SPLIT_SEED).filter("split = 'train'")
    fitted, _ = V.fit_model(tr, LEX_CATS, "n_chars", "regression")
    m = V.residual_moments(V.predict(fitted, None, tr, LEX_CATS, "n_chars", "regression"), LEX_CATS, "n_chars")
    return m.select("feature", (F.round("moment", 5) + F.lit(0.0)).alias("moment"), F.lit(tr.count()).cast("long").alias("n_train"))


@query("cross_validate", logistic_sql("cv"))
def q_cross_validate(spark, sf):
    """Five stratified folds of logistic fits: rows standardised, then columns refitted per fold; accuracy and the folds' majority."""
    folds = V.stratified_folds(S.row_standardize(_features(spark, sf), POINT_CATEGORIES), "vec_id", "label")
    rows, n = _class_numbers(_arrays(folds, POINT_CATEGORIES, "label", "fold"))
    out = evaluate_many(rows, ["x"], "y", "fold", list(range(5)), Loss("logistic"), classes=n).join(_majority(folds), "fold")
    return out.select(long_("fold", "fold"), "n_test", "baseline", r6("accuracy", "accuracy"))


@query("cross_validate_regression", regression_sql("cv"))
def q_cross_validate_regression(spark, sf):
    """Five contiguous folds of least squares: R2 and RMSE beside predicting the other folds' mean."""
    m = V.contiguous_folds(_regression_rows(spark, sf), "doc_id")
    res = evaluate_many(_arrays(m, LEX_CATS, "n_chars", "fold"), ["x"], "n_chars", "fold", list(range(5)), Loss("squared"))
    base = V.mean_baseline_cv(m, "n_chars").select(F.col("fold").cast("int").alias("fold"), r6("rmse", "baseline"))
    return res.join(base, "fold").select(long_("fold", "fold"), "n_test", "baseline", r6("r2", "r2"), r6("rmse", "rmse"))


@query("holdout_evaluate", logistic_sql("holdout"))
def q_holdout_evaluate(spark, sf):
    """A logistic fit on the training split: held-out accuracy beside the training mode's."""
    m = S.row_standardize(_held_split(spark, sf), POINT_CATEGORIES)
    rows, n = _class_numbers(_arrays(m, POINT_CATEGORIES, "label", "fold"))
    res = evaluate_many(rows, ["x"], "y", "fold", [1], Loss("logistic"), classes=n)
    base = V.majority_baseline_holdout(m.filter("fold = 0"), m.filter("fold = 1"), "label")
    return res.select("n_test", r6(base.select("accuracy").scalar(), "baseline"), r6("accuracy", "accuracy"))


@query("holdout_regression", regression_sql("holdout"))
def q_holdout_regression(spark, sf):
    """Least squares on the training split: held-out R2 and RMSE beside predicting the training mean."""
    split = V.random_split(_regression_rows(spark, sf), "doc_id", SPLIT_SEED).withColumn("fold", F.when(F.col("split") == "train", 0).otherwise(1))
    res = evaluate_many(_arrays(split, LEX_CATS, "n_chars", "fold"), ["x"], "n_chars", "fold", [1], Loss("squared"))
    base = V.mean_baseline_holdout(split.filter("fold = 0"), split.filter("fold = 1"), "n_chars")
    return res.select("n_test", r6(base.select("rmse").scalar(), "baseline"), r6("r2", "r2"), r6("rmse", "rmse"))


@query("fit_svr")
def q_fit_svr(spark, sf):
    """Support vector regression with a radial kernel, five contiguous folds; the target in its own deviations."""
    m = V.contiguous_folds(_regression_rows(spark, sf), "doc_id")
    spread = m.agg(F.stddev_pop("n_chars")).first()[0] or 1.0  # the margin of 0.1 is meant for a target of unit size
    rows = _arrays(m.withColumn("y", F.col("n_chars") / F.lit(spread)), LEX_CATS, "doc_id", "y", "fold")
    res = evaluate_many(rows, ["x"], "y", "fold", list(range(5)), Loss("insensitive"), landmarks=LANDMARKS, key="doc_id")
    return res.select(long_("fold", "fold"), "n_train", "n_test", r6("r2", "r2"), r6(F.col("rmse") * F.lit(spread), "rmse"),
                      (F.round("gradient", 6) + F.lit(0.0)).alias("gradient"))


@query("raw_vector_baseline")
def q_raw_vector_baseline(spark, sf):
    """The vectors themselves as features: logistic fits of five folds, with and without column scaling, and the folds' majority."""
    folds = V.stratified_folds(_emb(spark, sf), "vec_id", "label")
    rows, n = _class_numbers(folds)
    parts = [
        evaluate_many(rows, ["embedding"], "y", "fold", list(range(5)), Loss("logistic"), classes=n, scale=scaled).withColumn("scaled", F.lit(scaled))
        for scaled in (True, False)
    ]
    out = parts[0].unionByName(parts[1]).join(_majority(folds), "fold")
    return out.select("scaled", long_("fold", "fold"), "n_test", "baseline", r6("accuracy", "accuracy"))


GRID = [{"k": k, "distance": d, "reference": r} for k in (1, 2, 3, 4) for d in ("cosine", "l2") for r in ("all", "train")]


def grid_scores(spark, sf):
    """Every configuration's row-standardised score array on the same rows: (vec_id, label, fold, one array per configuration)."""
    pts, cats = fx.fx_centroid_points(spark, sf), fx.fx_point_categories(spark, sf)
    in_train = F.pmod(stable_hash("key", SPLIT_SEED), F.lit(100)) < 75
    sources = {"all": (None, pts), "train": (in_train, pts.filter(in_train))}
    models = {(1, r): mean_centroids(p) for r, (_, p) in sources.items()}
    found = kmeans_models(pts, {f"{k}-{r}": (k, flag) for k in (2, 3, 4) for r, (flag, _) in sources.items()}, seed=7)
    models |= {(int(v.split("-")[0]), v.split("-")[1]): c for v, c in found.items()}
    rows = V.random_split(_emb(spark, sf), "vec_id", SPLIT_SEED).withColumn("fold", F.when(F.col("split") == "train", 0).otherwise(1))
    names = []
    for c in GRID:
        name = f"run_{c['k']}_{c['distance']}_{c['reference']}"
        rows, scores = score_blocks(rows, models[c["k"], c["reference"]], cats, "embedding", c["distance"], prefix=f"_{name}_")
        rows = rows.withColumn(name, S.row_standardize_array(F.array(*scores.values())))
        names.append(name)
    return rows.select("vec_id", "label", "fold", *names), names


@query("experiment_grid")
def q_experiment_grid(spark, sf):
    """K x distance x reference corpus, all held-out fits in shared passes; results stored by run coordinates and read back by them."""
    rows, names = grid_scores(spark, sf)
    numbered, n = _class_numbers(rows)
    res = evaluate_many(numbered, names, "y", "fold", [1], Loss("logistic"), classes=n)
    runs = spark.createDataFrame([(m, *c.values()) for m, c in zip(names, GRID, strict=True)], "features string, k int, distance string, reference string")
    base = V.majority_baseline_holdout(rows.filter("fold = 0"), rows.filter("fold = 1"), "label").select("accuracy").scalar()
    table = res.join(F.broadcast(runs), "features").select("k", "distance", "reference", "n_test", r6(base, "baseline"), r6("accuracy", "accuracy"))
    path = write_result(table, table_path(spark, "grid-" + uuid.uuid4().hex), ["k", "distance", "reference"])
    stored = [select_run(spark, path, distance=d) for d in ("cosine", "l2")]
    return stored[0].unionByName(stored[1]).select(long_("k", "k"), "distance", "reference", "n_test", "baseline", "accuracy")


# ---------------------------------------------------------------- sources and sinks

_COUNTS_LANG = (
    "SELECT c.doc_id, c.category, c.n, d.lang FROM (" + _counts_sql(EXPANDED_TOKENS) + ") c JOIN documents d ON d.doc_id = c.doc_id"
)


def _write_counts(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", "lang")
    counts = L.lexicon_counts(docs, fx.fx_lexicon(spark), LEX_CATS, contractions=fx.fx_contractions(spark))
    out = counts.join(docs.select("doc_id", "lang"), "doc_id")
    out = out.withColumn("lexicon", F.lit("test"))
    return write_result(out, table_path(spark, "counts-" + uuid.uuid4().hex), ["lexicon", "lang"])  # a table per call


@query("write_result", _COUNTS_LANG)
def q_write_result(spark, sf):
    path = _write_counts(spark, sf)
    return spark.read.parquet(path).select("doc_id", "category", "n", "lang")


@query("select_run", _COUNTS_LANG.replace("FROM (", "FROM (", 1) + " WHERE d.lang = 'en'")
def q_select_run(spark, sf):
    path = _write_counts(spark, sf)
    return select_run(spark, path, lexicon="test", lang="en").select("doc_id", "category", "n", "lang")


_RERUN_SQL = _COUNTS_LANG.replace("SELECT c.doc_id, c.category, c.n, d.lang", "SELECT c.doc_id, c.category, "
                                  "CASE WHEN d.lang = 'en' THEN CAST(c.n > 0 AS BIGINT) ELSE c.n END AS n, d.lang")


def _rerun_store(spark, sf):
    """Counts stored as one run per language; then 'en' is run again as flags, and a rerun of 'de' ends before its commit."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", "lang")
    counts = L.lexicon_counts_wide(docs, fx.fx_lexicon(spark), LEX_CATS, contractions=fx.fx_contractions(spark), keep=["lang"])
    path = table_path(spark, "runs-" + uuid.uuid4().hex)
    first = counts.unpivot(["doc_id", "lang"], LEX_CATS, "category", "n").withColumn("lexicon", F.lit("test"))
    store_runs(first, path, ["lexicon", "lang"])
    stored = stored_runs(spark, path, lexicon="test")
    flags = stored.filter("lang = 'en'").withColumn("n", (F.col("n") > 0).cast("long"))
    store_runs(flags, path, ["lexicon", "lang"])
    write_attempt(stored.filter("lang = 'de'").withColumn("n", F.lit(-1).cast("long")), path, ["lexicon", "lang"])
    return path


@query("stored_runs", _RERUN_SQL)
def q_stored_runs(spark, sf):
    return stored_runs(spark, _rerun_store(spark, sf), lexicon="test").select("doc_id", "category", "n", "lang")


@query(
    "current_runs",
    "SELECT lang, CAST(count(*) * " + str(len(LEX_CATS)) + " AS BIGINT) AS n_rows FROM documents GROUP BY lang",
)
def q_current_runs(spark, sf):
    return current_runs(spark, _rerun_store(spark, sf)).select("lang", "n_rows")


@query(
    "sample_n",
    f"SELECT doc_id, md5(text) AS text_md5 FROM documents ORDER BY ({stable_hash_sql('doc_id', SAMPLE_SEED)}), doc_id LIMIT 5",
)
def q_sample_n(spark, sf):
    return sample_n(fx.documents(spark, sf), 5, "doc_id", SAMPLE_SEED).select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "read_corpus",
    "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
)
def q_read_corpus(spark, sf):
    from ..sources.readers import read_corpus

    df = read_corpus(spark, f"{sf.rstrip('/')}/documents.parquet")
    return df.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query("read_corpus_csv", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def q_read_corpus_csv(spark, sf):
    """The documents as CSV, columns in another order and the key as an index column, read back."""
    from ..sources.readers import read_corpus_csv

    path = table_path(spark, "corpus-csv-" + uuid.uuid4().hex)
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("row"), "source", "text", "n_chars", "lang")
    docs.write.option("header", True).option("escape", '"').csv(path)
    df = read_corpus_csv(spark, path, index_col="row")
    return df.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))
