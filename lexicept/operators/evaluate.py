"""Evaluation: folds, splits, label indexing, baselines, metrics and Spark ML fits.

Folds and baselines are plain DataFrame work. Fold positions come from a
range-partitioned rank (no single-task global window); baselines and
metrics are aggregates over small per-fold / per-class tables. ``fit_model``
uses Spark ML estimators for a single model; cross-validation, held-out
evaluation and grids of many models are in ``shared_fit``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import stable_hash
from ..functions.order_stats import select_rank
from ..functions.ranking import global_row_number
from ..functions.sizing import MODEL_MAX_ROWS, collect_bounded

#: Doubles per partition of a cached fit input (rows times features).
CELLS_PER_FIT_PARTITION = 4_000_000
MAX_ITER = 5000
FIT_TOLERANCE = 1e-6
#: Strength of the classifiers' L2 penalty: half the squared weights against C times the summed loss.
INVERSE_PENALTY = 1.0

# ---------------------------------------------------------------- folds and splits


def contiguous_folds(df: DataFrame, key: str, n_folds: int = 5, out_col: str = "fold") -> DataFrame:
    """Unshuffled k folds in key order; the first (n mod k) folds hold one extra row."""
    ranked = global_row_number(df, [F.asc(key)], "_r")
    n = df.agg(F.count("*")).scalar()
    p = F.col("_r") - 1
    q = F.floor(n / n_folds)
    r = n - q * n_folds
    boundary = r * (q + 1)
    fold = F.when(p < boundary, F.floor(p / (q + 1))).otherwise(r + F.floor((p - boundary) / q))
    return ranked.withColumn(out_col, fold.cast("int")).drop("_r")


def _stratified_bounds(counts: list[tuple], n_folds: int) -> dict:
    """Per class, cumulative fold sizes: the class-balanced allocation of an unshuffled stratified split.

    Classes in sorted order occupy consecutive ranges of the label-sorted
    index; fold i receives the positions congruent to i (mod k) of that range.
    """
    bounds, start = {}, 0
    for label, n in sorted(counts, key=lambda t: (t[0] is None, t[0])):
        end = start + n
        alloc = [((end - 1 - i) // n_folds) - ((start - 1 - i) // n_folds) for i in range(n_folds)]
        cum, acc = [], 0
        for a in alloc:
            acc += a
            cum.append(acc)
        bounds[label] = cum
        start = end
    return bounds


def stratified_folds(df: DataFrame, key: str, label: str, n_folds: int = 5, out_col: str = "fold") -> DataFrame:
    """Unshuffled stratified k folds: per class, contiguous blocks in key order. A null label is a class of its own, the last."""
    counts = [(r[0], int(r[1])) for r in collect_bounded(df.groupBy(label).count(), MODEL_MAX_ROWS, "class counts")]
    bounds = _stratified_bounds(counts, n_folds)
    ranked = global_row_number(df, [F.asc(key)], "_r", group_cols=[label])
    schema = T.StructType([T.StructField("_label", df.schema[label].dataType), T.StructField("_cum", T.ArrayType(T.LongType()))])
    table = df.sparkSession.createDataFrame(list(bounds.items()), schema)  # one row per class
    p = F.col("_r") - 1
    fold = F.size(F.filter("_cum", lambda b: b <= p))
    placed = ranked.join(F.broadcast(table), F.col(label).eqNullSafe(F.col("_label")))
    return placed.withColumn(out_col, fold.cast("int")).drop("_r", "_label", "_cum")


def exact_split(df: DataFrame, key: str, seed: int, train_share: float = 0.75, out_col: str = "split") -> DataFrame:
    """Seeded split with exactly floor(share * n) training rows: the smallest stable hashes, ties by an integer key.

    The cut is an exact order statistic found by refining counts; rows are neither sorted nor moved. Rows that share a key
    stay together, so copies of the cutting key may exceed the size.
    """
    hashed = df.withColumn("_h", stable_hash(key, seed))
    size = F.floor(F.col("n") * F.lit(train_share))
    cut = select_rank(hashed, "_h", size).first()
    if cut is None:
        return df.withColumn(out_col, F.lit("validation"))
    tied = hashed.filter(F.col("_h") == F.lit(cut["value"])).withColumn("_k", F.col(key).cast("long"))
    last = select_rank(tied, "_k", F.lit(cut["rank"] - cut["below"])).first()
    inside = F.col("_h") < F.lit(cut["value"])
    if last is not None:
        inside = inside | ((F.col("_h") == F.lit(cut["value"])) & (F.col(key).cast("long") <= F.lit(last["value"])))
    return hashed.withColumn(out_col, F.when(inside, F.lit("train")).otherwise(F.lit("validation"))).drop("_h")


def random_split(df: DataFrame, key: str, seed: int, train_pct: int = 75, out_col: str = "split") -> DataFrame:
    """Seeded train/validation split from a stable hash of the key (repartition-proof)."""
    bucket = F.pmod(stable_hash(key, seed), F.lit(100))
    return df.withColumn(out_col, F.when(bucket < train_pct, F.lit("train")).otherwise(F.lit("validation")))


def clean_targets(df: DataFrame, target: str, text_col: str, label_col: str = "label") -> DataFrame:
    """Rename the target to ``label`` and drop rows with a null text or label."""
    return df.withColumnRenamed(target, label_col).na.drop(subset=[text_col, label_col])


def label_index(train: DataFrame, label_col: str = "label") -> dict:
    """Class -> 0..n-1 in sorted class order, fitted on the training rows (small, bounded)."""
    rows = collect_bounded(train.select(label_col).na.drop().distinct(), MODEL_MAX_ROWS, "class list")
    return {v: i for i, v in enumerate(sorted(r[0] for r in rows))}


def index_labels(df: DataFrame, mapping: dict, label_col: str = "label", out_col: str = "label_idx",
                 handle_invalid: str = "keep") -> DataFrame:
    """Apply a fitted class index; unseen classes -> null ('keep'), dropped ('skip') or an error."""
    schema = T.StructType([T.StructField("_class", df.schema[label_col].dataType), T.StructField(out_col, T.LongType())])
    table = df.sparkSession.createDataFrame(list(mapping.items()), schema)  # one row per class
    out = df.drop(out_col).join(F.broadcast(table), F.col(label_col) == F.col("_class"), "left").drop("_class")
    if handle_invalid == "skip":
        return out.filter(F.col(out_col).isNotNull())
    if handle_invalid == "error":
        return out.withColumn(out_col, F.when(F.col(out_col).isNull(), F.raise_error(F.lit("unseen label"))).otherwise(F.col(out_col)))
    return out


# ---------------------------------------------------------------- baselines and metrics


def majority_baseline_cv(df: DataFrame, label: str, fold_col: str = "fold") -> DataFrame:
    """Per fold: the test fold's most frequent class (ties -> smallest) and its accuracy."""
    c = df.groupBy(fold_col, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(fold_col).orderBy(F.desc("n"), F.asc(label))
    tot = Window.partitionBy(fold_col)
    ranked = c.withColumn("_rk", F.row_number().over(w)).withColumn("_tot", F.sum("n").over(tot))
    return ranked.filter("_rk = 1").select(fold_col, F.col(label).alias("majority"), (F.col("n") / F.col("_tot")).alias("accuracy"))


def majority_baseline_holdout(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Accuracy on ``test`` of always predicting the training mode (ties -> smallest).

    The mode is a fitted parameter: class counts (one row per class) are
    brought to the driver and the winner applied as a literal.
    """
    counts = collect_bounded(train.groupBy(label).agg(F.count("*").alias("n")), MODEL_MAX_ROWS, "class counts")
    best = min(counts, key=lambda r: (-r["n"], r[label]))[label] if counts else None
    m = F.lit(best)
    return test.agg(F.avg((F.col(label) == m).cast("double")).alias("accuracy")).withColumn("majority", m)


def mean_baseline_cv(df: DataFrame, label: str, fold_col: str = "fold") -> DataFrame:
    """Per fold: R^2 and RMSE of predicting the mean of the other folds (rows with a null label count nowhere)."""
    df = df.filter(F.col(label).isNotNull())
    stats = df.groupBy(fold_col).agg(F.sum(label).alias("s"), F.count("*").alias("n"))
    fold_means = _fold_means(stats, fold_col)
    j = df.join(fold_means, fold_col)  # one row per fold, behind a shuffle: AQE broadcasts it from its measured size
    y = F.col(label).cast("double")
    agg = j.groupBy(fold_col).agg(
        F.sum((y - F.col("m_train")) ** 2).alias("sse"), F.sum((y - F.col("m_test")) ** 2).alias("sst"), F.count("*").alias("n")
    )
    return agg.select(fold_col, (1 - F.try_divide("sse", "sst")).alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def _fold_means(stats: DataFrame, fold_col: str) -> DataFrame:
    """(fold, training mean, test mean) from per-fold sums: a handful of rows."""
    tot = stats.agg(F.sum("s"), F.sum("n")).first()
    s_all, n_all = F.lit(tot[0]), F.lit(tot[1])
    return stats.select(fold_col, ((s_all - F.col("s")) / (n_all - F.col("n"))).alias("m_train"), (F.col("s") / F.col("n")).alias("m_test"))


def mean_baseline_holdout(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    y = F.col(label).cast("double")
    m = F.lit(train.agg(F.avg(y)).first()[0])  # fitted parameter: the training mean
    mt = F.lit(test.agg(F.avg(y)).first()[0])
    agg = test.filter(y.isNotNull()).agg(F.sum((y - m) ** 2).alias("sse"), F.sum((y - mt) ** 2).alias("sst"), F.count("*").alias("n"))
    return agg.select((1 - F.try_divide("sse", "sst")).alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def argmax_prediction(scores) -> Column:
    """Index of the highest score (first one on ties); softmax would keep the order."""
    s = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(s, F.array_max(s)) - 1).cast("long")


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           group_cols: list[str] | None = None) -> DataFrame:
    """Accuracy and support-weighted F1 from the confusion counts."""
    g = group_cols or []
    conf = pred.groupBy(*g, label, prediction).agg(F.count("*").alias("n"))
    tp = conf.filter(F.col(label) == F.col(prediction)).select(*g, F.col(label).alias("cls"), F.col("n").alias("tp"))
    support = conf.groupBy(*g, F.col(label).alias("cls")).agg(F.sum("n").alias("support"))
    predicted = conf.groupBy(*g, F.col(prediction).alias("cls")).agg(F.sum("n").alias("npred"))
    per = support.join(predicted, [*g, "cls"], "full").join(tp, [*g, "cls"], "left").fillna(0, ["support", "npred", "tp"])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("npred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return per.groupBy(*g).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       group_cols: list[str] | None = None) -> DataFrame:
    """RMSE and R^2 (1 - SSE/SST around the evaluated rows' own mean); rows with a null on either side are left out."""
    g = group_cols or []
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    agg = pred.filter(y.isNotNull() & p.isNotNull()).groupBy(*g).agg(
        F.count("*").alias("n"), F.sum((y - p) ** 2).alias("sse"), F.var_pop(y).alias("var")
    )
    sst = F.col("var") * F.col("n")
    return agg.select(*g, "n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (1 - F.try_divide(F.col("sse"), sst)).alias("r2"))


# ---------------------------------------------------------------- Spark ML fits


def _estimator(task: str, model: str, max_iter: int, reg_param: float):
    """Optimisers stop at ``tol``; ``max_iter`` is only their emergency stop. Penalties apply to the features as given."""
    if task == "classification":
        kind = LinearSVC if model == "svm" else LogisticRegression
        one = kind(maxIter=max_iter, regParam=reg_param, standardization=False, tol=FIT_TOLERANCE)
        return OneVsRest(classifier=one, labelCol="label_idx", featuresCol="features", parallelism=8)
    return LinearRegression(maxIter=max_iter, solver="normal", labelCol="label_y", featuresCol="features")


def _assemble(df: DataFrame, features: list[str] | str) -> DataFrame:
    if isinstance(features, str):  # one array column (raw vectors)
        return df.withColumn("features", array_to_vector(F.col(features)))
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def fit_model(train: DataFrame, features, label: str, task: str = "classification", model: str = "lr",
              max_iter: int = MAX_ITER):
    """Fit an L2-regularised one-vs-rest logistic regression / linear SVM, or an ordinary linear regression, to convergence."""
    data = _assemble(train, features)
    if task == "classification":
        mapping = label_index(train, label)
        data = index_labels(data, mapping, label, "label_idx", "skip")
    else:
        mapping = None
        data = data.withColumn("label_y", F.col(label).cast("double"))
    # iterative optimisers rescan their input: keep it materialised for the fit only, and size its
    # partitions to the data (each optimiser step is one job over every partition)
    cached = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, width = cached.agg(F.count("*"), F.max(F.size(vector_to_array("features")))).first()
        target = max(1, -(-n * (width or 1) // CELLS_PER_FIT_PARTITION))
        fit_input = cached.coalesce(target) if target < cached.rdd.getNumPartitions() else cached
        # mean loss + reg / 2 |w|^2 is C * summed loss + 1 / 2 |w|^2 for reg = 1 / (C n)
        fitted = Pipeline(stages=[_estimator(task, model, max_iter, 1.0 / (INVERSE_PENALTY * max(n, 1)))]).fit(fit_input)
    finally:
        cached.unpersist()
    return fitted, mapping


def predict(fitted, mapping, df: DataFrame, features, label: str, task: str = "classification") -> DataFrame:
    data = _assemble(df, features)
    if task == "classification":
        data = index_labels(data, mapping, label, "label_idx", "keep")
        return fitted.transform(data).withColumn("prediction", F.col("prediction").cast("long"))
    return fitted.transform(data.withColumn("label_y", F.col(label).cast("double")))


# ---------------------------------------------------------------- optimality and reports


def classifier_gradient(fitted, mapping: dict, train: DataFrame, features: list[str], label: str) -> DataFrame:
    """(class, feature, gradient) of the regularised logistic objective at the fitted weights: zero at the optimum.

    One aggregate with a sum per class and feature; the constant's entry is called ``intercept``.
    """
    n = train.filter(F.col(label).isin(*mapping)).count()
    by_index = {i: k for k, i in mapping.items()}
    cells = []
    for i, m in enumerate(fitted.stages[0].models):
        w = [float(x) for x in m.coefficients.toArray()]
        z = F.lit(float(m.intercept))
        for c, x in zip(features, w, strict=True):
            z = z + F.col(c) * F.lit(x)
        off = F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - (F.col(label) == F.lit(by_index[i])).cast("double")
        for c, x in [*zip(features, w, strict=True), ("intercept", 0.0)]:
            term = off if c == "intercept" else off * F.col(c)
            value = F.avg(term) + F.lit(x / (INVERSE_PENALTY * n))
            cells.append(F.struct(F.lit(by_index[i]).alias("class"), F.lit(c).alias("feature"), value.alias("gradient")))
    return train.filter(F.col(label).isin(*mapping)).agg(F.array(*cells).alias("c")).select(F.inline("c"))


def residual_moments(pred: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, moment): cosine of the training residuals with every feature and the constant, zero for least squares."""
    r = F.col(label).cast("double") - F.col("prediction")
    cells = []
    for c in [*features, "intercept"]:
        x = F.lit(1.0) if c == "intercept" else F.col(c).cast("double")
        cos = F.coalesce(F.try_divide(F.sum(r * x), F.sqrt(F.sum(r * r)) * F.sqrt(F.sum(x * x))), F.lit(0.0))
        cells.append(F.struct(F.lit(c).alias("feature"), cos.alias("moment")))
    return pred.agg(F.array(*cells).alias("c")).select(F.inline("c"))
