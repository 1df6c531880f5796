"""Statistics as aggregates: Pearson r, paired t-test, two-way ICC, Student-t p-values.

Every statistic is built from sums computed by Spark aggregates; only the
Student-t tail probability runs in Python, on the already-aggregated rows
(one row per test), through an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order_stats import exact_median
from .sizing import MODEL_MAX_ROWS, collect_bounded


def _tail_fraction(a: float, b: float, x: float) -> float:
    """1 / (1 + d1 / (1 + d2 / (1 + ...))) of the incomplete beta function, DLMF 8.17.22, summed from its tail.

    d(2m) = m (b - m) x / ((a + 2m - 1)(a + 2m)); d(2m + 1) = -(a + m)(a + b + m) x / ((a + 2m)(a + 2m + 1)).
    Below the turning point x < (a + 1) / (a + b + 2) about sqrt(max(a, b)) terms settle it.
    """
    terms = 100 + int(8 * math.sqrt(max(a, b)))
    value = 1.0
    for m in range(min(terms, 200_000), 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1.0 + even / value
        k = m - 1
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        value = 1.0 + odd / value
    return 1.0 / value


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbeta) * _tail_fraction(a, b, x) / a
    return 1.0 - math.exp(lbeta) * _tail_fraction(b, a, 1.0 - x) / b


def t_pvalue_scalar(t: float, df: float, alternative: str = "two-sided") -> float:
    """P-value of a Student-t statistic (two-sided, 'greater' or 'less')."""
    if t is None or df is None or (isinstance(t, float) and math.isnan(t)) or df <= 0:
        return float("nan")
    if math.isinf(t):
        two = 0.0
    else:
        two = betainc(df / 2.0, 0.5, df / (df + t * t))
    if alternative == "two-sided":
        return two
    upper = two / 2.0 if t > 0 else 1.0 - two / 2.0  # P(T >= t)
    return upper if alternative == "greater" else 1.0 - upper


@F.pandas_udf(T.DoubleType())
def t_pvalue_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_pvalue_scalar(a, b, "two-sided") if pd.notna(a) and pd.notna(b) else np.nan for a, b in zip(t, df)])


@F.pandas_udf(T.DoubleType())
def t_pvalue_greater(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_pvalue_scalar(a, b, "greater") if pd.notna(a) and pd.notna(b) else np.nan for a, b in zip(t, df)])


def paired_t_test(df: DataFrame, a: str, b: str, group_cols: list[str] | None = None, with_p: bool = True,
                  extra_aggs: list[Column] | None = None) -> DataFrame:
    """Paired t-test of columns a vs b: one aggregate of d = a - b (rows with a null skipped).

    Returns (groups..., n, mean_diff, sd_diff, t, df[, p_two_sided, p_greater]) plus any
    ``extra_aggs`` computed in the same pass.
    """
    g = group_cols or []
    d = (F.col(a) - F.col(b)).cast("double")
    agg = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*g).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"), *(extra_aggs or [])
    )
    t = F.try_divide(F.col("mean_diff"), F.col("sd_diff") / F.sqrt(F.col("n")))
    out = agg.withColumn("t", t).withColumn("df", (F.col("n") - 1).cast("double"))
    if with_p:
        out = out.withColumn("p_two_sided", t_pvalue_two_sided("t", "df")).withColumn("p_greater", t_pvalue_greater("t", "df"))
    return out


def _sum(cols):
    return reduce(lambda x, y: x + y, cols)


def row_pearson(a_cols: list[str], b_cols: list[str]) -> Column:
    """Pearson r between two equal-length column lists of the same row (null when a variance is 0)."""
    n = float(len(a_cols))
    a = [F.col(c).cast("double") for c in a_cols]
    b = [F.col(c).cast("double") for c in b_cols]
    ma, mb = _sum(a) / n, _sum(b) / n
    cov = _sum([(x - ma) * (y - mb) for x, y in zip(a, b)])
    va = _sum([(x - ma) * (x - ma) for x in a])
    vb = _sum([(y - mb) * (y - mb) for y in b])
    den = F.sqrt(va * vb)
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(cov / den)


def pearson_agg(x: str, y: str) -> Column:
    """Aggregate Pearson r over complete pairs; null (not an error) when a variance is 0.

    Moments are taken around running means, so large offsets do not cancel.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    den = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    return F.when(den > 0, F.covar_pop(a, b) / den)


def icc_average(long: DataFrame, object_col: str = "object", rater_col: str = "rater", score_col: str = "score",
                group_cols: list[str] | None = None) -> DataFrame:
    """Two-way ICC, absolute agreement, average-rater unit: (MSR - MSE) / (MSR + (MSC - MSE) / n).

    Complete cases only (objects scored by every rater of their group). The
    two-way ANOVA sums of squares come from sums alone --
    SSR = sum_i R_i^2 / k - G^2 / N, SSC = sum_j C_j^2 / n - G^2 / N,
    SST = sum x^2 - G^2 / N (R_i object sums, C_j rater sums, G grand sum) --
    so the plan is three grouped aggregates (per object, per rater, per
    group), each with partial aggregation, and joins of per-group rows. Scores
    are first shifted by their group's mean, which changes none of the sums of
    squares and keeps them from cancelling under a large common offset.
    """
    g = group_cols or []
    raw = long.select(*g, object_col, rater_col, F.col(score_col).cast("double").alias("x")).na.drop()
    per_group = raw.groupBy(*g).agg(F.countDistinct(rater_col).alias("k"), F.avg("x").alias("_mean"))
    # one row per group, behind a shuffle: AQE broadcasts it from its measured size
    if g:
        x = raw.join(per_group, g)
    else:
        x = raw.withColumn("k", per_group.select("k").scalar()).withColumn("_mean", per_group.select("_mean").scalar())
    x = x.withColumn("x", F.col("x") - F.col("_mean")).drop("_mean")
    per_obj = x.groupBy(*g, object_col).agg(
        F.count("*").alias("m"), F.first("k").alias("k"), F.sum("x").alias("R"), F.sum(F.col("x") * F.col("x")).alias("Q")
    )
    complete = per_obj.filter(F.col("m") == F.col("k"))
    rows = complete.groupBy(*g).agg(
        F.count("*").alias("n"), F.first("k").alias("k"), F.sum("R").alias("G"),
        F.sum(F.col("R") * F.col("R")).alias("RR"), F.sum("Q").alias("XX"),
    )
    col_sums = x.join(complete.select(*g, object_col), [*g, object_col], "left_semi").groupBy(*g, rater_col).agg(
        F.sum("x").alias("C")
    )
    cols = col_sums.groupBy(*g).agg(F.sum(F.col("C") * F.col("C")).alias("CC"))
    parts = rows.join(cols, g) if g else rows.withColumn("CC", cols.select("CC").scalar())
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    corr = F.col("G") * F.col("G") / (n * k)
    ssr = F.col("RR") / k - corr
    ssc = F.col("CC") / n - corr
    sse = (F.col("XX") - corr) - ssr - ssc
    msr, msc, mse = ssr / (n - 1), ssc / (k - 1), sse / ((n - 1) * (k - 1))
    icc = (msr - mse) / (msr + (msc - mse) / n)
    return parts.select(*g, F.col("n").cast("long").alias("n_objects"), F.col("k").cast("long").alias("n_raters"),
                        msr.alias("msr"), msc.alias("msc"), mse.alias("mse"), icc.alias("icc"))


def stack_columns(df: DataFrame, id_cols: list[str], columns: dict[str, str], name_col: str, value_col: str) -> DataFrame:
    """Side-by-side columns under each other: (ids..., name, value), one pass."""
    entries = F.array(*[F.struct(F.lit(k).alias(name_col), F.col(c).alias(value_col)) for k, c in columns.items()])
    return df.select(*id_cols, F.inline(entries))


def column_summary(long: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """(group, mean, median) of a long table, the median exact at any size; nulls count nowhere."""
    rows = long.select(group_col, value_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        means = collect_bounded(rows.groupBy(group_col).agg(F.avg(value_col).alias("mean")), MODEL_MAX_ROWS, "groups")
        medians = {r[0]: r["median"] for r in exact_median(rows, value_col, [group_col]).collect()}  # one row a group
    finally:
        rows.unpersist()
    schema = T.StructType([long.schema[group_col], T.StructField("mean", T.DoubleType()), T.StructField("median", T.DoubleType())])
    return long.sparkSession.createDataFrame([(r[0], r["mean"], medians.get(r[0])) for r in means], schema)


def f_quantile(p: float, d1: float, d2: float) -> float:
    """x with P(F(d1, d2) <= x) = p, by bisection of the incomplete beta function at d1 x / (d1 x + d2)."""
    if not (0.0 < p < 1.0 and d1 > 0 and d2 > 0):
        return float("nan")
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if betainc(d1 / 2, d2 / 2, mid) < p:
            low = mid
        else:
            high = mid
    t = (low + high) / 2
    return d2 * t / (d1 * (1.0 - t)) if t < 1.0 else float("inf")


def icc_bounds(msr: float, msc: float, mse: float, icc: float, n: int, k: int, alpha: float = 0.05) -> tuple[float, float]:
    """Confidence limits of the two-way agreement ICC of average ratings (McGraw and Wong 1996, table 7).

    The denominator's degrees of freedom are Satterthwaite's for c MSC + d MSE. Without error variance, or for an ICC of 1,
    the limits do not exist (NaN).
    """
    if n < 2 or k < 2 or not mse > 0 or icc is None or math.isnan(icc) or icc >= 1.0:
        return float("nan"), float("nan")
    c = icc / (n * (1.0 - icc))
    d = 1.0 + icc * (n - 1) / (n * (1.0 - icc))
    v = (c * msc + d * mse) ** 2 / ((c * msc) ** 2 / (k - 1) + (d * mse) ** 2 / ((n - 1) * (k - 1)))
    below, above = f_quantile(1 - alpha / 2, n - 1, v), f_quantile(1 - alpha / 2, v, n - 1)
    lower = n * (msr - below * mse) / (below * (msc - mse) + n * msr)
    upper = n * (above * msr - mse) / (msc - mse + n * above * msr)
    return lower, upper


def icc_interval(long: DataFrame, object_col: str = "object", rater_col: str = "rater", score_col: str = "score",
                 group_cols: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """``icc_average`` with the limits (lower, upper) of its confidence interval, worked out on the aggregated rows."""

    @F.pandas_udf("lower double, upper double")
    def limits(msr: pd.Series, msc: pd.Series, mse: pd.Series, icc: pd.Series, n: pd.Series, k: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([icc_bounds(*row, alpha) for row in zip(msr, msc, mse, icc, n, k, strict=True)], columns=["lower", "upper"])

    per = icc_average(long, object_col, rater_col, score_col, group_cols)
    found = per.withColumn("_l", limits("msr", "msc", "mse", "icc", "n_objects", "n_raters"))
    number = lambda c: F.when(~F.isnan(f"_l.{c}"), F.col(f"_l.{c}")).alias(c)
    return found.select(*per.columns, number("lower"), number("upper"))
