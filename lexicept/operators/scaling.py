"""Row and column standardisation (population std; a zero std divides by 1).

Wide inputs are standardised with plain column arithmetic: a row's mean and
std are expressions over its own category columns (no shuffle at all), and
column statistics are one global aggregate (a fitted model of 2C numbers,
brought to the driver like any fitted model and applied as literals). A
long-form variant uses a window keyed by the text id, whose groups are
bounded by the number of categories.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def row_standardize(df: DataFrame, cols: list[str], id_cols: list[str] | None = None) -> DataFrame:
    """(x - row mean) / row std across ``cols`` of each row (std 0 -> divide by 1)."""
    n = float(len(cols))
    vals = [F.col(c).cast("double") for c in cols]
    mean = _sum(vals) / F.lit(n)
    std = F.sqrt(_sum([(v - F.col("_rm")) * (v - F.col("_rm")) for v in vals]) / F.lit(n))
    tmp = df.withColumn("_rm", mean).withColumn("_rs", std)
    scale = F.when(F.col("_rs") == 0, F.lit(1.0)).otherwise(F.col("_rs"))
    keep = [c for c in df.columns if c not in cols] if id_cols is None else id_cols
    return tmp.select(*keep, *[((F.col(c).cast("double") - F.col("_rm")) / scale).alias(c) for c in cols])


def row_standardize_long(long: DataFrame, id_col: str = "doc_id", value_col: str = "similarity",
                         out_col: str | None = None) -> DataFrame:
    """Long form: window over each text's category rows (groups bounded by C)."""
    w = Window.partitionBy(id_col)
    m = F.avg(value_col).over(w)
    s = F.stddev_pop(value_col).over(w)
    scale = F.when(s == 0, F.lit(1.0)).otherwise(s)
    return long.withColumn(out_col or value_col, (F.col(value_col) - m) / scale)


def fit_columns(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Column means and population stds: one aggregate pass, 2C numbers."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0)) for c in cols}


def fit_columns_long(long: DataFrame, category_col: str = "category", value_col: str = "similarity") -> DataFrame:
    """Long-form fitted model: (category, mean, std), one row per category."""
    return long.groupBy(category_col).agg(F.avg(value_col).alias("mean"), F.stddev_pop(value_col).alias("std"))


def apply_columns(df: DataFrame, model: dict[str, tuple[float, float]], cols: list[str] | None = None) -> DataFrame:
    """(x - mean) / std per column with a fitted model (std 0 -> divide by 1)."""
    cols = cols or list(model)
    out = []
    for c in df.columns:
        if c in cols:
            m, s = model[c]
            out.append(((F.col(c).cast("double") - F.lit(m)) / F.lit(s if s != 0 else 1.0)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def column_standardize(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fit on ``fit_on`` (default: the table itself), then apply.

    Fitting and applying are two passes; when both read the same table it is
    persisted in between so its lineage runs once.
    """
    if fit_on is None:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        fit_on = df
    return apply_columns(df, fit_columns(fit_on, cols), cols)


def row_then_column(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows first, then columns fitted on the row-standardised table (annotation order)."""
    return column_standardize(row_standardize(df, cols), cols)


def column_then_row(df: DataFrame, cols: list[str], fit_on: DataFrame) -> DataFrame:
    """Columns fitted on ``fit_on`` (a corpus), then rows (sense-analysis order)."""
    return row_standardize(column_standardize(df, cols, fit_on), cols)


def select_features(df: DataFrame, categories: list[str], keep: list[str] | None = None) -> DataFrame:
    """Keep the lexicon's category columns, sorted by name."""
    keep = keep or []
    present = [c for c in sorted(categories) if c in df.columns]
    return df.select(*keep, *present)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def row_standardize_array(scores: pa.Array) -> pa.Array:
    """Every array to mean 0 and population deviation 1 (constant arrays to 0); all arrays of a batch have one length, null stays null."""
    valid = np.asarray(scores.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    x = np.asarray(scores.flatten().to_numpy(zero_copy_only=False), float).reshape(int(valid.sum()), -1) if valid.any() else np.zeros((0, 0))
    sd = x.std(axis=1, keepdims=True)
    x = (x - x.mean(axis=1, keepdims=True)) / np.where(sd > 0, sd, 1.0) if len(x) else x
    ends = np.cumsum(np.concatenate([[0], valid * x.shape[1]])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel(), pa.float64()), mask=pa.array(~valid))
