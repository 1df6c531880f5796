"""Column expressions for dense vectors stored as ``array<float|double>``.

Everything here is a native Spark expression (higher-order array functions or
the ML ``Summarizer`` aggregate), so vector work stays in the JVM.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def norm(v) -> Column:
    return F.sqrt(sq_norm(v))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either side has zero norm (never NaN, never raises)."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2_normalize(v) -> Column:
    """v / ||v||, with the zero vector returned unchanged (as double)."""
    n = norm(v)
    return F.when(n == 0, as_double(v)).otherwise(F.transform(_c(v), lambda x: x.cast("double") / n))


def sq_distance(a, b) -> Column:
    diffs = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


def l1_distance(a, b) -> Column:
    diffs = F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


def vector_mean(v, weight=None) -> Column:
    """Aggregate: (weighted) element-wise mean of equal-length vectors.

    Backed by ``Summarizer`` (a partial aggregate), so a hot group is merged
    from per-partition buffers, never gathered into one task.
    """
    vec = array_to_vector(_c(v))
    agg = Summarizer.mean(vec, _c(weight)) if weight is not None else Summarizer.mean(vec)
    return vector_to_array(agg)


def vector_sum(v, weight=None) -> Column:
    vec = array_to_vector(_c(v))
    agg = Summarizer.sum(vec, _c(weight)) if weight is not None else Summarizer.sum(vec)
    return vector_to_array(agg)


def explode_vector(df, id_cols, vec_col, dim_col="dim", value_col="x", digits: int | None = 6):
    """Long form (ids..., dim, x) of a vector column; values rounded for comparison."""
    cols = [F.col(c) for c in id_cols]
    out = df.select(*cols, F.posexplode(vec_col).alias(dim_col, value_col))
    if digits is not None:
        out = out.withColumn(value_col, F.round(F.col(value_col).cast("double"), digits) + F.lit(0.0))
    return out.withColumn(dim_col, F.col(dim_col).cast("long"))
