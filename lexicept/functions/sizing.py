"""Size checks before anything is broadcast or brought to the driver.

A side counts as small when both its rows and its bytes are within bounds.
They are measured by one distributed aggregate (a count and a sum of row
widths), so the check moves two numbers per task whatever the side's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A broadcast side lives once in every executor, a collected one in the driver.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 << 20
MODEL_MAX_ROWS = 1_000_000
MODEL_MAX_BYTES = 512 << 20


class TooLargeError(ValueError):
    pass


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of one value, near enough for a bound."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + F.lit(16)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _width(x, kind.elementType)), F.lit(0)) + F.lit(16)
        wide = 4 if isinstance(kind.elementType, (T.FloatType, T.IntegerType)) else 8
        return F.coalesce(F.greatest(F.size(value), F.lit(0)), F.lit(0)) * F.lit(wide) + F.lit(16)
    if isinstance(kind, T.StructType):
        out = F.lit(8).cast("long")
        for f in kind.fields:
            out = out + _width(value.getField(f.name), f.dataType)
        return out
    if isinstance(kind, T.MapType):
        return _width(F.map_keys(value), T.ArrayType(kind.keyType)) + _width(F.map_values(value), T.ArrayType(kind.valueType))
    return F.lit(8).cast("long")


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a side, by one distributed aggregate."""
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        width = width + _width(F.col(f"`{f.name}`"), f.dataType).cast("long")
    r = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return int(r[0]), int(r[1])


def is_small(df: DataFrame, bound: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    rows, size = measure(df)
    return rows <= bound and size <= max_bytes


def maybe_broadcast(df: DataFrame, bound: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only when the side is measured to be small.

    Beyond the bounds the plain DataFrame is returned and Spark plans a
    shuffle join (with AQE skew splitting for hot keys).
    """
    return F.broadcast(df) if is_small(df, bound, max_bytes) else df


def collect_bounded(df: DataFrame, bound: int = MODEL_MAX_ROWS, what: str = "table", max_bytes: int = MODEL_MAX_BYTES) -> list:
    """Bring a fitted model or list to the driver, refusing more than the bounds.

    What is collected here is fitted or user-written (a lexicon, centres, class
    lists); it does not grow with the texts.
    """
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise TooLargeError(f"{what} has more than {bound} rows; refusing to bring it to the driver")
    size = sum(_row_bytes(r) for r in rows)
    if size > max_bytes:
        raise TooLargeError(f"{what} has more than {max_bytes} bytes; refusing to keep it in the driver")
    return rows


def _row_bytes(value) -> int:
    if isinstance(value, (str, bytes, bytearray)):
        return len(value) + 16
    if isinstance(value, list) and value and isinstance(value[0], float):
        return 8 * len(value) + 16
    if isinstance(value, (tuple, list)):
        return sum(_row_bytes(v) for v in value) + 16
    return 8


def lookup_join(big: DataFrame, table: DataFrame, key: str, salt_cols: list[str], how: str = "inner",
                bound: int = BROADCAST_MAX_ROWS, buckets: int = 32, small: bool | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Join a large row set to a lookup table on ``key`` without a hot-key bottleneck.

    A table measured to be small is broadcast (``small`` passes a verdict the
    caller already has, so that an expensive table is not computed for the
    check). Beyond the bounds the join is salted: every big-side row draws one
    of ``buckets`` salts from a hash of ``salt_cols`` (deterministic, so
    retried tasks agree) and the table is replicated once per salt. A key that
    holds a third of the big side (a very frequent token) is then spread over
    ``buckets`` reducers instead of one. A caller that knows the frequent keys passes them as ``hot`` (one column ``key``, each
    once, few enough to broadcast): only these are salted and replicated, any other row of the table moves once.
    """
    if is_small(table, bound) if small is None else small:
        return big.join(F.broadcast(table), key, how)
    salt, salts = F.pmod(F.xxhash64(*salt_cols), F.lit(buckets)), F.sequence(F.lit(0), F.lit(buckets - 1))
    if hot is None:
        salted = big.withColumn("_salt", salt)
        replicated = table.withColumn("_salt", F.explode(salts))
    else:  # null keys meet nothing and are as many as they like
        some = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
        flag = F.coalesce(F.col("_hot"), F.lit(False))
        salted = big.join(some, key, "left").withColumn("_salt", F.when(flag | F.col(key).isNull(), salt).otherwise(F.lit(0).cast("long"))).drop("_hot")
        replicated = table.join(some, key, "left").withColumn("_salt", F.explode(F.when(flag, salts).otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted.join(replicated, [key, "_salt"], how).drop("_salt")
