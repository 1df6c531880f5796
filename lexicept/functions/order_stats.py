"""Exact order statistics at any size: the bucket that holds a rank is counted, opened and counted again.

No group is sorted or held by one task. Every round is one grouped count of at most ``BUCKETS`` rows a group with map-side
partial sums; the bucket that holds the wanted rank becomes the next range, until all its values are equal. Buckets have
equal width between the smallest and the largest value left, which always fall into different buckets, so every round
removes values.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sizing import MODEL_MAX_ROWS, collect_bounded

BUCKETS = 4096


def _same(groups: list[str]) -> Column:
    out = F.lit(True)
    for g in groups:
        out = out & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return out


def select_rank(df: DataFrame, value: str, rank: Column, group_cols: list[str] | None = None) -> DataFrame:
    """(groups..., n, rank, value, below, equal): the value at a rank (1 is the smallest) of every group.

    ``rank`` is an expression over ``n``, the group's count of values. Nulls and NaN count nowhere; a rank outside 1..n gives
    no row. ``below`` values are smaller, ``equal`` have the value itself. One row a group is brought to the driver.
    """
    g = list(group_cols or [])
    spark = df.sparkSession
    x = F.col(value)
    kind = df.schema[value].dataType
    floating = isinstance(kind, (T.DoubleType, T.FloatType))
    rows = df.filter(x.isNotNull() & ~F.isnan(x) if floating else x.isNotNull()).select(*g, x.alias("_v"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        start = rows.groupBy(*g).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        start = start.withColumn("r", rank.cast("long")).filter("r between 1 and n")
        todo = [(*[r[c] for c in g], r["n"], r["r"], r["lo"], r["hi"], 0, r["n"]) for r in collect_bounded(start, MODEL_MAX_ROWS, "groups")]
        schema = T.StructType([
            *[T.StructField(f"_g_{c}", df.schema[c].dataType) for c in g],
            T.StructField("n", T.LongType()), T.StructField("r", T.LongType()), T.StructField("lo", kind), T.StructField("hi", kind),
            T.StructField("below", T.LongType()), T.StructField("equal", T.LongType()),
        ])
        done = []
        k = len(g)
        while todo:
            done += [t for t in todo if t[k + 2] == t[k + 3]]
            todo = [t for t in todo if t[k + 2] != t[k + 3]]
            if not todo:
                break
            bounds = spark.createDataFrame(todo, schema)
            inside = rows.join(F.broadcast(bounds), _same(g) & F.col("_v").between(F.col("lo"), F.col("hi")))
            half = lambda c: F.col(c).cast("double") / 2  # noqa: E731  halves: no overflow between the extremes
            share = F.try_divide(half("_v") - half("lo"), half("hi") - half("lo"))
            if not floating:  # neighbours that doubles cannot tell apart
                share = F.coalesce(F.try_subtract("_v", "lo").cast("double") / F.try_subtract("hi", "lo").cast("double"), share)
            share = F.coalesce(share, F.lit(0.5))
            bucket = F.when(F.col("_v") >= F.col("hi"), F.lit(BUCKETS - 1)).when(F.col("_v") <= F.col("lo"), F.lit(0)).otherwise(
                F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS).cast("int"))))
            held = [f"_g_{c}" for c in g] + ["n", "r", "below"]
            counts = inside.groupBy(*held, bucket.alias("b")).agg(F.count("*").alias("m"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
            # at most BUCKETS rows a group
            upto = F.sum("m").over(Window.partitionBy(*held).orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
            cum = counts.withColumn("upto", F.col("below") + upto).filter(F.col("r").between(F.col("upto") - F.col("m") + 1, F.col("upto")))
            found = cum.select(*[f"_g_{c}" for c in g], "n", "r", "lo", "hi", (F.col("upto") - F.col("m")).alias("below"), F.col("m").alias("equal"))
            todo = [tuple(t) for t in collect_bounded(found, MODEL_MAX_ROWS, "groups")]
    finally:
        rows.unpersist()
    out = spark.createDataFrame(done, schema)
    return out.select(*[F.col(f"_g_{c}").alias(c) for c in g], "n", F.col("r").alias("rank"), F.col("lo").alias("value"), "below", "equal")


def exact_median(df: DataFrame, value: str, group_cols: list[str] | None = None) -> DataFrame:
    """(groups..., median): the middle value of every group, the mean of the two middle ones if their number is even."""
    g = list(group_cols or [])
    low = select_rank(df, value, F.floor((F.col("n") + 1) / 2), g)
    b = low.select(*[F.col(c).alias(f"_g_{c}") for c in g], "n", "rank", F.col("value").alias("_low"), "below", "equal")
    # the next larger value, where the upper middle is not a copy of the lower one
    larger = df.join(F.broadcast(b), _same(g) & (F.col(value) > F.col("_low")))
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        larger = larger.filter(~F.isnan(value))
    names = [f"_g_{c}" for c in g]
    following = collect_bounded(larger.groupBy(*names).agg(F.min(value).alias("_next")), MODEL_MAX_ROWS, "groups")
    after = {tuple(r[c] for c in names): r["_next"] for r in following}
    out = []
    for r in low.collect():  # one row a group, bounded by select_rank
        k = tuple(r[c] for c in g)
        upper = after[k] if r["n"] % 2 == 0 and r["below"] + r["equal"] == r["rank"] else r["value"]
        out.append((*k, float(r["value"]) / 2 + float(upper) / 2))
    schema = T.StructType([*[df.schema[c] for c in g], T.StructField("median", T.DoubleType())])
    return df.sparkSession.createDataFrame(out, schema)
