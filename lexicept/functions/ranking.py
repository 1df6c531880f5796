"""``row_number`` without funnelling a whole (or a hot) group into one task.

``row_number().over(Window.orderBy(...))`` with no partition key is planned
as a single-partition window, and ``Window.partitionBy(g)`` puts all rows
of a hot group ``g`` into one task. Here rows are range-partitioned on
(group, order) and sorted inside each partition instead, so a large group
spans many partitions. A monotonically increasing id orders the rows of a
partition; per (partition, group) counts -- one small row each -- give the
offsets that turn it into a dense 1-based rank within the group.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sizing import collect_bounded


def global_row_number(df: DataFrame, order_cols: list, out_col: str = "rank", group_cols: list[str] | None = None,
                      partitions: int | None = None) -> DataFrame:
    """Dense 1-based rank in ``order_cols`` order within ``group_cols`` (the order must be total)."""
    group_cols = group_cols or []
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = [F.col(g) for g in group_cols] + list(order_cols)
    ordered = (
        df.repartitionByRange(n, *sort_cols)
        .sortWithinPartitions(*sort_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_mid", 33))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    counts = collect_bounded(
        ordered.groupBy("_pid", *group_cols).agg(F.count("*").alias("n"), F.min("_mid").alias("start")),
        1_000_000, "partition x group counts",
    )
    running: dict = {}
    rows = []
    for r in sorted(counts, key=lambda r: r["_pid"]):
        g = tuple(r[c] for c in group_cols)
        # rows of one (partition, group) are contiguous in id order, starting at ``start``
        rows.append((int(r["_pid"]), *g, running.get(g, 0) - int(r["start"])))
        running[g] = running.get(g, 0) + int(r["n"])
    fields = [T.StructField("_pid", T.LongType())] + [df.schema[c] for c in group_cols] + [T.StructField("_off", T.LongType())]
    offsets = spark.createDataFrame(rows, T.StructType(fields))
    o = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in offsets.columns])
    cond = F.col("_pid") == F.col("_o__pid")
    for g in group_cols:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    joined = ordered.join(F.broadcast(o), cond, "inner")
    rank = (F.col("_mid") + F.col("_o__off") + 1).cast("long")
    return joined.withColumn(out_col, rank).drop("_mid", "_pid", *o.columns)
