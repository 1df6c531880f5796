"""Small pieces the corpus operators share: table reads, hash folds, Arrow results, written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of at most 1,000 rows and 8 MB.

    The default batch (10,000 rows, 64 MB) is held several times over: in the
    executor's Arrow buffers, on both ends of the pipe and in the worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def crc_fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back (cuts lineage, survives lost executors)."""
    spark = df.sparkSession
    path = table_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def add_struct(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Append one result column; an input column of that name (in any case) is replaced."""
    clash = [c for c in df.columns if c.lower() == name.lower()]
    return df.drop(*clash).withColumn(name, value) if clash else df.withColumn(name, value)
