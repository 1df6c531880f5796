"""A store of evaluation or counting runs, addressed by their coordinates.

``store_runs`` writes the rows of one or more runs under ``data/attempt_id=<id>/<coordinate>=<value>/`` and then commits
them by appending one row per run to the manifest (a small Parquet table). ``stored_runs`` reads the newest committed
attempt of each run: a rerun replaces exactly the runs it holds, other runs stay, and rows whose writer ended before its
commit are never seen. The commit is a single appended file, so a run is replaced wholly or not at all, and lost
executors cost only retried tasks.

Reading filters the manifest by the coordinates, then joins the data on its partition columns; the manifest side is small
and broadcast when proven so, and dynamic partition pruning opens the directories of the wanted runs only.

Defined cases: coordinates may be null; a run without rows is not committed unless ``empty_runs`` names it, which makes
it replace earlier rows by none; data columns must not be called ``attempt_id``; runs of one store share a schema.
Superseded attempts stay on storage until ``superseded`` names them to whoever clears the store.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizing import maybe_broadcast

ATTEMPT = "attempt_id"


def _data(path: str) -> str:
    return path.rstrip("/") + "/data"


def _manifest(path: str) -> str:
    return path.rstrip("/") + "/manifest"


def write_attempt(df: DataFrame, path: str, coords: list[str]) -> str:
    """Write the rows of some runs without committing them; the attempt's id is returned."""
    missing = [c for c in coords if c not in df.columns]
    if missing or not coords:
        raise ValueError(f"run coordinates missing from the rows: {missing or 'none given'}")
    if ATTEMPT in df.columns:
        raise ValueError(f"the column name {ATTEMPT} is taken by the store")
    attempt = uuid.uuid4().hex
    df.write.partitionBy(*coords).parquet(f"{_data(path)}/{ATTEMPT}={attempt}")
    return attempt


def commit_attempt(spark: SparkSession, path: str, attempt: str, schema: T.StructType, coords: list[str],
                   empty_runs: DataFrame | None = None) -> None:
    """Make an attempt the current one of every run it holds rows of, and of ``empty_runs`` (a table of coordinates)."""
    rows = spark.read.schema(schema).parquet(f"{_data(path)}/{ATTEMPT}={attempt}")
    runs = rows.groupBy(*coords).agg(F.count("*").alias("n_rows"))  # only partition columns are read
    if empty_runs is not None:
        none = empty_runs.select(*[F.col(c).cast(schema[c].dataType) for c in coords]).distinct().withColumn("n_rows", F.lit(0).cast("long"))
        runs = runs.unionByName(none).groupBy(*coords).agg(F.sum("n_rows").alias("n_rows"))
    stamp = runs.withColumn(ATTEMPT, F.lit(attempt)).withColumn("committed_ns", F.lit(time.time_ns()).cast("long"))
    stamp.withColumn("row_schema", F.lit(schema.json())).coalesce(1).write.mode("append").parquet(_manifest(path))


def store_runs(df: DataFrame, path: str, coords: list[str], empty_runs: DataFrame | None = None) -> str:
    """Write and commit the runs held by ``df``, replacing earlier attempts of the same runs."""
    attempt = write_attempt(df, path, coords)
    commit_attempt(df.sparkSession, path, attempt, df.schema, coords, empty_runs)
    return attempt


def _coords(manifest: DataFrame) -> list[str]:
    return [c for c in manifest.columns if c not in ("n_rows", ATTEMPT, "committed_ns", "row_schema")]


def current_runs(spark: SparkSession, path: str, **coords) -> DataFrame:
    """(coordinates..., n_rows, attempt_id, committed_ns): the committed attempt of each run; a null value asks for null."""
    manifest = spark.read.parquet(_manifest(path))
    names = _coords(manifest)
    unknown = set(coords) - set(names)
    if unknown:
        raise ValueError(f"no such run coordinates: {sorted(unknown)}")
    for name, value in coords.items():
        manifest = manifest.filter(F.col(name).eqNullSafe(F.lit(value)))
    newest = F.max_by(F.struct("n_rows", ATTEMPT, "committed_ns"), F.struct("committed_ns", ATTEMPT)).alias("_m")
    return manifest.groupBy(*names).agg(newest).select(*names, "_m.*")


def stored_runs(spark: SparkSession, path: str, **coords) -> DataFrame:
    """Rows of the current runs, restricted to the given coordinates, with the columns they were stored with."""
    current = current_runs(spark, path, **coords)
    names = [c for c in current.columns if c not in ("n_rows", ATTEMPT, "committed_ns")]
    newest = spark.read.parquet(_manifest(path)).agg(F.max_by("row_schema", "committed_ns")).first()[0]
    schema = T.StructType.fromJson(json.loads(newest))
    columns = schema.fieldNames()
    if not spark.read.parquet(_manifest(path)).filter("n_rows > 0").take(1):  # only runs without rows: no files to read
        return spark.createDataFrame([], schema)
    # every directory is named, so values of a declared type come back as that type ("01" stays text)
    data = spark.read.schema(schema.add(ATTEMPT, "string")).parquet(_data(path))
    wanted = maybe_broadcast(current.select(F.col(ATTEMPT).alias("_a"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)]))
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(names)], F.col(ATTEMPT) == F.col("_a"))
    return data.join(wanted, same, "left_semi").select(*[f"`{c}`" for c in columns])


def superseded(spark: SparkSession, path: str) -> DataFrame:
    """(coordinates..., attempt_id): committed attempts that a later one replaced."""
    manifest = spark.read.parquet(_manifest(path))
    names = _coords(manifest)
    current = current_runs(spark, path).select(F.col(ATTEMPT).alias("_a"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)])
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(names)], F.col(ATTEMPT) == F.col("_a"))
    return manifest.select(*names, ATTEMPT).join(current, same, "left_anti")
