"""Sources and sinks: typed reads, wide/long centroid files, partitioned result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import stable_hash
from ..operators.text import TOKEN_PATTERN, token_array

CORPUS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS_SCHEMA = "vec_id long, embedding array<float>, label int"


def balanced(df: DataFrame, key: str | None = None) -> DataFrame:
    """Spread a scan over the cluster when it yields fewer partitions than the default parallelism.

    Large inputs (many files / row groups) already have more splits than
    cores and pass through untouched; a small file stored as one row group
    would otherwise tokenise in a single task.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)


def read_corpus(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA, fmt: str = "parquet",
                columns: list[str] | None = None) -> DataFrame:
    """Text table with a declared schema; the key comes from the data, never from row order."""
    reader = spark.read.schema(schema)
    df = reader.parquet(path) if fmt == "parquet" else reader.option("header", True).option("multiLine", True).csv(path)
    return balanced(df.select(*columns) if columns else df)


def read_corpus_csv(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA, index_col: str | None = None,
                    key_col: str = "doc_id") -> DataFrame:
    """Text table from CSV files with a header; columns are found by name, in any order, and cast to ``schema``.

    ``index_col`` names a column that becomes the key ("" for the unnamed first column that data frame libraries write).
    Without it and without a ``key_col`` in the files the key is a hash of the row, so equal rows share it. Other columns
    that the schema lacks are left out; declared columns that the files lack are null.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    index = "_c0" if index_col == "" else index_col
    if index is not None and index not in raw.columns:
        raise ValueError(f"no index column {index_col!r} in {raw.columns}")
    key = f"`{index}`" if index is not None else f"`{key_col}`" if key_col in raw.columns else None
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns])
    out = []
    for field in T.StructType.fromDDL(schema):
        if field.name == key_col:
            value = row_hash if key is None else F.col(key)
        else:
            value = F.col(f"`{field.name}`") if field.name in raw.columns else F.lit(None)
        out.append(value.cast(field.dataType).alias(field.name))
    return balanced(raw.select(*out))


def read_vectors(spark: SparkSession, path: str, schema: str = VECTORS_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def attach_vectors(corpus: DataFrame, vectors: DataFrame, corpus_key, vector_key: str = "vec_id") -> DataFrame:
    """Align vectors to texts by key (equi-join), replacing row-position alignment."""
    key = F.col(corpus_key) if isinstance(corpus_key, str) else corpus_key
    return corpus.withColumn("_vk", key).join(vectors.withColumnRenamed(vector_key, "_vk"), "_vk").drop("_vk")


def read_pairs(pairs: DataFrame) -> DataFrame:
    """Reference pairs with every row holding a null dropped."""
    return pairs.na.drop("any")


def centroids_wide_to_long(wide: DataFrame, dim_col: str = "dim", categories: list[str] | None = None) -> DataFrame:
    """Wide centroid table (row per dimension, column per category) -> (category, cluster, centroid).

    ``unpivot`` is map-side; rebuilding each vector groups by category with a
    collect bounded by the dimension count d.
    """
    cats = categories or sorted(c for c in wide.columns if c != dim_col)
    long = wide.unpivot([dim_col], cats, "category", "x")
    vec = F.transform(F.array_sort(F.collect_list(F.struct(F.col(dim_col).alias("d"), F.col("x").cast("double").alias("x")))), lambda s: s["x"])
    return long.groupBy("category").agg(vec.alias("centroid")).select("category", F.lit(0).alias("cluster"), "centroid")


def centroids_long_to_wide(centroids: DataFrame, categories: list[str]) -> DataFrame:
    """(category, cluster, centroid) -> row per dimension, column per category (for export)."""
    ex = centroids.select("category", F.posexplode("centroid").alias("dim", "x"))
    return ex.groupBy("dim").pivot("category", categories).agg(F.first("x"))


def read_lexicon(lexicon: DataFrame) -> DataFrame:
    """(category, ord, pattern) -> adds ``is_prefix`` (trailing '*') and ``stem``."""
    return lexicon.select(
        "category",
        F.col("ord").cast("int").alias("ord"),
        F.lower(F.col("pattern")).alias("pattern"),
    ).withColumn("is_prefix", F.col("pattern").endswith("*")).withColumn(
        "stem", F.regexp_replace("pattern", r"\*$", "")
    ).dropDuplicates(["category", "pattern"])


def read_vocab(words: DataFrame, word_col: str = "text") -> DataFrame:
    """One-column word list: nulls dropped, distinct."""
    return words.select(F.col(word_col).alias("word")).na.drop().distinct()


def corpus_vocab(docs: DataFrame, text_col: str = "text", pattern: str = TOKEN_PATTERN) -> DataFrame:
    """Distinct tokens of a corpus (partial distinct per partition before the shuffle)."""
    return docs.select(F.explode(token_array(text_col, pattern)).alias("word")).distinct()


def write_result(df: DataFrame, path: str, partition_cols: list[str] | None = None, mode: str = "overwrite") -> str:
    """Persist a result as parquet, partitioned by run coordinates."""
    w = df.write.mode(mode)
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)
    return path


def select_run(spark: SparkSession, path: str, **coords) -> DataFrame:
    """Read one stored run: filters on partition columns prune directories at planning time."""
    df = spark.read.parquet(path)
    for k, v in coords.items():
        df = df.filter(F.col(k) == F.lit(v))
    return df


def sample_n(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Seeded sample of n rows: the n smallest stable hashes (a top-k plan, not a full sort)."""
    return df.withColumn("_h", stable_hash(key, seed)).orderBy("_h", key).limit(n).drop("_h")
