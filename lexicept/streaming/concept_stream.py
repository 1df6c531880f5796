"""Concept representation of a text stream.

The representation is stateless per text once the centroid model is fixed,
so a ``readStream`` of texts is scored by the same Arrow-batched scorer as
a batch table: stream-static join to the vectors, score, write. No state
store, no watermark is needed. The sink is a file table in the shared
folder with its checkpoint beside it, so a restarted query resumes from
the last committed micro-batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embed import encode_texts
from ..operators.represent import concept_matrix
from ..session import shared_dir
from ..sources.readers import CORPUS_SCHEMA


def stream_table(spark: SparkSession, directory: str, name: str, schema: str = CORPUS_SCHEMA,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the parquet file called ``name``.parquet, or the part files of the directory of that name, under ``directory``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # a pattern, because a plain path of a streaming source must be a directory
    return reader.parquet(f"{directory.rstrip('/')}/{name}{{.parquet}}")


def stream_concept_matrix(texts: DataFrame, vectors: DataFrame, centroids: DataFrame, categories: DataFrame,
                          id_col: str = "doc_id", vec_col: str = "embedding", metric: str = "cosine") -> DataFrame:
    """Wide representation of a streaming text table (``texts`` carries the vector key ``vec_id``)."""
    joined = texts.join(vectors, "vec_id")
    return concept_matrix(joined.select(id_col, vec_col), centroids, categories, id_col, vec_col, metric)


def stream_embed(texts: DataFrame, centroids: DataFrame, categories: DataFrame, encoder_factory, encoder_id: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text", metric: str = "cosine") -> DataFrame:
    """Wide representation of streamed texts: encode and score row by row, no join and no state."""
    vectors = encode_texts(texts.select(id_col, text_col), text_col, encoder_factory, encoder_id=encoder_id)
    return concept_matrix(vectors.select(id_col, "embedding"), centroids, categories, id_col, metric=metric)


def run_available(stream: DataFrame, name: str, timeout_s: int | None = None, base: str | None = None) -> str:
    """Process everything available now into a parquet table; returns its path.

    ``base`` (output + checkpoint) defaults to a fresh folder in the shared
    checkpoint folder. Passing the same ``base`` again resumes: files already
    committed by an earlier run (or by a run that died midway) are not read twice.
    ``timeout_s`` limits the wait only when given; a backlog takes the time it needs.
    """
    spark = stream.sparkSession
    base = base or shared_dir(spark).rstrip("/") + f"/streams/{name}-{uuid.uuid4().hex[:12]}"
    q = (
        stream.writeStream.format("parquet")
        .option("path", base + "/data")
        .option("checkpointLocation", base + "/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout_s}s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return base + "/data"


def vector_key(doc_id_col: str, n_vectors: int):
    return F.pmod(F.col(doc_id_col), F.lit(int(n_vectors)))
