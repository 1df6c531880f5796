"""The streaming representation equals the batch one."""

from __future__ import annotations

import __spark_entry__ as E


def test_stream_equals_batch(spark, sf_small):
    q = E.queries()
    s = q["stream_embed"](spark, sf_small)
    b = q["embed_texts"](spark, sf_small)
    assert s.count() == b.count()
    assert s.exceptAll(b.select(*s.columns)).count() == 0


def test_stream_resumes_from_its_checkpoint(spark, sf_small, tmp_path):
    from pyspark.sql import functions as F

    from lexicept.operators.refcorpus import reference_centroids
    from lexicept.sources import fixtures as fx
    from lexicept.streaming.concept_stream import run_available, stream_concept_matrix, stream_table, vector_key

    src = tmp_path / "src"
    docs = fx.table(spark, sf_small, "documents", spread=False)
    cut = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    docs.filter(F.col("doc_id") <= cut).write.parquet(str(src / "part1"))
    corpus = fx.fx_doc_vectors(spark, sf_small)
    cent = reference_centroids(corpus, fx.fx_lexicon(spark))
    vectors = fx.table(spark, sf_small, "embeddings").select("vec_id", "embedding")
    n_vec = vectors.count()

    def run():
        texts = (spark.readStream.schema(docs.schema).option("recursiveFileLookup", True).parquet(str(src))
                 .select("doc_id", vector_key("doc_id", n_vec).alias("vec_id")))
        return run_available(stream_concept_matrix(texts, vectors, cent, fx.fx_categories(spark)), "t",
                             base=str(tmp_path / "out"))

    first = spark.read.parquet(run()).count()
    docs.filter(F.col("doc_id") > cut).write.parquet(str(src / "part2"))
    out = spark.read.parquet(run())
    assert first < out.count() == docs.count()
    assert out.groupBy("doc_id").count().filter("count > 1").count() == 0
