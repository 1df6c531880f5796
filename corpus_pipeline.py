"""Corpus pipeline: language ID, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``documents``; the last returns
them too, a document as often as the mix takes it.

Defined cases: extra columns are kept whatever their names (a document rides in
one column while stages work on it); null, empty and letterless texts go with
the first stage; a null doc_id is kept where its text is; repeated rows count
as near-duplicates of each other; texts of any length are taken whole; an empty
table passes through all stages empty.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parent)
if _ROOT not in sys.path:
    sys.path.insert(0, _ROOT)

from lexicept.functions.sizing import maybe_broadcast  # noqa: E402
from lexicept.llm import decontaminate, langid, mixing, secretscan, simhash  # noqa: E402
from lexicept.llm.common import crc_fold, table, text_batches, written  # noqa: E402
from lexicept.session import ship_package  # noqa: E402

#: A document row and an entry (_i, _k) of a narrow table of rows, null ids included.
SAME = "doc.doc_id <=> _i and _key <=> _k"


def _packed(docs: DataFrame) -> DataFrame:
    """(doc, _key): the whole row in one column, so that its columns can have any names, and the hash of its text."""
    return docs.select(F.struct("*").alias("doc"), F.xxhash64("text").alias("_key"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; texts without letters or with a narrow margin go."""
    ship_package(spark)
    text_batches(spark)
    model = langid.fit(docs.filter(crc_fold("doc_id", 4) != 2))
    found = langid.identify(docs.select(F.struct("*").alias("doc"), "text"), model, out_col="language")
    return found.filter(~F.col("language.rejected")).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the one with the group's id.

    Rows that share that id are settled by the smallest text hash, then one of equal rows stays. A group without any id
    keeps its smallest text hash. Only the narrow table of losers meets the documents again.
    """
    ship_package(spark)
    text_batches(spark)
    row = ["doc_id", "_key"]
    keyed = _packed(docs)
    found = simhash.near_duplicates(docs.select("doc_id", "text", F.xxhash64("text").alias("_key")), keep=["_key"])
    rows = written(found.groupBy("group", "component_id", *row).agg(F.count("*").alias("n")), "pipeline-groups")
    first = rows.filter(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    # written, so that the join below has plain inputs and a large group can be split
    best = written(first.groupBy("group").agg(F.min(F.struct("_key", "doc_id")).alias("b")), "pipeline-first")
    judged = rows.join(best, "group", "left").withColumn("stays", F.struct("_key", "doc_id").eqNullSafe(F.col("b")))
    gone = written(judged.filter(~F.col("stays")).select(*row), "pipeline-duplicates")
    twice = written(judged.filter(F.col("stays") & (F.col("n") > 1)).select(*row), "pipeline-repeated")
    kept = keyed.join(maybe_broadcast(gone.select(F.col("doc_id").alias("_i"), F.col("_key").alias("_k"))), F.expr(SAME), "left_anti")
    if not twice.isEmpty():  # rows equal in id and text: one of each stays
        some = maybe_broadcast(twice.select(F.col("doc_id").alias("_i"), F.col("_key").alias("_k")))
        kept = kept.join(some, F.expr(SAME), "left_anti").unionByName(kept.join(some, F.expr(SAME), "left_semi").withColumn("_id", F.col("doc.doc_id")).dropDuplicates(["_id", "_key"]).drop("_id"))
    return kept.select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark window."""
    ship_package(spark)
    text_batches(spark)
    found = decontaminate.match(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad = written(found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("_i"), F.col("doc_key").alias("_k")).distinct(), "pipeline-contaminated")
    return _packed(docs).join(maybe_broadcast(bad), F.expr(SAME), "left_anti").select("doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; all documents stay."""
    ship_package(spark)
    text_batches(spark)
    clean = secretscan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as it is taken."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: No SQL form: compression, fingerprints and Newton steps. The stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
