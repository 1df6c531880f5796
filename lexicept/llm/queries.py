"""Registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path
from . import alignment, decontaminate, htmltext, importance, langid, licenses, mixing, pii, quality, secretscan, simhash, tokenbin, toxicity
from .common import crc_fold, table, text_batches


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(crc_fold("doc_id", 5) != 0))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "toxicity.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return decontaminate.report(decontaminate.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(crc_fold("doc_id", 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "language.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return pii.digest(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return secretscan.digest(secretscan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs.select("doc_id", "text"), quality.learn(docs)).select("doc_id", "quality.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    pages = htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    path = table_path(spark, "token-ids-" + uuid.uuid4().hex)
    tokenbin.write(table(spark, sf_dir, "documents"), path, _vocabulary("word_bpe_49k.json"), end_id=2)
    return tokenbin.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return alignment.link_scores(docs, _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))[0]


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_decontamination, op3_licenses, op4_language, op5_mixing, op6_pii, op7_secrets, op8_quality, op9_simhash, op10_html,
        op11_token_ids, op12_importance, op13_alignment,
    )
}

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, CASE WHEN len(w) < 10 THEN w ELSE w[k:k + 9] END AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
dw AS (SELECT r, k, n, w[k:k + n - 1] AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, k, n, item_id FROM dw JOIN win ON dw.g = win.g),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r),
g AS (SELECT row_number() OVER () AS gid, g FROM (SELECT DISTINCT g FROM win WHERE len(g) = 10)),
gw AS (SELECT gid, o, g[o] AS t FROM (SELECT gid, g, unnest(range(1, 11)) AS o FROM g)),
occ AS (SELECT r, p, w[p] AS t FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d) WHERE w[p] IN (SELECT t FROM gw)),
rare AS (SELECT gid, arg_min(o, c) AS o, arg_min(t, c) AS t FROM (SELECT gid, o, gw.t, coalesce(n, 0) AS c FROM gw
  LEFT JOIN (SELECT t, count(*) AS n FROM occ GROUP BY t) f ON f.t = gw.t) GROUP BY gid),
starts AS (SELECT DISTINCT gid, r, p - o + s AS b FROM rare JOIN occ USING (t), (SELECT unnest(range(-2, 1)) AS s)),
near AS (SELECT DISTINCT gid, r FROM (SELECT s.gid, s.r, s.b FROM starts s JOIN gw ON gw.gid = s.gid
  JOIN (SELECT r, t, p - s AS p FROM occ, (SELECT unnest(range(0, 3)) AS s)) x ON x.r = s.r AND x.t = gw.t AND x.p = s.b + gw.o
  GROUP BY s.gid, s.r, s.b HAVING count(DISTINCT gw.o) = 10)),
nears AS (SELECT r, count(*) AS n_near FROM (
  SELECT DISTINCT near.r, item_id FROM near JOIN g ON g.gid = near.gid JOIN win ON win.g = g.g WHERE item_id IS NOT NULL
  EXCEPT SELECT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near_items
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN nears USING (r)
"""

ORACLE = {"op2_decontamination": OP2_SQL, "op3_licenses": licenses.oracle_sql()}
