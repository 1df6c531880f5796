"""Queries: the streaming form of the flagship representation, and target attachment."""

from __future__ import annotations


from functools import partial

from ..operators.concepts import category_centroids, encode
from ..operators.embed import Md5Encoder
from ..operators.refcorpus import reference_centroids
from ..operators.represent import attach_targets, concept_matrix
from ..sources import fixtures as fx
from ..streaming.concept_stream import run_available, stream_embed, stream_table
from .common import long_, r6, sql_r6
from .q_lexicon import EMBED_BASE_SQL, LEX_CATS, MD5_DIM, TEXT_EMBED_SQL
from .registry import query

_WIDE_SQL = (
    EMBED_BASE_SQL + ",\n"
    "sims AS (SELECT d.doc_id, k.category, coalesce(list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), cl.c), 0) AS s "
    "FROM fx_doc_vectors d CROSS JOIN fx_categories k LEFT JOIN cl ON cl.category = k.category),\n"
    "wide AS (SELECT doc_id, " + ", ".join(f"max(CASE WHEN category = '{c}' THEN s END) AS {c}" for c in LEX_CATS)
    + " FROM sims GROUP BY doc_id)\n"
)


@query("stream_embed", TEXT_EMBED_SQL)
def q_stream_embed(spark, sf):
    """Flagship representation by a Structured Streaming query: the streamed texts are encoded and scored as they arrive."""
    encoder, name = partial(Md5Encoder, MD5_DIM), f"md5-{MD5_DIM}"
    lex = fx.fx_lexicon(spark)
    cent = category_centroids(encode(fx.documents(spark, sf), encoder, encoder_id=name), lex)
    texts = stream_table(spark, sf, "documents").select("doc_id", "text")
    wide = stream_embed(texts, cent, fx.fx_categories(spark), encoder, encoder_id=name)
    path = run_available(wide, "stream_embed")
    return spark.read.parquet(path).select("doc_id", *[r6(c, c) for c in LEX_CATS])


@query(
    "attach_targets",
    _WIDE_SQL + "SELECT w.doc_id, " + ", ".join(f"{sql_r6('w.' + c)} AS {c}" for c in LEX_CATS)
    + ", CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic FROM wide w LEFT JOIN labels l ON l.doc_id = w.doc_id",
)
def q_attach_targets(spark, sf):
    corpus = fx.fx_doc_vectors(spark, sf)
    cent = reference_centroids(corpus, fx.fx_lexicon(spark))
    rep = concept_matrix(corpus.select("doc_id", "embedding"), cent, fx.fx_categories(spark))
    labels = fx.table(spark, sf, "labels").select("doc_id", long_("quality", "quality"), long_("toxic", "toxic"))
    out = attach_targets(rep, labels)
    return out.select("doc_id", *[r6(c, c) for c in LEX_CATS], "quality", "toxic")
