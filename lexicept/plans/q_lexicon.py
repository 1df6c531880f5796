"""Queries: text preparation, lexicon counts, reference corpus, static vectors."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions.vectors import explode_vector, l2_normalize, norm
from ..operators import embed as E
from ..operators import lexicon as L
from ..operators import refcorpus as R
from ..operators import text as T
from ..operators.concepts import embed
from ..operators.represent import concept_matrix, ordered_categories
from ..sources import fixtures as fx
from ..sources.readers import corpus_vocab, read_lexicon, read_pairs
from .common import long_, r6, sql_r6
from .registry import query

W = fx.with_ctes
LEX = fx.LEXICON_SQL
CATS = fx.CATEGORIES_SQL
LEX_CATS = [c for c, _o, _p in sorted({(c, o, 0) for c, o, _ in fx.LEXICON_ROWS}, key=lambda t: (t[1], t[0]))]
KW = fx.SENSE_KEYWORD


def _docs(spark, sf):
    return fx.documents(spark, sf)


def _lex(spark):
    return fx.fx_lexicon(spark)


def _match_sql(tokens: str, extra_cols: str = "") -> str:
    """Naive oracle match: every token against every pattern, then distinct (pos, category)."""
    return (
        f"SELECT DISTINCT t.doc_id, t.pos, t.token, l.category{extra_cols} FROM {tokens} t JOIN fx_lexicon l ON "
        "(CASE WHEN l.pattern LIKE '%*' THEN starts_with(t.token, rtrim(l.pattern, '*')) ELSE t.token = l.pattern END)"
    )


def _counts_sql(tokens_cte: str, value: str = "CAST(count(h.pos) AS BIGINT)", cat_filter: str = "") -> str:
    return (
        W(LEX, CATS, tokens_cte, f"hits AS ({_match_sql('fx_tokens')})")
        + f"SELECT d.doc_id, c.category, {value} AS n FROM documents d CROSS JOIN fx_categories c "
        "LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.category = c.category "
        f"{cat_filter} GROUP BY d.doc_id, c.category"
    )


EXPANDED_TOKENS = fx.tokens_sql("fx_tokens", fx.expand_sql("lower(text)"))

# ---------------------------------------------------------------- text


@query("tokenize", W(fx.TOKENS_SQL) + "SELECT doc_id, pos, token FROM fx_tokens")
def q_tokenize(spark, sf):
    return T.tokenize(_docs(spark, sf), "doc_id", "text")


@query("tokenize_prefix", W(fx.tokens_sql("p", "lower(substring(text, 1, 512))")) + "SELECT doc_id, pos, token FROM p")
def q_tokenize_prefix(spark, sf):
    return T.tokenize_prefix(_docs(spark, sf), "doc_id", "text", 512)


@query("expand_contractions", "SELECT doc_id, " + fx.expand_sql("lower(text)") + " AS text FROM documents")
def q_expand_contractions(spark, sf):
    return T.expand_contractions(_docs(spark, sf), "text", fx.fx_contractions(spark))


@query("space_length", "SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_chunks FROM documents")
def q_space_length(spark, sf):
    return _docs(spark, sf).select("doc_id", T.space_length("text").alias("n_chunks"))


@query("keyword_filter", f"SELECT doc_id, lower(text) AS text FROM documents WHERE contains(lower(text), '{KW}')")
def q_keyword_filter(spark, sf):
    return T.keyword_filter(_docs(spark, sf), "text", KW)


@query(
    "keyword_append",
    f"SELECT doc_id, lower(text) AS text FROM documents WHERE contains(lower(text), '{KW}') "
    f"UNION ALL SELECT CAST(NULL AS BIGINT), '{KW}'",
)
def q_keyword_append(spark, sf):
    return T.keyword_append(T.keyword_filter(_docs(spark, sf), "text", KW), "text", KW, "doc_id")


@query(
    "first_keyword_token",
    W(fx.TOKENS_SQL) + f"SELECT doc_id, min(pos) AS pos, arg_min(token, pos) AS token FROM fx_tokens "
    f"WHERE contains(token, '{KW}') GROUP BY doc_id",
)
def q_first_keyword_token(spark, sf):
    return T.first_keyword_token(_docs(spark, sf), "doc_id", "text", KW)


# continuations are single letters here, so greedy splitting is: the longest prefix that is a piece, then letter by letter
@query(
    "subword_tokens",
    W(fx.TOKENS_SQL, fx.WORD_VECTORS_SQL,
      "voc AS (SELECT DISTINCT token AS w FROM fx_tokens)",
      "pieces AS (SELECT token AS piece FROM fx_word_vectors UNION SELECT DISTINCT unnest(string_split(w, '')) FROM voc)",
      "pre AS (SELECT v.w, max(v.l) AS l FROM (SELECT w, unnest(range(1, length(w) + 1)) AS l FROM voc) v "
      "JOIN pieces p ON p.piece = substr(v.w, 1, v.l) GROUP BY v.w)",
      "parts AS (SELECT w, list_concat([substr(w, 1, l)], CASE WHEN l = length(w) THEN [] "
      "ELSE ['##' || c FOR c IN string_split(substr(w, l + 1), '')] END) AS ps FROM pre)",
      "doc AS (SELECT t.doc_id, flatten(list(parts.ps ORDER BY t.pos)) AS ps FROM fx_tokens t JOIN parts ON parts.w = t.token GROUP BY t.doc_id)")
    + "SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, ps[i] AS token FROM ("
    "SELECT doc_id, ps, unnest(generate_series(1, len(ps))) AS i FROM doc)",
)
def q_subword_tokens(spark, sf):
    docs = _docs(spark, sf)
    words = fx.fx_word_vectors(spark, sf).select(F.col("token").alias("piece"))
    # the alphabet comes from the distinct vocabulary, not from every character of every text
    letters = corpus_vocab(docs).select(F.explode(F.split("word", "")).alias("ch")).distinct()
    pieces = words.unionByName(letters.select(F.col("ch").alias("piece"))).unionByName(
        letters.select(F.concat(F.lit("##"), "ch").alias("piece"))
    )
    return T.subword_tokens(docs, "doc_id", "text", pieces)


# ---------------------------------------------------------------- lexicon


@query(
    "read_lexicon",
    W(LEX, fx.TOKENS_SQL, "v AS (SELECT DISTINCT token FROM fx_tokens)")
    + "SELECT l.category, CAST(l.ord AS BIGINT) AS ord, l.pattern, l.pattern LIKE '%*' AS is_prefix, "
    "CAST(count(v.token) AS BIGINT) AS n_words FROM fx_lexicon l LEFT JOIN v ON "
    "(CASE WHEN l.pattern LIKE '%*' THEN starts_with(v.token, rtrim(l.pattern, '*')) ELSE v.token = l.pattern END) "
    "GROUP BY l.category, l.ord, l.pattern",
)
def q_read_lexicon(spark, sf):
    lex = read_lexicon(_lex(spark))
    hits = L.pattern_matches(corpus_vocab(_docs(spark, sf)), lex)
    n = hits.groupBy("category", "pattern").agg(F.count("*").alias("n_words"))
    return lex.join(n, ["category", "pattern"], "left").select(
        "category", long_("ord", "ord"), "pattern", "is_prefix", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words")
    )


@query(
    "word_categories",
    W(LEX, fx.TOKENS_SQL, "v AS (SELECT DISTINCT token FROM fx_tokens)")
    + "SELECT DISTINCT v.token AS word, l.category FROM v JOIN fx_lexicon l ON "
    "(CASE WHEN l.pattern LIKE '%*' THEN starts_with(v.token, rtrim(l.pattern, '*')) ELSE v.token = l.pattern END)",
)
def q_word_categories(spark, sf):
    return L.word_categories(corpus_vocab(_docs(spark, sf)), _lex(spark))


@query("read_vocab", W(fx.TOKENS_SQL) + "SELECT DISTINCT token AS word FROM fx_tokens")
def q_read_vocab(spark, sf):
    return corpus_vocab(_docs(spark, sf))


@query("lexicon_counts", _counts_sql(EXPANDED_TOKENS))
def q_lexicon_counts(spark, sf):
    return L.lexicon_counts(_docs(spark, sf), _lex(spark), LEX_CATS, contractions=fx.fx_contractions(spark))


@query("lexicon_counts_plain", _counts_sql(fx.TOKENS_SQL))
def q_lexicon_counts_plain(spark, sf):
    return L.lexicon_counts(_docs(spark, sf), _lex(spark), LEX_CATS)


@query("lexicon_flags", _counts_sql(EXPANDED_TOKENS, "CAST(count(h.pos) > 0 AS BIGINT)").replace(" AS n FROM", " AS flag FROM"))
def q_lexicon_flags(spark, sf):
    return L.lexicon_counts(_docs(spark, sf), _lex(spark), LEX_CATS, binary=True,
                            contractions=fx.fx_contractions(spark), value_col="flag")


@query("category_subset", _counts_sql(EXPANDED_TOKENS, cat_filter=f"WHERE c.ord >= {fx.SUBSET_MIN_ORD}"))
def q_category_subset(spark, sf):
    sub = L.category_subset(_lex(spark), fx.SUBSET_MIN_ORD)
    cats = ordered_categories(sub.select("category", "ord"))
    return L.lexicon_counts(_docs(spark, sf), sub, cats, contractions=fx.fx_contractions(spark))


@query(
    "counts_with_targets",
    "SELECT w.*, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic FROM ("
    + _counts_sql(EXPANDED_TOKENS).replace("SELECT d.doc_id, c.category,", "SELECT d.doc_id, c.category,", 1)
    + ") PIVOT (first(n) FOR category IN (" + ", ".join(f"'{c}'" for c in LEX_CATS) + ")) w "
    "LEFT JOIN labels l ON l.doc_id = w.doc_id",
)
def q_counts_with_targets(spark, sf):
    docs = _docs(spark, sf)
    wide = L.lexicon_counts_wide(docs, _lex(spark), LEX_CATS, contractions=fx.fx_contractions(spark))
    labels = fx.table(spark, sf, "labels").select("doc_id", long_("quality", "quality"), long_("toxic", "toxic"))
    return L.counts_with_targets(wide, labels)


@query(
    "category_words",
    W(LEX, fx.TOKENS_SQL, fx.WORD_VECTORS_SQL)
    + "SELECT DISTINCT l.category, v.token AS word FROM fx_word_vectors v JOIN fx_lexicon l ON "
    "(CASE WHEN l.pattern LIKE '%*' THEN starts_with(v.token, rtrim(l.pattern, '*')) ELSE v.token = l.pattern END)",
)
def q_category_words(spark, sf):
    wv = fx.fx_word_vectors(spark, sf)
    wc = L.word_categories(corpus_vocab(_docs(spark, sf)), _lex(spark))
    return L.category_words(wc, wv)


_SOFT_SQL = (
    W(LEX, CATS, fx.TOKENS_SQL, fx.WORD_VECTORS_SQL, EXPANDED_TOKENS.replace("fx_tokens AS", "xt AS", 1),
      "cw AS (SELECT DISTINCT l.category, v.token AS word, v.embedding FROM fx_word_vectors v JOIN fx_lexicon l ON "
      "(CASE WHEN l.pattern LIKE '%*' THEN starts_with(v.token, rtrim(l.pattern, '*')) ELSE v.token = l.pattern END))",
      "tc AS (SELECT doc_id, token, count(*) AS m FROM xt GROUP BY doc_id, token)",
      "ts AS (SELECT v.token, cw.category, sum(coalesce(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), "
      "CAST(cw.embedding AS DOUBLE[])), 0)) AS s FROM fx_word_vectors v CROSS JOIN cw GROUP BY v.token, cw.category)",
      "sc AS (SELECT tc.doc_id, ts.category, sum(tc.m * ts.s) AS score FROM tc JOIN ts ON ts.token = tc.token "
      "GROUP BY tc.doc_id, ts.category)")
    + "SELECT d.doc_id, c.category, " + sql_r6("coalesce(sc.score, 0)") + " AS score FROM documents d "
    "CROSS JOIN fx_categories c LEFT JOIN sc ON sc.doc_id = d.doc_id AND sc.category = c.category"
)


SOFT_RAW_SQL = _SOFT_SQL.replace(sql_r6("coalesce(sc.score, 0)"), "coalesce(sc.score, 0)")


@query("soft_lexicon_counts", _SOFT_SQL)
def q_soft_lexicon_counts(spark, sf):
    out = L.soft_lexicon_counts(_docs(spark, sf), _lex(spark), fx.fx_categories(spark), fx.fx_word_vectors(spark, sf),
                                contractions=fx.fx_contractions(spark))
    return out.select("doc_id", "category", r6("score", "score"))


# ---------------------------------------------------------------- reference corpus

_HITS_SQL = W(LEX, fx.TOKENS_SQL, f"hits AS ({_match_sql('fx_tokens')})")


@query("reference_pairs", _HITS_SQL + "SELECT doc_id, category, token AS word, pos AS word_idx FROM hits")
def q_reference_pairs(spark, sf):
    return R.reference_pairs(_docs(spark, sf), _lex(spark)).drop("sentence_key")


_DEDUPE_SQL = (
    "dd AS (SELECT DISTINCT h.category, h.token AS word, h.pos AS word_idx, d.text AS sentence "
    "FROM hits h JOIN documents d ON d.doc_id = h.doc_id)"
)


@query(
    "dedupe_pairs",
    _HITS_SQL.rstrip("\n") + ",\n" + _DEDUPE_SQL + "\nSELECT category, word, word_idx, sha256(sentence) AS sentence_key FROM dd",
)
def q_dedupe_pairs(spark, sf):
    pairs = R.dedupe_pairs(R.reference_pairs(_docs(spark, sf), _lex(spark), packed=True))
    return pairs.select("category", "word", "word_idx", "sentence_key")


_ATTACH_SQL = (
    W(LEX, fx.TOKENS_SQL, fx.DOC_VECTORS_SQL, f"hits AS ({_match_sql('fx_tokens')})", _DEDUPE_SQL,
      "merged AS (SELECT dd.category, c.doc_id, c.vec_id, c.embedding FROM dd JOIN fx_doc_vectors c ON c.text = dd.sentence)")
)


@query(
    "attach_embeddings",
    _ATTACH_SQL + "SELECT doc_id, category, CAST(count(*) AS BIGINT) AS weight, vec_id FROM merged GROUP BY doc_id, category, vec_id",
)
def q_attach_embeddings(spark, sf):
    corpus = fx.fx_doc_vectors(spark, sf)
    w = R.attach_embeddings(R.pair_weights(corpus, _lex(spark)), corpus.select("doc_id", "vec_id", "embedding"))
    return w.select("doc_id", "category", "weight", "vec_id")


@query(
    "read_pairs",
    _ATTACH_SQL + "SELECT category, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS total_weight "
    "FROM merged GROUP BY category",
)
def q_read_pairs(spark, sf):
    corpus = fx.fx_doc_vectors(spark, sf)
    w = read_pairs(R.attach_embeddings(R.pair_weights(corpus, _lex(spark)), corpus.select("doc_id", "embedding")))
    return w.groupBy("category").agg(F.count("*").alias("n_rows"), F.sum("weight").cast("long").alias("total_weight"))


_REF_CENT_SQL = (
    "rc AS (SELECT category, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM ("
    "SELECT category, embedding, unnest(generate_series(1, len(embedding))) AS i FROM merged) GROUP BY category, i)"
)


@query(
    "reference_centroids",
    _ATTACH_SQL.rstrip("\n") + ",\n" + _REF_CENT_SQL + f"\nSELECT category, CAST(i - 1 AS BIGINT) AS dim, {sql_r6('x')} AS x FROM rc",
)
def q_reference_centroids(spark, sf):
    cent = R.reference_centroids(fx.fx_doc_vectors(spark, sf), _lex(spark))
    return explode_vector(cent, ["category"], "centroid")


EMBED_BASE_SQL = (
    _ATTACH_SQL.rstrip("\n") + ",\n" + _REF_CENT_SQL + ",\n" + CATS
    + ",\ncl AS (SELECT category, list(x ORDER BY i) AS c FROM rc GROUP BY category)"
)


def embed_sims_sql(metric: str = "cosine") -> str:
    """Full query (doc_id, category, s): unrounded similarity of every document to every category."""
    if metric == "cosine":
        e = "coalesce(list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), cl.c), 0)"
    else:
        e = "coalesce(exp(-list_distance(CAST(d.embedding AS DOUBLE[]), cl.c) / len(d.embedding)), 0)"
    return (EMBED_BASE_SQL + f"\nSELECT d.doc_id, k.category, {e} AS s "
            "FROM fx_doc_vectors d CROSS JOIN fx_categories k LEFT JOIN cl ON cl.category = k.category")


@query(
    "embed",
    EMBED_BASE_SQL + ",\n"
    "sims AS (SELECT d.doc_id, k.category, coalesce(list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), cl.c), 0) AS s "
    "FROM fx_doc_vectors d CROSS JOIN fx_categories k LEFT JOIN cl ON cl.category = k.category)\n"
    "SELECT doc_id, " + ", ".join(f"{sql_r6(f'max(CASE WHEN category = {chr(39)}{c}{chr(39)} THEN s END)')} AS {c}" for c in LEX_CATS)
    + " FROM sims GROUP BY doc_id",
)
def q_embed(spark, sf):
    """Flagship: every document as lexicon-concept similarities (reference = the corpus itself)."""
    corpus = fx.fx_doc_vectors(spark, sf)
    lex = _lex(spark)
    cent = R.reference_centroids(corpus, lex)
    wide = concept_matrix(corpus.select("doc_id", "embedding"), cent, fx.fx_categories(spark))
    return wide.select("doc_id", *[r6(c, c) for c in LEX_CATS])


# ---------------------------------------------------------------- vectors


@query(
    "read_vectors",
    W(fx.DOC_VECTORS_SQL) + "SELECT doc_id, vec_id, " + sql_r6("sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))") + " AS norm FROM fx_doc_vectors",
)
def q_read_vectors(spark, sf):
    return fx.fx_doc_vectors(spark, sf).select("doc_id", "vec_id", r6(norm("embedding"), "norm"))


@query(
    "l2_normalize",
    "SELECT vec_id, CAST(i - 1 AS BIGINT) AS dim, " + sql_r6("CAST(embedding[i] AS DOUBLE) / nullif(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 0)")
    + " AS x FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)",
)
def q_l2_normalize(spark, sf):
    emb = fx.table(spark, sf, "embeddings")
    return explode_vector(emb.select("vec_id", l2_normalize("embedding").alias("u")), ["vec_id"], "u")


@query(
    "encode_tokens",
    W(fx.TOKENS_SQL, fx.WORD_VECTORS_SQL)
    + "SELECT t.doc_id, t.pos, t.token, " + sql_r6("v.embedding[1]") + " AS x0 FROM fx_tokens t JOIN fx_word_vectors v ON v.token = t.token",
)
def q_encode_tokens(spark, sf):
    tv = E.encode_tokens(_docs(spark, sf), fx.fx_word_vectors(spark, sf))
    return tv.select("doc_id", "pos", "token", r6(F.col("embedding")[0], "x0"))


#: Characters of a text before its tokens: the gaps between tokens and the tokens before, added up.
CONTEXT_DIM, CONTEXT_KEYWORD = 16, "an"
_SPAN_TOKENS_SQL = (
    "st AS (SELECT doc_id, regexp_extract_all(text, '\\p{L}+') AS t, regexp_split_to_array(text, '\\p{L}+') AS g FROM documents WHERE text IS NOT NULL)",
    "tok AS MATERIALIZED (SELECT doc_id, i, lower(t[i]) AS token, "
    "CAST(sum(length(g[i]) + length(t[i])) OVER (PARTITION BY doc_id ORDER BY i) - length(t[i]) AS BIGINT) AS s, length(t[i]) AS n "
    "FROM (SELECT doc_id, t, g, unnest(range(1, len(t) + 1)) AS i FROM st))",
    f"place AS MATERIALIZED (SELECT doc_id, i, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % {CONTEXT_DIM} AS p FROM tok)",
)


@query(
    "keyword_token_vector",
    W(*_SPAN_TOKENS_SQL,
      f"hit AS (SELECT doc_id, i, token, s, n FROM tok WHERE contains(token, '{CONTEXT_KEYWORD}') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1)")
    + "SELECT h.doc_id, CAST(h.i - 1 AS BIGINT) AS pos, h.s AS start, h.s + h.n AS \"end\", h.token, q.d AS dim, "
    + sql_r6("coalesce(sum(power(0.5, abs(p.i - h.i))), 0)") + f" AS x FROM hit h CROSS JOIN range({CONTEXT_DIM}) q(d) "
    "LEFT JOIN place p ON p.doc_id = h.doc_id AND abs(p.i - h.i) <= 2 AND p.p = q.d GROUP BY ALL",
)
def q_keyword_token_vector(spark, sf):
    """Contextual vector and character offsets of every text's first token that contains the keyword."""
    spans = E.encode_token_spans(_docs(spark, sf).select("doc_id", "text"), encoder_factory=partial(E.WindowTokenEncoder, CONTEXT_DIM), encoder_id=f"window-{CONTEXT_DIM}")
    hits = E.keyword_vector(spans, CONTEXT_KEYWORD).filter(F.col("pos").isNotNull())
    long = hits.select("doc_id", long_("pos", "pos"), long_("start", "start"), long_("end", "end"), "token", F.posexplode("embedding").alias("dim", "x"))
    return long.select("doc_id", "pos", "start", "end", "token", long_("dim", "dim"), r6("x", "x"))


@query(
    "pool_token_vectors",
    W(*_SPAN_TOKENS_SQL,
      f"v AS (SELECT a.doc_id, b.p AS d, sum(power(0.5, abs(a.i - b.i))) AS x FROM place a JOIN place b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 2 AND a.i + 2 GROUP BY ALL)",
      "n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id)")
    + "SELECT n.doc_id, q.d AS dim, " + sql_r6("coalesce(v.x, 0) / n.n") + f" AS x FROM n CROSS JOIN range({CONTEXT_DIM}) q(d) LEFT JOIN v ON v.doc_id = n.doc_id AND v.d = q.d",
)
def q_pool_token_vectors(spark, sf):
    """Mean of a text's contextual token vectors, pooled inside the row."""
    spans = E.encode_token_spans(_docs(spark, sf).select("doc_id", "text"), encoder_factory=partial(E.WindowTokenEncoder, CONTEXT_DIM), encoder_id=f"window-{CONTEXT_DIM}")
    pooled = spans.select("doc_id", E.pool_spans().alias("v"))
    return pooled.select("doc_id", F.posexplode("v").alias("dim", "x")).select("doc_id", long_("dim", "dim"), r6("x", "x"))


_POOL_SQL = (
    W(fx.TOKENS_SQL, fx.WORD_VECTORS_SQL)
    + "SELECT doc_id, CAST(i - 1 AS BIGINT) AS dim, " + sql_r6("avg(CAST(embedding[i] AS DOUBLE))") + " AS x FROM ("
    "SELECT t.doc_id, v.embedding, unnest(generate_series(1, len(v.embedding))) AS i FROM fx_tokens t "
    "JOIN fx_word_vectors v ON v.token = t.token) GROUP BY doc_id, i"
)


@query("mean_pool", _POOL_SQL)
def q_mean_pool(spark, sf):
    pooled = E.mean_pool(E.encode_tokens(_docs(spark, sf), fx.fx_word_vectors(spark, sf)))
    return explode_vector(pooled, ["doc_id"], "embedding")


@query("encode_distinct", _POOL_SQL)
def q_encode_distinct(spark, sf):
    enc = E.static_text_encoder(fx.fx_word_vectors(spark, sf))
    out = E.encode_distinct(_docs(spark, sf), enc).na.drop(subset=["embedding"])
    return explode_vector(out, ["doc_id"], "embedding")


MD5_DIM = 16
# the md5 feature hashing encoder in SQL: (doc_id, text, embedding)
MD5_VECTORS_SQL = (
    f"md5_places AS (SELECT doc_id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % {MD5_DIM} AS i, count(*) AS n FROM fx_tokens GROUP BY 1, 2),\n"
    "fx_doc_vectors AS (SELECT d.doc_id, d.text, 0 AS vec_id, list(CAST(coalesce(p.n, 0) AS DOUBLE) ORDER BY g.i) AS embedding "
    f"FROM documents d CROSS JOIN range({MD5_DIM}) g(i) LEFT JOIN md5_places p ON p.doc_id = d.doc_id AND p.i = g.i GROUP BY d.doc_id, d.text)"
)


@query(
    "encode_texts",
    W(fx.TOKENS_SQL, MD5_VECTORS_SQL)
    + "SELECT doc_id, CAST(i - 1 AS BIGINT) AS dim, " + sql_r6("embedding[i]") + " AS x FROM ("
    "SELECT doc_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM fx_doc_vectors)",
)
def q_encode_texts(spark, sf):
    out = E.encode_texts(_docs(spark, sf), "text", partial(E.Md5Encoder, MD5_DIM), encoder_id=f"md5-{MD5_DIM}")
    return explode_vector(out, ["doc_id"], "embedding")


TEXT_EMBED_BASE_SQL = EMBED_BASE_SQL.replace(fx.DOC_VECTORS_SQL, MD5_VECTORS_SQL)
TEXT_EMBED_SQL = (
    TEXT_EMBED_BASE_SQL + ",\n"
    "sims AS (SELECT d.doc_id, k.category, coalesce(list_cosine_similarity(d.embedding, cl.c), 0) AS s "
    "FROM fx_doc_vectors d CROSS JOIN fx_categories k LEFT JOIN cl ON cl.category = k.category)\n"
    "SELECT doc_id, " + ", ".join(f"{sql_r6(f'max(CASE WHEN category = {chr(39)}{c}{chr(39)} THEN s END)')} AS {c}" for c in LEX_CATS)
    + " FROM sims GROUP BY doc_id"
)


@query("embed_texts", TEXT_EMBED_SQL)
def q_embed_texts(spark, sf):
    """The callable flagship end to end: texts, encoder, centroids of their own lexicon hits, similarities."""
    wide = embed(_docs(spark, sf), _lex(spark), partial(E.Md5Encoder, MD5_DIM), encoder_id=f"md5-{MD5_DIM}")
    return wide.select("doc_id", *[r6(c, c) for c in LEX_CATS])
