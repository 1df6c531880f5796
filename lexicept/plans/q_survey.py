"""Queries: survey reshaping, human-agreement statistics and word senses (step 11)."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..functions.stats import column_summary, icc_average, icc_interval, paired_t_test, row_pearson, stack_columns
from ..operators import lexicon as L
from ..operators import scaling as S
from ..operators import sense as N
from ..operators import survey as U
from ..operators.refcorpus import reference_centroids
from ..operators.represent import concept_matrix
from ..operators.text import keyword_append, keyword_filter
from ..sources import fixtures as fx
from .common import r6, sql_r6
from .q_lexicon import EMBED_BASE_SQL, EXPANDED_TOKENS, LEX_CATS, SOFT_RAW_SQL, _counts_sql, embed_sims_sql
from .registry import query

W = fx.with_ctes
ID_COLS = [U.RATER_COL, U.SENTENCE_BATCH_COL, U.CATEGORY_BATCH_COL]
BATCH = ("6", "user")
SURVEY = W(fx.LEXICON_SQL, fx.SURVEY_ANSWERS_SQL)
IN_BATCH = f"SentenceBatch = '{BATCH[0]}' AND CategoryBatch = '{BATCH[1]}'"
REL = "contains(question, '_QS') AND NOT starts_with(question, '21_')"
CODE_SQL = ("CASE answer WHEN 'Not expressed' THEN 0 WHEN 'Potentially expressed' THEN 1 "
            "WHEN 'Most likely expressed' THEN 2 END")
CATS_SQL = "[" + ", ".join(f"'{c}'" for c in fx.SURVEY_CATEGORIES) + "]"
KEY_SQL = ("array_to_string(list_concat([CASE WHEN length(string_split(question, '_')[1]) < 2 THEN "
           "lpad(string_split(question, '_')[1], 2, '0') ELSE string_split(question, '_')[1] END], "
           "string_split(question, '_')[2:len(string_split(question, '_')) - 1]), '_')")


def _wide(spark, sf):
    return fx.fx_survey_wide(spark, sf)


def _long_all(spark, sf):
    return U.survey_to_long(_wide(spark, sf))


# ---------------------------------------------------------------- survey reshaping


@query(
    "drop_sparse_columns",
    SURVEY + "SELECT QProlificID, question, answer FROM sl WHERE question IN "
    "(SELECT question FROM sl GROUP BY question HAVING count(*) >= 4)",
)
def q_drop_sparse_columns(spark, sf):
    kept = U.drop_sparse_columns(_wide(spark, sf), 4, keep=ID_COLS)
    qcols = [c for c in kept.columns if c not in ID_COLS]
    long = kept.select("QProlificID", *[F.col(f"`{c}`") for c in qcols]).unpivot(["QProlificID"], qcols, "question", "answer")
    return long.na.drop(subset=["answer"])


@query("batch_filter", SURVEY + f"SELECT DISTINCT QProlificID, SentenceBatch, CategoryBatch FROM sl WHERE {IN_BATCH}")
def q_batch_filter(spark, sf):
    return U.batch_filter(_wide(spark, sf), *BATCH).select(*ID_COLS)


@query("question_columns", SURVEY + f"SELECT DISTINCT question AS column_name FROM sl WHERE {IN_BATCH} AND {REL}")
def q_question_columns(spark, sf):
    batch = U.drop_sparse_columns(U.batch_filter(_wide(spark, sf), *BATCH), 1, keep=ID_COLS)
    return spark.createDataFrame([(c,) for c in U.question_columns(batch.columns)], "column_name string")


@query("recode_ordinal", SURVEY + f"SELECT QProlificID, question, CAST({CODE_SQL} AS BIGINT) AS code FROM sl")
def q_recode_ordinal(spark, sf):
    w = _wide(spark, sf)
    long = w.select("QProlificID", *[F.col(f"`{q}`") for q in fx.SURVEY_QUESTIONS]).unpivot(
        ["QProlificID"], fx.SURVEY_QUESTIONS, "question", "answer"
    )
    return long.na.drop(subset=["answer"]).select("QProlificID", "question", U.recode("answer").alias("code"))


@query(
    "attention_score",
    SURVEY + "SELECT QProlificID, CAST(count_if(answer = 'Not expressed') AS BIGINT) AS attention FROM sl "
    "WHERE starts_with(question, '21_') GROUP BY QProlificID",
)
def q_attention_score(spark, sf):
    return U.attention_score(_wide(spark, sf))


@query(
    "response_sum",
    SURVEY + "SELECT QProlificID, CAST(sum(CASE answer WHEN 'Not expressed' THEN -1 WHEN 'Potentially expressed' THEN 0 "
    "WHEN 'Most likely expressed' THEN 1 END) AS BIGINT) AS response_sum FROM sl WHERE contains(question, '_QS1C1') "
    "GROUP BY QProlificID",
)
def q_response_sum(spark, sf):
    return U.response_sum(_wide(spark, sf))


@query(
    "survey_to_long",
    SURVEY + f"SELECT QProlificID AS Rater, question AS Object, CAST({CODE_SQL} AS BIGINT) AS Score FROM sl "
    f"WHERE {IN_BATCH} AND {REL}",
)
def q_survey_to_long(spark, sf):
    batch = U.drop_sparse_columns(U.batch_filter(_wide(spark, sf), *BATCH), 1, keep=ID_COLS)
    return U.survey_to_long(batch)


_LONG_CAT = (
    f"SELECT QProlificID AS Rater, question AS Object, CAST({CODE_SQL} AS BIGINT) AS Score, "
    f"{CATS_SQL}[CAST(regexp_extract(question, '_(\\d+)$', 1) AS INTEGER)] AS Category, {KEY_SQL} AS okey FROM sl WHERE {REL}"
)


@query("assign_category", SURVEY + f"SELECT Rater, Object, Score, Category FROM ({_LONG_CAT})")
def q_assign_category(spark, sf):
    return U.assign_category(_long_all(spark, sf), fx.SURVEY_CATEGORIES)


@query("object_key", SURVEY + f"SELECT DISTINCT Object, okey AS object_key FROM ({_LONG_CAT})")
def q_object_key(spark, sf):
    return _long_all(spark, sf).select("Object", U.object_key("Object").alias("object_key")).distinct()


_MEAN_RATING = f"SELECT okey AS object, Category AS category, avg(Score) AS rating FROM ({_LONG_CAT}) GROUP BY okey, Category"


@query("mean_rating", SURVEY + f"SELECT object, category, {sql_r6('rating')} AS rating FROM ({_MEAN_RATING})")
def q_mean_rating(spark, sf):
    m = U.mean_rating(U.assign_category(_long_all(spark, sf), fx.SURVEY_CATEGORIES))
    return m.select("object", "category", r6("rating", "rating"))


@query(
    "rating_matrix",
    SURVEY + "SELECT object, " + ", ".join(
        f"{sql_r6(f'max(CASE WHEN category = {chr(39)}{c}{chr(39)} THEN rating END)')} AS {c}" for c in fx.SURVEY_CATEGORIES
    ) + f" FROM ({_MEAN_RATING}) GROUP BY object",
)
def q_rating_matrix(spark, sf):
    m = U.rating_matrix(U.mean_rating(U.assign_category(_long_all(spark, sf), fx.SURVEY_CATEGORIES)), fx.SURVEY_CATEGORIES)
    return m.select("object", *[r6(c, c) for c in fx.SURVEY_CATEGORIES])


_OVERLAP_SQL = (
    "ov AS (SELECT d.text, min(d.doc_id) AS doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id "
    "WHERE d.text IN (SELECT text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY d.text)"
)


def _overlap(spark, sf):
    docs = fx.documents(spark, sf)
    lab = fx.table(spark, sf, "labels").select("doc_id")
    a, b = docs.join(lab, "doc_id", "left_semi"), docs.join(lab, "doc_id", "left_anti")
    return U.text_overlap(a, b, "text", "doc_id"), b


@query("text_overlap", W(_OVERLAP_SQL) + "SELECT md5(text) AS text_md5, doc_id FROM ov")
def q_text_overlap(spark, sf):
    ov, _ = _overlap(spark, sf)
    return ov.select(F.md5("text").alias("text_md5"), "doc_id")


@query(
    "first_match",
    W(_OVERLAP_SQL) + "SELECT md5(ov.text) AS text_md5, ov.doc_id, (SELECT min(doc_id) FROM documents d WHERE d.text = ov.text "
    "AND d.doc_id NOT IN (SELECT doc_id FROM labels)) AS match_key FROM ov",
)
def q_first_match(spark, sf):
    ov, b = _overlap(spark, sf)
    return U.first_match(ov, b, "text", "doc_id").select(F.md5("text").alias("text_md5"), "doc_id", "match_key")


# ---------------------------------------------------------------- agreement statistics

METHODS = ["embed", "embed_l2", "soft", "flags"]


def _rtc_sql(src: str) -> str:
    """Rows standardised, then columns fitted on the whole table; src has (doc_id, category, v)."""
    inner = (
        "SELECT doc_id, category, (v - avg(v) OVER (PARTITION BY doc_id)) / CASE WHEN stddev_pop(v) OVER "
        "(PARTITION BY doc_id) = 0 THEN 1 ELSE stddev_pop(v) OVER (PARTITION BY doc_id) END AS r FROM " + src
    )
    return (
        "SELECT doc_id, category, (r - avg(r) OVER (PARTITION BY category)) / CASE WHEN stddev_pop(r) OVER "
        f"(PARTITION BY category) = 0 THEN 1 ELSE stddev_pop(r) OVER (PARTITION BY category) END AS z FROM ({inner})"
    )


def _pearson_sql(a: str, b: str) -> str:
    dev = (
        f"SELECT a.doc_id, a.z - avg(a.z) OVER (PARTITION BY a.doc_id) AS da, b.z - avg(b.z) OVER (PARTITION BY a.doc_id) AS db "
        f"FROM {a} a JOIN {b} b ON b.doc_id = a.doc_id AND b.category = a.category"
    )
    return (
        "SELECT doc_id, CASE WHEN sum(da * da) * sum(db * db) = 0 THEN NULL ELSE "
        f"round(sum(da * db) / sqrt(sum(da * da) * sum(db * db)), 3) END AS r FROM ({dev}) GROUP BY doc_id"
    )


_SRC = {
    "hum": f"(SELECT doc_id, category, CAST(n AS DOUBLE) AS v FROM ({_counts_sql(EXPANDED_TOKENS)}))",
    "flags": "(SELECT doc_id, category, CAST(n AS DOUBLE) AS v FROM ("
    + _counts_sql(EXPANDED_TOKENS, "CAST(count(h.pos) > 0 AS BIGINT)") + "))",
    "soft": f"(SELECT doc_id, category, score AS v FROM ({SOFT_RAW_SQL}))",
    "embed": f"(SELECT doc_id, category, s AS v FROM ({embed_sims_sql('cosine')}))",
    "embed_l2": f"(SELECT doc_id, category, s AS v FROM ({embed_sims_sql('l2')}))",
}

CORR_SQL = W(
    *[f"z_{k} AS ({_rtc_sql(v)})" for k, v in _SRC.items()],
    *[f"r_{m} AS ({_pearson_sql('z_hum', 'z_' + m)})" for m in METHODS],
) + (
    "SELECT d.doc_id, " + ", ".join(f"r_{m}.r AS {m}_corr" for m in METHODS) + " FROM documents d "
    + " ".join(f"LEFT JOIN r_{m} ON r_{m}.doc_id = d.doc_id" for m in METHODS)
)


def _prefixed(df, prefix, cats):
    return df.select("doc_id", *[F.col(c).alias(f"{prefix}_{c}") for c in cats])


def _correlations(spark, sf):
    """Per document: Pearson r between the lexicon counts and each method, all scaled rows-then-columns."""
    lex, con, cats_df = fx.fx_lexicon(spark), fx.fx_contractions(spark), fx.fx_categories(spark)
    docs = fx.fx_doc_texts(spark, sf)  # texts and vectors apart: texts pass no shuffle
    vecs = fx.fx_doc_vectors(spark, sf).select("doc_id", "embedding")
    cent = reference_centroids(docs, lex, vectors=vecs).persist(StorageLevel.MEMORY_AND_DISK)  # one model, two metrics
    counts = L.lexicon_counts_wide(docs, lex, LEX_CATS, contractions=con).persist(StorageLevel.MEMORY_AND_DISK)
    tables = {
        "hum": counts,
        # flags are the counts' indicator: derived from the same table, not re-tokenised
        "flags": counts.select("doc_id", *[(F.col(c) > 0).cast("long").alias(c) for c in LEX_CATS]),
        "soft": L.soft_lexicon_counts_wide(docs, lex, cats_df, fx.fx_word_vectors(spark, sf), contractions=con),
        "embed": concept_matrix(vecs, cent, cats_df),
        "embed_l2": concept_matrix(vecs, cent, cats_df, metric="l2"),
    }
    # rows standardised per method, all methods side by side, then every column fitted in one aggregate
    rows = {k: _prefixed(S.row_standardize(t.select("doc_id", *LEX_CATS), LEX_CATS), k, LEX_CATS) for k, t in tables.items()}
    wide = reduce(lambda a, b: a.join(b, "doc_id", "left"), [docs.select("doc_id")] + list(rows.values()))
    cols = [f"{k}_{c}" for k in tables for c in LEX_CATS]
    joined = S.column_standardize(wide, cols)
    hum = [f"hum_{c}" for c in LEX_CATS]
    return joined.select(
        "doc_id", *[F.round(row_pearson(hum, [f"{m}_{c}" for c in LEX_CATS]), 3).alias(f"{m}_corr") for m in METHODS]
    )


@query("vector_correlation", CORR_SQL)
def q_vector_correlation(spark, sf):
    return _correlations(spark, sf)


@query(
    "stack_batches",
    " UNION ALL ".join(f"SELECT doc_id, '{m}' AS method, {m}_corr AS r FROM ({CORR_SQL})" for m in METHODS),
)
def q_stack_batches(spark, sf):
    return stack_columns(_correlations(spark, sf), ["doc_id"], {m: f"{m}_corr" for m in METHODS}, "method", "r")


@query(
    "column_summary",
    " UNION ALL ".join(
        f"SELECT '{m}' AS method, {sql_r6(f'avg({m}_corr)')} AS mean_r, {sql_r6(f'median({m}_corr)')} AS median_r FROM ({CORR_SQL})"
        for m in METHODS
    ),
)
def q_column_summary(spark, sf):
    long = stack_columns(_correlations(spark, sf), ["doc_id"], {m: f"{m}_corr" for m in METHODS}, "method", "r")
    return column_summary(long, "method", "r").select("method", r6("mean", "mean_r"), r6("median", "median_r"))


PAIRS = [(a, b) for i, a in enumerate(METHODS) for b in METHODS[i + 1:]]


def _ttest_sql(a: str, b: str, src: str, raw: bool = False) -> str:
    d = f"({a}_corr - {b}_corr)"
    sql_r6 = (lambda e: f"CAST({e} AS DOUBLE)") if raw else globals()["sql_r6"]
    return (
        f"SELECT '{a}' AS a, '{b}' AS b, CAST(count({d}) AS BIGINT) AS n, {sql_r6(f'avg({d})')} AS mean_diff, "
        f"{sql_r6(f'stddev_samp({d})')} AS sd_diff, {sql_r6(f'avg({d}) / (stddev_samp({d}) / sqrt(count({d})))')} AS t, "
        f"{sql_r6(f'count({d}) - 1')} AS df FROM ({src})"
    )


def _ttests(spark, sf, with_p: bool):
    corr = _correlations(spark, sf)
    # all pairs side by side, one grouped aggregate
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_corr").alias("x"), F.col(f"{b}_corr").alias("y")) for a, b in PAIRS])
    out = paired_t_test(corr.select(F.inline(pairs)), "x", "y", ["a", "b"], with_p=with_p)
    cols = ["mean_diff", "sd_diff", "t", "df"] + (["p_two_sided", "p_greater"] if with_p else [])
    return out.select("a", "b", "n", *[r6(c, c) for c in cols])


@query("paired_t_test", " UNION ALL ".join(_ttest_sql(a, b, CORR_SQL) for a, b in PAIRS))
def q_paired_t_test(spark, sf):
    return _ttests(spark, sf, with_p=False)


# P(|T| > |t|) = 1 - 2 c * integral of cos(u)^(df - 1) from 0 to atan(|t| / sqrt(df)), by Simpson's rule with 2,000 steps
_P_STEPS = 2000


def _pvalue_sql(src: str) -> str:
    f = f"power(cos(atan(abs(t) / sqrt(df)) * i / {_P_STEPS}), df - 1) * (CASE WHEN i IN (0, {_P_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    c = "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi())"
    return (
        f"WITH tt AS ({src}), p AS (SELECT a, b, n, mean_diff, sd_diff, t, df, 1 - 2 * {c} * (SELECT sum({f}) FROM range({_P_STEPS + 1}) r(i)) "
        f"* atan(abs(t) / sqrt(df)) / {_P_STEPS} / 3 AS two FROM tt) SELECT a, b, n, " + ", ".join(f"{sql_r6(x)} AS {x}" for x in ("mean_diff", "sd_diff", "t", "df"))
        + f", {sql_r6('two')} AS p_two_sided, {sql_r6('CASE WHEN t > 0 THEN two / 2 ELSE 1 - two / 2 END')} AS p_greater FROM p"
    )


@query("paired_t_pvalue", _pvalue_sql(" UNION ALL ".join(_ttest_sql(a, b, CORR_SQL, raw=True) for a, b in PAIRS)))
def q_paired_t_pvalue(spark, sf):
    return _ttests(spark, sf, with_p=True)


_ICC_SQL = W(
    "x AS (SELECT d.lang AS batch, u.doc_id AS object, u.rater, CAST(u.score AS DOUBLE) AS x FROM "
    "(UNPIVOT labels ON quality, toxic INTO NAME rater VALUE score) u JOIN documents d ON d.doc_id = u.doc_id "
    "WHERE u.score IS NOT NULL)",
    "k AS (SELECT batch, count(DISTINCT rater) AS k FROM x GROUP BY batch)",
    "po AS (SELECT batch, object, count(*) AS m, avg(x) AS rm FROM x GROUP BY batch, object)",
    "co AS (SELECT po.batch, po.object, po.rm FROM po JOIN k ON k.batch = po.batch WHERE po.m = k.k)",
    "xc AS (SELECT x.batch, x.object, x.rater, x.x FROM x JOIN co ON co.batch = x.batch AND co.object = x.object)",
    "g AS (SELECT batch, avg(x) AS gm, count(DISTINCT object) AS n, count(DISTINCT rater) AS k FROM xc GROUP BY batch)",
    "sr AS (SELECT co.batch, sum((rm - gm) ^ 2) AS sr FROM co JOIN g ON g.batch = co.batch GROUP BY co.batch)",
    "cm AS (SELECT batch, rater, avg(x) AS cmean FROM xc GROUP BY batch, rater)",
    "sc AS (SELECT cm.batch, sum((cmean - gm) ^ 2) AS sc FROM cm JOIN g ON g.batch = cm.batch GROUP BY cm.batch)",
    "st AS (SELECT xc.batch, sum((x - gm) ^ 2) AS st FROM xc JOIN g ON g.batch = xc.batch GROUP BY xc.batch)",
    "ms AS (SELECT g.batch, g.n, g.k, g.k * sr.sr / (g.n - 1) AS msr, g.n * sc.sc / (g.k - 1) AS msc, "
    "(st.st - g.k * sr.sr - g.n * sc.sc) / ((g.n - 1) * (g.k - 1)) AS mse FROM g JOIN sr ON sr.batch = g.batch "
    "JOIN sc ON sc.batch = g.batch JOIN st ON st.batch = g.batch)",
    "ic AS (SELECT *, (msr - mse) / (msr + (msc - mse) / n) AS icc FROM ms)",
) + (
    "SELECT batch, CAST(n AS BIGINT) AS n_objects, CAST(k AS BIGINT) AS n_raters, " + sql_r6("msr") + " AS msr, "
    + sql_r6("msc") + " AS msc, " + sql_r6("mse") + " AS mse, " + sql_r6("icc") + " AS icc, "
    + sql_r6("(SELECT avg(icc) FROM ic)") + " AS mean_icc FROM ic"
)


@query("icc_average", _ICC_SQL)
def q_icc_average(spark, sf):
    long = fx.fx_survey_long(spark, sf).join(
        fx.table(spark, sf, "documents").select(F.col("doc_id").alias("object"), F.col("lang").alias("batch")), "object"
    )
    per = icc_average(long, "object", "rater", "score", ["batch"])
    return per.select("batch", "n_objects", "n_raters", r6("msr", "msr"), r6("msc", "msc"), r6("mse", "mse"),
                      r6("icc", "icc"), r6(per.agg(F.avg("icc")).scalar(), "mean_icc"))


@query("icc_interval")
def q_icc_interval(spark, sf):
    """The ICC of every batch with its 95 % limits, and the means of all three over the batches."""
    long = fx.fx_survey_long(spark, sf).join(
        fx.table(spark, sf, "documents").select(F.col("doc_id").alias("object"), F.col("lang").alias("batch")), "object"
    )
    per = icc_interval(long, "object", "rater", "score", ["batch"])
    means = per.agg(F.avg("icc").alias("icc"), F.avg("lower").alias("lower"), F.avg("upper").alias("upper"))
    cols = ["icc", "lower", "upper"]
    return per.select("batch", "n_objects", "n_raters", *[r6(c, c) for c in cols], *[r6(means.select(c).scalar(), f"mean_{c}") for c in cols])


# ---------------------------------------------------------------- word senses

KW = fx.SENSE_KEYWORD
SENSES = ["sense_1", "sense_2"]

_SENSE_CTES = (
    fx.WORD_VECTORS_SQL,
    f"kd AS (SELECT doc_id, lower(text) AS text FROM documents WHERE contains(lower(text), '{KW}') "
    f"UNION ALL SELECT CAST(NULL AS BIGINT), '{KW}')",
    fx.tokens_sql("kt", "text", "kd"),
    f"kp AS (SELECT doc_id, min(pos) AS k FROM kt WHERE contains(token, '{KW}') GROUP BY doc_id)",
    "ctx AS (SELECT kt.doc_id, kt.token FROM kt JOIN kp ON kt.doc_id IS NOT DISTINCT FROM kp.doc_id "
    "WHERE kt.pos BETWEEN kp.k - 2 AND kp.k + 2)",
    "cvl AS (SELECT doc_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT ctx.doc_id, w.embedding, "
    "unnest(generate_series(1, len(w.embedding))) AS i FROM ctx JOIN fx_word_vectors w ON w.token = ctx.token) GROUP BY doc_id, i)",
    "cv AS (SELECT doc_id, list(x ORDER BY i) AS v FROM cvl GROUP BY doc_id)",
    "sw AS (SELECT CASE WHEN rank <= 12 THEN 'sense_1' ELSE 'sense_2' END AS sense, token AS word, "
    "CAST(embedding AS DOUBLE[]) AS e FROM fx_word_vectors WHERE rank BETWEEN 10 AND 15)",
    "ss AS (SELECT cv.doc_id, avg(CASE WHEN sw.sense = 'sense_1' THEN list_cosine_similarity(cv.v, sw.e) END) AS sense_1, "
    "avg(CASE WHEN sw.sense = 'sense_2' THEN list_cosine_similarity(cv.v, sw.e) END) AS sense_2 FROM cv CROSS JOIN sw "
    "GROUP BY cv.doc_id)",
    "tr AS (SELECT doc_id, sense_1, sense_2, 'sense_' || CAST(doc_id % 2 + 1 AS VARCHAR) AS true_sense FROM ss "
    "WHERE doc_id IS NOT NULL)",
)
_SENSE_SQL = W(fx.TOKENS_SQL, *_SENSE_CTES)


def fx_senses(wv):
    return wv.filter(F.col("rank").between(10, 15)).select(
        F.when(F.col("rank") <= 12, F.lit("sense_1")).otherwise(F.lit("sense_2")).alias("sense"), F.col("token").alias("word")
    )


def _sense_sims(spark, sf):
    wv = fx.fx_word_vectors(spark, sf)
    docs = keyword_append(keyword_filter(fx.documents(spark, sf), "text", KW), "text", KW, "doc_id")
    ctx = N.keyword_context_vectors(docs, wv, KW, 2)
    return N.sense_similarity(ctx, fx_senses(wv), wv, SENSES)


def _truth(spark, sf):
    docs = fx.documents(spark, sf)
    return docs.select("doc_id", F.concat(F.lit("sense_"), (F.pmod("doc_id", F.lit(2)) + 1).cast("string")).alias("true_sense"))


@query(
    "sense_similarity",
    _SENSE_SQL + f"SELECT doc_id, {sql_r6('sense_1')} AS sense_1, {sql_r6('sense_2')} AS sense_2, "
    f"{sql_r6('sense_1 - sense_2')} AS diff FROM ss",
)
def q_sense_similarity(spark, sf):
    s = _sense_sims(spark, sf)
    return s.select("doc_id", r6("sense_1", "sense_1"), r6("sense_2", "sense_2"), r6("diff", "diff"))


@query(
    "sense_group_means",
    _SENSE_SQL + "SELECT true_sense, " + sql_r6("avg(sense_1)") + " AS mean_sense_1, " + sql_r6("avg(sense_2)")
    + " AS mean_sense_2, CAST(count(*) AS BIGINT) AS n, " + sql_r6("avg(sense_1 - sense_2)") + " AS mean_diff, "
    + sql_r6("stddev_samp(sense_1 - sense_2)") + " AS sd_diff, "
    + sql_r6("avg(sense_1 - sense_2) / (stddev_samp(sense_1 - sense_2) / sqrt(count(*)))") + " AS t, "
    + sql_r6("count(*) - 1") + " AS df FROM tr GROUP BY true_sense",
)
def q_sense_group_means(spark, sf):
    g = N.sense_group_means(_sense_sims(spark, sf), _truth(spark, sf), "sense_1", "sense_2")
    return g.select("true_sense", r6("mean_sense_1", "mean_sense_1"), r6("mean_sense_2", "mean_sense_2"), "n",
                    *[r6(c, c) for c in ("mean_diff", "sd_diff", "t", "df")])


_SAME = "CASE WHEN true_sense = 'sense_1' THEN sense_1 ELSE sense_2 END"
_OPP = "CASE WHEN true_sense = 'sense_1' THEN sense_2 ELSE sense_1 END"


@query(
    "same_vs_opposite",
    _SENSE_SQL + f"SELECT CAST(count(*) AS BIGINT) AS n, {sql_r6(f'avg({_SAME} - {_OPP})')} AS mean_diff, "
    f"{sql_r6(f'stddev_samp({_SAME} - {_OPP})')} AS sd_diff, "
    f"{sql_r6(f'avg({_SAME} - {_OPP}) / (stddev_samp({_SAME} - {_OPP}) / sqrt(count(*)))')} AS t, "
    f"{sql_r6('count(*) - 1')} AS df, {sql_r6(f'avg({_SAME})')} AS same_mean, {sql_r6(f'avg({_OPP})')} AS opposite_mean, "
    f"{sql_r6(f'avg({_SAME}) / avg({_OPP})')} AS ratio FROM tr",
)
def q_same_vs_opposite(spark, sf):
    s = N.same_vs_opposite(_sense_sims(spark, sf), _truth(spark, sf), SENSES)
    return s.select("n", *[r6(c, c) for c in ("mean_diff", "sd_diff", "t", "df", "same_mean", "opposite_mean", "ratio")])


_REP_SQL = (
    EMBED_BASE_SQL + ",\n" + ",\n".join(_SENSE_CTES)
    + ",\nvecs AS (SELECT COALESCE(CAST(doc_id AS VARCHAR), 'keyword') AS id, v FROM cv "
    "UNION ALL SELECT word, e FROM sw),\n"
    "corp AS (SELECT d.doc_id, k.category, coalesce(list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), cl.c), 0) AS s "
    "FROM fx_doc_vectors d CROSS JOIN fx_categories k LEFT JOIN cl ON cl.category = k.category),\n"
    "fit AS (SELECT category, avg(s) AS m, stddev_pop(s) AS sd FROM corp GROUP BY category),\n"
    "rep AS (SELECT vecs.id, k.category, (coalesce(list_cosine_similarity(vecs.v, cl.c), 0) - fit.m) / "
    "CASE WHEN fit.sd = 0 THEN 1 ELSE fit.sd END AS c FROM vecs CROSS JOIN fx_categories k "
    "LEFT JOIN cl ON cl.category = k.category JOIN fit ON fit.category = k.category),\n"
    "rz AS (SELECT id, category, (c - avg(c) OVER (PARTITION BY id)) / CASE WHEN stddev_pop(c) OVER (PARTITION BY id) = 0 "
    "THEN 1 ELSE stddev_pop(c) OVER (PARTITION BY id) END AS z FROM rep)\n"
    "SELECT id, " + ", ".join(f"{sql_r6(f'max(CASE WHEN category = {chr(39)}{c}{chr(39)} THEN z END)')} AS {c}" for c in LEX_CATS)
    + " FROM rz GROUP BY id"
)


@query("sense_representation", _REP_SQL)
def q_sense_representation(spark, sf):
    corpus = fx.fx_doc_vectors(spark, sf)
    lex, cats_df = fx.fx_lexicon(spark), fx.fx_categories(spark)
    cent = reference_centroids(corpus, lex)
    wv = fx.fx_word_vectors(spark, sf)
    docs = keyword_append(keyword_filter(fx.documents(spark, sf), "text", KW), "text", KW, "doc_id")
    ctx = N.keyword_context_vectors(docs, wv, KW, 2).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("keyword")).alias("id"), "embedding"
    )
    words = fx_senses(wv).join(wv.select(F.col("token").alias("word"), "embedding"), "word").select(
        F.col("word").alias("id"), "embedding"
    )
    corpus_matrix = concept_matrix(corpus.select("doc_id", "embedding"), cent, cats_df)
    rep = N.sense_representation(ctx.unionByName(words), cent, cats_df, LEX_CATS, corpus_matrix)
    return rep.select("id", *[r6(c, c) for c in LEX_CATS])


# the same analysis in concept space: contexts and reference words as scaled category similarities
_CONCEPT_SENSE_SQL = (
    _REP_SQL[:_REP_SQL.index("SELECT id, " + sql_r6("max(CASE WHEN category = '" + LEX_CATS[0] + "' THEN z END)"))].rstrip("\n")
    + ",\nrv AS (SELECT id, list(z ORDER BY category) AS v FROM rz GROUP BY id),\n"
    "cw AS (SELECT c.doc_id, sw.sense, list_cosine_similarity(rc.v, rw.v) AS s FROM cv c "
    "JOIN rv rc ON rc.id = COALESCE(CAST(c.doc_id AS VARCHAR), 'keyword') CROSS JOIN sw JOIN rv rw ON rw.id = sw.word),\n"
    "css AS (SELECT doc_id, avg(CASE WHEN sense = 'sense_1' THEN s END) AS sense_1, avg(CASE WHEN sense = 'sense_2' THEN s END) AS sense_2 "
    "FROM cw GROUP BY doc_id),\n"
    "ctr AS (SELECT doc_id, sense_1, sense_2, 'sense_' || CAST(doc_id % 2 + 1 AS VARCHAR) AS true_sense FROM css WHERE doc_id IS NOT NULL)\n"
)


def _concept_sense_sims(spark, sf):
    corpus = fx.fx_doc_vectors(spark, sf)
    lex, cats_df = fx.fx_lexicon(spark), fx.fx_categories(spark)
    cent = reference_centroids(corpus, lex)
    wv = fx.fx_word_vectors(spark, sf)
    docs = keyword_append(keyword_filter(fx.documents(spark, sf), "text", KW), "text", KW, "doc_id")
    senses = fx_senses(wv)
    words = wv.join(senses.select(F.col("word").alias("token")), "token", "left_semi").select("token", "embedding")
    ctx, reps = N.concept_space(N.keyword_context_vectors(docs, wv, KW, 2), words, cent, cats_df, LEX_CATS,
                                concept_matrix(corpus.select("doc_id", "embedding"), cent, cats_df))
    return N.sense_similarity(ctx, senses, reps, SENSES)


@query(
    "sense_concept_similarity",
    _CONCEPT_SENSE_SQL + f"SELECT doc_id, {sql_r6('sense_1')} AS sense_1, {sql_r6('sense_2')} AS sense_2, {sql_r6('sense_1 - sense_2')} AS diff FROM css",
)
def q_sense_concept_similarity(spark, sf):
    s = _concept_sense_sims(spark, sf)
    return s.select("doc_id", r6("sense_1", "sense_1"), r6("sense_2", "sense_2"), r6("diff", "diff"))


@query(
    "sense_concept_same_vs_opposite",
    _CONCEPT_SENSE_SQL + f"SELECT CAST(count(*) AS BIGINT) AS n, {sql_r6(f'avg({_SAME})')} AS same_mean, {sql_r6(f'avg({_OPP})')} AS opposite_mean, "
    f"{sql_r6(f'avg({_SAME}) / avg({_OPP})')} AS ratio FROM ctr",
)
def q_sense_concept_same_vs_opposite(spark, sf):
    s = N.same_vs_opposite(_concept_sense_sims(spark, sf), _truth(spark, sf), SENSES)
    return s.select("n", *[r6(c, c) for c in ("same_mean", "opposite_mean", "ratio")])


# ---------------------------------------------------------------- human agreement, end to end

_SURVEY_LIST = ", ".join(f"'{c}'" for c in fx.SURVEY_CATEGORIES)
_AGREEMENT_METHODS = {
    "counts": f"(SELECT doc_id, category, CAST(n AS DOUBLE) AS v FROM ({_counts_sql(EXPANDED_TOKENS)}) WHERE category IN ({_SURVEY_LIST}))",
    "embed": f"(SELECT doc_id, category, s AS v FROM ({embed_sims_sql('cosine')}) WHERE category IN ({_SURVEY_LIST}))",
}
_AGREEMENT_SQL = (
    SURVEY.rstrip("\n") + ",\n"
    "rated AS (" + _MEAN_RATING + "),\n"
    "texts AS (SELECT o.object, d.text FROM (SELECT DISTINCT object FROM rated) o JOIN documents d ON d.doc_id = CAST(split_part(o.object, '_', 1) AS BIGINT)),\n"
    "shared AS (SELECT text, min(object) AS object FROM texts GROUP BY text),\n"
    "linked AS (SELECT s.object, min(d.doc_id) AS doc_id FROM shared s JOIN documents d ON d.text = s.text GROUP BY s.object),\n"
    "z_h0 AS (" + _rtc_sql("(SELECT object AS doc_id, category, rating AS v FROM rated)") + "),\n"
    "z_h AS (SELECT l.doc_id, z.category, z.z FROM z_h0 z JOIN linked l ON l.object = z.doc_id),\n"
    + ",\n".join(f"z_{m} AS ({_rtc_sql(src)}),\nr_{m} AS ({_pearson_sql('z_h', 'z_' + m)})" for m, src in _AGREEMENT_METHODS.items())
    + "\nSELECT l.object, l.doc_id, " + ", ".join(f"r_{m}.r AS {m}_corr" for m in _AGREEMENT_METHODS) + " FROM linked l "
    + " ".join(f"LEFT JOIN r_{m} ON r_{m}.doc_id = l.doc_id" for m in _AGREEMENT_METHODS)
)


@query("human_agreement", _AGREEMENT_SQL)
def q_human_agreement(spark, sf):
    """Survey answers to per-method correlations: the object of turn t is rated, document t is its text."""
    cats = fx.SURVEY_CATEGORIES
    ratings = U.rating_matrix(U.mean_rating(U.assign_category(_long_all(spark, sf), cats)), cats)
    docs = fx.documents(spark, sf)
    turn = F.split("object", "_")[0].cast("long")
    texts = ratings.select("object", turn.alias("doc_id")).join(docs, "doc_id").select("object", "text")
    corpus, lex = fx.fx_doc_vectors(spark, sf), fx.fx_lexicon(spark)
    counts = L.lexicon_counts_wide(docs, lex, LEX_CATS, contractions=fx.fx_contractions(spark))
    sims = concept_matrix(corpus.select("doc_id", "embedding"), reference_centroids(corpus, lex), fx.fx_categories(spark))
    methods = {"counts": counts.select("doc_id", *cats), "embed": sims.select("doc_id", *cats)}
    return U.human_agreement(ratings, texts, docs, methods, cats)
