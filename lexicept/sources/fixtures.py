"""Derived test inputs, each written once as a DataFrame and once as SQL.

All of them are computed from the driver-provided tables, so their size
grows with the scale factor. The SQL text is used by the DuckDB oracle SQL of
the registered queries (``plans/q_*.py``); keep both forms in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number
from ..functions.sizing import maybe_broadcast
from ..operators.text import TOKEN_PATTERN, tokenize
from ..session import shared_dir
from .readers import balanced

# The test lexicon (category, ord, pattern); a trailing '*' marks a prefix.
LEXICON_ROWS = [
    ("article", 0, "the"),
    ("article", 0, "a"),
    ("conj", 1, "and"),
    ("prep", 2, "of"),
    ("prep", 2, "in*"),
    ("th_words", 3, "th*"),
    ("conj", 1, "en*"),
    ("absent", 4, "zzzqq"),
]

# Contraction table (contraction, expansion), lower case.
CONTRACTION_ROWS = [
    ("can't", "cannot"),
    ("won't", "will not"),
    ("don't", "do not"),
    ("doesn't", "does not"),
    ("isn't", "is not"),
    ("it's", "it is"),
    ("i'm", "i am"),
    ("you're", "you are"),
    ("we're", "we are"),
    ("they're", "they are"),
    ("i've", "i have"),
    ("i'll", "i will"),
    ("let's", "let us"),
    ("that's", "that is"),
]

SUBSET_MIN_ORD = 2
SENSE_KEYWORD = "that"


# Tables whose rows carry long texts or vectors: per-row work dominates, so small scans are spread out.
_SPREAD = {"documents", "conversations", "pages", "embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return balanced(df) if spread and name in _SPREAD else df


def fx_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON_ROWS, "category string, ord int, pattern string")


def fx_categories(spark: SparkSession) -> DataFrame:
    return fx_lexicon(spark).select("category", "ord").distinct()


def fx_contractions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTRACTION_ROWS, "contraction string, expansion string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def fx_word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus tokens ranked by (count desc, token asc); rank r <-> embeddings.vec_id = r - 1.

    The inner join with ``embeddings`` bounds the vocabulary by the vector table.
    The rank is computed over the distinct vocabulary (after a partial count)
    with a range-partitioned global row number, never in a single task.
    """
    toks = tokenize(documents(spark, sf_dir), "doc_id", "text")
    counts = toks.groupBy("token").agg(F.count("*").alias("n"))
    ranked = global_row_number(counts, [F.desc("n"), F.asc("token")], "rank")
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = ranked.join(emb, F.col("rank") - 1 == F.col("vec_id")).select("token", "rank", "vec_id", "embedding")
    # reused by several operators of one query: materialise once in the shared checkpoint folder
    shared_dir(spark)
    return out.checkpoint(eager=True)


def fx_doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined to embeddings on vec_id = doc_id mod (number of vectors).

    The modulus is a scalar subquery (evaluated once), not a cross join.
    """
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return _vector_keyed(spark, sf_dir).join(emb, "vec_id").select("doc_id", "text", "vec_id", "embedding")


def fx_doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of ``fx_doc_vectors``, the same rows: texts stay where they lie and meet the broadcast vector ids alone."""
    ids = table(spark, sf_dir, "embeddings", spread=False).select("vec_id")
    return _vector_keyed(spark, sf_dir).join(maybe_broadcast(ids), "vec_id").select("doc_id", "text")


def _vector_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_vec = table(spark, sf_dir, "embeddings", spread=False).agg(F.count("*")).scalar()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("vec_id", F.pmod(F.col("doc_id"), n_vec))


def fx_centroid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"),
        F.col("vec_id").alias("key"),
        "embedding",
        "label",
    )


def fx_point_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category list for the embedding points, ordered by label, plus one empty category."""
    emb = table(spark, sf_dir, "embeddings")
    cats = emb.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), F.col("label").alias("ord")).distinct()
    extra = spark.createDataFrame([("c_empty", 1000)], "category string, ord int")
    return cats.unionByName(extra)


# ---------------------------------------------------------------- SQL forms

LEXICON_SQL = "fx_lexicon AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {o}, '{p}')" for c, o, p in LEXICON_ROWS
) + ") t(category, ord, pattern))"

CATEGORIES_SQL = "fx_categories AS (SELECT DISTINCT category, ord FROM fx_lexicon)"

CONTRACTIONS_SQL = "fx_contractions AS (SELECT * FROM (VALUES " + ", ".join(
    "('" + c.replace("'", "''") + "', '" + e + "')" for c, e in CONTRACTION_ROWS
) + ") t(contraction, expansion))"

def tokens_sql(name: str = "fx_tokens", text_expr: str = "lower(text)", source: str = "documents",
               id_col: str = "doc_id") -> str:
    """CTE of (id, pos, token) over ``source``; ``text_expr`` prepares the text."""
    return (
        f"{name} AS (SELECT {id_col}, CAST(i - 1 AS BIGINT) AS pos, toks[i] AS token FROM ("
        f"SELECT {id_col}, toks, unnest(generate_series(1, len(toks))) AS i FROM ("
        f"SELECT {id_col}, regexp_extract_all({text_expr}, '{TOKEN_PATTERN}') AS toks FROM {source})))"
    )


def expand_sql(expr: str) -> str:
    """SQL form of ``expand_contractions_expr`` (replace every whole-word contraction)."""
    for src, dst in CONTRACTION_ROWS:
        expr = f"regexp_replace({expr}, '\\b{src.replace(chr(39), chr(39) * 2)}\\b', '{dst}', 'g')"
    return expr


TOKENS_SQL = tokens_sql()

WORD_VECTORS_SQL = (
    "fx_word_vectors AS (SELECT r.token, r.rank, e.vec_id, e.embedding FROM ("
    "SELECT token, n, row_number() OVER (ORDER BY n DESC, token ASC) AS rank FROM ("
    "SELECT token, count(*) AS n FROM fx_tokens GROUP BY token) c) r "
    "JOIN embeddings e ON r.rank - 1 = e.vec_id)"
)

DOC_VECTORS_SQL = (
    "fx_doc_vectors AS (SELECT d.doc_id, d.text, e.vec_id, e.embedding FROM documents d "
    "JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings))"
)

CENTROID_POINTS_SQL = (
    "fx_centroid_points AS (SELECT 'c' || CAST(label AS VARCHAR) AS category, vec_id AS key, embedding, label "
    "FROM embeddings)"
)

POINT_CATEGORIES_SQL = (
    "fx_point_categories AS (SELECT DISTINCT 'c' || CAST(label AS VARCHAR) AS category, label AS ord FROM embeddings "
    "UNION ALL SELECT 'c_empty', 1000)"
)


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------- survey inputs

# The survey's category batch list and its question grid.
SURVEY_CATEGORIES = ["article", "conj", "prep"]
SURVEY_TURNS = list(range(1, 11))
SURVEY_QUESTIONS = [f"{t}_QS1C1_{j}" for t in SURVEY_TURNS for j in range(1, len(SURVEY_CATEGORIES) + 1)] + ["21_QS1C1_1"]


def _answer(n):
    return (
        F.when(n == 0, F.lit("Not expressed"))
        .when(n <= 5, F.lit("Potentially expressed"))
        .otherwise(F.lit("Most likely expressed"))
    )


def fx_survey_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long answers derived from ``conversations``: respondent = conversation, one question per
    (turn, category), answered from the turn's lexicon count; plus one attention item."""
    from ..operators.lexicon import lexicon_counts_wide

    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    counts = lexicon_counts_wide(conv, fx_lexicon(spark), SURVEY_CATEGORIES, ["conv_id", "turn"])
    qs = counts.unpivot(["conv_id", "turn"], SURVEY_CATEGORIES, "category", "n")
    pos = F.array_position(F.array(*[F.lit(c) for c in SURVEY_CATEGORIES]), F.col("category"))
    answers = qs.select(
        "conv_id",
        F.concat((F.col("turn") + 1).cast("string"), F.lit("_QS1C1_"), pos.cast("string")).alias("question"),
        _answer(F.col("n")).alias("answer"),
    )
    attention = conv.filter(F.col("turn") == 0).select(
        "conv_id",
        F.lit("21_QS1C1_1").alias("question"),
        F.when(F.col("role") == "user", F.lit("Not expressed")).otherwise(F.lit("Potentially expressed")).alias("answer"),
    )
    return answers.unionByName(attention)


def fx_survey_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide survey export: QProlificID, SentenceBatch, CategoryBatch and one column per question."""
    conv = table(spark, sf_dir, "conversations")
    batches = conv.groupBy("conv_id").agg(
        F.count("*").cast("string").alias("SentenceBatch"),
        F.min_by("role", "turn").alias("CategoryBatch"),
    )
    wide = fx_survey_answers(spark, sf_dir).groupBy("conv_id").pivot("question", SURVEY_QUESTIONS).agg(F.first("answer"))
    return batches.join(wide, "conv_id").select(
        F.concat(F.lit("R"), F.col("conv_id").cast("string")).alias("QProlificID"), "SentenceBatch", "CategoryBatch",
        *[F.col(f"`{q}`") for q in SURVEY_QUESTIONS],
    )


def fx_survey_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` unpivoted: rater in {quality, toxic}, object = doc_id, score."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long"), F.col("toxic").cast("long"))
    return lab.unpivot(["doc_id"], ["quality", "toxic"], "rater", "score").withColumnRenamed("doc_id", "object")


def _answer_sql(n: str) -> str:
    return (f"CASE WHEN {n} = 0 THEN 'Not expressed' WHEN {n} <= 5 THEN 'Potentially expressed' "
            "ELSE 'Most likely expressed' END")


SURVEY_ANSWERS_SQL = (
    tokens_sql("ct", "lower(text)", "conversations", "conv_id, turn") + ",\n"
    "ch AS (SELECT DISTINCT t.conv_id, t.turn, t.pos, l.category FROM ct t JOIN fx_lexicon l ON "
    "(CASE WHEN l.pattern LIKE '%*' THEN starts_with(t.token, rtrim(l.pattern, '*')) ELSE t.token = l.pattern END)),\n"
    "sc AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {i + 1})" for i, c in enumerate(SURVEY_CATEGORIES))
    + ") t(category, j)),\n"
    "cq AS (SELECT c.conv_id, c.turn, sc.j, count(ch.pos) AS n FROM conversations c CROSS JOIN sc "
    "LEFT JOIN ch ON ch.conv_id = c.conv_id AND ch.turn = c.turn AND ch.category = sc.category GROUP BY c.conv_id, c.turn, sc.j),\n"
    "answers AS (SELECT conv_id, CAST(turn + 1 AS VARCHAR) || '_QS1C1_' || CAST(j AS VARCHAR) AS question, "
    + _answer_sql("n") + " AS answer FROM cq "
    "UNION ALL SELECT conv_id, '21_QS1C1_1', CASE WHEN role = 'user' THEN 'Not expressed' ELSE 'Potentially expressed' END "
    "FROM conversations WHERE turn = 0),\n"
    "batches AS (SELECT conv_id, CAST(count(*) AS VARCHAR) AS SentenceBatch, arg_min(role, turn) AS CategoryBatch "
    "FROM conversations GROUP BY conv_id),\n"
    "sl AS (SELECT 'R' || CAST(a.conv_id AS VARCHAR) AS QProlificID, b.SentenceBatch, b.CategoryBatch, a.question, a.answer "
    "FROM answers a JOIN batches b ON b.conv_id = a.conv_id)"
)
