"""Survey reshaping and human-agreement preparation.

Wide survey exports (one row per respondent, one column per question) are
turned long with ``unpivot`` (map-side), recoded through a small code table,
averaged per (object, category) and pivoted back with a fixed column list.
Column pruning by non-null counts is one aggregate pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import row_pearson
from .scaling import row_then_column

# Column names of the survey export format.
RATER_COL = "QProlificID"
SENTENCE_BATCH_COL = "SentenceBatch"
CATEGORY_BATCH_COL = "CategoryBatch"

# Answer texts and their ordinal codes.
ANSWER_CODES = [("Not expressed", 0), ("Potentially expressed", 1), ("Most likely expressed", 2)]
ANSWER_CODES_SIGNED = [("Not expressed", -1), ("Potentially expressed", 0), ("Most likely expressed", 1)]
ATTENTION_PREFIX = "21_"
QUESTION_MARK = "_QS"


def drop_sparse_columns(df: DataFrame, thresh: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Keep columns with at least ``thresh`` non-null values (thresh=1: drop all-null columns)."""
    keep = keep or []
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in keep or counts[c] >= thresh])


def batch_filter(df: DataFrame, sentence_batch, category_batch, sb_col: str = SENTENCE_BATCH_COL,
                 cb_col: str = CATEGORY_BATCH_COL) -> DataFrame:
    """Rows of one (sentence batch, category batch), compared as strings."""
    return df.filter((F.col(sb_col).cast("string") == str(sentence_batch)) & (F.col(cb_col).cast("string") == str(category_batch)))


def question_columns(columns: list[str]) -> list[str]:
    """Question columns: contain '_QS' and are not attention items ('21_...')."""
    return [c for c in columns if QUESTION_MARK in c and not c.startswith(ATTENTION_PREFIX)]


def attention_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.startswith(ATTENTION_PREFIX)]


def recode(answer, codes=ANSWER_CODES) -> Column:
    """Answer text -> ordinal code (unknown text -> null)."""
    a = F.col(answer) if isinstance(answer, str) else answer
    expr = None
    for text, code in codes:
        expr = (F.when(a == F.lit(text), F.lit(code)) if expr is None else expr.when(a == F.lit(text), F.lit(code)))
    return expr.otherwise(F.lit(None)).cast("long")


def survey_to_long(wide: DataFrame, rater_col: str = RATER_COL, codes=ANSWER_CODES) -> DataFrame:
    """(Rater, Object, Score) over the question columns; null scores dropped."""
    qcols = question_columns(wide.columns)
    if not qcols:  # nothing answered in this selection: empty result, same schema
        return wide.select(F.col(rater_col).alias("Rater"), F.lit(None).cast("string").alias("Object"),
                           F.lit(None).cast("long").alias("Score")).filter(F.lit(False))
    long = wide.select(rater_col, *[F.col(f"`{c}`") for c in qcols]).unpivot([rater_col], qcols, "Object", "answer")
    return long.select(F.col(rater_col).alias("Rater"), "Object", recode("answer", codes).alias("Score")).na.drop(subset=["Score"])


def attention_score(wide: DataFrame, rater_col: str = RATER_COL) -> DataFrame:
    """Per respondent, the number of attention items answered 'Not expressed'."""
    acols = attention_columns(wide.columns)
    long = wide.select(rater_col, *[F.col(f"`{c}`") for c in acols]).unpivot([rater_col], acols, "item", "answer")
    return long.groupBy(rater_col).agg(F.count_if(F.col("answer") == "Not expressed").alias("attention"))


def response_sum(wide: DataFrame, rater_col: str = RATER_COL, marker: str = "_QS1C1") -> DataFrame:
    """Per respondent, the sum of -1/0/1 codes over question columns containing ``marker``."""
    cols = [c for c in wide.columns if marker in c]
    long = wide.select(rater_col, *[F.col(f"`{c}`") for c in cols]).unpivot([rater_col], cols, "item", "answer")
    return long.groupBy(rater_col).agg(F.sum(recode("answer", ANSWER_CODES_SIGNED)).alias("response_sum"))


def assign_category(long: DataFrame, categories: list[str], object_col: str = "Object") -> DataFrame:
    """Question suffix ``_i`` -> the i-th category of the batch list (1-based)."""
    idx = F.regexp_extract(F.col(object_col), r"_(\d+)$", 1)
    arr = F.array(*[F.lit(c) for c in categories])
    cat = F.when(idx == "", F.lit(None)).otherwise(F.try_element_at(arr, idx.cast("int")))
    return long.withColumn("Category", cat)


def object_key(obj) -> Column:
    """Drop the last '_' part and zero-pad the leading number to width 2 (never truncate)."""
    o = F.col(obj) if isinstance(obj, str) else obj
    parts = F.split(o, "_")
    first = parts[0]
    padded = F.when(F.length(first) < 2, F.lpad(first, 2, "0")).otherwise(first)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.array_join(F.concat(F.array(padded), rest), "_")


def mean_rating(long: DataFrame, object_col: str = "Object", category_col: str = "Category",
                score_col: str = "Score") -> DataFrame:
    """Mean score per (object key, category), nulls skipped."""
    return long.groupBy(object_key(object_col).alias("object"), F.col(category_col).alias("category")).agg(
        F.avg(score_col).alias("rating")
    )


def rating_matrix(ratings: DataFrame, categories: list[str], object_col: str = "object") -> DataFrame:
    """Object x category matrix, keyed by object (batches pasted by key, not by position)."""
    return ratings.groupBy(object_col).pivot("category", categories).agg(F.first("rating"))


def _digest(text_col: str) -> Column:
    return F.sha2(F.col(text_col), 256)


def text_overlap(a: DataFrame, b: DataFrame, text_col: str, key_col: str) -> DataFrame:
    """Texts of ``a`` that also occur in ``b``, once each, at their first key in ``a``.

    Texts are compared through a SHA-256 digest: ``b`` contributes 32-byte keys
    (copies collapse map-side) and only matched rows of ``a`` carry their text
    through the final aggregation.
    """
    keys = b.select(_digest(text_col).alias("_tk")).distinct()
    # pre-aggregate a per text first (copies fold map-side), so both join sides hold each key once
    firsts = a.groupBy(_digest(text_col).alias("_tk")).agg(
        F.any_value(text_col).alias(text_col), F.min(key_col).alias(key_col)
    )
    return firsts.join(keys, "_tk", "left_semi").drop("_tk")


def first_match(texts: DataFrame, b: DataFrame, text_col: str, key_col: str, out_col: str = "match_key") -> DataFrame:
    """For each text, the smallest key of a row of ``b`` carrying it (digest-keyed, partial aggregate)."""
    first = b.groupBy(_digest(text_col).alias("_tk")).agg(F.min(key_col).alias(out_col))
    return texts.withColumn("_tk", _digest(text_col)).join(first, "_tk").drop("_tk")


def human_agreement(ratings: DataFrame, object_texts: DataFrame, corpus: DataFrame, methods: dict[str, DataFrame], categories: list[str],
                    object_col: str = "object", text_col: str = "text", key_col: str = "doc_id", digits: int = 3) -> DataFrame:
    """Per rated object, the Pearson r between its human vector and every method's vector of the same text.

    ``ratings`` is the object x category matrix, ``object_texts`` gives each
    object its text, ``methods`` maps a name to a (key, categories...) table.
    Human and computed matrices are each standardised by rows, then by
    columns; an object meets the computed vectors at the first corpus row that
    carries its text. Objects whose text is not in the corpus drop out.
    """
    human = row_then_column(ratings, categories).select(object_col, *[F.col(c).cast("double").alias(f"_h_{c}") for c in categories])
    shared = text_overlap(object_texts, corpus, text_col, object_col)
    out = first_match(shared, corpus, text_col, key_col, key_col).select(object_col, key_col).join(human, object_col)
    for name, table in methods.items():
        scaled = row_then_column(table, categories).select(key_col, *[F.col(c).alias(f"_{name}_{c}") for c in categories])
        out = out.join(scaled, key_col, "left")
    h = [f"_h_{c}" for c in categories]
    return out.select(object_col, key_col, *[F.round(row_pearson(h, [f"_{m}_{c}" for c in categories]), digits).alias(f"{m}_corr") for m in methods])
