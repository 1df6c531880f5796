"""Steps that stay in the text's row or in a hash table of texts: same results, bounded work per task."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicept.functions.sizing import measure
from lexicept.operators import embed as E
from lexicept.operators import lexicon as L
from lexicept.operators import phrases as P
from lexicept.operators.text import TEXTS_AT_A_TIME, expand_contractions_expr, subword_tokens
from lexicept.streaming.concept_stream import run_available, stream_table


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_stream_reads_the_part_files_of_a_directory(spark, tmp_path):
    rows = [(i, f"text {i}", "en", "web", 6) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    docs.write.parquet(str(tmp_path / "in" / "other.parquet"))
    path = run_available(stream_table(spark, str(tmp_path / "in"), "documents").select("doc_id", "text"), "t", base=str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in spark.read.parquet(path).collect()) == list(range(20))


def test_lexicon_counts_make_no_row_per_token(spark):
    texts = [(1, "The theory of the inn"), (1, "Into it, the end"), (None, "and AND anda"), (2, None), (3, ""), (4, "été thé in")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    lex = [("a", 0, "the"), ("b", 1, "in*"), ("b", 1, "inn"), ("c", 2, "th*"), ("c", 2, "and"), ("d", 3, "*"), ("e", 4, "of")]
    lexicon = spark.createDataFrame(lex, "category string, ord int, pattern string")
    cats = ["a", "b", "c", "d"]  # hits of "e" count nowhere, but keep a text
    wide = L.lexicon_counts_wide(docs, lexicon, cats)
    assert "Generate" not in _plan(wide) and "BroadcastHashJoin" not in _plan(wide)
    want: dict = {}
    for key, text in texts:
        row = want.setdefault(key, dict.fromkeys(cats, 0))
        for token in re.findall(r"[^\W\d_]+", (text or "").lower()):
            for c in cats:
                row[c] += any(token.startswith(p[:-1]) if p.endswith("*") else token == p for k, _, p in lex if k == c)
    assert {r["doc_id"]: {c: r[c] for c in cats} for r in wide.collect()} == want
    kept = L.lexicon_counts_wide(docs, lexicon.filter("category != 'd'"), cats[:3], fill_missing=False)
    assert {r["doc_id"] for r in kept.collect()} == {1, None, 4}


def test_mean_pool_sums_in_a_hash_table(spark):
    rows = [(i % 7 if i % 7 else None, [float(i), 1.0, -0.5 * i] if i % 5 else None) for i in range(400)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    pooled = E.mean_pool(vectors)
    assert "ObjectHashAggregate" not in _plan(pooled) and "SortAggregate" not in _plan(pooled)
    for r in pooled.collect():
        own = [v for k, v in rows if k == r["doc_id"] and v is not None]
        assert np.allclose(r["embedding"], np.mean(own, axis=0))
    with pytest.raises(Exception, match="other widths"):
        E.mean_pool(vectors.union(spark.createDataFrame([(1, [1.0])], vectors.schema))).collect()


def test_a_worker_holds_some_texts_at_a_time(spark):
    class _Largest:
        """Encoder whose vectors say how many texts it was given at once."""

        def __call__(self, texts):
            return np.full((len(texts), 1), len(texts), np.float32)

    class _LargestSpans:
        def __call__(self, texts):
            return [(np.array([0]), np.array([1]), np.array([[len(texts)]], np.float32)) for _ in texts]

    n = 3 * TEXTS_AT_A_TIME + 5
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("a word "), F.col("id").cast("string")).alias("text")).coalesce(1)
    out = E.encode_texts(docs, encoder_factory=_Largest).agg(F.max(F.col("embedding")[0]), F.count("*")).first()
    assert out[0] <= TEXTS_AT_A_TIME and out[1] == n
    spans = E.encode_token_spans(docs, encoder_factory=_LargestSpans)
    assert spans.agg(F.max(F.col("spans.vectors")[0])).first()[0] <= TEXTS_AT_A_TIME
    pooled = E.encode_token_spans(docs).select("doc_id", E.pool_spans().alias("v"))
    assert pooled.filter(F.size("v") == 16).count() == n


def test_keyword_vector_takes_no_substring_per_token(spark):
    docs = spark.createDataFrame([(1, "É Can 😀 pan"), (2, None), (3, "none here"), (4, "xx a n")], "doc_id long, text string")
    out = E.keyword_vector(E.encode_token_spans(docs), "an")
    assert "substring" not in _plan(out).lower()
    found = {r["doc_id"]: (r["pos"], r["start"], r["end"], r["token"], r["embedding"] is None) for r in out.collect()}
    none = (None, None, None, None, True)
    assert found == {1: (1, 2, 5, "can", False), 2: none, 3: none, 4: none}


def test_keyword_vector_encodes_a_text_once_in_one_python_step(spark, tmp_path):
    seen = str(tmp_path / "seen")

    class _Counting(E.WindowTokenEncoder):
        def __call__(self, texts):
            with open(seen, "a") as f:
                f.write("x" * len(texts))
            return super().__call__(texts)

    texts = [(i, f"the land {i} and sand" if i % 3 else "no hit") for i in range(30)] + [(30, None), (31, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    hits = E.keyword_vector(E.encode_token_spans(docs, encoder_factory=_Counting), "an").filter(F.col("pos").isNotNull())
    out = hits.select("doc_id", "token", F.posexplode("embedding"))
    assert _plan(out).count("ArrowEvalPython") == 1
    assert {r["doc_id"] for r in out.collect()} == {i for i in range(30) if i % 3}
    assert len(open(seen).read()) == len(texts)


def test_keyword_vector_of_stored_spans(spark, tmp_path):
    texts = [(1, "É Can 😀 pan"), (2, None), (3, "none here"), (4, "xx a n"), (5, "")] + [(i, f"x{i} " * (i % 9) + "Sand y") for i in range(6, 300)]
    spans = E.encode_token_spans(spark.createDataFrame(texts, "doc_id long, text string"))
    want = sorted(E.keyword_vector(spans, "an").collect())
    spans.withColumn("old", F.col("spans").dropFields("text")).write.parquet(str(tmp_path / "spans"))
    stored = spark.read.parquet(str(tmp_path / "spans"))
    assert sorted(E.keyword_vector(stored.drop("old"), "an").collect()) == want
    assert sorted(E.keyword_vector(stored.drop("spans"), "an", spans_col="old").collect()) == want
    lost = stored.withColumn("spans", F.when(F.col("doc_id") > 5, F.col("spans"))).drop("old")
    got = {r["doc_id"]: r for r in E.keyword_vector(lost, "an").collect()}
    assert got[1]["pos"] is None and got[1]["embedding"] is None and all(got[r["doc_id"]] == r for r in want if r["doc_id"] > 5)


def test_long_texts_are_encoded_some_bytes_at_a_time(spark):
    class _Held:
        def __call__(self, texts):
            held = sum(len((t or "").encode()) for t in texts)
            return [(np.array([0]), np.array([1]), np.array([[len(texts), held]], np.float32)) for _ in texts]

    size = E.TEXT_BYTES_AT_A_TIME
    texts = [None, "é" * (size // 3)] * 5 + ["", "x" * (2 * size), "y", None] + ["z" * (size // 4)] * 9
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = [tuple(r[0]) for r in E.encode_token_spans(docs, encoder_factory=_Held).select("spans.vectors").collect()]
    assert len(got) == len(texts) and all(held <= size or n == 1 for n, held in got)
    assert sum(1 / n for n, _ in got) < 12  # slices


def test_phrase_steps_skip_words_that_open_nothing(spark):
    trie = P.Trie([("the * of", "a"), ("in*", "b"), (".", "c")])
    words = "we see the end of it inside .".split()
    assert [trie.opens(w) for w in words] == [False, False, True, False, False, False, True, True]
    assert list(trie.walk(words, True)) == [(2, 3, {"a"}), (6, 1, {"b"}), (7, 1, {"c"})]
    docs = spark.createDataFrame([(1, "We see the end of it, inside."), (2, None), (3, "")], "doc_id long, text string")
    assert "ArrowEvalPython" in _plan(P.token_spans(docs, "doc_id", "text"))
    assert P.token_spans(docs, "doc_id", "text").count() == 9


def test_subwords_and_contractions_of_null_and_repeated_words(spark):
    docs = spark.createDataFrame([(1, "inner inn"), (2, None), (3, "xyz inner"), (4, "")], "doc_id long, text string")
    pieces = spark.createDataFrame([("inn",), ("##er",)], "piece string")
    rows = sorted(tuple(r) for r in subword_tokens(docs, "doc_id", "text", pieces).collect())
    assert rows == [(1, 0, "inn"), (1, 1, "##er"), (1, 2, "inn"), (3, 0, "[UNK]"), (3, 1, "inn"), (3, 2, "##er")]
    texts = spark.createDataFrame([("i can't go",), ("scan'tin",), (None,)], "text string")
    got = [r[0] for r in texts.select(expand_contractions_expr("text", [("can't", "cannot")])).collect()]
    assert got == ["i cannot go", "scan'tin", None]


def test_width_of_float_vectors(spark):
    df = spark.createDataFrame([([1.0] * 100,)], "v array<float>")
    assert measure(df) == (1, 416)
