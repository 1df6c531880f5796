"""Both sides of every size switch give the same rows, with repeated and null ids."""

from __future__ import annotations

import pytest

from lexicept.functions import sizing
from lexicept.functions.hashing import stable_hash
from lexicept.functions.stats import icc_average, pearson_agg
from lexicept.operators import embed as E
from lexicept.operators import lexicon as L
from lexicept.operators import refcorpus as RC
from lexicept.operators import represent as R
from lexicept.operators import text as T
from lexicept.operators.concepts import embed


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def model(spark):
    cats = spark.createDataFrame([("a", 0), ("b", 1), ("none", 2)], "category string, ord int")
    cent = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("b", 0, [1.0, 1.0])], "category string, cluster int, centroid array<double>")
    docs = spark.createDataFrame([(1, [1.0, 0.5]), (1, [0.2, 0.9]), (None, [0.3, 0.1]), (None, None)], "doc_id long, embedding array<float>")
    return docs, cent, cats


@pytest.mark.parametrize("reduce", ["max", "mean"])
def test_model_blocks(model, monkeypatch, reduce):
    one = rows(R.concept_matrix(*model, reduce=reduce)), rows(R.concept_similarity(*model, reduce=reduce))
    monkeypatch.setattr(R, "MAX_MODEL_CELLS", 1)
    assert (rows(R.concept_matrix(*model, reduce=reduce)), rows(R.concept_similarity(*model, reduce=reduce))) == one
    assert len(one[0]) == 4


def test_wide_lexicons(spark, monkeypatch):
    lex = spark.createDataFrame([("c", 0, "red*"), ("d", 1, "blue"), ("e", 2, "zz")], "category string, ord int, pattern string")
    docs = spark.createDataFrame([(1, "red blue redder", 5), (1, "blue", 6), (None, "red", 7), (3, None, 8)], "doc_id long, text string, k int")
    words = spark.createDataFrame([("red", [1.0, 0.0]), ("blue", [0.6, 0.8])], "token string, embedding array<float>")
    cats = lex.select("category", "ord")
    run = lambda: (
        rows(L.lexicon_counts_wide(docs, lex, ["c", "d", "e"], keep=["k"])),
        [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows(L.soft_lexicon_counts_wide(docs, lex, cats, words))],
    )
    narrow = run()
    monkeypatch.setattr(L, "CONDITIONAL_COUNT_MAX_CATEGORIES", 0)
    assert run() == narrow
    assert (None, 7, 1, 0, 0) in narrow[0] and len(narrow[0]) == 4


def test_sizes_count_bytes(spark):
    df = spark.createDataFrame([(i, [0.5] * 1000, "x" * 100) for i in range(50)], "i long, v array<double>, s string")
    n, size = sizing.measure(df)
    assert n == 50 and 50 * 8100 < size < 50 * 8300
    assert not sizing.is_small(df, max_bytes=100_000) and sizing.is_small(df)


def test_lookup_join_paths(spark):
    big = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(40)], "id long, key string")
    table = spark.createDataFrame([("hot", 1), ("k4", 2)], "key string, v int")
    assert rows(sizing.lookup_join(big, table, "key", ["id"], "left", small=True)) == rows(sizing.lookup_join(big, table, "key", ["id"], "left", small=False))


def test_only_hot_keys_are_replicated(spark, monkeypatch):
    big = spark.createDataFrame([(i, None if i % 5 == 0 else "hot" if i % 2 else f"k{i}") for i in range(400)], "id long, key string")
    table = spark.createDataFrame([("hot", 1), ("k4", 2), ("k6", 3)], "key string, v int")
    hot = spark.createDataFrame([("hot",)], "key string")
    for how in ("left", "inner"):
        want = rows(sizing.lookup_join(big, table, "key", ["id"], how, small=True))
        for some in (hot, hot.limit(0)):
            assert rows(sizing.lookup_join(big, table, "key", ["id"], how, small=False, hot=some)) == want
    texts = spark.createDataFrame([(i, None if i % 7 == 0 else f"word {i % 3 if i % 2 else i}") for i in range(60)], "doc_id long, text string")
    run = lambda: rows(E.encode_distinct(texts, lambda t: E.encode_texts(t, "text", E.Md5Encoder, encoder_id="hot")))
    want = run()
    monkeypatch.setattr(E, "BROADCAST_MAX_BYTES", 0)
    monkeypatch.setattr(E, "HOT_ROWS", 4)
    salted, seen = E.lookup_join, []
    monkeypatch.setattr(E, "lookup_join", lambda *a, **k: seen.append(k["hot"].count()) or salted(*a, **k))
    assert run() == want and len(want) == 60 and seen == [3]


def test_embed_moves_texts_once(spark):
    """Hits are counted on the texts themselves: the rows of the centroids do not pass the join of texts with vectors."""
    lex = spark.createDataFrame([("c", 0, "red*"), ("d", 1, "blue")], "category string, ord int, pattern string")
    texts = spark.createDataFrame([(1, "red one"), (2, "blue two"), (3, None), (4, "red one"), (4, "red blue")], "doc_id long, text string")
    out = embed(texts, lex, E.Md5Encoder, encoder_id="once")
    assert "InMemoryTableScan" in out._jdf.queryExecution().executedPlan().toString()
    vectors = E.encode_distinct(texts, lambda t: E.encode_texts(t, "text", E.Md5Encoder, encoder_id="once"))
    cent = RC.reference_centroids(vectors, lex)
    assert rows(RC.reference_centroids(texts, lex, vectors=vectors.select("doc_id", "embedding"))) == rows(cent)
    assert rows(out) == rows(R.concept_matrix(vectors, cent, lex.select("category", "ord")))


def test_one_encoder_per_worker_and_one_encoding_per_text(spark, tmp_path):
    made, seen = str(tmp_path / "made"), str(tmp_path / "seen")

    class Counting(E.Md5Encoder):
        def __init__(self):
            super().__init__(4)
            with open(made, "a") as f:
                f.write("x")

        def __call__(self, texts):
            with open(seen, "a") as f:
                f.write("x" * len(texts))
            return super().__call__(texts)

    texts = spark.createDataFrame([(i, f"word{chr(97 + i % 5)} again") for i in range(60)], "doc_id long, text string").repartition(12)
    out = E.encode_distinct(texts, lambda t: E.encode_texts(t.repartition(12), "text", Counting, encoder_id="counting")).collect()
    assert len(out) == 60 and all(r["embedding"] is not None for r in out)
    assert len(open(made).read()) <= 4  # local[4]: at most one per worker, over 12 partitions
    assert len(open(seen).read()) == 5  # 60 rows, 5 distinct texts, each encoded once


def test_embed_call(spark):
    lex = spark.createDataFrame([("c", 0, "red*"), ("d", 1, "blue")], "category string, ord int, pattern string")
    texts = spark.createDataFrame([(1, "red one"), (2, "blue two"), (3, None), (4, "red one")], "doc_id long, text string")
    got = {r["doc_id"]: (r["c"], r["d"]) for r in embed(texts, lex, E.Md5Encoder).collect()}
    assert got[1] == got[4] and got[3] == (0.0, 0.0) and got[1][0] == pytest.approx(1.0) and got[2][1] == pytest.approx(1.0)
    two = embed(texts, lex, E.Md5Encoder, k=2).collect()
    assert len(two) == 4


def test_text_keys_and_literal_contractions(spark):
    df = spark.createDataFrame([("alpha",), ("beta",), ("12",)], "k string").select("k", stable_hash("k", 3).alias("h"))
    hs = {r["k"]: r["h"] for r in df.collect()}
    assert len(set(hs.values())) == 3
    assert hs["12"] == spark.range(12, 13).select(stable_hash("id", 3)).first()[0]
    rules = [("ain't", "won't"), ("won't", "will not"), ("c'st", "is $5 \\x")]
    out = T.expand_contractions(spark.createDataFrame([("I ain't, c'st won't",)], "text string"), "text", rules).first()[0]
    assert out == "i won't, is $5 \\x will not"


def test_moments_keep_large_offsets(spark):
    df = spark.createDataFrame([(1e9 + i, 1e9 + 2 * i) for i in range(10)], "x double, y double")
    assert df.agg(pearson_agg("x", "y")).first()[0] == pytest.approx(1.0)
    scores = [(o, r, float(o * o % 7 + r)) for o in range(12) for r in range(3)]
    near = icc_average(spark.createDataFrame(scores, "object int, rater int, score double")).first()
    far = icc_average(spark.createDataFrame([(o, r, s + 1e8) for o, r, s in scores], "object int, rater int, score double")).first()
    assert far["icc"] == pytest.approx(near["icc"], abs=1e-6)


def test_packed_pairs_meet_by_text(spark):
    lex = spark.createDataFrame([("c", 0, "red*"), ("c", 0, "blue"), ("c", 0, "blue"), ("d", 1, "re*"), ("e", 2, "zz")], "category string, ord int, pattern string")
    texts = ["red Blue redder red", "red Blue redder red", "none here", None, "", "été blue", "reé \U0001f600 re"]
    docs = spark.createDataFrame([(i // 2 or None, t) for i, t in enumerate(texts * 2)], "doc_id long, text string").repartition(3)
    keys = ["category", "word", "word_idx", "sentence_key"]
    packed = RC.reference_pairs(docs, lex, packed=True, with_text=True)
    assert packed.count() == 14 and {"hits", "sentence"} <= set(packed.columns)
    out = RC.dedupe_pairs(packed)
    got = rows(out.select(keys))
    assert got == rows(RC.dedupe_pairs(RC.reference_pairs(docs, lex)).select(keys)) and len(got) == 7 + 1 + 2
    assert rows(RC.dedupe_pairs(RC.reference_pairs(docs, lex, packed=True, max_chars=8))) == rows(RC.dedupe_pairs(RC.reference_pairs(docs, lex, max_chars=8)).select(keys))
    # what is shuffled is one row per text: the only exchange is by the text's key
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sentence_key" in plan and "hashpartitioning(category" not in plan


def test_dedupe_pairs_query_moves_texts_not_hits(spark, sf_small):
    from lexicept.plans.catalog import QUERIES

    plan = QUERIES["dedupe_pairs"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sentence_key" in plan and "hashpartitioning(category" not in plan


def test_doc_texts_are_the_rows_of_doc_vectors(spark, tmp_path):
    from lexicept.sources import fixtures as fx

    docs = [(1, "one"), (1, "again"), (None, "no id"), (7, None), (-3, "below"), (5, "five")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    vecs = [(0, [0.5]), (1, [1.0]), (1, [2.0]), (None, [3.0]), (9, [4.0])]  # repeated, null and unreached ids
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    texts = fx.fx_doc_texts(spark, str(tmp_path))
    assert rows(texts) == rows(fx.fx_doc_vectors(spark, str(tmp_path)).select("doc_id", "text")) and len(rows(texts)) == 5
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
