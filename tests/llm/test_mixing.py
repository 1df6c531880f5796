import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexicept.llm import mixing, queries


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    pool, full, got = 1.5 * sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in order if s not in full]
        left = pool - sum(2 * sizes[s] for s in full)
        got = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if got[s] > 2 * sizes[s]]
        if not over:
            return got | {s: 2 * sizes[s] for s in full}
        full.update(over)


def brute_lambda(xs, tokens, target):
    lo, hi = -1e6, 1e6
    for _ in range(300):
        mid = (lo + hi) / 2
        got = sum(t * min(2.0, math.exp(min(mid * x, 50))) for x, t in zip(xs, tokens, strict=True))
        lo, hi = (mid, hi) if got < target else (lo, mid)
    return lo


def corpus(seed, sources=7):
    rng = random.Random(seed)
    rows = []
    for s in [*(f"s{i}" for i in range(sources)), None, "n", "é"]:
        for _ in range(rng.choice([1, 5, 60])):
            rows.append((len(rows), "w " * int(math.exp(rng.uniform(0, 7))), s))
    return rows + [(9000, None, "s1"), (9001, "", "s2"), (9002, "a b", "s1"), (9002, "a b", "s1"), (None, "a b c", None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_taken(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    by_id = {d: s for d, _, s in rows}
    taken = {}
    for r in out:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in want.items():
        smallest = min([size(x) for _, x, y in rows if y == s and size(x)], default=0)
        assert abs(taken[s] - t) <= 0.03 * t + smallest + 1, (s, taken[s], t)
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, out), key=str)


def test_newton_solves_the_dual(spark):
    rng = random.Random(4)
    cells, goal = [], []
    for s, share in (("a", 0.3), ("b", 0.97), ("c", 1.2), ("d", 1.9), ("e", 1.999), ("full", 2.0)):
        sizes = [math.exp(rng.uniform(0, 8)) for _ in range(40)]
        mean = sum(sizes) / 40
        cells += [(s, t, t, t / mean) for t in sizes]
        goal.append((s, sum(sizes), share * sum(sizes)))
    lam = dict(mixing._newton(
        spark.createDataFrame(cells, "src string, tokens double, mean double, x double"),
        spark.createDataFrame(goal, "src string, source_size double, target double")).collect())
    assert set(lam) == set("abcde")
    for s, _, t in goal[:-1]:
        xs = [c[3] for c in cells if c[0] == s]
        tokens = [c[1] for c in cells if c[0] == s]
        got = sum(k * min(2.0, math.exp(lam[s] * x)) for x, k in zip(xs, tokens, strict=True))
        assert got == pytest.approx(t, rel=1e-5)
        assert lam[s] == pytest.approx(brute_lambda(xs, tokens, t), rel=1e-3, abs=1e-4)


def test_cells_of_any_size_get_exactly_the_planned_copies(spark, monkeypatch):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") < 4000, "x").otherwise("y").alias("source"))
    found = []
    for bucket in (1000, 10, 100_000):
        monkeypatch.setattr(mixing, "BUCKET_DOCS", bucket)
        found.append(sorted(map(tuple, mixing.mix(docs).collect())))
    assert found[0] == found[1] == found[2]
    for _, taken, target in mixing.mix(docs).groupBy("source_size").agg(F.sum("taken"), F.max("target")).collect():
        assert abs(taken - target) <= 4


def test_equal_rows_meet_the_target(spark, monkeypatch):
    hot = [(1, "one two three four five six seven eight nine ten", "a")] * 1000 + [(2, "some other words", "a")] * 5
    docs = spark.createDataFrame(hot, "doc_id long, text string, source string").repartition(6)
    for bucket in (1000, 7):
        monkeypatch.setattr(mixing, "BUCKET_DOCS", bucket)
        rows = mixing.mix(docs).collect()
        assert abs(sum(r["taken"] for r in rows) - 1.5 * 10_015) <= 10 and max(r["copies"] for r in rows) <= 2
    kept = mixing.written(docs, "test-mixing")
    mixed = mixing.mixed_documents(kept)
    assert mixed.groupBy("doc_id").count().orderBy("doc_id").first()["count"] == sum(r["copies"] for r in mixing.mix(kept).collect() if r["doc_id"] == 1)


def test_mixed_documents(spark):
    docs = spark.createDataFrame([(*r, "keep", 1) for r in corpus(5)], "doc_id long, text string, source string, SIZE string, src int")
    want = {}
    for r in mixing.mix(docs.drop("SIZE", "src")).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in want.items() if n}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
    assert mixing.mixed_documents(docs).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(nothing).collect()] == [0, 0]


def test_plan_is_native(spark, sf_small):
    plan = queries.op5_mixing(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow", plan)
