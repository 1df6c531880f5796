import hashlib
import random
import re

import pytest

from lexicept.llm import decontaminate as D


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    out = []
    wins = []
    for i, t in items:
        w = words(t)
        wins += [(i, w[k:k + window]) for k in range(len(w) - window + 1)] if len(w) >= window else [(i, w)] if w else []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for i, g in wins:
            for k in range(len(w) - len(g) + 1):
                if w[k:k + len(g)] == g:
                    hit.update(range(k, k + len(g)))
                    if i is not None:
                        found.add(str(i))
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["é", "naïve", "X1"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 9, 10, 14, 25])))) for i in range(12)]
    items += [(100, items[4][1]), (None, " ".join(vocab[:11])), (101, None), (102, "the the the")]
    docs = []
    for d in range(25):
        body = rng.choices(vocab, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            body[len(body) // 2:len(body) // 2] = words(rng.choice(items)[1])
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(body).upper() if d % 5 == 0 else " ".join(body)))
    docs += [(3, docs[3][1]), (None, docs[7][1]), (77, None), (78, ""), (79, "the " * 500)]
    return docs, items


def brute_near(docs, items, window=10, slack=2):
    """Items of a whole window whose words all lie 0 to ``slack`` behind their places from some start, without exact ones."""
    out = []
    for d, t in docs:
        w = words(t)
        at = {}
        for p, x in enumerate(w):
            at.setdefault(x, []).append(p)
        near, exact = set(), set()
        for i, text in items:
            g = words(text)
            for k in range(len(g) - window + 1):
                win = g[k:k + window]
                if any(w[s:s + window] == win for s in range(len(w))):
                    exact.add(i)
                if any(all(any(0 <= p - s - o <= slack for p in at.get(x, ())) for o, x in enumerate(win)) for s in range(-window - slack, len(w) + slack)):
                    near.add(i)
            if 0 < len(g) < window and any(w[s:s + len(g)] == g for s in range(len(w))):
                exact.add(i)
        out.append((d, len(w), sorted(x for x in near - exact if x is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment,block,parts", [(1 << 18, 10**6, 1), (64, 10**6, 3), (1, 30, 7)])
def test_proximity_matches_brute_force_at_every_segmentation(spark, monkeypatch, segment, block, parts):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    rng = random.Random(13)
    vocab = [f"w{i}" for i in range(14)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([4, 10, 10, 12])))) for i in range(10)]
    docs = []
    for d in range(80):
        body = rng.choices(vocab, k=rng.randint(0, 30))
        planted = words(rng.choice(items)[1])
        for _ in range(rng.randint(0, 3)):  # displaced, swapped or interrupted copies
            k = rng.randrange(len(planted))
            planted.insert(rng.randrange(len(planted) + 1), planted.pop(k) if rng.random() < 0.6 else "zz")
        body[len(body) // 2:len(body) // 2] = planted
        docs.append((d, " ".join(body)))
    got = D.match(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts),
                  spark.createDataFrame(items, "item_id long, text string"), segment_tokens=segment)
    want = brute_near(docs, items)
    assert sorted(((r["doc_id"], r["n_words"], r["near_items"]) for r in got.collect()), key=str) == want
    assert sum(len(n) for _, _, n in want) > 10


@pytest.mark.parametrize("seed,segment,block", [(1, 1 << 18, 10**6), (2, 64, 10**6), (3, 64, 30), (4, 1, 1)])
def test_matches_brute_force(spark, monkeypatch, seed, segment, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    docs, items = case(seed)
    if seed == 4:
        monkeypatch.setattr(D, "VOCAB_TERMS", 1)  # the index then stores all terms
    got = D.report(D.match(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", __import__("pyspark").sql.functions.lit("clash")),
        spark.createDataFrame(items, "item_id long, text string"), segment_tokens=segment))
    rows = sorted((tuple(r)[:6] for r in got.collect()), key=str)
    assert rows == brute(docs, items)


def test_small_candidate_chunks(spark, monkeypatch):
    docs, items = case(9)
    q = D.Windows([(i, D.words_of(t.encode() if t else None)) for i, t in items])
    seg = D._Segment(None)
    for d, t in docs:
        seg.add(d, 0, t.encode() if t else None)
    row = seg.row("s")
    flat = {n: row.column(n)[0].values.to_numpy().astype("int64") for n in ("n_words", "starts", "docs", "positions")}
    flat["terms"] = row.column("terms")[0].values.to_pylist()
    whole = sorted(zip(*(x.tolist() for x in D._segment_matches(flat, q, 2)), strict=True))
    monkeypatch.setattr(D, "CANDIDATES", 3)
    assert sorted(zip(*(x.tolist() for x in D._segment_matches(flat, q, 2)), strict=True)) == whole
    assert whole


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, item), (2, item.replace("five", "five extra")), (3, item.replace("two three", "three two")), (4, item.replace("five", "other")),
            (5, item.replace("five", "five a b c d"))]
    got = D.match(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(8, item)], "item_id long, text string"))
    assert {r["doc_id"]: (r["items"], r["near_items"]) for r in got.collect()} == {
        1: ([8], []), 2: ([], [8]), 3: ([], [8]), 4: ([], []), 5: ([], [])}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in D.report(D.match(docs, none)).collect()] == [(1, 2, 0, 0)]
    assert D.report(D.match(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string"))).count() == 0
