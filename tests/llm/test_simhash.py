import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lexicept.llm import queries, simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=3):
    """Smallest index reachable, by plain search over all pairs."""
    u = np.array(fps, dtype=np.uint64)
    seen, label = {}, {}
    for i in range(len(u)):
        if i in label:
            continue
        stack, group = [i], []
        label[i] = i
        while stack:
            j = stack.pop()
            group.append(j)
            for k in np.flatnonzero(np.bitwise_count(u ^ u[j]) <= radius):
                if int(k) not in label:
                    label[int(k)] = i
                    stack.append(int(k))
        for j in group:
            seen[j] = min(group)
    return seen


@given(st.one_of(st.none(), st.text(alphabet="aBcé \t\n\x0b\x85 zK", max_size=80)))
@settings(max_examples=150, deadline=None)
def test_fingerprint_matches_definition(text):
    assert simhash.fingerprint_of(None if text is None else text.encode()) == brute_fingerprint(text)


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
@settings(max_examples=300, deadline=None)
def test_every_pair_within_radius_collides(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    masks = simhash.covering_masks(3, list(range(64)))
    assert len(masks) == 15
    together = [m for m in masks if fp & m == other & m]
    assert together
    # the second covering, over the bits a first key left free, covers the pair again
    for m in together:
        free = [b for b in range(64) if not m >> b & 1]
        assert len(free) <= 32
        assert any(fp & x == other & x for x in simhash.covering_masks(3, free, turn=7))


def clustered(n, seed):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 30])):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            out.append(x)
            c = x if rng.random() < 0.3 else c
    return out[:n]


@pytest.mark.parametrize("bucket_rows", [1024, 2])
def test_components_match_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket_rows)
    fps = clustered(400, bucket_rows) + [0, 0, 7]
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in sorted(set(signed))], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.covering_links(nodes)).collect()}
    want = brute_components(fps)
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(roots.get(x, x), []).append(i)
    assert {tuple(g) for g in groups.values()} == {tuple(sorted(j for j in want if want[j] == i)) for i in set(want.values())}


def test_query_matches_brute_force(spark, sf_small):
    rows = queries.op9_simhash(spark, sf_small).collect()
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect())
    fps = [brute_fingerprint(t) for _, t in docs]
    want = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows}
    assert len(rows) == len(docs)
    assert got == {d: (f"{fps[i]:016x}", docs[want[i]][0]) for i, (d, _) in enumerate(docs)}


def test_edge_rows(spark):
    long = "word " * 60_000
    docs = spark.createDataFrame(
        [(5, None, "a"), (4, "", "b"), (3, " \t\n", None), (9, "A b c", "x"), (2, "a b c", "x"), (2, "a b c", "x"), (None, "a b c", "y"),
         (None, "quite another text of seven words", "z"), (11, long, "l")],
        "doc_id long, text string, fp string",
    )
    rows = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs.drop("fp")).collect()]
    assert sorted(rows, key=str) == sorted([(5, 3), (4, 3), (3, 3), (9, 2), (2, 2), (2, 2), (None, 2), (None, None), (11, 11)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
