"""Rule tokens and phrase patterns against plain readings of their rules."""

from __future__ import annotations

import random

import pytest

from lexicept.operators import phrases as P


def _naive(pattern: list[tuple[str, bool]], words: list[str], i: int) -> bool:
    part = words[i:i + len(pattern)]
    return len(part) == len(pattern) and all(w.startswith(p) if stem else w == p for w, (p, stem) in zip(part, pattern, strict=True))


def _naive_hits(rows, words, longest):
    out, i = [], 0
    while i < len(words):
        here = {(len(t), c) for p, c in rows for t in [P.Trie.pattern_tokens(p)] if t and _naive(t, words, i)}
        if longest and here:
            top = max(n for n, _ in here)
            out += [(i, top, c) for n, c in here if n == top]
            i += top
        else:
            out += [(i, n, c) for n, c in here]
            i += 1
    return sorted(out)


@pytest.mark.parametrize("text,want", [
    ("I can't pay $1,234.50 -- it's Bob's!", ["I", "ca", "n't", "pay", "$", "1,234.50", "-", "-", "it", "'s", "Bob", "'s", "!"]),
    ("Don’t wait... they'LL go at 10:30.", ["Do", "n’t", "wait", "...", "they", "'LL", "go", "at", "10:30", "."]),
    ("n't isn'tx 'sx a b　c", ["n't", "isn", "'", "tx", "'", "sx", "a", "b", "c"]),
    ("été İSTANBUL 3rd", ["été", "İSTANBUL", "3", "rd"]),
    ("", []), (None, []), (" \t\r\n", []),
])
def test_tokens(text, want):
    spans = P.spans_of(text)
    assert [w for _, _, w in spans] == want
    assert all((text or "")[s:e] == w for s, e, w in spans)


@pytest.mark.parametrize("longest", [True, False])
def test_trie_equals_naive_matching(longest):
    rng = random.Random(5)
    vocab = ["a", "ab", "abc", "b", "ba", "c", ".", "'s"]
    for _ in range(300):
        part = lambda: rng.choice([*vocab, "a*", "ab*", "b*", "*"])
        rows = [(" ".join(part() for _ in range(rng.randint(0, 4))), rng.choice("xyz")) for _ in range(rng.randint(0, 8))]
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 25))]
        got = sorted((i, n, c) for i, n, found in P.Trie(rows).walk(words, longest) for c in found)
        assert got == _naive_hits(rows, words, longest)


def test_queries_over_defined_cases(spark):
    docs = spark.createDataFrame(
        [(1, "Look forward to it. I can't stand it!", "u"), (1, "Look forward to it. I can't stand it!", "u"),
         (2, None, "u"), (3, "", None), (None, "LOOK FORWARD", "v"), (4, "x " * 50_000 + "look forward", "v")],
        "doc_id long, text string, category string",
    )
    lex = spark.createDataFrame(
        [("hope", "look forward to"), ("see", "look"), ("dislike", "can't stand"), ("dislike", "can't st*"), ("none", ""), ("none", None)],
        "category string, pattern string",
    )
    hits = [tuple(r) for r in P.phrase_hits(docs, lex).collect()]
    one = [(1, 0, 3, 0, 15, "hope"), (1, 6, 3, 22, 33, "dislike")]
    assert sorted(hits, key=repr) == sorted([*one, *one, (None, 0, 1, 0, 4, "see"), (4, 50_000, 1, 100_000, 100_004, "see")], key=repr)
    every = P.phrase_hits(docs.filter("doc_id = 1").limit(1), lex, mode="all").collect()
    assert sorted((r["pos"], r["n_tokens"], r["category"]) for r in every) == [(0, 1, "see"), (0, 3, "hope"), (6, 3, "dislike")]
    counts = P.phrase_counts(docs, lex, ["hope", "see", "dislike", "none"]).collect()
    assert len(counts) == 24
    assert sum(r["n"] for r in counts if r["doc_id"] == 1) == 4
    assert [r["n"] for r in counts if r["doc_id"] in (2, 3)] == [0] * 8
    kept = P.token_spans(docs, "doc_id", "text", keep=["category"])
    assert kept.columns == ["doc_id", "category", "pos", "start_char", "end_char", "token"]
    empty = docs.limit(0)
    assert P.phrase_hits(empty, lex).count() == P.phrase_counts(empty, lex, ["hope"]).count() == 0
    assert P.phrase_hits(docs, lex.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.phrase_hits(docs, lex, mode="first")
