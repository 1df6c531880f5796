"""Cross-tokenizer alignment: divide and conquer at shared cuts.

A text is encoded by two tokenizers whose tokens spell the same bytes (a space and the text). A byte offset where a token
of both ends is a shared cut. ``leaf_groups`` looks for the cut nearest the middle of an interval (an end of one side is
looked up among the other's by bisection), splits there and goes on with both halves; an interval without a cut is a
leaf, the smallest run of tokens of either side that cover the same bytes. Inside a leaf, tokens whose byte ranges overlap are linked.

Where both tokenizers start a new word at a single space (``words.cuts_hold``), the ends of words are shared cuts from
the outset, so every distinct word is aligned once per worker and texts are put together from words. Otherwise the whole
text is one interval.

Corpus side: the distinct id pairs of every document are counted over all documents; a link is best when its pair's
count is the highest of its A id. Pair counts meet the documents' pairs by broadcast while their table is small and by a
salted join beyond that, so a pair found in most documents does not land in one task.

Defined cases: texts that are null, empty or that a tokenizer does not give back byte for byte have no tokens, groups or
links (zeros, empty digest). Repeated rows count as documents of their own; ids may be null. Texts of any length
are taken in slices between cuts; only a text without any cut is encoded whole. Extra columns are ignored. An empty table
has an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, pairwise, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import lookup_join
from .common import written
from .words import BytePairIds, Memo, byte_letters, cuts_hold, sentence_model, tokenizer

#: Words kept by a worker; memory only.
MEMO_WORDS = 500_000
RESULT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def leaf_groups(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a_from, a_to, b_from, b_to) of every leaf in order.

    ``a`` and ``b`` are the ascending byte ends of two tokenisations of the same bytes; the intervals to start from lie
    between consecutive ``a_cuts`` and ``b_cuts``. All intervals of a depth are halved together: each looks for the shared end
    nearest its middle, one step to either side at a time, by bisection among the other side's ends.
    """
    work = np.stack([a_cuts[:-1], a_cuts[1:], b_cuts[:-1], b_cuts[1:]])
    leaves = []
    while work.shape[1]:
        single = (work[1] - work[0] <= 1) | (work[3] - work[2] <= 1)
        leaves.append(work[:, single])
        work = work[:, ~single]
        middle = (work[0] + work[1] - 1) // 2
        at = np.full(work.shape[1], -1)  # position in a of the shared end
        open_ = np.arange(work.shape[1])
        step = 0
        while len(open_):
            for side in (step, -step) if step else (0,):
                i = middle[open_] + side
                inside = (i >= work[0, open_]) & (i < work[1, open_] - 1)
                who, i = open_[inside], i[inside]
                hit = b[np.searchsorted(b, a[i])] == a[i]
                at[who[hit]] = i[hit]
                open_ = open_[at[open_] < 0]
            step += 1
            open_ = open_[(middle[open_] + step < work[1, open_] - 1) | (middle[open_] - step >= work[0, open_])]
        cutless = at < 0
        leaves.append(work[:, cutless])
        work, at = work[:, ~cutless], at[~cutless]
        there = np.searchsorted(b, a[at])
        left, right = work.copy(), work.copy()
        left[1], left[3] = at + 1, there + 1
        right[0], right[2] = at + 1, there + 1
        work = np.concatenate([left, right], axis=1)
    out = np.concatenate(leaves, axis=1)
    return tuple(out[:, np.argsort(out[0], kind="stable")])


class Aligned(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: bytes  # a1,a2|b1;a3|b2,b3;
    pairs: bytes  # one 64-bit code a * b_size + b per link
    ok: bool


NOTHING = Aligned(0, 0, 0, 0, b"", b"", False)


class Aligner:
    """Alignments of texts under a byte-level tokenizer (A) and a sentencepiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = tokenizer(a_path, plain_specials=True), sentence_model(b_path)
        how = cuts_hold(self.a), cuts_hold(self.b)
        self.cut = how == ("led", "led")
        self.a_ids = BytePairIds(self.a, "led" if self.cut else None)
        byte_of = {letter: b for b, letter in byte_letters().items()}
        plain = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = token.encode() if token in plain else bytes(byte_of[c] for c in token)
        self.b_size = self.b.get_piece_size()
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b_size))
        ]
        self.a_len, self.b_len = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        # a token's id as text with the mark behind it: A inside a group, A at its end, B inside, B at its end
        ids = (len(self.a_bytes), len(self.b_bytes))
        self.marked = [b"%d%s" % (i, mark) for n, marks in zip(ids, (b",|", b",;"), strict=True) for mark in (marks[:1], marks[1:]) for i in range(n)]
        self.marked_len = np.fromiter(map(len, self.marked), np.int64, len(self.marked))
        self.memo = Memo(self.align, MEMO_WORDS)

    def align(self, pieces: list[str]) -> list[tuple]:
        """The alignment (fields of ``Aligned``) of a space and each piece, all halved together."""
        if not pieces:
            return []
        all_a, all_b = self.a_ids(pieces), self.b.encode(pieces, num_threads=1)
        a_cuts, b_cuts, ids_a, ids_b, a, b = self.spelled(all_a, all_b)
        want = " " + " ".join(pieces)
        ends_at = np.cumsum(np.fromiter(map(len, map(str.encode, pieces)), np.int64, len(pieces)) + 1)
        # all pieces are looked at together; only where they are not given back, one by one
        sound = len(a) and len(b) and a_cuts[1:].all() and b_cuts[1:].all() and (a[a_cuts[1:] - 1] == ends_at).all() and (b[b_cuts[1:] - 1] == ends_at).all()
        if not (sound and self.bytes_of(ids_a, self.a_bytes) == want.encode() == self.bytes_of(ids_b, self.b_bytes)):
            out = [tuple(NOTHING)] * len(pieces)
            kept = []
            for k, (piece, x, y) in enumerate(zip(pieces, all_a, all_b, strict=True)):
                one = (" " + piece).encode()
                if b"".join([self.a_bytes[i] for i in x]) == one and b"".join([self.b_bytes[i] for i in y]) == one:
                    kept.append(k)
            if kept:
                found = self.laid_out(*self.spelled([all_a[k] for k in kept], [all_b[k] for k in kept]))
                for k, r in zip(kept, found, strict=True):
                    out[k] = r
            return out
        return self.laid_out(a_cuts, b_cuts, ids_a, ids_b, a, b)

    @staticmethod
    def bytes_of(ids: np.ndarray, of: list[bytes]) -> bytes:
        return b"".join(map(of.__getitem__, ids.tolist()))

    def spelled(self, a_ids: list, b_ids: list) -> tuple[np.ndarray, ...]:
        """Of id lists: where they end, all ids in a row, and the ends of the tokens in the joined bytes; for A and B."""
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_ids, b_ids))
        a_cuts, b_cuts = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n[-1])) for x, n in ((a_ids, a_cuts), (b_ids, b_cuts)))
        return a_cuts, b_cuts, ids_a, ids_b, np.cumsum(self.a_len[ids_a]), np.cumsum(self.b_len[ids_b])

    def laid_out(self, a_cuts: np.ndarray, b_cuts: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple]:
        """The alignments (fields of ``Aligned``) of strings whose id lists spell the same bytes."""
        a_from, a_to, b_from, b_to = leaf_groups(a, b, a_cuts, b_cuts)
        # between two neighbouring ends of either side lies the overlap of exactly one pair
        ends = np.union1d(a, b)
        left, right = np.searchsorted(a, ends), np.searchsorted(b, ends)
        pairs = (ids_a[left] * self.b_size + ids_b[right]).astype("<i8").tobytes()
        link_cuts, group_cuts = np.searchsorted(left, a_cuts), np.searchsorted(a_from, a_cuts)
        # the order of the text: a group's A ids, then its B ids
        group_a, group_b = (np.repeat(np.arange(len(a_from)), x) for x in (a_to - a_from, b_to - b_from))
        size_a, size_b = len(self.a_bytes), len(self.b_bytes)
        coded = np.empty(len(a) + len(b), np.int64)
        ia, ib = np.arange(len(a)), np.arange(len(b))
        coded[ia + b_from[group_a]] = ids_a + size_a * (ia == a_to[group_a] - 1)
        coded[ib + a_to[group_b]] = 2 * size_a + ids_b + size_b * (ib == b_to[group_b] - 1)
        shown = self.bytes_of(coded, self.marked)
        shown_cuts = np.concatenate([[0], np.cumsum(self.marked_len[coded])])[a_cuts + b_cuts].tolist()
        pair_cuts = (8 * link_cuts).tolist()
        # plain tuples: those of numbers and bytes are nothing to the garbage collector, however many the memo holds
        return list(zip(
            *(np.diff(x).tolist() for x in (a_cuts, b_cuts, group_cuts, link_cuts)),
            [shown[i:j] for i, j in pairwise(shown_cuts)], [pairs[i:j] for i, j in pairwise(pair_cuts)], repeat(True),
        ))

    def texts(self, texts: list[str | None]) -> list[Aligned]:
        if not self.cut:
            return [Aligned(*self.align([t])[0]) if t else NOTHING for t in texts]
        out = []
        for t, parts in zip(texts, self.memo.texts(texts), strict=True):
            if not parts:
                out.append(NOTHING)
            elif not all([p[6] for p in parts]):
                out.append(Aligned(*self.align([t])[0]))  # the whole text decides
            else:
                out.append(Aligned(
                    sum([p[0] for p in parts]), sum([p[1] for p in parts]), sum([p[2] for p in parts]), sum([p[3] for p in parts]),
                    b"".join([p[4] for p in parts]), b"".join([p[5] for p in parts]), True,
                ))
        return out


_ALIGNERS: dict = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per process and pair of tokenizers; it keeps the words it has met."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def align(text_col: str, a_path: str, b_path: str) -> Column:
    """Struct of a text's counts, the digest of its groups, and its distinct linked id pairs with how often each is linked."""

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = aligner(a_path, b_path)
        for texts in batches:
            counts, digests, codes, times, ends = [], [], [], [], [0]
            for r in one.texts(texts.to_pylist()):
                counts.append(r[:4])
                digests.append(hashlib.sha256(r.groups[:-1]).hexdigest() if r.n_groups else "")
                pairs, often = np.unique(np.frombuffer(r.pairs, "<i8"), return_counts=True)
                codes.append(pairs)
                times.append(often.astype(np.int32))
                ends.append(ends[-1] + len(pairs))
            cols = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 4
            offsets = pa.array(ends, pa.int32())
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.zeros(0, t)]).astype(t), k))
                for x, t, k in ((codes, np.int64, pa.int64()), (times, np.int32, pa.int32()))
            ]
            yield pa.StructArray.from_arrays([*cols, pa.array(digests, pa.string()), *lists], names=[f.split()[0] for f in RESULT.split(", ")])

    return run(F.col(text_col))


def groups_of(text_col: str, a_path: str, b_path: str) -> Column:
    """The groups of a text as text, ``a1,a2|b1;a3|b2,b3``."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = aligner(a_path, b_path)
        for texts in batches:
            yield pa.array([r.groups[:-1].decode() for r in one.texts(texts.to_pylist())], pa.string())

    return run(F.col(text_col))


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, a, b, n_docs, best) over all documents; ``best``: no other pair of that A id is in more documents.

    Tasks count the pairs they hold before the shuffle; an A id has at most ``b_size`` pairs, so its window is bounded.
    """
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    a = F.expr(f"pair div {b_size}")
    table = counted.withColumn("a", a).withColumn("b", F.col("pair") - F.col("a") * b_size)
    return table.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a"))).select("pair", "a", "b", "n_docs", "best")


def link_scores(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): every document's counts, digest, n_best and count_sum; the corpus table of pairs."""
    rows = docs.select("doc_id", align("text", a_path, b_path).alias("_a")).select("doc_id", "_a.*")
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "alignment-rows")
    pairs = written(pair_counts(rows, sentence_model(b_path).get_piece_size()), "alignment-pairs")
    links = rows.select("_row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    scored = lookup_join(links, pairs.select("pair", "n_docs", "best"), "pair", ["_row"])
    sums = scored.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = rows.drop("pairs", "times").join(sums, "_row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), pairs
