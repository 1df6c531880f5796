"""Benchmark decontamination with a document-partitioned positional inverted index.

``build_index`` tokenises the corpus once and stores token postings as a
Parquet table of segments. A segment covers the documents of one task up to
about ``SEGMENT_TOKENS`` tokens and holds a term dictionary plus, per term,
its (document, position) list. Only terms that occur in the test set are
stored when the test vocabulary is small enough to send to the tasks; beyond
``VOCAB_TERMS`` every term is stored.

``match`` reads segments and answers all test windows against each of them.
A window's lists are intersected from its rarest term in that segment on:
each occurrence proposes a start, and the other terms' offset-adjusted lists
are probed in order of rarity, so most windows end after one or two lists.
A start that survives with displacement zero everywhere is an exact phrase.
A whole window whose terms all occur in a document, displaced from their
places by amounts at most ``SLACK`` apart, is a proximity match; all common
shifts around the anchor are tried, so neither the anchor nor the segment
decides what matches. No posting is shuffled: a segment is one row. Test sets
larger than ``BLOCK_WORDS`` words are taken in blocks, each matched against
the whole index.

Defined cases: null text has no words; an item without words is never
matched; items with equal texts all count; a null item_id marks words but is
in no item list; repeated documents each get a row; empty tables give rows
without hits or no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import is_small
from .common import written

WINDOW = 10
SLACK = 2
#: Tokens (stored postings and others) after which a task closes a segment.
SEGMENT_TOKENS = 1 << 18
#: Largest test vocabulary sent to the tasks as an index filter.
VOCAB_TERMS = 2_000_000
#: Words of test items matched in one pass over the index.
BLOCK_WORDS = 1_000_000
#: Starts examined together inside a segment.
CANDIDATES = 1 << 20

#: Word bytes: digits, a-z and everything beyond ASCII; A-Z lowered, the rest separates.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)

INDEX_SCHEMA = (
    "segment string, doc_ids array<long>, doc_keys array<long>, n_words array<int>, "
    "terms array<binary>, starts array<int>, docs array<int>, positions array<int>"
)
MATCH_SCHEMA = (
    "segment string, ord int, doc_id long, doc_key long, n_words long, spans array<struct<start:int,end:int>>, "
    "items array<long>, near_items array<long>"
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list holding all of ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


class _Segment:
    """Postings of one segment while it is filled."""

    def __init__(self, vocab: dict[bytes, int] | None):
        self.vocab = vocab
        self.terms: dict[bytes, int] = {} if vocab is None else vocab
        self.ids: list = []
        self.keys: list = []
        self.sizes: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.tokens = 0

    def add(self, doc_id, doc_key, text: bytes | None) -> None:
        words = words_of(text)
        if self.vocab is None:
            known = self.terms
            codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        else:
            get = self.terms.get
            codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(codes >= 0)
        self.parts.append((codes[at], at))
        self.ids.append(doc_id)
        self.keys.append(doc_key)
        self.sizes.append(len(words))
        self.tokens += len(words) + 16

    def row(self, name: str) -> pa.RecordBatch:
        codes = np.concatenate([c for c, _ in self.parts])
        pos = np.concatenate([p for _, p in self.parts])
        doc = np.repeat(np.arange(len(self.parts)), [len(c) for c, _ in self.parts])
        order = np.argsort(codes, kind="stable")
        codes, pos, doc = codes[order], pos[order], doc[order]
        used, starts = np.unique(codes, return_index=True)
        back = {i: w for w, i in self.terms.items()} if self.vocab is None else self.back
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name]),
                _lists(self.ids, pa.int64()), _lists(self.keys, pa.int64()), _lists(self.sizes, pa.int32()),
                _lists([back[i] for i in used.tolist()], pa.binary()),
                _lists(np.append(starts, len(codes)), pa.int32()), _lists(doc, pa.int32()), _lists(pos, pa.int32()),
            ],
            names=["segment", "doc_ids", "doc_keys", "n_words", "terms", "starts", "docs", "positions"],
        )


def build_index(docs: DataFrame, vocab: list[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text",
                segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Store token postings of ``docs`` (of the terms in ``vocab``, or of all terms) and return the stored table."""
    sent = None if vocab is None else docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        terms = None if sent is None else {w: i for i, w in enumerate(sent.value)}

        def fresh() -> _Segment:
            s = _Segment(terms)
            s.back = None if sent is None else sent.value
            return s

        seg = fresh()
        for batch in batches:
            for i, k, t in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                seg.add(i.as_py(), k.as_py(), t.as_py())
                if seg.tokens >= segment_tokens:
                    yield seg.row(f"{task}-{made}")
                    seg, made = fresh(), made + 1
        if seg.ids:
            yield seg.row(f"{task}-{made}")

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("doc_key"), F.col(text_col).cast("binary").alias("t")
    )
    return written(rows.mapInArrow(run, INDEX_SCHEMA), "decontaminate-index")


class Windows:
    """Test windows of one block of items: term codes, offsets and the items each window stands for."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, words in items:
            if len(words) >= window:
                for i in range(len(words) - window + 1):
                    owners[tuple(words[i:i + window])].add(item)
            elif words:
                owners[tuple(words)].add(item)
        self.vocab = sorted({w for g in owners for w in g})
        code = {w: i for i, w in enumerate(self.vocab)}
        self.window = window
        self.size = np.array([len(g) for g in owners], np.int64)
        self.code = np.full((len(owners), window), -1, np.int64)
        for r, g in enumerate(owners):
            self.code[r, :len(g)] = [code[w] for w in g]
        self.items = [sorted(x for x in s if x is not None) for s in owners.values()]


def _between(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether sorted ``keys`` hold a value from ``low`` to ``high``, for each pair of bounds."""
    i = np.searchsorted(keys, low)
    return (i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] <= high)


def _segment_matches(seg: dict, q: Windows, slack: int) -> tuple[np.ndarray, ...]:
    """(window, doc, start, exact) of all phrase matches in one segment, and of one proximity match per window and document."""
    terms, starts = seg["terms"], seg["starts"]
    sizes = seg["n_words"]
    gap = q.window + slack + 1
    base = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes + 2 * gap, out=base[1:])
    local = {w: i for i, w in enumerate(terms)}
    code = np.array([local.get(w, -1) for w in q.vocab] + [-1], np.int64)
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, bool),)
    if not len(q.code) or not len(terms):
        return none
    w = code[q.code]  # local term of each window place; -1: absent or past the end
    past = q.code < 0
    alive = np.flatnonzero(((w >= 0) | past).all(axis=1))
    if not len(alive):
        return none
    w, past, size = w[alive], past[alive], q.size[alive]
    counts = np.diff(starts)
    rarity = np.where(past, np.iinfo(np.int64).max, counts[w])
    order = np.argsort(rarity, axis=1, kind="stable")
    # postings in (term, place) order as one sorted array: lists are ranges of it
    shift = int(base[-1] + 2 * gap).bit_length()
    term_of = np.repeat(np.arange(len(terms)), counts)
    place = base[seg["docs"]] + gap + seg["positions"]
    keys = (term_of << shift) | place
    first = np.take_along_axis(w, order[:, :1], 1)[:, 0]
    cost = np.cumsum(counts[first])
    found: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(alive):
        upto = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + CANDIDATES, side="right")))
        n = counts[first[at:upto]]
        win = np.repeat(np.arange(at, upto), n)
        ramp = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = place[np.repeat(starts[first[at:upto]], n) + ramp] - np.repeat(order[at:upto, 0], n)
        exact = np.ones(len(win), bool)
        for step in range(1, q.window):
            if not len(win):
                break
            off = order[win, step]
            ends = past[win, off]
            key = (np.where(ends, 0, w[win, off]) << shift) | (begin + off)
            near = ends | _between(keys, key - slack, key + slack)
            exact &= ends | _between(keys, key, key)
            near &= exact | (size[win] == q.window)
            win, begin, exact = win[near], begin[near], exact[near]
        doc = np.searchsorted(base, begin, side="right") - 1
        start = begin - base[doc] - gap
        ok = exact & (start >= 0) & (start + size[win] <= sizes[doc])
        found.append((alive[win[ok]], doc[ok], start[ok], exact[ok]))
        whole = size[win] == q.window
        shifts = np.arange(-slack, 1)
        win, begin = np.repeat(win[whole], len(shifts)), (begin[whole][:, None] + shifts).ravel()
        for off in range(q.window):
            low = (w[win, off] << shift) | (begin + off)
            near = _between(keys, low, low + slack)
            win, begin = win[near], begin[near]
        doc = np.searchsorted(base, begin, side="right") - 1
        _, one = np.unique(win * len(base) + doc, return_index=True)  # a window is near a document or not
        found.append((alive[win[one]], doc[one], (begin - base[doc] - gap)[one], np.zeros(len(one), bool)))
        at = upto
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _match_block(index: DataFrame, q: Windows, slack: int) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        q = sent.value
        for batch in batches:
            for r in range(batch.num_rows):
                flat = lambda name, r=r, batch=batch: batch.column(name)[r].values
                seg = {n: flat(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("n_words", "starts", "docs", "positions")}
                seg["terms"] = flat("terms").to_pylist()
                by_doc: dict[int, list] = defaultdict(list)
                for win, doc, start, exact in zip(*(x.tolist() for x in _segment_matches(seg, q, slack)), strict=True):
                    by_doc[doc].append((win, start, exact))
                spans, items, near = [], [], []
                for d in range(len(seg["n_words"])):
                    hits = by_doc.get(d, ())
                    spans.append([{"start": s, "end": e} for s, e in _merged([(s, s + int(q.size[w])) for w, s, x in hits if x])])
                    exact_items = {i for w, _, x in hits if x for i in q.items[w]}
                    items.append(sorted(exact_items))
                    near.append(sorted({i for w, _, x in hits if not x for i in q.items[w]} - exact_items))
                n = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("segment")[r].as_py()] * n, pa.string()), pa.array(range(n), pa.int32()),
                        flat("doc_ids"), flat("doc_keys"), pa.array(seg["n_words"], pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array(items, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64())),
                    ],
                    names=["segment", "ord", "doc_id", "doc_key", "n_words", "spans", "items", "near_items"],
                )

    return index.mapInArrow(run, MATCH_SCHEMA)


def read_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Yield blocks of (item, words) of at most about ``BLOCK_WORDS`` words, streamed to the driver partition by partition."""
    block, n = [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).toLocalIterator():
        words = words_of(bytes(r["t"]) if r["t"] is not None else None)
        if n and n + len(words) > BLOCK_WORDS:
            yield block
            block, n = [], 0
        block.append((r["i"], words))
        n += len(words)
    yield block


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = SLACK,
          id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Index ``docs`` and return one row per document: n_words, merged exact spans (word offsets), items, near_items.

    ``doc_key`` is xxhash64 of the text; with ``doc_id`` it ties a result to its row.
    """
    vocab = None
    terms = benchmark.select(
        F.explode(F.split(F.regexp_replace(F.lower(item_text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " ")).alias("w")
    ).distinct()
    blocks = read_items(benchmark, item_col, item_text)
    first = Windows(next(blocks), window)
    rest = next(blocks, None)
    if rest is None:
        vocab = first.vocab
    elif is_small(terms, VOCAB_TERMS):
        vocab = sorted({w for b in read_items(benchmark, item_col, item_text) for _, ws in b for w in ws})
    index = build_index(docs, vocab, id_col, text_col, segment_tokens)
    out = _match_block(index, first, slack)
    if rest is None:
        return out.drop("segment", "ord")
    parts = [out, _match_block(index, Windows(rest, window), slack)]
    parts += [_match_block(index, Windows(b, window), slack) for b in blocks]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = union.groupBy("segment", "ord", "doc_id", "doc_key", "n_words").agg(
        flat("spans").alias("spans"), flat("items").alias("items"), flat("near_items").alias("near_items")
    )
    return merged.select(
        "doc_id", "doc_key", "n_words", _merge_spans("spans").alias("spans"), "items",
        F.array_except("near_items", "items").alias("near_items"),
    )


def _merge_spans(col: str):
    """Sorted, possibly overlapping spans into disjoint ones."""
    return F.expr(
        f"""aggregate({col}, cast(array() as array<struct<start:int,end:int>>), (acc, s) ->
              case when size(acc) > 0 and s.start <= acc[size(acc) - 1].end
                   then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', acc[size(acc) - 1].start, 'end', greatest(acc[size(acc) - 1].end, s.end))))
                   else concat(acc, array(s)) end)"""
    )


def report(matches: DataFrame) -> DataFrame:
    """Digest per document of ``match``'s result."""
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return matches.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )
