"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint is the bitwise majority of the 64-bit hashes of its
word shingles. Two fingerprints link when at most ``radius`` bits differ.

Every bit position is given a nonzero code of ``radius + 1`` bits; table v
(one per nonzero v) keys a fingerprint by the bits whose code has an odd
inner product with v. At most ``radius`` differing bits span at most
``radius`` dimensions, so some v is orthogonal to all their codes and that
table keeps none of them: the pair collides there for certain. For radius 3
that is 15 tables of 32 to 36 key bits each.

Equal fingerprints are folded first, so copies never meet as pairs. Buckets
with more members than ``BUCKET_ROWS`` go through a second covering over the
bits their key left free; what then shares a bucket differs only in the few
bits neither key holds, which bounds it. Inside a bucket a task works on
blocks of a distance matrix and returns only a spanning forest of the links.
Components of the link graph come from alternating star contraction with
grouped minima and joins.

Defined cases: null or wordless text has fingerprint zero and links like any
other; a null doc_id takes part in linking but is never a component id (a
component of null ids only has a null id); repeated rows each get a row;
an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Buckets above this many distinct fingerprints are split by the second covering.
BUCKET_ROWS = 1024
#: Rows of the distance matrix computed at a time.
BLOCK = 512


def fingerprint_of(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of UTF-8 text: A-Z lowered, ASCII white space splits words, shingles keep repeats."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[s:e - 1], SEED) for s, e in zip(ends, ends[k:], strict=False)], dtype="<u8"
    )
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    ones = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(ones.view("<u8")[0])


def fingerprint(text_col: str, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Fingerprint as a signed long (the same 64 bits)."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        out = np.fromiter((fingerprint_of(t.as_py(), shingle_words) for t in texts), dtype=np.uint64, count=len(texts))
        return pa.array(out.view(np.int64), type=pa.int64())

    return run(F.col(text_col).cast("binary"))


def covering_masks(radius: int, bits: list[int], turn: int = 0) -> list[int]:
    """One mask per nonzero vector of ``radius + 1`` bits; ``bits`` get the nonzero codes in rotation."""
    codes = (1 << (radius + 1)) - 1
    code = {b: (i + turn) % codes + 1 for i, b in enumerate(bits)}
    return [
        sum(1 << b for b in bits if (code[b] & v).bit_count() % 2)
        for v in range(1, codes + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask_array(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)) for m in masks])


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within one bucket of distinct fingerprints."""
    n = len(values)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges = []
    u = values.view(np.uint64)
    for at in range(0, n, BLOCK):
        part = u[at:at + BLOCK]
        near = np.bitwise_count(part[:, None] ^ u[None, at:]) <= radius
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            a, b = find(at + int(i)), find(at + int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((int(values[at + i]), int(values[at + j])))
    return edges


def _bucket_links(buckets: DataFrame, radius: int, keys: list[str]) -> DataFrame:
    """Links (a, b) inside each bucket; buckets arrive whole and sorted, one after another, in a partition."""

    def run(batches):
        carry_key, carry = None, []

        def flush():
            found = _forest(np.concatenate(carry), radius) if carry else []
            return pa.RecordBatch.from_pydict(
                {"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())}
            )

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            if not len(fps):
                continue
            change = np.zeros(len(fps), dtype=bool)
            change[0] = True
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(change)
            for s, e in zip(starts, [*starts[1:], len(fps)], strict=True):
                key = tuple(int(c[s]) for c in cols)
                if key != carry_key:
                    if sum(map(len, carry)) > 1:
                        yield flush()
                    carry_key, carry = key, []
                carry.append(fps[s:e])
        if sum(map(len, carry)) > 1:
            yield flush()

    return (
        buckets.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "a long, b long")
    )


def covering_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column ``fp``) whose closure has every pair within ``radius`` bits."""
    masks = covering_masks(radius, list(range(64)))
    keyed = fps.select(
        "fp", F.posexplode(F.transform(_mask_array(masks), lambda m: F.col("fp").bitwiseAND(m))).alias("t", "key")
    )
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    sizes = written(sizes, "simhash-buckets")
    two = sizes.filter(f"n = 2 and bit_count(a ^ b) <= {int(radius)}").select("a", "b")
    shared = written(keyed.join(sizes.filter("n > 2").select("t", "key", "n"), ["t", "key"]), "simhash-shared")
    links = two.unionByName(_bucket_links(shared.filter(F.col("n") <= BUCKET_ROWS), radius, ["t", "key"]))

    # second covering, over the bits that the first key left free
    free = [covering_masks(radius, [b for b in range(64) if not m >> b & 1], turn=7) for m in masks]
    second = F.element_at(F.array(*[_mask_array(ms) for ms in free]), F.col("t") + 1)
    hot = shared.filter(F.col("n") > BUCKET_ROWS).select(
        "t", "key", "fp", F.posexplode(F.transform(second, lambda m: F.col("fp").bitwiseAND(m))).alias("t2", "key2")
    )
    return links.unionByName(_bucket_links(hot, radius, ["t", "key", "t2", "key2"])).distinct()


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of an undirected edge list (a, b); root is the smallest node of its component.

    Alternating large-star / small-star contraction. Both steps are a grouped
    minimum (partial per task) and a join, so a hub is never gathered in one
    task; every round is written to the shared folder.
    """

    def hashes(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    now = written(edges.filter("a != b").select("a", "b"), "simhash-star")
    state = hashes(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        now = written(small(large(now)), "simhash-star")
        after = hashes(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``id_col``, ``fp`` (long), ``group``, ``component_id``, and the columns named in ``keep``.

    ``group`` (a fingerprint of the component) tells components apart where
    ids repeat; ``component_id`` is the smallest id of the component. The
    result is narrow; texts are read once, for the fingerprint.
    """
    cols = [F.col(id_col), *[F.col(c) for c in keep or []]]
    prints = written(docs.select(*cols, fingerprint(text_col, shingle_words).alias("fp")), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")), "simhash-nodes")
    roots = components(covering_links(nodes.select("fp"), radius))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = placed.join(least, "root").select("fp", F.col("root").alias("group"), "component_id")
    return prints.join(labels, "fp", "left").select(id_col, *(keep or []), "fp", "group", "component_id")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
