"""Token ids as binary shards: fixed-size id blocks, bit-plane or byte-plane shuffled, zstandard per plane, a chunk index.

``encode`` turns texts into ids, ``write`` stores them, encoded, in ascending document order as one shard file per partition,
``read`` gives them back. ``IdPlanes`` is the Spark data source behind both, so Spark's commit protocol covers the
files: a task writes under a name of its own, and only files named by a commit that reached the driver enter the
manifest; what lost executors or failed attempts leave behind is never read.

Shard layout (little-endian)::

    "IDPLANE1" | planes of block 0 | planes of block 1 | ... | documents | index | index length (8 bytes) | "IDPLANE1"

A block is ``block`` consecutive ids (the last may be shorter) as unsigned 32-bit integers, transposed into 4 byte
planes or 32 bit planes, each compressed on its own. ``documents`` are the document ids, their validity and their
lengths, compressed. ``index`` is JSON: kind of planes, counts, and per block the offset, the ids, the compressed
length of every plane and the crc32 of the ids. A block is found and checked from the index alone.

Defined cases: a null or empty text has the end id only. Documents are ordered by id, null ids first; rows that share an
id by text hash, equal rows in any order (they hold the same ids). Texts of any length are encoded in slices between
cuts (``words``); a very long text without any space is encoded whole. Columns besides id and text are ignored. An empty table writes
shards without documents. Document ids are integers.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .words import BytePairIds, Memo, cuts_hold, slices, tokenizer

MAGIC = b"IDPLANE1"
#: Ids of a block.
BLOCK = 1 << 16
#: Elements of texts kept by a worker with their ids; memory only, results do not depend on it.
KEPT_PIECES = 700_000
#: Bytes of texts encoded at a time; a longer text goes in slices between cuts.
PART_BYTES = 8 << 20
#: Compression level of the planes.
LEVEL = 3
SCHEMA = "shard int, doc_id bigint, start bigint, n_tokens bigint, ids binary"
MANIFEST = "_manifest.json"
#: Bytes of ids handed to Spark at a time.
BATCH_BYTES = 4 << 20

# ---------------------------------------------------------------- texts to ids

_ENCODERS: dict = {}
SPACE, LETTER, MARK, DIGIT, OTHER = range(5)


def _kinds() -> np.ndarray:
    """The kind of every byte of UTF-8; letters are A-Z, a-z and, by their two bytes, U+00C0 to U+00FF."""
    kinds = np.full(256, OTHER, np.uint8)
    kinds[33:127] = MARK
    kinds[[ord(c) for c in "'<>"]] = OTHER
    kinds[[9, 10, 11, 12, 13, 32]] = SPACE
    kinds[48:58] = DIGIT
    kinds[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = LETTER
    return kinds


KINDS = _kinds()


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive texts of about ``PART_BYTES`` with the row of the first; a longer text comes in slices, each a part of its row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    i = 0
    while i < len(texts):
        if sizes[i] > PART_BYTES:
            yield from ((i, pa.array([s], pa.string())) for s in slices(texts[i].as_py()))
            i += 1
        else:
            j = int(np.searchsorted(ends, ends[i] - sizes[i] + PART_BYTES, "right"))
            yield i, texts.slice(i, j - i)
            i = j


def _elements(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(elements of all texts, where each text's begin): what stands between ASCII white space, and that white space itself.

    Pieces of Latin letters, marks and digits alone are cut into the tokenizer's words, letters A-Z in small; a piece with
    any other character stays whole, because apostrophes, special tokens and normal forms reach over such cuts.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    begins = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[begins[0] : begins[-1]]
    begins = begins - begins[0]
    if not len(raw):
        return pa.array([], pa.binary()), begins
    kind = KINDS[raw]
    kind[1:][(raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))] = OTHER  # the signs of multiplication and division
    cut = kind == DIGIT
    cut[1:] |= kind[1:] != kind[:-1]
    cut[begins[begins < len(raw)]] = True
    at = np.flatnonzero(cut).astype(np.int32)
    kind = kind[at]
    first = np.zeros(len(at), bool)
    first[np.searchsorted(at, begins[begins < len(raw)])] = True
    first[1:] |= kind[:-1] == SPACE
    first &= kind != SPACE
    piece = np.cumsum(first, dtype=np.int32)
    odd = np.zeros(piece[-1] + 1, bool)
    odd[piece[kind == OTHER]] = True
    odd = odd[piece]
    kept = first | (kind == SPACE) | ~odd
    at, small = at[kept], ((kind == LETTER) & ~odd)[kept]
    ends = np.append(at[1:], np.int32(len(raw)))
    raw = raw + ((raw - 65 < 26) & np.repeat(small, ends - at)) * np.uint8(32)
    return binaries(raw.tobytes(), ends - at), np.searchsorted(at, begins)


def _of_pieces(memo: Memo, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids of each); only a part's distinct elements become Python values and are looked up."""
    elements, begins = _elements(texts)
    if not len(elements):
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    coded = elements.dictionary_encode()
    values = memo.distinct(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    taken = binaries(b"".join(values), np.fromiter(map(len, values), np.int64, len(values))).take(coded.indices)
    _, ends, data = taken.buffers()
    ends = np.frombuffer(ends, np.int32, len(taken) + 1) // 4
    return np.frombuffer(data or b"", np.uint32, ends[-1]), np.diff(ends[begins])


def _encoder(path: str, end_id: int | None):
    """texts -> (ids of all texts, ids of each); a worker keeps the elements of texts it has met."""
    if (path, end_id) in _ENCODERS:
        return _ENCODERS[path, end_id]
    model = tokenizer(path)
    how = cuts_hold(model)
    ids_of_words = BytePairIds(model, how)
    memo = Memo(lambda pieces: [x.tobytes() for x in ids_of_words([p.decode() for p in pieces])], limit=KEPT_PIECES)

    def whole(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [model.encode(t, add_special_tokens=False).ids if t else [] for t in texts.to_pylist()]
        return np.array([*chain.from_iterable(found)], np.uint32), np.array([*map(len, found)], np.int64)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        runs, sizes = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for row, part in _parts(texts) if how == "dropped" else [(0, texts)]:
            ids, each = _of_pieces(memo, part) if how == "dropped" else whole(part)
            runs.append(ids)
            sizes[row : row + len(each)] += each
        ids = np.concatenate(runs).astype("<u4")
        return (ids, sizes) if end_id is None else (np.insert(ids, np.cumsum(sizes), end_id), sizes + 1)

    _ENCODERS[path, end_id] = encode
    return encode


def encode(text_col: str, tokenizer_path: str, end_id: int | None = None) -> Column:
    """The ids of a text as binary, little-endian unsigned 32-bit integers, with ``end_id`` behind them."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        many = _encoder(tokenizer_path, end_id)
        for texts in batches:
            ids, sizes = many(texts)
            yield binaries(ids.tobytes(), 4 * sizes)

    return run(F.col(text_col))


def binaries(data: bytes, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of ``sizes`` bytes as binary values."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


# ---------------------------------------------------------------- blocks


def planes_of(ids: np.ndarray, kind: str) -> np.ndarray:
    """Rows are the planes of a block: 4 rows of bytes, or 32 rows of packed bits (lowest bit first)."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if kind == "byte":
        return np.ascontiguousarray(rows)
    bits = (rows[:, None, :] >> np.arange(8, dtype=np.uint8)[None, :, None]) & 1
    return np.packbits(bits.reshape(32, -1), axis=1, bitorder="little")


def ids_of(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        rows = np.frombuffer(b"".join(planes), np.uint8).reshape(4, n)
    else:
        packed = np.frombuffer(b"".join(planes), np.uint8).reshape(32, -1)
        bits = np.unpackbits(packed, axis=1, count=n, bitorder="little").reshape(4, 8, n)
        rows = (bits << np.arange(8, dtype=np.uint8)[None, :, None]).sum(axis=1, dtype=np.uint8)
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


class ShardWriter:
    """Writes one shard to an open binary stream; holds one block and two numbers a document."""

    def __init__(self, out, kind: str = "byte", block: int = BLOCK):
        self.out, self.kind, self.block = out, kind, block
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.at, self.blocks, self.pending, self.waiting = len(MAGIC), [], [], 0
        self.docs: list[np.ndarray] = []
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.stack([doc_ids, valid, lengths]).astype("<i8"))
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            rest = np.concatenate(self.pending)
            full = len(rest) // self.block * self.block
            for k in range(0, full, self.block):
                self._block(rest[k : k + self.block])
            self.pending, self.waiting = [rest[full:].copy()], len(rest) - full

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.pack(p.tobytes()) for p in planes_of(ids, self.kind)]
        self.blocks.append([self.at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), [len(p) for p in packed]])
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> tuple[int, int]:
        """(documents, ids) written."""
        rest = np.concatenate(self.pending) if self.pending else np.zeros(0, "<u4")
        if len(rest):
            self._block(rest)
        docs = np.concatenate(self.docs, axis=1) if self.docs else np.zeros((3, 0), "<i8")
        table = self.pack(docs.tobytes())
        n_docs, n_ids = docs.shape[1], sum(b[1] for b in self.blocks)
        index = json.dumps({"kind": self.kind, "docs": [self.at, n_docs, len(table)], "ids": n_ids, "blocks": self.blocks}).encode()
        self.out.write(table + index + len(index).to_bytes(8, "little") + MAGIC)
        return n_docs, n_ids


class ShardReader:
    """Random access to a shard through its index."""

    def __init__(self, file):
        self.file = file
        tail = len(MAGIC) + 8
        size = file.seek(0, 2)
        file.seek(size - tail)
        end = file.read(tail)
        if end[8:] != MAGIC:
            raise ValueError("not an id shard, or cut short")
        n = int.from_bytes(end[:8], "little")
        file.seek(size - tail - n)
        self.index = json.loads(file.read(n))
        self.unpack = zstandard.ZstdDecompressor().decompress

    def documents(self) -> np.ndarray:
        """Rows: document ids, validity, lengths."""
        at, n, size = self.index["docs"]
        self.file.seek(at)
        return np.frombuffer(self.unpack(self.file.read(size)), "<i8").reshape(3, n)

    def block(self, k: int) -> np.ndarray:
        at, n, crc, sizes = self.index["blocks"][k]
        self.file.seek(at)
        data = self.file.read(sum(sizes))
        cuts = np.cumsum([0, *sizes])
        ids = ids_of([self.unpack(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], n, self.index["kind"])
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def ranges(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, end document, their ids) as blocks complete them."""
        ends = np.cumsum(self.documents()[2])
        first, start, held = 0, 0, []
        have = 0
        for k in range(len(self.index["blocks"])):
            ids = self.block(k)
            held.append(ids)
            have += len(ids)
            end = int(np.searchsorted(ends, have, "right"))
            if end > first:
                run = np.concatenate(held)
                done = int(ends[end - 1]) - start
                yield first, end, run[:done]
                first, start, held = end, start + done, [run[done:].copy()]


# ---------------------------------------------------------------- Spark data source


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    docs: int
    ids: int


@dataclass
class Shard(InputPartition):
    number: int
    name: str
    start: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.kind, self.block = options["path"], options.get("planes", "byte"), int(options.get("block", BLOCK))
        self.tokenizer, self.end_id = options.get("tokenizer"), int(options["end_id"]) if "end_id" in options else None

    def write(self, iterator):
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(self.path)
        part = TaskContext.get().partitionId()
        name = f"shard-{part:06d}-{uuid.uuid4().hex}.idp"
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}") as out:
            shard = ShardWriter(out, self.kind, self.block)
            for batch in iterator:
                keys = batch.column(0).cast(pa.int64())
                if self.tokenizer:
                    ids, sizes = _encoder(self.tokenizer, self.end_id)(batch.column(1))
                else:
                    rows = batch.column(1).to_pylist()
                    ids, sizes = np.frombuffer(b"".join(rows), "<u4"), np.fromiter(map(len, rows), np.int64, len(rows)) // 4
                valid = keys.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
                shard.add(keys.fill_null(0).to_numpy(zero_copy_only=False), valid, sizes, ids)
            docs, n = shard.close()
        return Written(part, name, docs, n)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        rows = sorted((m.partition, m.name, m.docs, m.ids) for m in messages if m is not None)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}.tmp") as out:
            out.write(json.dumps([r[1:] for r in rows]).encode())
        store.move(f"{root}/{MANIFEST}.tmp", f"{root}/{MANIFEST}")

    def abort(self, messages) -> None:
        """Nothing to undo: files without a manifest are not read."""


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(f"{root}/{MANIFEST}") as f:
            shards = json.loads(f.read())
        out, start = [], 0
        for number, (name, docs, ids) in enumerate(shards):
            if docs:
                out.append(Shard(number, name, start))
            start += ids
        return out or [Shard(-1, "", 0)]

    def read(self, partition):
        from pyarrow import fs

        if partition.number < 0:
            return
        store, root = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(f"{root}/{partition.name}") as f:
            shard = ShardReader(f)
            keys, valid, lengths = shard.documents()
            starts = partition.start + np.cumsum(lengths) - lengths
            for a, b, ids in shard.ranges():
                cuts = [a]  # batches of bounded size; a longer document is a batch of its own
                ends = np.cumsum(lengths[a:b])
                while cuts[-1] < b:
                    base = int(ends[cuts[-1] - a - 1]) if cuts[-1] > a else 0
                    cuts.append(max(cuts[-1] + 1, a + int(np.searchsorted(ends, base + BATCH_BYTES // 4, "right"))))
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    base = int(ends[lo - a - 1]) if lo > a else 0
                    n = lengths[lo:hi]
                    data = ids[base : base + int(n.sum())].tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(hi - lo, partition.number, np.int32)),
                            pa.array(keys[lo:hi], mask=valid[lo:hi] == 0),
                            pa.array(starts[lo:hi]),
                            pa.array(n),
                            binaries(data, 4 * n),
                        ],
                        names=["shard", "doc_id", "start", "n_tokens", "ids"],
                    )


class IdPlanes(DataSource):
    """``spark.read.format("id_planes")`` and ``df.write.format("id_planes")``; options: planes (byte or bit), block.

    Rows to write are (doc_id, ids as little-endian 32-bit integers), or (doc_id, text) with the options tokenizer and end_id:
    the writing task then encodes them itself, so that ids do not travel between Python workers.
    """

    @classmethod
    def name(cls) -> str:
        return "id_planes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, planes: str = "byte", block: int = BLOCK) -> None:
    """Encode ``docs`` (doc_id, text) and write the shards below ``path``, a new folder that all executors share.

    Texts are dealt out by ranges of doc_id, so shards follow each other in that order; one id shared by very many rows is
    spread by text hash and row. Ids are made behind the shuffle, by the task that writes them.
    """
    spark = docs.sparkSession
    spark.dataSource.register(IdPlanes)
    rows = docs.select("doc_id", F.col("text").alias("_text"), F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_m"))
    order = [F.asc_nulls_first("doc_id"), F.asc("_h"), F.asc("_m")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    out = dealt.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("_text").alias("text")).write.format("id_planes")
    if end_id is not None:
        out = out.option("end_id", end_id)
    out.option("tokenizer", tokenizer_path).option("planes", planes).option("block", block).mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_id, start, n_tokens, ids) of shards below ``path``; ``start`` counts the ids of all documents before."""
    spark.dataSource.register(IdPlanes)
    return spark.read.format("id_planes").load(path)
