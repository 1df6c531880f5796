"""Target-distribution importance resampling with an Aho-Corasick dictionary of payload words.

Words carry two CRC-32 values (of the word, and of a space and the word) and their length in bytes. A dictionary of distinct
words, each between delimiters, is an Aho-Corasick automaton: one scan over a buffer of texts emits the payload of every
word it knows. Payloads of adjacent words compose: appending n bytes multiplies a CRC by x^(8n), a linear map that
is tabled per length, so the CRC of "a b c" comes from three payloads without touching its bytes again. Runs of one to
three words are features, hashed to ``BUCKETS`` buckets.

A worker's dictionary starts empty and takes the words that the worker meets again, up to ``DICTIONARY_WORDS`` of at most
``WORD_BYTES`` bytes; any other word gets the same payload computed in place. Both bounds hold memory only: results do
not depend on what the dictionary knows.

Buckets are counted over all texts of the corpus and of the target; a bucket's gain is 1000 times the log of the ratio of the
smoothed shares, rounded down. A document's weight is the sum of its features' gains; Gumbel noise from a hash of its id
turns the highest scores into a sample without replacement.

Defined cases: a null or empty text has no words, weight 0 and is never drawn. A null doc_id takes the noise of the
empty id and ranks behind ties. Rows that share an id share noise; ties go to the smaller id, equal rows in stored order.
Buffers are cut between words at ``PIECE`` bytes, so a text of any length is scanned in parts, with the last two words carried over.
An empty corpus or target counts zero features. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order_stats import select_rank
from ..functions.sizing import collect_bounded
from .common import written

BUCKETS = 10_000
DICTIONARY_WORDS, WORD_BYTES = 100_000, 64
#: Bytes scanned at a time.
PIECE = 2 << 20
SEED = 42
MIN_WORDS, DRAW_PERCENT = 20, 5

#: A-Z to a-z; every other ASCII character that is no digit or small letter to a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def shift_tables(longest: int) -> np.ndarray:
    """[n, k, v]: what v in byte k of a CRC becomes when n bytes are appended (the CRC of those bytes comes on top)."""
    zero = zlib.crc32(b"\0")
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    out[0] = [[v << 8 * k for v in range(256)] for k in range(4)]
    out[1] = [[zlib.crc32(b"\0", v << 8 * k) ^ zero for v in range(256)] for k in range(4)]
    for n in range(2, longest + 1):
        out[n] = shifted(out, out[n - 1], np.ones((), np.int64))
    return out


def shifted(tables: np.ndarray, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (tables[n, 0, crc & 255] ^ tables[n, 1, crc >> 8 & 255]) ^ (tables[n, 2, crc >> 16 & 255] ^ tables[n, 3, crc >> 24])


class PayloadDictionary:
    """Distinct words with payloads (crc of the word, crc of space and word, bytes) behind an automaton."""

    def __init__(self, limit: int = DICTIONARY_WORDS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.limit, self.size, self.fresh, self.ready = limit, 0, {}, False
        self.crc, self.led, self.bytes = (np.zeros(max(1, limit), t) for t in (np.uint32, np.uint32, np.int64))

    def offer(self, word: bytes, crc: int, led: int) -> None:
        if len(word) <= WORD_BYTES and self.size + len(self.fresh) < self.limit:
            self.fresh[word] = (crc, led, len(word))

    def settle(self) -> None:
        """Take offered words in once they are worth a rebuild."""
        if len(self.fresh) > max(500, self.size // 4) or (self.fresh and self.size + len(self.fresh) >= self.limit):
            for word, payload in self.fresh.items():
                self.crc[self.size], self.led[self.size], self.bytes[self.size] = payload
                self.automaton.add_word(" " + word.decode("latin-1") + " ", self.size)
                self.size += 1
            self.fresh = {}
            self.automaton.make_automaton()
            self.ready = True

    def scan(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the delimiters behind known words, their entries), in text order."""
        if not self.ready:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(buffer.decode("latin-1"))), np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]


class Scanner:
    """Buckets of the features of texts; keeps a task's dictionary."""

    def __init__(self, limit: int = DICTIONARY_WORDS, piece: int = PIECE):
        self.dictionary, self.piece = PayloadDictionary(limit), piece
        self.tables = shift_tables(WORD_BYTES + 1)

    def payloads(self, buffer: bytes) -> tuple:
        """(start, crc, led crc, bytes) of every word of a buffer that begins and ends with a space, and the long words."""
        space = np.frombuffer(buffer, np.uint8) == 32
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        entry = np.full(len(starts), -1, np.int64)
        at, known = self.dictionary.scan(buffer)
        entry[np.searchsorted(ends, at)] = known
        d = self.dictionary
        crc, led, size = d.crc[entry], d.led[entry], ends - starts
        met: dict[bytes, tuple[int, int]] = {}
        unknown = np.flatnonzero(entry < 0)
        values = []
        for a, b in zip(starts[unknown].tolist(), ends[unknown].tolist(), strict=True):
            w = buffer[a:b]
            p = met.get(w)
            if p is None:
                p = met[w] = (zlib.crc32(w), zlib.crc32(buffer[a - 1 : b]))
            else:  # met again: worth an entry
                d.offer(w, *p)
            values.append(p)
        if values:
            crc[unknown], led[unknown] = np.array(values, np.uint32).T
        d.settle()
        return starts, crc, led, size

    def features(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per piece: text numbers of its words, then the buckets of the runs of 1, 2, 3 words ending at each (-1: no such run)."""
        folded = [(t or b"").translate(_FOLD) for t in texts]
        buffer = b" " + b" ".join(folded) + b" "
        firsts = np.cumsum([1, *(len(t) + 1 for t in folded)])
        del folded
        start = 0
        carry = (np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        while start < len(buffer) - 1:
            end = buffer.find(b" ", start + self.piece)
            end = len(buffer) - 1 if end < 0 else end
            at, crc, led, size = self.payloads(buffer[start : end + 1])
            text = np.searchsorted(firsts, at + start, "right") - 1
            k = len(carry[0])
            text, crc, led, size, at = (np.concatenate([a, b]) for a, b in zip(carry, (text, crc, led, size, at + start), strict=True))
            two, three = np.full(len(crc), -1, np.int64), np.full(len(crc), -1, np.int64)
            pair = np.zeros(len(crc), np.uint32)
            if len(crc) > 1:
                pair[1:] = self._append(buffer, crc[:-1], led[1:], size[1:], at[1:])
                two[1:] = np.where(text[1:] == text[:-1], pair[1:].astype(np.int64) % BUCKETS, -1)
            if len(crc) > 2:
                triple = self._append(buffer, pair[1:-1], led[2:], size[2:], at[2:])
                three[2:] = np.where(text[2:] == text[:-2], triple.astype(np.int64) % BUCKETS, -1)
            yield text[k:], crc[k:].astype(np.int64) % BUCKETS, two[k:], three[k:]
            carry = tuple(x[-2:] for x in (text, crc, led, size, at))
            start = end

    def _append(self, buffer: bytes, crc: np.ndarray, led: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        """CRC of (text of ``crc``, space, word): composed from the payloads; long words are read on instead."""
        out = shifted(self.tables, crc, np.minimum(size, WORD_BYTES) + 1) ^ led.astype(np.uint32)
        for i in np.flatnonzero(size > WORD_BYTES).tolist():
            out[i] = zlib.crc32(buffer[int(at[i]) : int(at[i] + size[i])], zlib.crc32(b" ", int(crc[i])))
        return out


_SCANNERS: list[Scanner] = []


def scanner() -> Scanner:
    """One per process, so that the next task goes on with the words met before."""
    if not _SCANNERS:
        _SCANNERS.append(Scanner())
    return _SCANNERS[0]


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features per bucket over all texts: every task counts, the counts are added up by bucket (``BUCKETS`` rows)."""

    def run(batches):
        scan, total = scanner(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, *runs in scan.features(batch.column(0).cast(pa.binary()).to_pylist()):
                for b in runs:
                    total += np.bincount(b[b >= 0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in collect_bounded(counted.groupBy("bucket").agg(F.sum("n").alias("n")), BUCKETS, "bucket counts"):
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) per bucket, in doubles."""
    s, t = corpus.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def weigh(text_col: str, gain: list[int]) -> Column:
    """Struct (n_words, n_features, weight) of a text."""

    @F.arrow_udf("n_words long, n_features long, weight long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = scanner()
        table = np.array([*gain, 0], float)  # the last entry answers bucket -1
        for texts in batches:
            n = len(texts)
            words, feats, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for text, *runs in scan.features(texts.cast(pa.binary()).to_pylist()):
                words += np.bincount(text, minlength=n)
                for b in runs:
                    feats += np.bincount(text[b >= 0], minlength=n)
                    weight += np.bincount(text, weights=table[b], minlength=n)  # whole numbers, exact below 2^53
            yield pa.StructArray.from_arrays([pa.array(words), pa.array(feats), pa.array(weight.astype(np.int64))], names=["n_words", "n_features", "weight"])

    return run(F.col(text_col))


def noise(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 8 hex digits of sha256("seed:id")."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, percent: int = DRAW_PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) rows with their rank among the drawn ones, null if undrawn.

    The lowest drawn score is found by refining counts; only rows from there up are sorted, by ranges. Ranks follow from the
    rows of each sorted partition and those before it.
    """
    rows = written(scored.withColumn("_row", F.monotonically_increasing_id()), "importance-scores")
    fit = F.col("n_words") >= min_words
    k = rows.filter(fit).count() * percent // 100
    cut = select_rank(rows.filter(fit), "score", F.col("n") - F.lit(k) + 1).first() if k else None
    if cut is None:
        return rows.drop("_row").withColumn("rank", F.lit(None).cast("long"))
    top = fit & (F.col("score") >= F.lit(cut["value"]))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    placed = rows.filter(top).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "importance-drawn")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # one row per partition
    offsets = sizes.select("_part", before.alias("_before"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    rank = (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")
    ranked = ranked.withColumn("rank", F.when(rank <= k, rank))
    kept = [*[c for c in rows.columns if c != "_row"], "rank"]
    rest = rows.filter(~top).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*kept).unionByName(rest.select(*kept))


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAW_PERCENT, seed: int = SEED) -> DataFrame:
    """Score every document (doc_id, text) against the texts of ``target`` and draw ``percent`` of the eligible ones."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    w = docs.select("doc_id", weigh("text", gain).alias("_w")).select("doc_id", "_w.*")
    return draw(w.withColumn("score", F.col("weight") + noise("doc_id", seed)), percent)
