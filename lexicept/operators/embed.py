"""Text and token vectors: pluggable batch encoders, static word vectors, pooling.

``encode_texts`` is the one place where a model runs: a caller-supplied
encoder factory is instantiated once per Python worker and fed Arrow
batches of the text column. Everything else (token vectors from a
vector table, mean pooling, normalisation) is native Spark.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizing import BROADCAST_MAX_BYTES, lookup_join
from ..functions.vectors import vector_mean
from .text import TEXTS_AT_A_TIME, TOKEN_PATTERN, tokenize

_ENCODERS: dict = {}


def worker_encoder(factory: Callable, key: str):
    """The encoder of this Python worker, made on first use.

    Tasks reach this function by import, so ``_ENCODERS`` is the worker's own
    module-level table and outlives a task.
    """
    if key not in _ENCODERS:
        _ENCODERS[key] = factory()
    return _ENCODERS[key]


def _some_at_a_time(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Slices of ``TEXTS_AT_A_TIME`` rows: what a worker holds does not follow the batch size."""
    for whole in batches:
        for at in range(0, len(whole), TEXTS_AT_A_TIME):
            yield whole.slice(at, TEXTS_AT_A_TIME)


def _some_bytes_at_a_time(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same slices of texts, cut again beyond ``TEXT_BYTES_AT_A_TIME``; a longer text comes alone."""
    for some in _some_at_a_time(batches):
        begun = held = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(some), 0).to_pylist()):
            if i > begun and held + size > TEXT_BYTES_AT_A_TIME:
                yield some.slice(begun, i - begun)
                begun, held = i, 0
            held += size
        yield some.slice(begun)


#: Bytes of text that a Python worker turns into token vectors at once: these take a dozen times the bytes of their text.
TEXT_BYTES_AT_A_TIME = 1 << 20
#: Assumed bytes of one encoded text when the distinct texts are sized for a broadcast (1,024 floats and the key).
VECTOR_BYTES = 4096 + 64
#: Rows beyond which one text's rows are spread over several tasks; of n rows at most n / HOT_ROWS texts have so many.
HOT_ROWS = 50_000


class Md5Places(dict):
    """Token -> first 8 hex digits of its md5, mod ``dim``; the first ``KEPT`` tokens are kept, the others worked out again."""

    KEPT = 200_000

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        place = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dim
        if len(self) < self.KEPT:
            self[token] = place
        return place


class Md5Encoder:
    """Feature hashing by md5, whose arithmetic SQL can repeat: a token adds 1 to place h mod d, h its first 8 hex digits."""

    def __init__(self, dim: int = 16):
        self.dim = dim
        self._word = re.compile(r"[^\W\d_]+")
        self._place = Md5Places(dim)

    def __call__(self, texts: list) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            words = self._word.findall(t.lower()) if t else ()
            out[i] = np.bincount(np.fromiter(map(self._place.__getitem__, words), np.int64, len(words)), minlength=self.dim)
        return out


class HashingEncoder:
    """Deterministic stand-in encoder: signed feature hashing of word tokens, L2-normalised.

    Real deployments pass their own factory (a sentence-embedding model);
    the contract is ``encoder(list[str]) -> np.ndarray (n, d)``.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._word = re.compile(r"[^\W\d_]+")

    def __call__(self, texts: list) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            if not isinstance(t, str):
                continue
            for w in self._word.findall(t.lower()):
                h = zlib.crc32(w.encode("utf-8"))
                out[i, h % self.dim] += 1.0 if (h >> 16) & 1 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        np.divide(out, n, out=out, where=n > 0)
        return out


def encode_texts(df: DataFrame, text_col: str = "text", encoder_factory: Callable = HashingEncoder,
                 out_col: str = "embedding", encoder_id: str | None = None) -> DataFrame:
    """Append ``out_col array<float>`` computed by the encoder over Arrow batches of the text column alone.

    ``encoder_id`` names the encoder in a worker's table; two factories need
    two names. Without one, each call of ``encode_texts`` has its own.
    """
    key = encoder_id or uuid.uuid4().hex

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _some_at_a_time(batches):
            vecs = np.asarray(worker_encoder(encoder_factory, key)(texts.to_pylist()), dtype=np.float32)
            dim = vecs.shape[1] if vecs.ndim == 2 else 0
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dim, pa.int32()), pa.array(vecs.ravel(), pa.float32()))

    return df.withColumn(out_col, encode(F.col(text_col)))


def encode_tokens(df: DataFrame, word_vectors: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  pattern: str = TOKEN_PATTERN, token_col: str = "token", vec_col: str = "embedding") -> DataFrame:
    """(id, pos, token, embedding) for every token that has a static vector."""
    toks = tokenize(df.select(id_col, text_col), id_col, text_col, pattern)
    wv = word_vectors.select(F.col(token_col).alias("token"), F.col(vec_col).alias("embedding"))
    return lookup_join(toks, wv, "token", [id_col, "pos"]).select(id_col, "pos", "token", "embedding")


def mean_pool(token_vectors: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding") -> DataFrame:
    """Average of a text's token vectors: one sum per element, folded by text map-side, one shuffle.

    Plain sums stay in a hash table of one row per text; an aggregate over whole vectors falls back to sorting every token's
    vector once a task has met more than a few texts. The width comes from the first vector; other widths raise.
    """
    v = F.col(vec_col)
    some = token_vectors.filter(v.isNotNull()).select(F.size(v)).first()
    if some is None:
        return token_vectors.groupBy(id_col).agg(vector_mean(vec_col).alias(vec_col))
    dim = some[0]
    sums = [F.sum(F.get(v, F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dim)]
    pooled = token_vectors.groupBy(id_col).agg(*sums, F.count(v).alias("_n"), F.count_if(F.size(v) != dim).alias("_other"))
    mean = F.array(*[F.try_divide(f"_{i}", "_n") for i in range(dim)])
    checked = F.when(F.col("_other") > 0, F.raise_error(F.lit(f"vectors of other widths than {dim}"))).otherwise(mean)
    return pooled.select(id_col, F.when(F.col("_n") > 0, checked).alias(vec_col))


def encode_distinct(df: DataFrame, encode: Callable[[DataFrame], DataFrame], id_col: str = "doc_id",
                    text_col: str = "text", vec_col: str = "embedding") -> DataFrame:
    """Encode each distinct text once, then attach the vector to every row carrying it.

    Texts are keyed by a SHA-256 digest: the de-duplication shuffles each
    text once (copies collapse map-side), and the join back moves only the
    32-byte key with the row id. ``encode`` maps a DataFrame with columns
    (``_tk``, ``text_col``) to (``_tk``, ``vec_col``).
    """
    keyed = df.select(id_col, text_col).withColumn("_tk", F.sha2(F.col(text_col), 256))
    distinct = keyed.select("_tk", text_col).na.drop().dropDuplicates(["_tk"])
    vecs = encode(distinct).select("_tk", vec_col)
    # broadcast when small, else shuffled by key, with only the texts repeated in many rows salted by row id; the check counts
    # keys, so nothing is encoded for it
    rows = keyed.select("_tk").na.drop().groupBy("_tk").agg(F.count("*").alias("n"))
    keys, hot = rows.agg(F.count("*"), F.collect_list(F.when(F.col("n") > HOT_ROWS, F.col("_tk")))).first()
    hot_keys = df.sparkSession.createDataFrame([(k,) for k in hot], "_tk string")
    return lookup_join(keyed, vecs, "_tk", [id_col], how="left", small=keys * VECTOR_BYTES <= BROADCAST_MAX_BYTES, hot=hot_keys).drop("_tk")


def static_text_encoder(word_vectors: DataFrame, pattern: str = TOKEN_PATTERN, text_col: str = "text",
                        vec_col: str = "embedding") -> Callable[[DataFrame], DataFrame]:
    """An ``encode`` for ``encode_distinct``: mean of the static vectors of a text's tokens."""

    def encode(texts: DataFrame) -> DataFrame:
        tv = encode_tokens(texts, word_vectors, "_tk", text_col, pattern, vec_col=vec_col)
        return mean_pool(tv, "_tk", vec_col)

    return encode


# ---------------------------------------------------------------- contextual token vectors

SPAN_VECTORS = T.StructType([
    T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())),
    T.StructField("vectors", T.ArrayType(T.FloatType())), T.StructField("text", T.StringType()),
])


class WindowTokenEncoder:
    """A deterministic contextual encoder standing in for a language model: (starts, ends, vectors) of a text's tokens.

    A token's vector is its own md5 place (as in ``Md5Encoder``) plus those of its neighbours up to ``reach`` tokens away,
    each halved once per token of distance. Offsets are characters of the text, the end exclusive.
    """

    def __init__(self, dim: int = 16, reach: int = 2, pattern: str = r"[^\W\d_]+"):
        self.dim, self.reach, self.token = dim, reach, re.compile(pattern)
        self._place = Md5Places(dim)

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        for text in texts:
            at = np.array([m.span() for m in self.token.finditer(text or "")], np.int32).reshape(-1, 2)
            n = len(at)
            places = np.fromiter((self._place[text[a:b].lower()] for a, b in at.tolist()), np.int64, n)
            vectors = np.zeros((n, self.dim), np.float32)
            for step in range(-self.reach, self.reach + 1):
                i = np.arange(max(0, -step), min(n, n - step))  # a row meets one neighbour a step
                vectors[i, places[i + step]] += 0.5 ** abs(step)
            out.append((at[:, 0], at[:, 1], vectors))
        return out


def encode_token_spans(df: DataFrame, text_col: str = "text", encoder_factory: Callable = WindowTokenEncoder, out_col: str = "spans",
                       encoder_id: str | None = None) -> DataFrame:
    """Append one struct per text: starts and ends of its tokens, all their vectors in one flat array, and the text itself.

    The encoder sees some texts at a time and returns (starts, ends, tokens x dim) per text; a text's tokens stay in its row, as
    nested Arrow lists, until ``keyword_vector``, ``pool_spans`` or ``span_rows`` picks some. A null text has no tokens.
    ``keyword_vector`` and ``pool_spans`` take the struct alone, so Spark runs them in the encoder's worker and no vectors
    travel between the two.
    """
    key = encoder_id or uuid.uuid4().hex

    @F.arrow_udf(SPAN_VECTORS)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _some_bytes_at_a_time(batches):
            found = worker_encoder(encoder_factory, key)(texts.to_pylist())
            lists = []
            for k, kind in ((0, np.int32), (1, np.int32), (2, np.float32)):
                parts = [np.asarray(f[k], kind).ravel() for f in found]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, kind)]))))
            yield pa.StructArray.from_arrays([*lists, texts], names=SPAN_VECTORS.names)

    return df.withColumn(out_col, encode(F.col(text_col)))


def _width(spans: str) -> Column:
    return F.try_divide(F.size(f"{spans}.vectors"), F.size(f"{spans}.starts")).cast("int")


def keyword_vector(df: DataFrame, keyword: str, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Per text the first token that contains the keyword: (pos, start, end, token, embedding) columns; null where there is none.

    The step is marked nondeterministic so that a filter on its columns stays above it: moved below, it would encode every
    text a second time. Filter other columns first. ``text_col`` serves spans that do not hold their text.
    """
    wanted = keyword.lower()

    def first(text: str | None, starts: np.ndarray, ends: np.ndarray, vectors: np.ndarray) -> dict | None:
        if text is None or wanted not in text.lower():  # a token that holds it is part of the text
            return None
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            token = text[a:b].lower()
            if wanted in token:
                width = len(vectors) // len(starts)
                return {"pos": i, "start": a, "end": b, "token": token, "embedding": vectors[i * width : (i + 1) * width]}
        return None

    # slices of a Python string take no search; by ``substring`` every token would walk its text from the start
    @F.arrow_udf("pos int, start int, end int, token string, embedding array<float>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("pos", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("token", pa.string()), ("embedding", pa.list_(pa.float32()))])
        for spans in _some_at_a_time(batches):
            of = dict(zip((f.name for f in spans.type), spans.flatten(), strict=True))
            lists = []
            for name in ("starts", "ends", "vectors"):
                bounds = [0, *accumulate(pc.fill_null(pc.list_value_length(of[name]), 0).to_pylist())]
                flat = of[name].flatten().to_numpy(zero_copy_only=False)
                lists.append([flat[i:j] for i, j in zip(bounds, bounds[1:], strict=False)])
            yield pa.array([first(*x) for x in zip(of["text"].to_pylist(), *lists, strict=True)], kind)

    spans = F.col(spans_col)
    if "text" not in df.schema[spans_col].dataType.names:
        spans = F.struct(f"{spans_col}.*", F.col(text_col).alias("text"))
    kept = [c for c in df.columns if c != spans_col]
    return df.select(*kept, find.asNondeterministic()(spans).alias("_hit")).select(*kept, "_hit.*")


def pool_spans(spans_col: str = "spans") -> Column:
    """Mean of a text's token vectors, one reshape per text; null without tokens."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def pool(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for spans in _some_at_a_time(batches):
            starts, vectors = spans.field("starts"), spans.field("vectors")
            out = [np.asarray(v.values).reshape(len(s), -1).mean(axis=0, dtype=float) if len(s) else None for s, v in zip(starts, vectors, strict=True)]
            yield pa.array(out, pa.list_(pa.float64()))

    return pool(F.col(spans_col))


def span_rows(df: DataFrame, id_col: str, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """One row per token (id, pos, start, end, token, embedding), for callers that want them."""
    s = F.arrays_zip(F.col(f"{spans_col}.starts").alias("a"), F.col(f"{spans_col}.ends").alias("b"))
    rows = df.select(id_col, F.col(text_col).alias("_t"), F.col(f"{spans_col}.vectors").alias("_v"), _width(spans_col).alias("_d"), F.posexplode(s).alias("pos", "_s"))
    return rows.select(id_col, F.col("pos").cast("long").alias("pos"), F.col("_s.a").alias("start"), F.col("_s.b").alias("end"),
                       F.expr("substring(_t, _s.a + 1, _s.b - _s.a)").alias("token"), F.slice("_v", F.col("pos") * F.col("_d") + 1, F.col("_d")).alias("embedding"))
