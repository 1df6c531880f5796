"""Quality rules and distribution divergence.

Base rules count word characters, symbols, repeated lines and words in
repeated 8-word windows. The method compares two histograms of a document,
character classes and common words, with references per language by the
Jensen-Shannon distance (base 2, so 0 to 1) and keeps the document when the
nearest language is near enough. A text with fewer than ``MIN_WORDS`` words
is not judged by its histograms: too few counts to compare.

References are corpus statistics over all labelled rows: class counts are
exact sums; common words are the ``TOP_WORDS`` most frequent words of a
language, ties in byte order of the word. Each task counts words in a bounded
table that is sent on as partial counts when it is full, and the partial
counts are added up by language and word: the counts are exact and do not
depend on the partitions. The most frequent words are taken per language and
share of the words first, then per language.

Defined cases: null text has no words (and fails the length rule); without
references the method's verdict is to keep; rows with null lang add to no
reference but are judged like others; repeated rows get equal results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import collect_bounded
from .common import add_struct, written

MIN_TEXT_WORDS = 20
MAX_REPEATED = (30, 100)
REPEAT_WINDOW = 8
MIN_WORDS = 60
TOP_WORDS = 200
#: A task's table of word counts is full at this many words or after this many bytes of text (which bound the words it holds).
TASK_WORDS = 200_000
TASK_BYTES = 64 << 20
#: Counts sent on at once, and shares of the words for the first step of the most frequent words.
SENT_ROWS = 20_000
SHARES = 64
MAX_LANGUAGES = 256
#: Largest accepted distance of character classes and of common words.
MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.56

SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "symbol", "mark", "wide")
RESULT = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,"
    "char_distance:double,word_distance:double,nearest:string,kept:boolean>"
)


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES.index("mark"), np.uint8)
    for c in range(256):
        ch = chr(c)
        if c >= 0x80:
            t[c] = CLASSES.index("wide")
        elif ch.islower():
            t[c] = CLASSES.index("lower")
        elif ch.isupper():
            t[c] = CLASSES.index("upper")
        elif ch.isdigit():
            t[c] = CLASSES.index("digit")
        elif ch == "\n":
            t[c] = CLASSES.index("line")
        elif ch in " \t\r\x0b\x0c":
            t[c] = CLASSES.index("space")
        elif ch in ".,;:!?'\"()-":
            t[c] = CLASSES.index("stop")
        elif c in SYMBOLS:
            t[c] = CLASSES.index("symbol")
    return t


_CLASS = _class_table()
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if chr(c) in ".,;:!?\"'()-" else c for c in range(256))


def char_classes(data: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=len(CLASSES)).astype(float)


def common_words(data: bytes) -> list[bytes]:
    """Words of the common-word histogram: A-Z lowered, sentence punctuation separates, symbols stay."""
    return data.translate(_FOLD).split()


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text, first occurrences included.

    A repeated window is a run of ``window - 1`` repeated pairs, so only starts of such runs are compared as windows.
    """
    n = len(words)
    if n <= window or len(set(words)) == n:
        return 0
    names = {w: i for i, w in enumerate(set(words))}
    ids = np.array([names[w] for w in words], np.int64)
    pairs = ids[:-1] * n + ids[1:]
    ranked = np.sort(pairs)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if len(twice) == 0:
        return 0
    at = np.minimum(np.searchsorted(twice, pairs), len(twice) - 1)
    runs = np.cumsum(np.concatenate([[0], (twice[at] == pairs).astype(np.int64)]))
    starts = np.flatnonzero(runs[window - 1:] - runs[:-(window - 1)] == window - 1)
    if len(starts) < 2:
        return 0
    code = ids[starts]  # windows named word by word: a longer prefix's name comes from its shorter one's and the next word
    for k in range(1, window):
        code = np.unique(code * n + ids[starts + k], return_inverse=True)[1]
    often = starts[np.bincount(code)[code] > 1]
    edge = np.zeros(n + 1, np.int64)
    edge[often] += 1  # starts are distinct
    edge[often + window] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(data: bytes, words: list[bytes]) -> tuple[int, int, int, int, bool]:
    """(word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    chars = sum(map(len, words)) - (0 if data.isascii() else int((np.frombuffer(data, np.int8) < -64).sum()))
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeated = repeated_words(words)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    failed = len(words) < MIN_TEXT_WORDS or MAX_REPEATED[1] * repeated > MAX_REPEATED[0] * len(words)
    return chars, symbols, dup, repeated, failed


def js_distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of matching rows of two count matrices (a row without counts is at distance 1)."""
    p = p / np.maximum(p.sum(axis=-1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(axis=-1, keepdims=True), 1e-300)
    m = np.maximum((p + q) / 2, 1e-300)
    kl = (p * np.log2(np.maximum(p, 1e-300) / m) + q * np.log2(np.maximum(q, 1e-300) / m)).sum(axis=-1)
    return np.sqrt(np.clip(kl / 2, 0.0, 1.0))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """{lang: {"chars": class counts, "words": {word: count}, "total": words}} over all rows with a language."""
    schema = "lang string, kind string, item string, n long"
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())

    def run(batches):
        words: dict[str, Counter] = {}
        chars: dict[str, np.ndarray] = {}
        total: Counter = Counter()
        read = 0

        def sent(rows):
            while part := list(islice(rows, SENT_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], names=["lang", "kind", "item", "n"])

        def word_rows():
            return ((k, "word", w.decode("utf-8", "replace"), n) for k, seen in words.items() for w, n in seen.items())

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, data = lang.as_py(), text.as_py()
                ws = common_words(data)
                words.setdefault(lang, Counter()).update(ws)
                total[lang] += len(ws)
                chars[lang] = chars.get(lang, 0) + char_classes(data)
                read += len(data)
                if read > TASK_BYTES or sum(map(len, words.values())) > TASK_WORDS:
                    yield from sent(word_rows())
                    words, read = {}, 0
        yield from sent(word_rows())
        yield from sent((k, "total", "", n) for k, n in total.items())
        yield from sent((k, "char", str(i), int(n)) for k, v in chars.items() for i, n in enumerate(v))

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, F.col(text_col).cast("binary"))
    sums = written(rows.mapInArrow(run, schema).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "quality-counts")  # read twice
    best = sums.filter("kind = 'word'")
    for part in (["lang", F.pmod(F.crc32(F.col("item").cast("binary")), F.lit(SHARES))], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("n"), "item"))
        best = best.withColumn("_rank", rank).filter(F.col("_rank") <= TOP_WORDS).drop("_rank")
    frequent = sums.filter("kind != 'word'").unionByName(best)
    model: dict = {}
    for r in collect_bounded(frequent, MAX_LANGUAGES * 5100, "language references"):
        m = model.setdefault(r["lang"], {"chars": [0.0] * len(CLASSES), "words": {}, "total": 0})
        if r["kind"] == "total":
            m["total"] = r["n"]
        elif r["kind"] == "char":
            m["chars"][int(r["item"])] = float(r["n"])
        else:
            m["words"][r["item"]] = r["n"]
    for m in model.values():
        m["words"] = dict(sorted(m["words"].items(), key=lambda x: (-x[1], x[0])))
    return {k: m for k, m in model.items() if m["total"]}


class Judge:
    """Distances of one text to every language reference."""

    def __init__(self, model: dict):
        self.langs = sorted(model)
        self.chars = np.array([model[k]["chars"] for k in self.langs]).reshape(len(self.langs), len(CLASSES))
        self.column = {w.encode(): i for i, w in enumerate(sorted({w for k in self.langs for w in model[k]["words"]}))}
        # per language the columns of its words, padded by a column that is always zero, and their counts; last the rest
        width = max((len(model[k]["words"]) for k in self.langs), default=0)
        self.places = np.full((len(self.langs), width), len(self.column), np.int64)
        self.words = np.zeros((len(self.langs), width + 1))
        for r, k in enumerate(self.langs):
            m = model[k]
            for i, (w, n) in enumerate(m["words"].items()):
                self.places[r, i] = self.column[w.encode()]
                self.words[r, i] = n
            self.words[r, -1] = max(0, m["total"] - sum(m["words"].values()))

    def distances(self, data: bytes) -> tuple[float, float, str | None]:
        """(character distance, word distance, language) of the nearest reference by their sum."""
        counts = Counter(common_words(data))
        total = counts.total()
        if not self.langs or not total:
            return 0.0, 0.0, None
        mine = np.zeros(len(self.column) + 1)
        for w in self.column.keys() & counts.keys():
            mine[self.column[w]] = counts[w]
        hist = np.empty_like(self.words)
        hist[:, :-1] = mine[self.places]
        hist[:, -1] = total - hist[:, :-1].sum(axis=1)
        dw = js_distances(hist, self.words)
        dc = js_distances(char_classes(data)[None, :], self.chars)
        at = int(np.argmin(dw + dc))
        return float(dc[at]), float(dw[at]), self.langs[at]


def judge(text: bytes | None, refs: Judge, max_char: float, max_word: float, min_words: int) -> tuple:
    data = text or b""
    words = data.split()
    chars, symbols, dup, repeated, failed = base_counts(data, words)
    dc, dw, near = refs.distances(data)
    far = len(words) >= min_words and (dc > max_char or dw > max_word)
    return len(words), chars, symbols, dup, repeated, failed, dc, dw, near, not failed and not far


def verdict(text_col: str, model: dict, max_char: float, max_word: float, min_words: int) -> Column:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "nearest", "kept"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        refs = Judge(model)
        for texts in batches:
            rows = [judge(t.as_py(), refs, max_char, max_word, min_words) for t in texts]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run(F.col(text_col).cast("binary"))


def assess(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "quality", max_char: float = MAX_CHAR_DISTANCE,
           max_word: float = MAX_WORD_DISTANCE, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with a struct column of counts, distances and the verdict; no shuffle, one result per row."""
    return add_struct(docs, out_col, verdict(text_col, model, max_char, max_word, min_words))
