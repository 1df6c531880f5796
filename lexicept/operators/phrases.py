"""Rule tokens with character offsets, and phrase patterns matched by one walk over a token trie.

Tokens. An ordered rule list cuts a text into numbers, words, negation clitics ("can't" gives "ca" and "n't"), other
clitics ("'s", "'ll"), runs of dots and single marks; white space separates. Every token carries its offsets in the
original text (code points, end exclusive), so a token is always a slice of it. Matching compares lower-cased tokens.

Phrases. A pattern is a sequence of tokens divided by spaces; a token ending in ``*`` matches by its stem and a lone
``*`` matches any token. The patterns are a user dictionary: collected within a bound, compiled into a trie (nodes with
exact children and with stem children by stem length) and broadcast. A task walks each text once from every start; the
work of a start is bounded by the longest pattern, not by the number of patterns. Two readings:

* ``all``: every pattern at every place, once per (place, length, category);
* ``longest``: left to right the longest match at a place is taken, with the categories of all patterns of that length,
  and the walk goes on behind it.

Counts come straight out of the walk, one array per text: nothing is exploded and nothing is shuffled.

Defined cases: null and empty texts have no tokens, no hits and zero counts; repeated rows each get their own results;
an empty lexicon matches nothing; patterns without a token (null, empty, white space) are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizing import MODEL_MAX_ROWS, collect_bounded
from .text import TEXTS_AT_A_TIME

# White space between tokens, letters, and the token rules in order of precedence.
SPACES = r"\x09-\x0D\x20\xA0\u3000"
LETTER = r"[\p{L}\p{M}]"
RULES = {
    "number": r"[0-9]+(?:[.,:][0-9]+)*",
    "stem": LETTER + r"+?(?=[nN]['’][tT](?!" + LETTER + "))",
    "negation": r"[nN]['’][tT](?!" + LETTER + ")",
    "word": LETTER + "+",
    "clitic": r"['’](?:[rR][eE]|[vV][eE]|[lL][lL]|[sSdDmM])(?!" + LETTER + ")",
    "dots": r"\.{2,}",
    "mark": f"[^{SPACES}]",
}
_TOKEN = regex.compile("|".join(RULES.values()))

SPANS = T.ArrayType(T.StructType([
    T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("token", T.StringType()),
]))
HITS = T.ArrayType(T.StructType([
    T.StructField("pos", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("start_char", T.LongType()),
    T.StructField("end_char", T.LongType()), T.StructField("category", T.StringType()),
]))


def spans_of(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, token) of one text."""
    return [(*m.span(), m.group()) for m in _TOKEN.finditer(text or "")]


def _texts(batches: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    """Some texts at a time, so that a task holds the tokens of a few texts, whatever the batch."""
    for whole in batches:
        for at in range(0, len(whole), TEXTS_AT_A_TIME):
            yield whole.slice(at, TEXTS_AT_A_TIME).to_pylist()


def _lists(sizes: list[int], columns: list[list], kind: T.ArrayType) -> pa.Array:
    """One list of structs per text from flat columns and the lists' lengths."""
    fields = [pa.field(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in kind.elementType.fields]
    rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), rows)


@F.arrow_udf(SPANS)
def _spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in _texts(batches):
        sizes, starts, ends, words = [], [], [], []
        for t in texts:
            at = [m.span() for m in _TOKEN.finditer(t or "")]
            sizes.append(len(at))
            starts += [s for s, _ in at]
            ends += [e for _, e in at]
            words += [t[s:e] for s, e in at]
        yield _lists(sizes, [starts, ends, words], SPANS)


def token_spans(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """(id, pos, start_char, end_char, token): one row per token, map-side only."""
    rows = df.select(id_col, *(keep or []), F.posexplode(_spans(F.col(text_col))).alias("pos", "_s"))
    return rows.select(id_col, *(keep or []), F.col("pos").cast("long").alias("pos"), "_s.start_char", "_s.end_char", "_s.token")


#: Words whose first step in the trie a task keeps.
OPENS_KEPT = 200_000


class Trie:
    """Token patterns as a trie; ``ends[node]`` holds the categories of the patterns that end there."""

    def __init__(self, rows: list[tuple[str | None, str]]):
        self.words: list[dict[str, int]] = [{}]
        self.stems: list[dict[int, dict[str, int]]] = [{}]
        self.ends: list[set[str]] = [set()]
        self._opens: dict[str, bool] = {}
        for pattern, category in rows:
            node = 0
            for token, is_stem in self.pattern_tokens(pattern):
                node = self._child(node, token, is_stem)
            if node:
                self.ends[node].add(category)

    @staticmethod
    def pattern_tokens(pattern: str | None) -> list[tuple[str, bool]]:
        """(token, is a stem) of a pattern; a star belongs to the token before it, or stands for any token."""
        out: list[tuple[str, bool]] = []
        for part in (pattern or "").lower().split():
            starred = part.endswith("*")
            tokens = [w for _, _, w in spans_of(part[:-1] if starred else part)] or ([""] if starred else [])
            out += [(w, False) for w in tokens[:-1]] + [(w, starred) for w in tokens[-1:]]
        return out

    def _child(self, node: int, token: str, is_stem: bool) -> int:
        kids = self.stems[node].setdefault(len(token), {}) if is_stem else self.words[node]
        if token not in kids:
            kids[token] = len(self.words)
            self.words.append({})
            self.stems.append({})
            self.ends.append(set())
        return kids[token]

    def at(self, words: list[str], i: int) -> Iterator[tuple[int, set[str]]]:
        """(length, categories) of the patterns matching from token ``i`` on, shortest first."""
        active = [0]
        for n, w in enumerate(words[i:i + self.depth()], 1):
            reached = []
            for node in active:
                if w in self.words[node]:
                    reached.append(self.words[node][w])
                for size, kids in self.stems[node].items():
                    if len(w) >= size and w[:size] in kids:
                        reached.append(kids[w[:size]])
            if not reached:
                return
            active = reached
            found = set().union(*(self.ends[node] for node in active))
            if found:
                yield n, found

    def depth(self) -> int:
        """Tokens of the longest pattern."""
        if not hasattr(self, "_depth"):
            deep = [0] * len(self.words)
            for node in range(len(self.words)):  # children come after their parents
                for kids in (self.words[node], *self.stems[node].values()):
                    for child in kids.values():
                        deep[child] = deep[node] + 1
            self._depth = max(deep)
        return self._depth

    def opens(self, word: str) -> bool:
        """Whether a pattern can begin with the word; the answers of the first words are kept."""
        known = word in self.words[0] or any(len(word) >= size and word[:size] in kids for size, kids in self.stems[0].items())
        if len(self._opens) < OPENS_KEPT:
            self._opens[word] = known
        return known

    def walk(self, words: list[str], longest: bool) -> Iterator[tuple[int, int, set[str]]]:
        """(pos, length, categories) over a whole text."""
        i, known = 0, self._opens
        while i < len(words):
            w = words[i]
            if not (known[w] if w in known else self.opens(w)):
                i += 1
                continue
            here = list(self.at(words, i))
            if longest and here:
                yield (i, *here[-1])
                i += here[-1][0]
                continue
            for n, found in here:
                yield i, n, found
            i += 1


def _lowered(text: str | None) -> tuple[list[tuple[int, int]], list[str]]:
    """Spans of the tokens and the tokens in lower case."""
    spans = [m.span() for m in _TOKEN.finditer(text or "")]
    return spans, [text[s:e].lower() for s, e in spans]


def phrase_trie(lexicon: DataFrame) -> Trie:
    """Compile (category, pattern) rows; the collect is the dictionary's size check."""
    rows = collect_bounded(lexicon.select("pattern", "category").distinct(), MODEL_MAX_ROWS, "phrase lexicon")
    return Trie([(r["pattern"], r["category"]) for r in rows])


def _check_mode(mode: str) -> bool:
    if mode not in ("all", "longest"):
        raise ValueError(f"mode must be 'all' or 'longest', not {mode!r}")
    return mode == "longest"


def phrase_hits(df: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "longest",
                keep: list[str] | None = None) -> DataFrame:
    """(id, pos, n_tokens, start_char, end_char, category): one row per match and category."""
    longest = _check_mode(mode)
    sent = df.sparkSession.sparkContext.broadcast(phrase_trie(lexicon))

    @F.arrow_udf(HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = sent.value
        for texts in _texts(batches):
            sizes, rows = [], []
            for text in texts:
                spans, words = _lowered(text)
                before = len(rows)
                rows += [(i, n, spans[i][0], spans[i + n - 1][1], c) for i, n, found in trie.walk(words, longest) for c in sorted(found)]
                sizes.append(len(rows) - before)
            yield _lists(sizes, list(zip(*rows, strict=True)) or [[]] * 5, HITS)

    rows = df.select(id_col, *(keep or []), F.explode(hits(F.col(text_col))).alias("_h"))
    return rows.select(id_col, *(keep or []), "_h.pos", "_h.n_tokens", "_h.start_char", "_h.end_char", "_h.category")


def phrase_counts(df: DataFrame, lexicon: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text",
                  mode: str = "longest", value_col: str = "n") -> DataFrame:
    """Long, zero-filled (id, category, n): matches per category, row by row, without a shuffle."""
    longest = _check_mode(mode)
    sent = df.sparkSession.sparkContext.broadcast((phrase_trie(lexicon), {c: i for i, c in enumerate(categories)}))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie, place = sent.value

        def of(text):
            n = [0] * len(place)
            for _, _, found in trie.walk([w.lower() for w in _TOKEN.findall(text or "")], longest):
                for c in found:
                    if c in place:
                        n[place[c]] += 1
            return n

        for texts in _texts(batches):
            yield pa.array([of(t) for t in texts], pa.list_(pa.int64()))

    names = F.array(*[F.lit(c) for c in categories])
    rows = df.select(id_col, F.explode(F.arrays_zip(names.alias("category"), counts(F.col(text_col)).alias("n"))).alias("_z"))
    return rows.select(id_col, F.col("_z.category").alias("category"), F.col("_z.n").alias(value_col))
