"""Toxicity by a weighted finite-state pattern grammar.

A text is a sequence of clauses (sentence ends, commas, quotes and line ends
separate). Words are read as sets of classes, and five transducers pass them on
with marks added, each reading what the one before wrote:

* reported speech: marks what follows a verb of saying up to the sentence end,
  and what stands between quotes (an opening quote without a closing one in its
  line is none);
* negation: marks the next words of the clause, up to a word of contrast;
* target: second person or a person word marks the next words of the clause;
* threat: an act of violence after a modal or a first person, with a person
  between them or right after the act, is marked as a threat once it is complete;
* insult: sends the weight of words and word stems (learned, plus a few fixed
  words) to the tape of their marks: quoted, negated, targeted or, when the
  clause ends without a target, plain.

``Composition`` chains them into one machine whose transitions are worked out
when first met. A document's tapes plain / targeted / negated / quoted / threat
are sums over its matched clauses; a logistic model over these sums, fitted
by Newton steps on labelled rows, gives the score.

Learning is bounded: at most about ``SAMPLE_DOCS`` labelled ids chosen by a
hash of the id, and as many different texts of theirs, teach the lexicon weights (log
odds of document counts) and the model; copies of a text teach once. Scoring reads whole texts of all rows, by text alone.

Defined cases: null, empty and wordless texts are scored like a text without
matches; without labels of both kinds the fixed words alone are scored with
default model weights; repeated rows score alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import collect_bounded
from .common import add_struct, written

SAMPLE_DOCS = 8_000
#: Words of a labelled row that can teach a weight must be in at least this many toxic rows.
MIN_ROWS = 4
#: Least log odds of a learned word or stem.
MIN_WEIGHT = 3.0
#: Rows of prior belief added to every entry, split between the labels as the sample is.
PRIOR_ROWS = 2.0
#: Lexicon entries kept, by evidence.
LEXICON_SIZE = 50_000
STEM_LENGTHS = (5, 6, 7, 8, 10)
#: Words that a negation, a target, a threat's cue and an act of violence reach forward within their clause.
NEGATION_REACH = 5
TARGET_REACH = 4
CUE_REACH = 3
OBJECT_REACH = 2
#: Weight of a complete threat and of a fixed insult.
FIXED_WEIGHT = 4.0

# Word classes of the grammar (English, French, German, Spanish).
INSULTS = {"idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown",
           "imbecile", "crétin", "salaud", "dummkopf", "abschaum", "imbécil", "estúpido", "basura"}
ACTS = {"kill", "hurt", "beat", "shoot", "destroy", "stab", "tuer", "töten", "matar"}
THREAT_CUES = {"will", "gonna", "shall", "ll", "must", "i", "we", "vais", "werde", "voy"}
TARGETS = {"you", "your", "yours", "u", "ur", "he", "him", "she", "her", "they", "them", "people", "tu", "te", "toi", "vous",
           "du", "dich", "ihr", "sie", "tú", "usted", "ustedes"}
NEGATIONS = {"not", "never", "no", "nor", "neither", "cannot", "isn", "aren", "don", "without", "pas", "jamais", "nicht", "kein",
             "keine", "nunca"}
CONTRASTS = {"but", "mais", "aber", "sondern", "pero", "sino"}
SAYINGS = {"said", "says", "wrote", "called", "quoted", "claimed", "dit", "sagte", "dijo"}
OBJECTS = {"it", "everyone", "everybody", "anyone"}
FILLERS = {"all", "of", "the", "every", "each", "those", "these"}

TAPES = ("plain", "targeted", "negated", "quoted", "threat")
QUOTES = '"“”„«»'
# a word keeps a final n't
_TOKEN = re.compile(r"[^\W\d_]+(?:(?<=n)['’]t(?![^\W\d_]))?|[\"“”„«»]|[.!?;]+|,")
RESULT = "struct<score:double,predicted:int,plain:double,targeted:double,negated:double,quoted:double,threat:double,clauses:int>"


# Word classes (bits of a symbol) and the marks that transducers add. A symbol with BREAK is no word: it ends a clause.
INSULT, ACT, CUE, TARGET, OBJECT, NEGATION, CONTRAST, SAYING, FILLER, BREAK, QUOTE, STOP, LINE = (1 << i for i in range(13))
QUOTED, NEGATED, TARGETED, THREAT, THREAT_QUOTED, THREAT_NEGATED = (1 << i for i in range(13, 19))


def reported_speech(state: str, symbol: int) -> tuple[str, int]:
    """States: plain, said (up to the sentence end), quote (up to the closing quote)."""
    if symbol & LINE:
        return "plain", symbol
    if symbol & QUOTE:
        return ("plain" if state == "quote" else "quote"), symbol
    if symbol & STOP and state == "said":
        return "plain", symbol
    if symbol & BREAK:
        return state, symbol
    marked = symbol if state == "plain" else symbol | QUOTED
    return ("said" if state == "plain" and symbol & SAYING else state), marked


def negation(left: int, symbol: int) -> tuple[int, int]:
    """State: words that the last negation still reaches."""
    if symbol & (BREAK | CONTRAST):
        return 0, symbol
    marked = symbol | NEGATED if left else symbol
    return (NEGATION_REACH if symbol & NEGATION else max(0, left - 1)), marked


def target(left: int, symbol: int) -> tuple[int, int]:
    """State: words that the last target still reaches."""
    if symbol & BREAK:
        return 0, symbol
    marked = symbol | TARGETED if left else symbol
    return (TARGET_REACH if symbol & TARGET else max(0, left - 1)), marked


def threat(state: tuple[int, bool, int, int], symbol: int) -> tuple[tuple[int, bool, int, int], int]:
    """State: words the cue still reaches, a person since the cue, words in which an act awaits its object, the act's mark."""
    if symbol & BREAK:
        return (0, False, 0, 0), symbol
    cue, person, waits, mark = state
    if waits and symbol & (TARGET | OBJECT):
        symbol, waits = symbol | mark, 0
    elif waits and not symbol & FILLER:
        waits -= 1
    if symbol & ACT and cue:
        mark = THREAT_QUOTED if symbol & QUOTED else THREAT_NEGATED if symbol & NEGATED else THREAT
        if person:
            symbol, waits = symbol | mark, 0
        else:
            waits = OBJECT_REACH
    person = cue > 0 and (person or bool(symbol & TARGET))
    cue = max(0, cue - 1)
    if symbol & CUE:
        cue, person = CUE_REACH, False
    return (cue, person and cue > 0, waits, mark if waits else 0), symbol


#: Registers of the insult transducer: the tapes, and the weights of the clause that wait for a target.
WAITING = len(TAPES)


def insult(state: int, symbol: int) -> tuple[int, tuple[int, int, int]]:
    """(register for the word's weight, tape for the waiting weights, tape for a threat); -1 is none. One state."""
    if symbol & BREAK:
        return state, (-1, 0, -1)
    word = -1
    if symbol & INSULT:
        word = 3 if symbol & QUOTED else 2 if symbol & NEGATED else 1 if symbol & TARGETED else WAITING
    done = 4 if symbol & THREAT else 3 if symbol & THREAT_QUOTED else 2 if symbol & THREAT_NEGATED else -1
    return state, (word, 1 if symbol & TARGET else -1, done)


class Composition:
    """The transducers in a chain as one machine; a transition is worked out once and kept (reaches bound their number)."""

    CHAIN = (reported_speech, negation, target, threat, insult)
    START = ("plain", 0, 0, (0, False, 0, 0), 0)

    def __init__(self):
        self.arcs: dict = {}

    def arc(self, state: tuple, symbol: int) -> tuple:
        found = self.arcs.get((state, symbol))
        if found is None:
            out, states = symbol, []
            for t, s in zip(self.CHAIN, state, strict=True):
                s, out = t(s, out)
                states.append(s)
            found = self.arcs[state, symbol] = (tuple(states), *out)
        return found


class Grammar:
    """Weighted lexicon (whole words and stems) read by the composed transducers."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words = {**{w: FIXED_WEIGHT for w in INSULTS}, **words}
        self.stems = stems
        self.cache: dict[str, tuple[int, float]] = {}
        self.classed = ACTS | THREAT_CUES | TARGETS | OBJECTS | NEGATIONS | CONTRASTS | SAYINGS | FILLERS
        self.machine = Composition()

    def weight(self, word: str) -> float:
        w = self.words.get(word)
        if w is not None:
            return w
        best = 0.0
        for n in STEM_LENGTHS:
            if n >= len(word):
                break
            best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def symbol(self, token: str) -> tuple[int, float]:
        """Classes and insult weight of a token."""
        if token[0] in ".!?;,":
            return (BREAK if token == "," else BREAK | STOP), 0.0
        if token in QUOTES:
            return BREAK | QUOTE, 0.0
        w = self.weight(token)
        if token not in self.classed and not token.endswith("t"):  # most words
            return (INSULT if w > 0 else 0), w
        classes = ((INSULT, w > 0), (ACT, token in ACTS), (CUE, token in THREAT_CUES), (TARGET, token in TARGETS),
                   (OBJECT, token in OBJECTS), (NEGATION, token in NEGATIONS or token.endswith(("n't", "n’t"))), (CONTRAST, token in CONTRASTS),
                   (SAYING, token in SAYINGS), (FILLER, token in FILLERS))
        return sum(bit for bit, holds in classes if holds), w

    def tokens(self, text: str) -> Iterator[list[str]]:
        """Tokens of each line; the last of an odd number of quotes in a line is left out."""
        for line in text.lower().split("\n"):
            found = _TOKEN.findall(line)
            if any(q in line for q in QUOTES):
                quotes = [i for i, t in enumerate(found) if t in QUOTES]
                if len(quotes) % 2:
                    del found[quotes[-1]]
            yield found

    def tapes(self, text: str) -> tuple[list[float], int, int]:
        """Summed output tapes, matched clauses and words of a text."""
        out = [0.0] * (WAITING + 1)
        matched = words = 0
        lines = list(self.tokens(text))
        cache = self.cache
        if len(cache) > 500_000:
            cache.clear()
        kinds = set().union(*lines)
        for tok in kinds:
            if tok not in cache:
                cache[tok] = self.symbol(tok)
        marks = {t for t in kinds if cache[t][0] & BREAK}
        live = {t for t in kinds if cache[t][0] & (INSULT | ACT)}
        arc, arcs = self.machine.arc, self.machine.arcs
        state, hit = Composition.START, False
        for line in lines:
            words += len(line) - sum(map(marks.__contains__, line))
            if live.isdisjoint(line):  # no path to an accepting state; the line end resets all states
                continue
            read = [cache[t] for t in line]
            for symbol, weight in (*read, (BREAK | LINE, 0.0)):
                if not symbol and state == Composition.START:
                    continue
                state, word, flush, done = arcs.get((state, symbol)) or arc(state, symbol)
                if word >= 0:
                    out[word] += weight
                    hit = True
                if flush >= 0 and out[WAITING]:
                    out[flush] += out[WAITING]
                    out[WAITING] = 0.0
                if done >= 0:
                    out[done] += FIXED_WEIGHT
                    hit = True
                if symbol & BREAK:
                    matched += hit
                    hit = False
        return out[:WAITING], matched, words


def features(tapes: list[float], words: int) -> list[float]:
    """Model inputs: each tape damped and per square root of length, the length, and a constant."""
    scale = (50 + words) ** 0.5
    return [*[math.log1p(t) for t in tapes], *[min(20.0, 10 * t / scale) for t in tapes], math.log(50 + words), 1.0]


#: Used when there are no labels of both kinds.
DEFAULT_WEIGHTS = [3.0, 3.0, 0.3, 0.6, 3.0, 0, 0, 0, 0, 0, 0, -3.0]


def entries(text: str) -> tuple[set[str], set[str]]:
    """Distinct words and stems of a text."""
    found = {t for t in _TOKEN.findall(text.lower()) if t[0].isalpha()}
    return found, {w[:k] for w in found for k in STEM_LENGTHS if len(w) > k}


def weights_of(counts: dict[str, tuple[int, int]], n: tuple[int, int]) -> dict[str, float]:
    """Log odds of (other, toxic) row counts, shrunk to the labels' shares and kept when clearly toxic."""
    ranked = []
    prior = PRIOR_ROWS / max(1, n[0] + n[1])
    for w, (q, p) in counts.items():
        if p >= MIN_ROWS and n[0]:
            odds = math.log((p + prior * n[1]) / n[1]) - math.log((q + prior * n[0]) / n[0])
            if odds >= MIN_WEIGHT:
                ranked.append((odds * p, w, min(odds, 8.0)))
    return {w: o for _, w, o in sorted(ranked, reverse=True)[:LEXICON_SIZE]}


def learn_lexicons(sample: DataFrame) -> dict[int, tuple[dict[str, float], dict[str, float]]]:
    """(words, stems) learned from both halves of the sample (2) and from each half alone (0, 1).

    ``sample`` has (t, y, half); each task counts its rows, the counts are added up by entry.
    """

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for t, y, half in zip(*(batch.column(i) for i in range(3)), strict=True):
                words, stems = entries(t.as_py())
                k = (half.as_py(), y.as_py())
                counts[("n", "", *k)] += 1
                counts.update(("w", w, *k) for w in words)
                counts.update(("s", w, *k) for w in stems)
        cols = list(zip(*((*k, n) for k, n in counts.items()), strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
            names=["kind", "item", "half", "y", "n"],
        )

    cell = lambda h, y: F.sum(F.when((F.col("half") == h) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"c{h}{y}")
    sums = (
        sample.select("t", "y", "half").mapInArrow(run, "kind string, item string, half int, y int, n long")
        .groupBy("kind", "item").agg(*[cell(h, y) for h in (0, 1) for y in (0, 1)])
        .filter((F.col("kind") == "n") | (F.col("c01") + F.col("c11") >= MIN_ROWS))
    )
    rows = collect_bounded(sums, 40 * LEXICON_SIZE, "toxicity lexicon candidates")
    total = next((r for r in rows if r["kind"] == "n"), None)
    out = {}
    for part, cols in ((0, (("c00",), ("c01",))), (1, (("c10",), ("c11",))), (2, (("c00", "c10"), ("c01", "c11")))):
        add = lambda r, cols=cols: tuple(sum(r[c] for c in cs) for cs in cols)
        n = add(total) if total else (0, 0)
        out[part] = tuple(weights_of({r["item"]: add(r) for r in rows if r["kind"] == k}, n) for k in "ws")
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 50) -> list[float]:
    """Ridge logistic regression by Newton steps; the constant (last column) is not shrunk."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Model from labelled rows: {"words", "stems", "weights"}. Null labels and texts are left out."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    n = known.count()
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30))
    rate = min(1.0, SAMPLE_DOCS / max(1, n))
    picked = known.filter(u < F.lit(int(rate * (1 << 30))))
    sample = docs.filter(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("_t")).join(F.broadcast(picked), id_col)
    half = F.pmod(F.xxhash64("_t"), F.lit(2)).cast("int")
    texts = sample.select(F.col("_t").alias("t"), (F.col("_y") > 0).cast("int").alias("y"), half.alias("half")).distinct()
    rows = written(texts, "toxicity-sample")
    found = rows.count()
    if found > 2 * SAMPLE_DOCS:  # few ids with many texts: the texts are sampled again
        share = F.pmod(F.xxhash64("t", F.lit(23)), F.lit(1 << 30))
        rows = written(rows.filter(share < F.lit(int(SAMPLE_DOCS / found * (1 << 30)))), "toxicity-sample-texts")
    if rows.select("y").distinct().count() < 2:
        return {"words": {}, "stems": {}, "weights": DEFAULT_WEIGHTS}
    lexicons = learn_lexicons(rows)

    # a half's features come from the lexicon of the other half, so the model sees weights that were not learned from its rows
    @F.arrow_udf("array<double>")
    def inputs(texts: pa.Array, halves: pa.Array) -> pa.Array:
        grammars = [Grammar(*lexicons[1]), Grammar(*lexicons[0])]
        out = []
        for t, h in zip(texts, halves, strict=True):
            tapes, _, words = grammars[h.as_py()].tapes(t.as_py())
            out.append(features(tapes, words))
        return pa.array(out, pa.list_(pa.float64()))

    found = collect_bounded(rows.select("y", inputs("t", "half").alias("x")), 4 * SAMPLE_DOCS, "toxicity features")
    found = sorted((r["y"], r["x"]) for r in found)
    weights = fit_logistic(np.array([x for _, x in found]), np.array([y for y, _ in found], dtype=float))
    words, stems = lexicons[2]
    return {"words": words, "stems": stems, "weights": weights}


def score_text(text: str | None, grammar: Grammar, weights: list[float]) -> tuple:
    tapes, matched, words = grammar.tapes(text or "")
    z = sum(a * b for a, b in zip(weights, features(tapes, words), strict=True))
    score = 1.0 / (1.0 + float(np.exp(-max(-30.0, min(30.0, z)))))
    return (score, int(score >= 0.5), *tapes, matched)


def toxicity(text_col: str, model: dict) -> Column:
    names = ["score", "predicted", *TAPES, "clauses"]
    kinds = [pa.float64(), pa.int32(), *[pa.float64()] * 5, pa.int32()]

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grammar = Grammar(model["words"], model["stems"])
        for texts in batches:
            rows = [score_text(t.as_py(), grammar, model["weights"]) for t in texts]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run(F.col(text_col))


def score(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column (score, predicted, the five tapes, clauses); no shuffle, one result per row."""
    return add_struct(docs, out_col, toxicity(text_col, model))
