"""The composed transducers of the toxicity grammar against a reading of whole clauses, and by hand."""

import random

import pytest

from lexicept.llm import toxicity as X

VOCABULARY = ["idiot", "scum", "kill", "hurt", "i", "will", "must", "you", "them", "it", "not", "doesn't", "but", "said", "all", "of", "time",
              "bread", "window", ",", ".", "!", '"', "“", "”", "\n"]


def read(text):
    """(tapes, clauses) from the definitions: every insult and act looks at its own clause, no running state."""
    out, clauses = dict.fromkeys(X.TAPES, 0.0), 0
    for line in text.lower().split("\n"):
        toks = [t for t in line.split(" ") if t]
        quotes = [i for i, t in enumerate(toks) if t in X.QUOTES]
        if len(quotes) % 2:
            del toks[quotes.pop()]
        inside = lambda i: sum(q < i for q in quotes) % 2 == 1  # noqa: B023, E731
        marks = {".", "!", ",", *X.QUOTES}
        ends = [-1] + [i for i, t in enumerate(toks) if t in marks] + [len(toks)]
        for a, b in zip(ends, ends[1:], strict=False):
            clause, matched = range(a + 1, b), False

            def quoted(i):
                sentence = max([j for j in range(i) if toks[j] in {".", "!"} and not inside(j)], default=-1)
                # a saying counts outside quotes, until the sentence end or a quote
                opened = max([j for j in range(i) if toks[j] in X.QUOTES], default=-1)
                return inside(i) or any(toks[j] in X.SAYINGS for j in range(max(sentence, opened) + 1, i) if not inside(j))

            def negated(i):
                near = [j for j in clause if i - X.NEGATION_REACH <= j < i]
                return any((toks[j] in X.NEGATIONS or toks[j].endswith("n't")) and not any(toks[k] in X.CONTRASTS for k in range(j + 1, i + 1)) for j in near)

            tape_of = lambda i, other: "quoted" if quoted(i) else "negated" if negated(i) else other  # noqa: B023, E731
            for i in clause:
                if toks[i] in X.INSULTS:
                    near = any(toks[j] in X.TARGETS for j in clause if j >= i - X.TARGET_REACH and j != i)
                    out[tape_of(i, "targeted" if near else "plain")] += X.FIXED_WEIGHT
                    matched = True
                cues = [j for j in clause if i - X.CUE_REACH <= j < i and toks[j] in X.THREAT_CUES]
                if toks[i] in X.ACTS and cues:
                    whom = any(toks[j] in X.TARGETS for j in range(cues[-1] + 1, i))
                    counted = 0
                    for j in range(i + 1, b):
                        again = [k for k in range(j - X.CUE_REACH, j) if k > a and toks[k] in X.THREAT_CUES]
                        if whom or counted >= X.OBJECT_REACH or (toks[j] in X.ACTS and again):
                            break
                        if toks[j] in X.TARGETS | X.OBJECTS:
                            whom = True
                        counted += toks[j] not in X.FILLERS
                    if whom:
                        out[tape_of(i, "threat")] += X.FIXED_WEIGHT
                        matched = True
            clauses += matched
    return out, clauses


def test_grammar_against_whole_clauses():
    rng = random.Random(8)
    grammar = X.Grammar({}, {})
    seen = dict.fromkeys(X.TAPES, 0)
    for _ in range(9000):
        text = " ".join(rng.choices(VOCABULARY, k=rng.randint(1, 24))).replace(" \n ", "\n")
        tapes, clauses, _ = grammar.tapes(text)
        want, matched = read(text)
        assert (dict(zip(X.TAPES, tapes, strict=True)), clauses) == (want, matched), repr(text)
        for t in X.TAPES:
            seen[t] += want[t] > 0
    assert min(seen.values()) > 200  # every tape was met
    assert len(grammar.machine.arcs) < 20_000


@pytest.mark.parametrize(("text", "tape"), [
    ("He doesn't look like an idiot.", "negated"),
    ("She wasn't an idiot.", "negated"),
    ("you can’t call that stupid", "negated"),
    ("“It was fine. What an idiot. Go.”", "quoted"),
    ("not clever but you idiot", "targeted"),
    ("I will kill you", "threat"),
    ("we must hurt all of them", "threat"),
    ("je vais te tuer", "threat"),
    ("ich werde dich töten", "threat"),
    ("I will never hurt you", "negated"),
    ('a 5" pipe. what an idiot', "plain"),
    ("I kill time with my friends", None),
    ("we must beat traffic", None),
    ("² x³ all is well", None),
])
def test_sentences(text, tape):
    tapes = dict(zip(X.TAPES, X.Grammar({}, {}).tapes(text)[0], strict=True))
    assert {t for t, v in tapes.items() if v} == ({tape} if tape else set())
