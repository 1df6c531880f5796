"""Tokenizers applied word by word: texts are cut where the tokenizer must cut anyway, and each distinct piece is encoded once.

A cut is a single space between two characters that are no white space. Byte-level tokenizers with the usual splitting
pattern and tokenizers that drop white space start a new word there, whatever stands around it; a sentencepiece model
does when no piece holds a space mark behind another character. ``cuts_hold`` reads this from the tokenizer itself;
any other tokenizer gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: A single space between two characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Marks, a run of letters, marks: at most three words for the tokenizers below. No apostrophe (it may start a word
#: with letters) and no angle bracket (special tokens have them).
SIMPLE = re.compile(rf"([!-&(-/:;=?@\[-`{{-~]*)([{LETTERS}]+)([!-&(-/:;=?@\[-`{{-~]*)")
#: Characters a text is taken at a time; the next cut behind ends the slice.
SLICE = 1 << 20
#: Pieces kept by a worker and the longest of them. They bound its memory; results do not depend on them.
MEMO_PIECES, MEMO_CHARS = 300_000, 64
#: Fixed value: the splitting pattern of tokenizers whose words hold no white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LOADED: dict = {}


def tokenizer(path: str, plain_specials: bool = False):
    """The tokenizer of a JSON file, loaded once per process; ``plain_specials``: special tokens in texts are text."""
    from tokenizers import Tokenizer

    if (path, plain_specials) not in _LOADED:
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = plain_specials
        _LOADED[path, plain_specials] = t
    return _LOADED[path, plain_specials]


def sentence_model(path: str):
    import sentencepiece

    if path not in _LOADED:
        _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _LOADED[path]


def cuts_hold(model) -> str | None:
    """How words start at a cut: "dropped" (white space belongs to no token), "led" (to the word behind) or None (no cuts)."""
    if hasattr(model, "id_to_piece"):
        inner = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
        return None if inner or model.encode("a  b", out_type=str) != model.encode("a", out_type=str) + ["▁", "▁b"] else "led"
    spec = json.loads(model.to_str())
    if any("<" not in t["content"] for t in spec["added_tokens"]):
        return None
    steps, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
    if steps.get("type") == "ByteLevel" and steps["use_regex"] and not steps["add_prefix_space"] and norm is None:
        return "led"
    parts = steps.get("pretokenizers", [{}])
    kinds = {n["type"] for n in (norm or {}).get("normalizers", [])}
    split = parts[0].get("pattern") == {"Regex": WORD_PATTERN} and parts[0].get("behavior") == "Removed"
    return "dropped" if split and kinds <= {"NFC", "Replace", "Lowercase"} else None


def slices(text: str, size: int = SLICE):
    """Consecutive parts of a text between cuts, of about ``size`` characters; without cuts the text stays whole."""
    start = 0
    while len(text) - start > size and (m := CUT.search(text, start + size)):
        yield text[start : m.start()]
        start = m.end()
    yield text[start:]


def byte_letters() -> dict[int, str]:
    """The printable letter of every byte in byte-level vocabularies (bytes that print stand for themselves)."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return {b: chr(b) if b in printing else chr(next(others)) for b in range(256)}


class Memo:
    """piece -> value. The unknown pieces of a part of a batch are made together, so that a tokenizer sees lists.

    When half the limit is known, the table becomes the older one and a new one is begun; what is met again moves into that, the
    rest goes with the next change. So frequent pieces stay, however many rare ones pass.
    """

    def __init__(self, make, limit: int = MEMO_PIECES, cut=CUT.split):
        self.make, self.limit, self.cut, self.known, self.older = make, limit, cut, {}, {}

    def _values(self, pieces: list[list[str]]) -> list[list]:
        known, older = self.known, self.older
        missed = set().union(*pieces).difference(known)
        if missed:
            back = {p: older[p] for p in missed if p in older}
            known.update(back)
            new = [p for p in missed if p not in back]
            if new:
                known.update(zip(new, self.make(new), strict=True))
        out = [[*map(known.__getitem__, ps)] for ps in pieces]
        self._turn(chain.from_iterable(pieces))
        return out

    def distinct(self, pieces: list) -> list:
        """The values of a part's distinct pieces, in order: one look each at what is known, another for what is not."""
        out = [*map(self.known.get, pieces)]
        missed = [i for i, v in enumerate(out) if v is None]
        names = [pieces[i] for i in missed]
        values = [*map(self.older.get, names)]
        new = [p for p, v in zip(names, values, strict=True) if v is None]
        made = iter(self.make(new) if new else ())
        values = [next(made) if v is None else v for v in values]
        for i, v in zip(missed, values, strict=True):
            out[i] = v
        self.known.update(zip(names, values, strict=True))
        self._turn(pieces)
        return out

    def _turn(self, pieces) -> None:
        """Begin a new table when half the limit is known; ``pieces`` are those of the part."""
        known = self.known
        if len(known) > self.limit // 2:
            if len(known) > self.limit:  # go on with the pieces of this part
                known = {p: known[p] for p in set(pieces)}
            for p in [p for p in known if len(p) > MEMO_CHARS]:
                del known[p]
            self.known, self.older = {}, known if len(known) <= self.limit else {}

    def texts(self, texts: list[str | None]) -> list[list]:
        """The values of every text's pieces, in order; texts are taken in parts of about ``SLICE`` characters."""
        out: list[list] = [[] for _ in texts]
        numbers, pieces, chars = [], [], 0

        def settle() -> None:
            for i, values in zip(numbers, self._values(pieces), strict=True):
                out[i] = out[i] + values if out[i] else values
            numbers.clear()
            pieces.clear()

        for i, t in enumerate(texts):
            for s in slices(t) if t else ():
                numbers.append(i)
                pieces.append(self.cut(s))
                chars += len(s)
                if chars >= SLICE:
                    settle()
                    chars = 0
        settle()
        return out


def split_dropped(text: str) -> list[str]:
    """Pieces for tokenizers that drop white space: every space and line end is a cut, whatever stands around it."""
    return text.replace("\n", " ").split(" ")


class BytePairIds:
    """Ids of pieces (without special tokens), as ``encode`` gives them.

    Runs of Latin letters, the common case, go straight to the model as the one word the tokenizer would make of them;
    their ids are kept as well, because the same word comes with different marks behind it.
    """

    def __init__(self, model, how: str | None, limit: int = MEMO_PIECES):
        self.model, self.how, self.limit, self.table = model, how, limit, byte_letters()
        self.words: dict[str, array] = {}

    def _word(self, s: str) -> array:
        found = self.words.get(s)
        if found is None:
            shown = s if s.isascii() and " " not in s else s.encode().decode("latin-1").translate(self.table)
            found = array("I", [t.id for t in self.model.model.tokenize(shown)])
            if len(s) <= MEMO_CHARS:
                if len(self.words) >= self.limit:
                    self.words.clear()
                self.words[s] = found
        return found

    def __call__(self, pieces: list[str]) -> list[array]:
        dropped = self.how == "dropped"
        out: list = [None] * len(pieces)
        others = []
        for i, piece in enumerate(pieces):
            if dropped and piece.isalpha() and piece.isascii():
                out[i] = self._word(piece.lower())
                continue
            m = SIMPLE.fullmatch(piece) if self.how else None
            if m is None:
                others.append(i)
                continue
            before, letters, behind = m.groups()
            if dropped:
                letters = letters.lower()
            elif before:
                before = " " + before
            else:
                letters = " " + letters
            found = self._word(letters)
            if before:
                found = self._word(before) + found
            out[i] = found + self._word(behind) if behind else found
        found = self.model.encode_batch_fast([pieces[i] if dropped else " " + pieces[i] for i in others], add_special_tokens=False)
        for i, e in zip(others, found, strict=True):
            out[i] = array("I", e.ids)
        return out
