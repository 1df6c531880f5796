"""Token shards, importance resampling and cross-tokenizer alignment against plain brute force."""

from __future__ import annotations

import gc
import hashlib
import io
import math
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexicept.llm import alignment, importance, tokenbin, words
from lexicept.llm.common import table, text_batches
from lexicept.session import table_path

WORD_BPE, BYTE_BPE, PIECE_BPE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  two  spaces ", "tab\tnew\n\nline end \n", "Don't STOP! we'll 'tis O'Neil's", "été, ÉTÉ. straße 北京 日本語のテキスト",
    "é Å ́x Σίσυφος ΣΑΣ", "<|endoftext|> a<|startoftext|>b </s> <s> <0x41> ▁x▁y", "x " * 30, "word " * 25, "1,234.56 3rd x1y2", "a" * 3000,
    "emoji 👩‍👩‍👧 \x1c sep \x85 nel \xa0 nbsp", "naïve—dash…", "▁", "(see) [it] \"quoted\" a|b <b>bold</b> x! !y ...z... 'quoted' it's. he'll, *a_b* #tag @me {c} e=mc", "the cat sat on the mat and looked at the very same cat " * 400,
]


@pytest.fixture(scope="module")
def docs(spark, sf_small):
    text_batches(spark)
    given = [(r.doc_id, r.text) for r in table(spark, sf_small, "documents").limit(60).collect()]
    rows = given + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (10_003, "  two  spaces "), (10_003, "other text")]
    clash = [(i, t, "x", 1, 2, 3, "lang") for i, t in rows]  # extra columns named like the operators' own
    return spark.createDataFrame(clash, "doc_id long, text string, ids string, _row int, _h int, _a int, weight string").repartition(5)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_word_by_word_ids_are_the_tokenizers_own(rows):
    texts = [t for _, t in rows if t]
    for path, plain in ((WORD_BPE, False), (BYTE_BPE, True)):
        model = words.tokenizer(path, plain)
        how = words.cuts_hold(model)
        assert how
        ids = words.BytePairIds(model, how, 50)
        lead = "" if how == "dropped" else " "
        cut = words.split_dropped if how == "dropped" else words.CUT.split
        for limit in (words.MEMO_PIECES, 3):
            memo = words.Memo(ids, limit, cut)
            got = [[i for part in parts for i in part] for parts in memo.texts(texts)]
            assert got == [model.encode(lead + t, add_special_tokens=False).ids for t in texts]
    model = words.sentence_model(PIECE_BPE)
    assert words.cuts_hold(model) == "led"
    memo = words.Memo(lambda p: model.encode(p))
    assert [[i for part in parts for i in part] for parts in memo.texts(texts)] == model.encode(texts)


def test_plain_words_take_no_pattern(monkeypatch):
    """Letters alone go to the model as they are; only pieces with marks or other letters meet the pattern."""
    model = words.tokenizer(WORD_BPE)
    met = []

    class Counting:
        def fullmatch(self, piece, whole=words.SIMPLE):
            met.append(piece)
            return whole.fullmatch(piece)

    monkeypatch.setattr(words, "SIMPLE", Counting())
    pieces = ["plain", "Words", "naïve", "a,", "(b)", "x1", "ÉTÉ", "it's", "ＡＢ", "\x7f", "tab\tbed"]
    got = words.BytePairIds(model, "dropped")(pieces)
    assert [list(x) for x in got] == [model.encode(p, add_special_tokens=False).ids for p in pieces]
    assert met == pieces[2:]


def test_only_words_not_met_before_reach_the_tokenizer(monkeypatch):
    """Marks, digits and capitals around a word make no piece of their own; a piece with other characters stays whole."""
    made = []

    class Counting(words.BytePairIds):
        def __call__(self, pieces):
            made.extend(pieces)
            return super().__call__(pieces)

    monkeypatch.setattr(tokenbin, "BytePairIds", Counting)
    monkeypatch.setattr(tokenbin, "_ENCODERS", {})
    texts = ["cat, Cat. (cat)\ncat!", None, "", "dog 12 cat's été, ÉTÉ", "CAT;dog"]
    model = words.tokenizer(WORD_BPE)
    for _ in range(2):
        ids, sizes = tokenbin._encoder(WORD_BPE, 2)(pa.array(texts))
        want = [[*(model.encode(t, add_special_tokens=False).ids if t else []), 2] for t in texts]
        assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]
    assert sorted(made) == sorted(["cat", ",", " ", ".", "(", ")", "\n", "!", "dog", "1", "2", "cat's", "été", "ÉtÉ", ";"])


def test_any_characters_give_the_tokenizers_own_ids(spark, monkeypatch):
    model, rng = words.tokenizer(WORD_BPE), np.random.default_rng(4)
    letters = [*"abzAZ  '<>|.,;-_09\n\t\r\x0b\x0c\x1c\x00\x7f×÷éÉßÿªµ½\x85\xa0", "́", "̇", *"İΣ北가ſK👩", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", " word", "DON'T"]
    texts = [None if k % 20 == 0 else "".join(rng.choice(letters, rng.choice([0, 1, 3, 30, 150]))) for k in range(300)]
    want = [[*(model.encode(t, add_special_tokens=False).ids if t else []), 2] for t in texts]
    for part, size in ((tokenbin.PART_BYTES, 1 << 20), (60, 10)):  # at last most texts are longer than a part, and cut
        monkeypatch.setattr(tokenbin, "PART_BYTES", part)
        monkeypatch.setattr(tokenbin, "slices", lambda t, size=size: words.slices(t, size))
        monkeypatch.setattr(tokenbin, "_ENCODERS", {})
        for given in (pa.array(["before", *texts]).slice(1), pa.array(texts, pa.large_string())):
            ids, sizes = tokenbin._encoder(WORD_BPE, 2)(given)
            assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts) if "\x00" not in (t or "")], "k long, text string")
    got = df.select("k", tokenbin.encode("text", WORD_BPE, 2).alias("ids")).collect()
    assert all(np.frombuffer(r.ids, "<u4").tolist() == want[r.k] for r in got) and len(got) == df.count()


def test_other_tokenizers_get_whole_texts(monkeypatch):
    monkeypatch.setattr(tokenbin, "cuts_hold", lambda model: None)
    monkeypatch.setattr(tokenbin, "_ENCODERS", {})
    model = words.tokenizer(WORD_BPE)
    ids, sizes = tokenbin._encoder(WORD_BPE, None)(pa.array(ODD))
    want = [model.encode(t, add_special_tokens=False).ids if t else [] for t in ODD]
    assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]


def test_distinct_pieces_are_made_once_while_they_are_frequent():
    made = []
    memo = words.Memo(lambda ps: made.extend(ps) or [p.upper() for p in ps], 20)
    for n in range(60):
        part = [f"rare{n}x{i}" for i in range(6)] + ["often"] * (n % 2 == 0) + ["y" * 65]
        assert memo.distinct(part) == [p.upper() for p in part]
        assert len(memo.known) + len(memo.older) <= 40 and "y" * 65 not in memo.older
    assert made.count("often") == 1
    assert memo.distinct([f"new{i}" for i in range(50)]) == [f"NEW{i}" for i in range(50)] and memo.distinct([]) == []


def test_slices_put_together_are_the_text():
    text = "ab cd  ef\ngh " * 50
    parts = list(words.slices(text, 40))
    assert len(parts) > 5 and " ".join(parts) == text
    assert list(words.slices("x" * 500, 40)) == ["x" * 500]


def _ids(rows):
    model = Tokenizer.from_file(WORD_BPE)
    return [(i, [*(model.encode(t, add_special_tokens=False).ids if t else []), 2]) for i, t in rows]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_shards_round_trip(spark, docs, rows, planes):
    path = table_path(spark, "test-ids-" + uuid.uuid4().hex)
    tokenbin.write(docs, path, WORD_BPE, 2, planes, block=500)
    got = tokenbin.read(spark, path).collect()
    got = sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got), key=lambda r: r[1])
    keyed = lambda i: -1 if i is None else i
    want = {}
    for i, ids in _ids(rows):
        want.setdefault(keyed(i), []).append(np.array(ids, "<u4").tobytes())
    start = 0
    for i, at, n, ids in got:
        assert at == start and n == len(ids) // 4
        want[keyed(i)].remove(ids)
        start += n
    assert not any(want.values()) and [keyed(r[0]) for r in got] == sorted(keyed(r[0]) for r in got)


def test_blocks_and_index():
    rng = np.random.default_rng(1)
    for kind in ("byte", "bit"):
        for n in (1, 7, 8, 100):
            ids = rng.integers(0, 2**32, n, dtype=np.uint32)
            assert (tokenbin.ids_of([p.tobytes() for p in tokenbin.planes_of(ids, kind)], n, kind) == ids).all()
        out = io.BytesIO()
        shard = tokenbin.ShardWriter(out, kind, block=10)
        lengths = np.array([1, 25, 4, 1])
        ids = rng.integers(0, 50_000, 31, dtype=np.uint32)
        shard.add(np.arange(4), np.ones(4, int), lengths, ids)
        assert shard.close() == (4, 31)
        reader = tokenbin.ShardReader(out)
        assert [b[1] for b in reader.index["blocks"]] == [10, 10, 10, 1]
        assert (reader.block(2) == ids[20:30]).all()  # found by the index alone
        assert (np.concatenate([x for _, _, x in reader.ranges()]) == ids).all()
        broken = bytearray(out.getvalue())
        reader.index["blocks"][0][2] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            reader.block(0)
        with pytest.raises(ValueError, match="cut short"):
            tokenbin.ShardReader(io.BytesIO(bytes(broken[:-3])))


def test_files_outside_the_manifest_are_not_read(spark, docs):
    import os

    path = table_path(spark, "test-ids-" + uuid.uuid4().hex)
    tokenbin.write(docs.limit(3), path, WORD_BPE, 2)
    n = tokenbin.read(spark, path).count()
    with open(os.path.join(path.replace("file:", ""), "shard-000000-lost.idp"), "wb") as f:
        f.write(b"half a file")
    assert n == 3 and tokenbin.read(spark, path).count() == 3


def test_empty_table(spark, docs):
    none = docs.filter("false")
    path = table_path(spark, "test-ids-" + uuid.uuid4().hex)
    tokenbin.write(none, path, WORD_BPE, 2)
    assert tokenbin.read(spark, path).count() == 0
    assert importance.resample(none, none).collect() == []
    assert alignment.link_scores(none, BYTE_BPE, PIECE_BPE)[0].collect() == []


# ---------------------------------------------------------------- importance

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text):
    w = _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def _bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def test_importance_matches_brute_force(spark, sf_small, docs, rows):
    target = table(spark, sf_small, "benchmark")
    got = importance.resample(docs, target, percent=30).select("doc_id", "n_features", "weight", "score", "rank").collect()
    s = Counter(_bucket(f) for _, t in rows for f in _features(t)[1])
    t = Counter(_bucket(f) for r in target.collect() for f in _features(r["text"])[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    want, fit = [], []
    for i, text in rows:
        w, fs = _features(text)
        weight = sum(gain[_bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want.append((i, len(fs), weight, score))
        if len(w) >= 20:
            fit.append((-score, i))
    k = len(fit) * 30 // 100
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    assert [(-r.score, r.doc_id) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == sorted(fit)[:k]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, k + 1))


def test_dictionary_size_and_buffer_cuts_do_not_change_features():
    texts = ["The cat; the CAT, the cat's " * 9, "", None, "ünï çode " * 5 + "y" * 200 + " z " + "w" * 65, "a b", "-"] * 3
    want = Counter(_bucket(f) for t in texts for f in _features(t)[1])
    for limit in (0, 2, 1000):
        for piece in (1, 13, 1 << 20):
            scan, got = importance.Scanner(limit, piece), Counter()
            for _ in range(3):  # later rounds find words in the automaton
                got = Counter()
                for _, *runs in scan.features([t.encode() if t is not None else None for t in texts]):
                    for b in runs:
                        got.update(b[b >= 0].tolist())
                assert got == want


def test_equal_scores_and_one_id_for_many_rows(spark):
    same = spark.createDataFrame([(7, "w " * 20)] * 400 + [(i, "w " * 20) for i in range(200)], "doc_id long, text string").repartition(7)
    got = importance.resample(same, same, percent=50)
    ranks = [r["rank"] for r in got.orderBy("rank").collect() if r["rank"]]
    assert got.count() == 600 and ranks == list(range(1, 301))


def test_frequent_pieces_stay_in_the_memo():
    made = []
    memo = words.Memo(lambda ps: made.extend(ps) or [p.upper() for p in ps], 20)
    for n in range(60):  # a piece of every second part among rare ones
        part = [f"rare{n}x{i}" for i in range(6)] + ["often"] * (n % 2 == 0)
        assert memo.texts([" ".join(part)]) == [[p.upper() for p in part]]
        assert len(memo.known) + len(memo.older) <= 40
    assert made.count("often") == 1 and len(made) == 6 * 60 + 1


# ---------------------------------------------------------------- alignment


def _brute(rows):
    a_model, b_model = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    a_model.encode_special_tokens = True
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printing]
    letter = {chr(b): b for b in printing} | {chr(256 + n): b for n, b in enumerate(others)}
    of_a = {i: bytes(letter[c] for c in t) for t, i in a_model.get_vocab().items() if not t.startswith("<|end")}
    piece = b_model.id_to_piece
    of_b = lambda i: bytes([int(piece(i)[3:5], 16)]) if b_model.is_byte(i) else piece(i).replace("▁", " ").encode()
    out, count = [], Counter()
    for i, t in rows:
        a = a_model.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_model.encode(t) if t else []
        xa, xb = [of_a[k] for k in a], [of_b(k) for k in b]
        if not t or b"".join(xa) != (" " + t).encode() or b"".join(xb) != (" " + t).encode():
            out.append((i, None))
            continue
        ends = [np.cumsum([len(x) for x in xs]) for xs in (xa, xb)]
        starts = [e - np.array([len(x) for x in xs]) for e, xs in zip(ends, (xa, xb), strict=True)]
        groups, last = [], 0
        for c in sorted(set(ends[0].tolist()) & set(ends[1].tolist())):
            groups.append("|".join(",".join(str(k) for k, e in zip(x, es, strict=True) if last < e <= c) for x, es in zip((a, b), ends, strict=True)))
            last = c
        links = [(a[p], b[q]) for p in range(len(a)) for q in np.flatnonzero((starts[1] < ends[0][p]) & (ends[1] > starts[0][p]))]
        count.update(set(links))
        out.append((i, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [
        (i, 0, 0, 0, 0, 0, 0, "") if z is None else
        (i, z[0], z[1], z[2], len(z[3]), sum(count[k] == top[k[0]] for k in z[3]), sum(count[k] for k in z[3]), z[4])
        for i, z in out
    ]


def test_alignment_matches_brute_force(spark, docs, rows, monkeypatch):
    short = [r for r in rows if r[1] is None or len(r[1]) < 9000]
    few = docs.filter("text is null or length(text) < 9000")
    want = sorted(_brute(short), key=repr)
    got, pairs = alignment.link_scores(few, BYTE_BPE, PIECE_BPE)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert pairs.filter("best").count() >= pairs.select("a").distinct().count()
    # the salted join of large pair tables, and whole texts as one interval, give the same
    from lexicept.functions import sizing

    monkeypatch.setattr(sizing, "BROADCAST_MAX_ROWS", 0)
    monkeypatch.setattr(sizing, "is_small", lambda *a, **k: False)
    assert sorted((tuple(r) for r in alignment.link_scores(few, BYTE_BPE, PIECE_BPE)[0].collect()), key=repr) == want


def test_whole_texts_as_one_interval(rows):
    one, whole = alignment.Aligner(BYTE_BPE, PIECE_BPE), alignment.Aligner(BYTE_BPE, PIECE_BPE)
    whole.cut = False
    texts = [t for _, t in rows]
    assert [r[:5] for r in one.texts(texts)] == [r[:5] for r in whole.texts(texts)]


def test_leaf_groups_split_at_every_shared_end():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.array(sorted({*rng.integers(1, n + 1, int(rng.integers(1, 40))).tolist(), n})) for _ in range(2))
        a_from, a_to, b_from, b_to = alignment.leaf_groups(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
        assert a[a_to - 1].tolist() == b[b_to - 1].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        assert a_from.tolist() == [0, *a_to[:-1].tolist()] and b_from.tolist() == [0, *b_to[:-1].tolist()]


def test_groups_as_text(spark):
    df = spark.createDataFrame([(1, "hello worlds"), (2, None)], "doc_id long, text string")
    got = [r[0] for r in df.orderBy("doc_id").select(alignment.groups_of("text", BYTE_BPE, PIECE_BPE)).collect()]
    assert re.fullmatch(r"[\d,]+\|[\d,]+(;[\d,]+\|[\d,]+)*", got[0]) and got[1] == ""
    assert got[0].count("|") == df.filter("doc_id = 1").select(alignment.align("text", BYTE_BPE, PIECE_BPE).alias("r")).select(F.col("r.n_groups")).first()[0]


def test_pieces_aligned_together_or_alone():
    one, pieces = alignment.Aligner(BYTE_BPE, PIECE_BPE), ["word", "word,", "Zé.\nthe", "</s>", "\ufffd", "a\u2581b", "12", "<s>x", "don't", ""]
    alone = [one.align([p])[0] for p in pieces]
    assert one.align(pieces) == alone and one.align([]) == []
    assert any(r[6] for r in alone) and not all(r[6] for r in alone)  # a piece that is not given back leaves the others
    good = [p for p, r in zip(pieces, alone, strict=True) if r[6]]
    assert one.align(good) == [r for r in alone if r[6]]
    assert not any(map(gc.is_tracked, _after_collection(one.align(good))))


def _after_collection(values):
    gc.collect()
    return values
