import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lexicept.llm import quality, queries


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if c[tuple(w[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))


@given(st.one_of(st.text(alphabet="ab é\n\t#*| ", max_size=200), st.lists(st.sampled_from(["a", "b", "c\n"]), max_size=80).map(" ".join)))
@settings(max_examples=300, deadline=None)
def test_base_counts(text):
    got = quality.judge(text.encode(), quality.Judge({}), 1, 1, 0)
    assert got[:6] == brute(text)
    assert got[9] == (not got[5])


def test_query(spark, sf_check):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_check}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_check}/labels.parquet").collect()}
    rows = queries.op8_quality(spark, sf_check).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(docs[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    judged = [(labels[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    good = [k for y, k in judged if y == 1]
    bad = [k for y, k in judged if y == 0]
    assert sum(good) / len(good) > 0.99
    assert sum(bad) / max(1, len(bad)) < 0.3


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", None, 2), (None, "x " * 30, "en", 3), (4, "x " * 30, "xx", 4)], "doc_id long, text string, lang string, QUALITY int")
    model = quality.learn(docs)
    assert set(model) == {"en", "xx"}
    out = quality.assess(docs, model).collect()
    assert [r["quality"]["n_words"] for r in out] == [0, 0, 30, 30]
    assert quality.learn(docs.limit(0)) == {}
    assert quality.assess(docs, {}).filter("quality.kept").count() == 0  # 30 equal words repeat; the rest is too short
    assert quality.assess(docs.limit(0), model).count() == 0


def exact(rows):
    """{lang: (total, the most frequent words)} by plain counting."""
    counts = {}
    for lang, text in rows:
        counts.setdefault(lang, Counter()).update(quality.common_words(text.encode()))
    return {k: (c.total(), dict(sorted(((w.decode(), n) for w, n in c.items()), key=lambda x: (-x[1], x[0].encode()))[:quality.TOP_WORDS])) for k, c in counts.items()}


def test_references_are_exact_for_any_partitions(spark):
    # every task's own words outrank the words that are frequent in the corpus as a whole
    rows = [("en", " ".join([f"own{t}x{i} " * 2 for i in range(2500)] + [f"shared{i}" for i in range(250)])) for t in range(5)]
    rows += [("de", "eins zwei zwei"), ("de", "drei é z")]
    want = exact(rows)
    assert set(want["en"][1]) == {f"shared{i}" for i in sorted(range(250), key=lambda i: f"shared{i}")[:200]}
    docs = spark.createDataFrame(rows, "lang string, text string")
    for n in (1, 7):
        model = quality.learn(docs.repartition(n))
        assert {k: (m["total"], m["words"]) for k, m in model.items()} == want


def test_full_tables_are_sent_on(spark, monkeypatch):
    rows = [("en", f"a b c{i} d{i % 3} " + "é" * (i % 5)) for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    for name, small in (("TASK_WORDS", 5), ("TASK_BYTES", 40), ("SENT_ROWS", 2)):
        monkeypatch.setattr(quality, name, small)
        model = quality.learn(docs)
        assert {k: (m["total"], m["words"]) for k, m in model.items()} == exact(rows)
