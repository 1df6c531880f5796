"""The corpus pipeline against plain Python on the smallest tables, and its edge cases."""

from collections import Counter

import corpus_pipeline as cp
from lexicept.llm import langid, mixing, secretscan
from lexicept.llm.common import crc_fold

from .test_decontaminate import brute
from .test_simhash import brute_components, brute_fingerprint


def test_stages_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").select("item_id", "text").collect()]
    sets = {}
    for name, stage in cp.STAGES[:-1]:
        before = docs
        docs = cp.written(stage(spark, before, sf_small), "test-stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sets[name] = ({r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in docs.collect()})

    before, after = sets["language ID"]
    packers = langid.compressors(langid.fit(spark.read.parquet(f"{sf_small}/documents.parquet").filter(crc_fold("doc_id", 4) != 2)))
    assert before == rows
    assert after == {d: t for d, t in rows.items() if not langid.classify(t, packers)[3]}

    before, after = sets["SimHash near-dedup"]
    ids = sorted(before)
    groups = brute_components([brute_fingerprint(before[d]) for d in ids])
    assert set(after) == {ids[i] for i in set(groups.values())}

    before, after = sets["benchmark decontamination"]
    bad = {r[0] for r in brute(list(before.items()), items) if r[5]}
    assert bad and set(after) == set(before) - bad

    before, after = sets["secret scans"]
    assert set(before) == set(after)
    for d, t in after.items():
        assert (t == before[d]) == (not secretscan.find(before[d]))
        assert not [s for s in secretscan.base_spans(t) if "[REDACTED]" not in t[s[0]:s[2] + 10]]

    mixed = cp.STAGES[-1][1](spark, docs, sf_small)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert copies == {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    assert sum(copies.values()) > 0
    assert Counter(r["doc_id"] for r in cp.run(spark, sf_small).collect()) == copies


def test_edge_rows(spark, sf_small):
    text = "the river and the stone are in the valley and the people of the hills went there for the water"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (1, "a different text of the same id that the others do not have at all", "en", None, 1),
            (None, text, "en", "a", 1), (None, None, None, None, None), (7, "", "en", "b", 0), (8, "12345 !!", "en", "b", 8)]
    own = ["_key", "_i", "_k", "_mix_key", "_language", "doc", "src", "h", "t", "cell", "size", "language", "group", "b", "n"]
    docs = spark.createDataFrame([(*r, *own) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in own))
    for table in (docs, docs.limit(0)):
        out = table
        for name, stage in cp.STAGES:
            out = cp.written(stage(spark, out, sf_small), "test-edge")
            assert out.columns == docs.columns
            assert out.select(*own).distinct().collect() in ([tuple(own)], [])
            if name == "SimHash near-dedup" and table is docs:
                kept = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
                assert kept == sorted([(1, text), (1, rows[2][1])], key=str)
