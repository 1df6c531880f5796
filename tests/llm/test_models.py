"""Language ID and toxicity: held-out accuracy, grammar behaviour, edge rows."""

from lexicept.llm import langid, queries, toxicity


def test_language_held_out(spark, sf_check):
    truth = {r["doc_id"]: (r["lang"], len(r["text"] or "")) for r in spark.read.parquet(f"{sf_check}/documents.parquet").collect()}
    rows = [r for r in queries.op4_language(spark, sf_check).collect() if r["held_out"]]
    assert len(rows) > 150
    assert all(0 <= r["score"] <= 1 for r in rows)
    right = [r["lang_pred"] == truth[r["doc_id"]][0] for r in rows]
    assert sum(right) / len(right) > 0.96
    long = [r for r in rows if truth[r["doc_id"]][1] > 300]
    assert sum(r["rejected"] for r in long) / len(long) < 0.02


def test_language_edges(spark):
    fit = spark.createDataFrame(
        [("the cat and the dog went to the river " * 9, "en"), ("der hund und die katze gingen zum fluss " * 9, "de"), (None, "fr"), ("x", None)],
        "text string, lang string")
    model = langid.fit(fit)
    assert set(model) == {"en", "de"}
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "123 !?", 3), (4, "the dog and the cat", 4), (5, "Der Hund und die Katze " * 9000, 5), (5, "a", 6)],
                                 "doc_id long, text string, LANGUAGE int")
    out = {(r["doc_id"], i): r["language"] for i, r in enumerate(langid.identify(docs, model).collect())}
    assert [x["lang_pred"] for x in out.values()][:5] == ["und", "und", "und", "en", "de"]
    assert [x["rejected"] for x in out.values()][:5] == [True, True, True, False, False]
    assert langid.fit(fit.limit(0)) == {}
    assert langid.identify(docs, {}).filter("language.lang_pred != 'und'").count() == 0
    assert langid.identify(docs.limit(0), model).count() == 0


def test_language_margin():
    packers = langid.compressors({"a": b"alpha beta gamma " * 20, "b": b"alpha beta gamma " * 20})
    lang, score, margin, rejected = langid.classify("alpha beta gamma", packers)
    assert (lang, score, margin, rejected) == ("a", 0.5, 0.0, True)  # equal sizes: settled by name, rejected


def tapes(text, **words):
    g = toxicity.Grammar(words, {"zzzzz": 2.0})
    return dict(zip(toxicity.TAPES, g.tapes(text)[0], strict=True))


def test_grammar():
    plain = tapes("what an idiot.")
    assert plain["plain"] == 4.0 and sum(plain.values()) == 4.0
    assert tapes("you are an idiot.")["targeted"] == 4.0
    assert tapes("idiot, that is you.")["plain"] == 4.0  # another clause
    assert tapes("that idiot is you.")["targeted"] == 4.0
    assert tapes("he is not an idiot.")["negated"] == 4.0
    assert tapes("the judge said idiot.")["quoted"] == 4.0
    assert tapes("they shouted “idiot”")["quoted"] == 4.0
    assert tapes("i will kill it")["threat"] == 4.0
    assert tapes("they kill time")["threat"] == 0.0
    assert tapes("zzzzzabc")["plain"] == 2.0 and tapes("zzzzz")["plain"] == 0.0  # a stem needs more than itself
    assert sum(tapes("all is well").values()) == 0


def test_toxicity_held_out(spark, sf_check):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_check}/labels.parquet").collect()}
    rows = queries.op1_toxicity(spark, sf_check).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(y == p for y, p in held) / len(held) > 0.93


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "you idiot", 0.5), (4, "you idiot " * 30_000, 0.5)], "doc_id long, text string, Toxicity double")
    labels = spark.createDataFrame([(4, 1), (4, None), (9, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)  # one kind of label only
    assert model["weights"] == toxicity.DEFAULT_WEIGHTS
    out = [r["toxicity"] for r in toxicity.score(docs, model).collect()]
    assert out[0] == out[1] and out[0]["predicted"] == 0 and out[2]["predicted"] == 1 and out[3]["predicted"] == 1
    assert toxicity.fit(docs.limit(0), labels.limit(0))["words"] == {}
    assert toxicity.score(docs.limit(0), model).count() == 0
