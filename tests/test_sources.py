"""Sources and sinks: typed CSV reads, partitioned results with pruning, stable samples and splits."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from lexicept.operators.evaluate import random_split
from lexicept.session import table_path
from lexicept.sources import fixtures as fx
from lexicept.sources.readers import read_corpus, sample_n, select_run, write_result


def test_read_corpus_csv_with_declared_schema(spark, tmp_path):
    p = tmp_path / "corpus.csv"
    p.write_text('doc_id,text,lang,source,n_chars\n7,"hello, world",en,s1,12\n3,"two\nlines",en,s2,9\n')
    df = read_corpus(spark, str(p), fmt="csv")
    assert dict(df.dtypes)["doc_id"] == "bigint"
    assert sorted((r["doc_id"], r["text"]) for r in df.collect()) == [(3, "two\nlines"), (7, "hello, world")]


def test_select_run_prunes_partitions(spark, sf_small):
    docs = fx.table(spark, sf_small, "documents", spread=False).select("doc_id", "lang")
    path = write_result(docs, table_path(spark, "test_runs"), ["lang"])
    run = select_run(spark, path, lang="en")
    buf = io.StringIO()
    with redirect_stdout(buf):
        run.explain()
    assert "PartitionFilters: [isnotnull(lang" in buf.getvalue() and "(lang" in buf.getvalue()
    assert run.count() == docs.filter(F.col("lang") == "en").count()


def test_sample_and_split_do_not_depend_on_partitioning(spark, sf_small):
    docs = fx.documents(spark, sf_small)
    a = [r["doc_id"] for r in sample_n(docs, 5, "doc_id", 11).collect()]
    b = [r["doc_id"] for r in sample_n(docs.repartition(7), 5, "doc_id", 11).collect()]
    assert a == b and len(a) == 5
    s1 = random_split(docs, "doc_id", 3).select("doc_id", "split")
    s2 = random_split(docs.repartition(3), "doc_id", 3).select("doc_id", "split")
    assert s1.exceptAll(s2).count() == 0
    share = s1.filter(F.col("split") == "train").count() / s1.count()
    assert 0.6 < share < 0.9


def test_read_corpus_csv(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from lexicept.sources.readers import read_corpus_csv

    unnamed, plain = tmp_path / "a.csv", tmp_path / "b.csv"
    unnamed.write_text(',text,extra,lang\n7,"one, ""two""\nthree",x,en\n8,,y,de\n', encoding="utf8")
    plain.write_text("lang,text\nen,same\nen,same\nde,other\n", encoding="utf8")
    rows = read_corpus_csv(spark, str(unnamed), index_col="").orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(7, 'one, "two"\nthree', "en", None, None), (8, None, "de", None, None)]
    keyed = read_corpus_csv(spark, str(plain))
    assert keyed.filter(F.col("doc_id").isNull()).count() == 0
    assert (keyed.count(), keyed.select("doc_id").distinct().count()) == (3, 2)
    with pytest.raises(ValueError):
        read_corpus_csv(spark, str(plain), index_col="absent")
