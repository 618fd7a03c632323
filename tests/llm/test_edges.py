"""Queries and the pipeline on nulls in any column, clashing column names, repeated rows and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vantage.llm import queries

#: Names that operators give to columns of their own.
CLASH = "_id _rejected _text _t _w _own _pool a b band bands best_item block blocks centre comp component_id copies d2 f gk h id items kept k lines_gone n n_items n_shingles n_words node odd overlap p_source pi rep score sig size source_size spans src start taken target term words whole x y".split()


def write(spark, folder, empty):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [
        (None, text, "en", "s", 5), (1, None, "en", "s", 5), (2, "", None, "s", None), (3, text, None, None, 5), (3, text, None, None, 5), (4, text + "\n" + text, "en", None, 5),
        (5, "\n".join([text, "tail one", "tail two"]), "de", "t", 5), (6, "x " + text, "de", "t", 5), (7, " \n\t", "de", "t", 5), (None, None, None, None, None), (8, "é𝄞 " * 90, "en", "s", 5),
    ]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long")
    tables = {
        "documents": docs.select("*", *[F.lit(c).alias(c) for c in CLASH]),
        "labels": spark.createDataFrame([] if empty else [(3, 1, None), (None, 1, 1), (4, None, 0), (4, None, 0), (5, 1, 1)], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([] if empty else [(None, None, None), (1, None, ""), (2, "http://a.net/es/x", None), (2, "http://a.net/es/x", None)], "page_id long, url string, html string"),
        "benchmark": spark.createDataFrame([] if empty else [(None, "x y z"), (1, None), (2, ""), (3, "alpha beta gamma delta"), (3, "alpha beta gamma delta")], "item_id long, text string"),
    }
    for name, t in tables.items():
        t.withColumns({c: F.lit(c) for c in CLASH if c not in t.columns}).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return {name: t.count() for name, t in tables.items()}


@pytest.mark.parametrize("empty", [False, True])
def test_queries_on_odd_tables(spark, tmp_path, empty):
    n = write(spark, tmp_path, empty)
    for name, query in queries.queries().items():
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == n["pages" if name.startswith("op10") else "documents"], name


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_tables(spark, tmp_path, empty):
    write(spark, tmp_path, empty)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert sorted(out.columns) == sorted(docs.columns), name
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if not empty and name in ("quality", "lines", "near", "decontaminate"):
            assert ids.count(None) == 2, name
    assert len(set(corpus_pipeline.run(spark, str(tmp_path)).columns)) == len(docs.columns)
