import re

import corpus_pipeline
from vantage.llm import queries


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert len(corpus_pipeline.STAGES) == 5 and out.columns == [*docs.columns, "copies", "taken"]
    assert 0 < out.count() <= docs.count()


def test_filtering_stages_on_empty(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_line_stage_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, sf).collect()}
    seen, want = set(), {}
    for r in docs.orderBy("doc_id").collect():
        lines = r.text.split("\n")
        worded = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for k, a in enumerate(worded):
            for run in [worded[k : k + 1]] + [worded[k : k + 2]] * (k + 1 < len(worded)):
                block = tuple(lines[i] for i in run)
                if block in seen and (len(run) == 2 or len(re.findall(r"[^\x20\x09-\x0D]+", block[0])) >= 8):
                    gone |= set(run)
                seen.add(block)
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or text.strip(" \t\n\x0b\x0c\r"):
            want[r.doc_id] = text
    assert kept == want


def test_every_query_is_registered():
    assert sorted(q.split("_")[0] for q in queries.queries()) == sorted(f"op{i}" for i in range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
