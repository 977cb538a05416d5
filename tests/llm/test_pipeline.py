import os

import pytest

import corpus_pipeline
from granary.llm import decontaminate, mixing, quality

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not there")
def test_stages(spark):
    docs = first = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        assert set(out.columns) - set(first.columns) == ({"copies"} if k == 4 else set())
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0] and sizes[1] == sizes[2]
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.find(spark, docs, bench).count() == 0
    texts = [r["text"] for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    kept = {r["doc_id"] for r in quality.assess(first).where("kept").collect()}
    assert {r["doc_id"] for r in docs.collect()} <= kept


def test_mixing_takes_copies(spark):
    docs = spark.createDataFrame([(k, "a" if k else "b", "w " * (10 if k else 1000)) for k in range(20)], "doc_id long, source string, text string")
    out = {r["doc_id"]: r["copies"] for r in mixing.take(spark, docs).collect()}
    assert set(out.values()) <= {1, 2} and out[1] == 2
