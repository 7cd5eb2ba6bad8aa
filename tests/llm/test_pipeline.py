"""The corpus pipeline on the smallest tables, stage by stage."""

import os

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and ids <= before
        if name != "near_dedup":
            assert len(good & before - ids) <= 0.05 * len(good), name
        before = ids
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count() and last.where("NOT round_trip").count() == 0
