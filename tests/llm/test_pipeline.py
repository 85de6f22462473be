"""The pipeline's stages on the smallest tables."""

import os

import pytest

import corpus_pipeline
from plantpulse.llm import personal

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables are not here")
def test_stages_feed_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
            seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] == seen[3]
    redacted = spark.read.parquet(str(tmp_path / "personal_data"))
    left = personal.personal_data(redacted, personal.SpanModel())
    assert left.agg({"n_email": "sum", "n_card": "sum", "n_ip": "sum", "n_phone": "sum"}).first() == (0, 0, 0, 0)
    pieces = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert pieces == {r.doc_id for r in redacted.select("doc_id").collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables are not here")
def test_run_gives_the_last_stage(spark):
    assert set(corpus_pipeline.run(spark, SF).columns) >= {"doc_id", "sequence_id", "offset", "length"}


def test_empty_documents_go_through(spark, docs, tmp_path):
    labels = str(tmp_path / "labels.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(labels)
    rows = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, str(tmp_path))
    assert rows.collect() == []
