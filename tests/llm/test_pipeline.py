import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
    kept = got.select("doc_id").distinct()
    assert 0.8 * docs.count() <= kept.count() <= docs.count()
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).filter("n <> m or n > 2048").count() == 0


def test_stages_in_order_and_columns(spark):
    from helpers import awkward, table

    rows = [(d, t, "en") for d, t in awkward()] + [(200 + i, "the of and to in that which " * 8 + f"w{i}", "en") for i in range(30)]
    docs = table(spark, rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "repeats", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, "")
        assert made.columns == docs.columns and made.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()
