"""The pipeline's stages, each on its own input, and from end to end."""

import corpus_pipeline
from pyspark.sql import functions as F

from pixelmill.llm import decontamination, minhash, quality


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "benchmark_passages", "personal_data", "piece_ids"]
    kept = stages["quality_rules"](spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == quality.assess(docs).where("kept").count()
    one = stages["near_duplicates"](spark, docs, sf)
    assert one.columns == docs.columns and one.count() == minhash.near_duplicates(docs).where("keep").count()
    clean = stages["benchmark_passages"](spark, docs, sf)
    bad = decontamination.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").select("doc_id")
    assert clean.columns == docs.columns and docs.join(bad, "doc_id", "left_anti").exceptAll(clean).count() == 0 and clean.join(bad, "doc_id").count() == 0
    private = stages["personal_data"](spark, docs, sf)
    assert private.columns == docs.columns and private.count() == docs.count() and private.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.[a-z]")).count() == 0
    ids = stages["piece_ids"](spark, docs, sf)
    assert ids.count() == docs.count() and ids.where("not round_trip").count() == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() < spark.read.parquet(f"{sf}/documents.parquet").count() and out.select("doc_id").distinct().count() == out.count()


def test_empty_documents_pass_through(spark, sf, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
