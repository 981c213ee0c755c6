"""The pipeline's stages against brute force."""

from __future__ import annotations

import re

import corpus_pipeline as pipeline
from pyspark.sql import functions as F


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = pipeline.stored(pipeline.language(spark, docs, sf))
    assert one.columns == docs.columns and one.count() >= 0.98 * docs.count()
    two = pipeline.stored(pipeline.near_duplicates(spark, one, sf))
    assert two.columns == docs.columns
    from tests.llm.test_text_ops import linked_groups, near_pairs

    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    groups = linked_groups(list(texts), near_pairs(texts, 5)[1])
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(set(groups.values()))
    three = pipeline.stored(pipeline.secrets(spark, two, sf))
    assert three.count() == two.count()
    assert three.where(F.col("text").rlike("AKIA[A-Z0-9]{16}|[0-9a-f]{24}") | (F.length("text") != F.col("n_chars"))).isEmpty()
    four = pipeline.stored(pipeline.mixture(spark, three, sf))
    words = lambda df: df.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(words(four) - 1.5 * words(three)) < 50
    five = pipeline.tokens(spark, four, sf)
    assert five.count() == four.count() and five.where("n_tokens <> size(ids)").isEmpty()


def test_odd_documents(spark, odd, none, sf):
    docs = odd.select(*pipeline.COLUMNS)
    for rows in (docs, docs.where("false")):
        for name, stage in pipeline.STAGES:
            rows = pipeline.stored(stage(spark, rows, sf))
            assert name == "tokens" or rows.columns == list(pipeline.COLUMNS)
    kept = pipeline.near_duplicates(spark, docs, sf).collect()
    assert sum(r["doc_id"] is None for r in kept) == 2
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 8, 9, 10]
    assert all(not re.search("token=", r["text"] or "") for r in kept)
