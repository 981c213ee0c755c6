"""Retrieval metrics: benchmark passages against the documents that hold them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberleaf.functions import text as t
from emberleaf.operators import metrics as m
from emberleaf.queries import Registry, table

q = Registry()
_RANKED = """
w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark),
s AS (SELECT item_id, doc_id, len(list_intersect(b.w, w.w)) / len(b.w) AS score FROM b CROSS JOIN w),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0), k AS (SELECT * FROM r WHERE rank <= 5),
g AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, left(b.text, 60))), n AS (SELECT item_id, count(DISTINCT doc_id) AS n FROM g GROUP BY 1),
h AS (SELECT n.item_id, n, count(rank) FILTER (rank <= 1) AS h1, count(rank) FILTER (rank <= 3) AS h3, count(rank) FILTER (rank <= 5) AS h5, min(rank) AS first FROM n LEFT JOIN (SELECT k.* FROM k SEMI JOIN g ON k.item_id = g.item_id AND k.doc_id = g.doc_id) x USING (item_id) GROUP BY ALL)"""


def _measured(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    words = docs.select("doc_id", F.explode(t.tokens("text")).alias("w"))
    asked = bench.select("item_id", t.tokens("text").alias("ws")).select("item_id", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    score = words.join(asked, "w").groupBy("item_id", "doc_id", "n").agg(F.count("*").alias("c")).withColumn("score", F.col("c") / F.col("n"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    ranked = score.withColumn("rank", rank).where("rank <= 5").select(F.col("item_id").alias("query"), F.col("doc_id").alias("id"), "rank")
    heads = bench.select("item_id", F.left("text", F.lit(60)).alias("head"))
    relevant = m.holders(docs.select("doc_id", "text"), heads, "doc_id", "text", "head").select(F.col("item_id").alias("query"), F.col("doc_id").alias("id"))
    return m.retrieval(ranked, relevant)


@q(f"WITH {_RANKED} SELECT item_id AS query, round(h1 / n, 6) AS recall_1, round(h3 / n, 6) AS recall_3, round(h5 / n, 6) AS recall_5, h1 / 1.0::DOUBLE AS precision_1, round(h3 / 3.0, 6)::DOUBLE AS precision_3, round(h5 / 5.0, 6)::DOUBLE AS precision_5, round(coalesce(1 / first, 0), 6) AS mrr FROM h")
def retrieval_metrics(spark, sf_dir):
    """Recall, precision and reciprocal rank of a keyword search for each passage."""
    rows = _measured(spark, sf_dir)
    return rows.select("query", *(F.round(c, 6).alias(c) for c in rows.columns if c != "query"))


@q(f"WITH {_RANKED} SELECT count(*) AS queries, round(avg(h1 / n), 6) AS recall_1, round(avg(h3 / n), 6) AS recall_3, round(avg(h5 / n), 6) AS recall_5, round(avg(h1 / 1.0), 6) AS precision_1, round(avg(h3 / 3.0), 6) AS precision_3, round(avg(h5 / 5.0), 6) AS precision_5, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM h")
def retrieval_summary(spark, sf_dir):
    rows = m.averages(_measured(spark, sf_dir))
    return rows.select("queries", *(F.round(c, 6).alias(c) for c in rows.columns if c != "queries"))


@q("""
WITH s AS (SELECT user_id, list_distinct(list(json_extract_string(props, '$.k')) FILTER (event_type = 'click')) AS predicted, list_distinct(list(json_extract_string(props, '$.k')) FILTER (event_type <> 'click')) AS actual FROM events GROUP BY user_id)
SELECT count(*) AS sessions, sum(coalesce(len(predicted), 0))::BIGINT AS predictions, sum(coalesce(len(list_intersect(predicted, actual)), 0))::BIGINT AS hits, round(avg(CASE WHEN len(predicted) > 0 THEN len(list_intersect(predicted, actual)) / len(predicted) END), 6) AS accuracy FROM s
""")
def prediction_accuracy(spark, sf_dir):
    """How many of a user's clicks foretell their other events."""
    k = F.get_json_object("props", "$.k")
    log = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type") == "click", k)).alias("predicted"), F.collect_set(F.when(F.col("event_type") != "click", k)).alias("actual"))
    return m.prediction_accuracy(log).withColumn("accuracy", F.round("accuracy", 6))
