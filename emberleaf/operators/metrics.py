"""Quality of retrieval and of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Passages that may be broadcast.
FEW = 2000


def holders(docs: DataFrame, passages: DataFrame, key: str, text: str, passage: str) -> DataFrame:
    """Rows of ``docs`` (``key``, ``text``) with each row of ``passages`` whose column ``passage`` they contain.

    Up to FEW passages are compared with every text. Of more, those of six words or more find their texts by three inner words,
    which are whole words of a text that holds the passage; shorter ones must be FEW.
    """
    hit = F.contains(F.col(text), F.col(passage))
    if passages.count() <= FEW:
        return docs.join(F.broadcast(passages), hit)
    own = passages.withColumn("w_", F.split(passage, " ")).withColumn("k_", F.when(F.size("w_") >= 6, F.array_join(F.slice("w_", 2, 3), " ")))
    short = passages.join(own.where("k_ is null").select(passage).distinct(), passage, "left_semi")
    if short.count() > FEW:
        raise ValueError(f"more than {FEW} passages of fewer than six words")
    words = docs.select(key, F.split(text, " ").alias("a"))
    keys = words.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("a") - 3)), lambda i: F.array_join(F.slice("a", i + 1, 3), " ")))).alias("k_"))
    found = keys.join(own.where("k_ is not null"), "k_").drop("k_", "w_").join(docs, key).where(hit)
    return found.select(*docs.columns, *passages.columns).unionByName(docs.join(F.broadcast(short), hit).select(*docs.columns, *passages.columns))


def retrieval(ranked: DataFrame, relevant: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """recall@k, precision@k and reciprocal rank of each query.

    ``ranked`` has query, id and rank; ``relevant`` has query and id. Queries without relevant rows are left out.
    """
    total = relevant.groupBy("query").agg(F.count_distinct("id").alias("n"))
    hits = ranked.join(relevant.distinct(), ["query", "id"])
    per = hits.groupBy("query").agg(F.min("rank").alias("first"), *(F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks))
    rows = total.join(per, "query", "left")
    at = lambda k: F.coalesce(f"hits_{k}", F.lit(0))
    return rows.select("query", *((at(k) / F.col("n")).alias(f"recall_{k}") for k in ks), *((at(k) / F.lit(float(k))).alias(f"precision_{k}") for k in ks), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def averages(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in rows.columns if c != "query"))


def prediction_accuracy(log: DataFrame) -> DataFrame:
    """Sessions, predictions, hits and the mean share of predictions that came true.

    ``log`` has arrays ``predicted`` and ``actual``; sessions without predictions do not count in the mean.
    """
    hits = F.size(F.array_intersect("predicted", "actual"))
    n = F.size(F.array_distinct("predicted"))
    return log.agg(F.count("*").alias("sessions"), F.sum(n).cast("long").alias("predictions"), F.sum(hits).cast("long").alias("hits"), F.avg(F.when(n > 0, hits / n)).alias("accuracy"))
