"""Tiers of a registry made of orders: an order is an artifact, its last shipment the last access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberleaf.functions import text as t
from emberleaf.operators import lifecycle as lc
from emberleaf.queries import Registry, table

q = Registry()
NOW = 904608000.0  # 1998-09-01
SQL = """
registry AS (SELECT 'order/' || o_orderkey AS path, (['hot', 'hot', 'warm', 'cold'])[(o_orderkey % 4 + 1)::INT] AS tier, epoch(o_orderdate)::BIGINT AS created_at,
  coalesce(epoch(l.last), epoch(o_orderdate))::BIGINT AS last_accessed, floor(o_totalprice / 100)::BIGINT AS original_size,
  CASE WHEN o_orderkey % 4 >= 2 THEN floor(o_totalprice / 500)::BIGINT ELSE 0 END AS compressed_size
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey),
aged AS (SELECT *, (904608000 - created_at) / 3600 AS age, (904608000 - last_accessed) / 3600 AS idle FROM registry)"""


def registry(spark, sf_dir) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    rows = table(spark, sf_dir, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    key = F.col("o_orderkey")
    return rows.select(
        F.concat(F.lit("order/"), key.cast("string")).alias("path"),
        F.get(F.array(*map(F.lit, ("hot", "hot", "warm", "cold"))), (key % 4).cast("int")).alias("tier"),
        seconds("o_orderdate").alias("created_at"),
        F.coalesce(seconds("last"), seconds("o_orderdate")).alias("last_accessed"),
        F.floor(F.col("o_totalprice") / 100).alias("original_size"),
        F.when(key % 4 >= 2, F.floor(F.col("o_totalprice") / 500)).otherwise(0).alias("compressed_size"),
    )


@q(f"""WITH {SQL}
SELECT path, 'warm' AS target FROM aged WHERE tier = 'hot' AND age >= 168 AND idle >= 72 AND original_size >= 512
UNION ALL SELECT path, 'cold' FROM aged WHERE tier = 'warm' AND age >= 720 AND idle >= 336
UNION ALL SELECT path, 'frozen' FROM aged WHERE tier = 'cold' AND age >= 2160 AND idle >= 720
""")
def tier_candidates(spark, sf_dir):
    """What may move to each next tier."""
    rows = registry(spark, sf_dir)
    due = F.lit(None).cast("string")
    for tier, before in lc.BEFORE.items():
        due = F.when((F.col("tier") == before) & lc.due(tier, NOW), tier).otherwise(due)
    return rows.select("path", due.alias("target")).where("target is not null")


_DUE = {"warm": "age >= 168 AND idle >= 72 AND original_size >= 512", "cold": "age >= 720 AND idle >= 336", "frozen": "age >= 2160 AND idle >= 720"}


@q(f"""WITH {SQL},
a AS (SELECT *, CASE WHEN tier = 'hot' AND {_DUE["warm"]} THEN 'warm' ELSE tier END AS t1 FROM aged),
b AS (SELECT *, CASE WHEN t1 = 'warm' AND {_DUE["cold"]} THEN 'cold' ELSE t1 END AS t2 FROM a),
c AS (SELECT *, CASE WHEN t2 = 'cold' AND {_DUE["frozen"]} THEN 'frozen' ELSE t2 END AS t3 FROM b)
SELECT path, tier AS from_tier, t3 AS to_tier, original_size FROM c WHERE tier <> t3
""")
def tier_cascade(spark, sf_dir):
    """The moves of one run over the whole registry."""
    return lc.actions(registry(spark, sf_dir), NOW)


@q(f"""WITH {SQL}
SELECT CASE WHEN age >= 2160 AND idle >= 720 THEN 'frozen' WHEN age >= 720 AND idle >= 336 THEN 'cold' WHEN age >= 168 AND idle >= 72 THEN 'warm' ELSE 'hot' END AS tier, count(*) AS n, sum(original_size)::BIGINT AS bytes FROM aged GROUP BY 1
""")
def tiers_by_age(spark, sf_dir):
    """How many artifacts belong in each tier by age alone."""
    tier = lc.tier_of_age(lc.hours_since(F.col("created_at"), NOW), lc.hours_since(F.col("last_accessed"), NOW))
    return registry(spark, sf_dir).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.sum("original_size").alias("bytes"))


@q(f"""WITH {SQL},
g AS (SELECT tier, count(*) AS n, sum(original_size)::BIGINT AS o, coalesce(sum(compressed_size) FILTER (compressed_size > 0), 0)::BIGINT AS c, coalesce(sum(original_size) FILTER (tier = 'hot'), 0)::BIGINT AS h FROM registry GROUP BY GROUPING SETS ((tier), ()))
SELECT tier, n, o AS original_size, c AS compressed_size, CASE WHEN c > 0 THEN round(o / c, 2) ELSE 1.0 END::DOUBLE AS overall_ratio, CASE WHEN c > 0 THEN o - h - c ELSE 0 END AS space_saved FROM g
""")
def registry_stats(spark, sf_dir):
    """Bytes and ratios of each tier and of all."""
    return lc.stats(registry(spark, sf_dir))


@q("""
SELECT (['hot', 'warm', 'cold', 'frozen'])[(doc_id % 4 + 1)::INT] AS tier, count(*) AS n, sum(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))))::BIGINT AS total_keywords, sum(n_chars)::BIGINT AS total_chars FROM documents GROUP BY 1
""")
def context_stats(spark, sf_dir):
    tier = F.get(F.array(*map(F.lit, ("hot", "warm", "cold", "frozen"))), (F.col("doc_id") % 4).cast("int"))
    return lc.context_stats(table(spark, sf_dir, "documents").select(tier.alias("tier"), t.tokens("text").alias("keywords"), F.col("n_chars").alias("char_count")))


@q("""
SELECT unit, period, n, bytes FROM (
  SELECT 'week' AS unit, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS period, count(*) AS n, round(sum(o_totalprice), 2) AS bytes FROM orders GROUP BY 2
  UNION ALL SELECT 'month', strftime(date_trunc('month', o_orderdate), '%Y-%m-%d'), count(*), round(sum(o_totalprice), 2) FROM orders GROUP BY 2
  UNION ALL SELECT 'quarter', strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d'), count(*), round(sum(o_totalprice), 2) FROM orders GROUP BY 2)
""")
def batch_rollup(spark, sf_dir):
    """Batches of weeks, made into months and quarters."""
    orders = table(spark, sf_dir, "orders")
    out = None
    for unit in ("week", "month", "quarter"):
        part = lc.rollup(orders, "o_orderdate", unit, F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("bytes")).select(F.lit(unit).alias("unit"), "period", "n", "bytes")
        out = part if out is None else out.unionByName(part)
    return out


@q("""
SELECT o_orderkey AS path, o_custkey AS mtime FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_orderkey = o.o_orderkey AND s.o_orderkey % 3 <> 0 AND s.o_custkey + (s.o_orderkey % 5 = 0)::INT = o.o_custkey)
""")
def changed_files(spark, sf_dir):
    """Files that are new or changed since a recorded state."""
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("mtime"))
    state = files.where("path % 3 <> 0").withColumn("mtime", F.col("mtime") + (F.col("path") % 5 == 0).cast("int"))
    return lc.changed(files, state)


@q(f"""WITH {SQL}
SELECT path, CASE WHEN compressed_size > 0 THEN round(original_size / compressed_size, 2) ELSE 0 END::DOUBLE AS ratio, CASE WHEN original_size > 0 THEN round((1 - compressed_size / original_size) * 100, 1) ELSE 0 END::DOUBLE AS savings
FROM aged WHERE 904608000 - last_accessed >= 48 * 3600 AND 904608000 - created_at <= 365 * 86400
""")
def compaction(spark, sf_dir):
    """Artifacts old enough to compact and not yet to delete, with their ratios."""
    rows = registry(spark, sf_dir).withColumns({"last_modified": F.col("last_accessed"), "recycled_at": F.col("created_at")})
    ratio, savings = lc.ratios(F.col("original_size"), F.col("compressed_size"))
    return lc.retained(lc.compactable(rows, NOW), NOW, 365).select("path", ratio.alias("ratio"), savings.alias("savings"))
