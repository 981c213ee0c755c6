"""Supersession among the orders of a customer: a topic is the set of its items' states and years."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberleaf.operators import supersession as s
from emberleaf.queries import Registry, table
from emberleaf.sources.tables import stored

q = Registry()
_ROWS = """
rows AS (SELECT o.o_orderkey AS id, 'customer ' || o_custkey AS kind, list_distinct(list_concat(list(l_returnflag || l_linestatus), list(strftime(l_shipdate, '%Y')))) AS terms, strftime(o_orderdate, '%Y-%m-%d') AS created_date
  FROM orders o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
known AS (SELECT * FROM rows WHERE kind IS NOT NULL AND len(terms) >= 2),
found AS (SELECT n.id AS new_id, o.id AS old_id, len(list_intersect(n.terms, o.terms)) / len(list_distinct(list_concat(n.terms, o.terms))) AS similarity, n.created_date AS new_date, o.created_date AS old_date
  FROM known n JOIN known o ON n.kind = o.kind AND n.created_date > o.created_date AND n.id <> o.id WHERE len(list_intersect(n.terms, o.terms)) / len(list_distinct(list_concat(n.terms, o.terms))) >= 0.7),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY similarity DESC, old_date DESC, old_id) AS r FROM found) WHERE r = 1),
links AS (SELECT old_id AS id, arg_min(new_id, (new_date, new_id)) AS successor FROM best GROUP BY old_id)"""
_CHAIN = f"WITH RECURSIVE {_ROWS}, chain AS (SELECT id, successor AS tip FROM links UNION ALL SELECT c.id, l.successor FROM chain c JOIN links l ON l.id = c.tip), ends AS (SELECT id, tip AS \"end\" FROM chain c WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.id = c.tip))"


def rows(spark, sf_dir):
    items = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    keys = F.col("o_orderkey").alias("id"), F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_date")
    return items.groupBy(*keys).agg(F.array_union(F.collect_set(F.concat("l_returnflag", "l_linestatus")), F.collect_set(F.date_format("l_shipdate", "yyyy"))).alias("terms"))


@q(f"WITH {_ROWS} SELECT new_id, old_id, round(similarity, 6) AS similarity FROM best")
def supersessions(spark, sf_dir):
    """Which earlier artifact each artifact supersedes."""
    return s.register(rows(spark, sf_dir)).select("new_id", "old_id", F.round("similarity", 6).alias("similarity"))


@q(f'{_CHAIN} SELECT id, "end" FROM ends')
def supersession_chains(spark, sf_dir):
    """The artifact at the end of each chain."""
    return s.chain_ends(s.superseded_by(s.register(rows(spark, sf_dir))))


@q(f"""{_CHAIN}, results AS (SELECT id, 100.0 / (id % 97 + 1) AS score FROM rows)
SELECT r.id, round(CASE WHEN e.id IS NOT NULL THEN score * 0.3 WHEN r.id IN (SELECT successor FROM links) THEN score * 1.2 ELSE score END, 6) AS score, e.id IS NOT NULL AS superseded
FROM results r LEFT JOIN ends e ON e.id = r.id WHERE NOT (e.id IS NOT NULL AND e."end" <> r.id AND e."end" IN (SELECT id FROM results))
""")
def superseded_results(spark, sf_dir):
    """Results of a search after supersession."""
    every = stored(rows(spark, sf_dir))
    links = stored(s.superseded_by(s.register(every)))
    results = every.select("id", (100.0 / (F.col("id") % 97 + 1)).alias("score"))
    return s.adjust(results, links, s.chain_ends(links)).withColumn("score", F.round("score", 6))
