"""Joins and set operations that the engine's loops stand for."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberleaf.queries import Registry, table

q = Registry()


@q("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_join(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(items, "o_orderkey", "left_semi")


@q("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark, sf_dir):
    """Customers without an order above 400,000."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@q("SELECT coalesce(a.k, b.k) AS nation, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def full_join(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full")


@q("SELECT e.event_id, max(p.ts) AS previous FROM events e JOIN events p ON p.user_id = e.user_id AND p.ts < e.ts AND p.event_type = 'purchase' WHERE e.event_type = 'click' GROUP BY e.event_id")
def as_of(spark, sf_dir):
    """The last purchase before each click of a user, by one window over the union instead of a range join."""
    rows = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase')")
    before = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(W.unboundedPreceding, -1)
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(before)
    return rows.withColumn("previous", last).where("event_type = 'click' and previous is not null").select("event_id", "previous")


@q("SELECT n_name, sum(c)::BIGINT AS n FROM (SELECT c_nationkey AS k, 1 AS c FROM customer UNION ALL SELECT s_nationkey, 1 FROM supplier) JOIN nation ON n_nationkey = k GROUP BY n_name")
def union_all(spark, sf_dir):
    both = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")))
    return both.join(F.broadcast(table(spark, sf_dir, "nation")), "n_nationkey").groupBy("n_name").agg(F.count("*").alias("n"))


@q("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def intersection(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.where("event_type = 'click'").select("user_id").intersect(ev.where("event_type = 'purchase'").select("user_id"))


@q("SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 5000")
def exception(spark, sf_dir):
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 5000").select("c_custkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).subtract(poor)


@q("SELECT l_orderkey AS id, 1.0 / (60 + min(r)) AS score FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 20 GROUP BY 1")
def top_per_group(spark, sf_dir):
    """Ranks within groups, cut before the shuffle by a group limit, and the best of each order."""
    rank = F.row_number().over(W.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    top = table(spark, sf_dir, "lineitem").withColumn("r", rank).where("r <= 20")
    return top.groupBy(F.col("l_orderkey").alias("id")).agg((1.0 / (60 + F.min("r"))).alias("score"))
