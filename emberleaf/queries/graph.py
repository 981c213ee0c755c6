"""The co-recall graph of events: a session is a user's day, an artifact the event's key."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberleaf.functions import text as t
from emberleaf.operators import graph as g
from emberleaf.queries import Registry, table
from emberleaf.sources.tables import checkpoint_dir

q = Registry()
_LOG = "log AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS session, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item FROM events), one AS (SELECT DISTINCT session, item FROM log)"
_PAIRS = f"{_LOG}, pairs AS (SELECT a.item AS a, b.item AS b, count(*) AS n_ab FROM one a JOIN one b USING (session) WHERE a.item < b.item GROUP BY ALL), n AS (SELECT item, count(*) AS n_a FROM log GROUP BY item), s AS (SELECT count(DISTINCT session) AS n FROM log)"
_GRAPH = f"""{_PAIRS},
w AS (SELECT a, b, n_ab, CASE WHEN n_ab >= 3 THEN least(greatest(0.0, log2(n_ab * s.n / (x.n_a * y.n_a)::DOUBLE)) / 10, 1.0) ELSE 0.0 END AS weight FROM pairs JOIN n x ON x.item = a JOIN n y ON y.item = b, s),
d AS (SELECT a AS src, b AS dst, n_ab, weight FROM w UNION ALL SELECT b, a, n_ab, weight FROM w),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM d) WHERE r <= 100)"""


def log(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("session"), F.get_json_object("props", "$.k").cast("long").alias("item"))


@q(f"WITH {_PAIRS} SELECT a, b, n_ab FROM pairs")
def co_recalls(spark, sf_dir):
    """How many sessions hold both of two artifacts."""
    return g.co_recalls(log(spark, sf_dir), "session", "item")


@q(f"WITH {_GRAPH} SELECT src, dst, n_ab, round(weight, 6) AS weight FROM e")
def co_recall_graph(spark, sf_dir):
    """Directed edges with their weights."""
    return g.graph(log(spark, sf_dir), "session", "item").select("src", "dst", "n_ab", F.round("weight", 6).alias("weight"))


@q(f"WITH {_GRAPH} SELECT src, dst, n_ab, round(least(1.0, weight * 20), 6) AS overlap FROM e")
def stored_graph(spark, sf_dir):
    """Directed edges saved with overlaps that are held within 1, and loaded."""
    path = f"{checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}"
    g.save(g.graph(log(spark, sf_dir), "session", "item").withColumn("overlap", F.col("weight") * 20), path)
    return g.load(spark, path).select("src", "dst", "n_ab", F.round("overlap", 6).alias("overlap"))


@q(f"WITH {_GRAPH} SELECT count(*) AS edges, count(DISTINCT src) AS nodes, (SELECT count(DISTINCT session) FROM log) AS sessions, (SELECT count(*) FROM log) AS recalls FROM e")
def graph_stats(spark, sf_dir):
    rows = log(spark, sf_dir)
    return g.stats(g.graph(rows, "session", "item"), rows, "session")


@q(f"""WITH {_GRAPH},
x AS (SELECT src, dst, weight * 4 AS weight FROM e), f0 AS (SELECT item AS seed, item AS id, 1.0::DOUBLE AS act FROM (SELECT DISTINCT item FROM log)),
n1 AS (SELECT seed, dst AS id, max(act * weight) AS act FROM f0 JOIN x ON id = src WHERE act * weight >= 0.01 GROUP BY seed, dst), f1 AS (SELECT * FROM n1 WHERE id <> seed OR act > 1), b1 AS (SELECT seed, id, max(act) AS act FROM (FROM f0 UNION ALL FROM f1) GROUP BY seed, id),
n2 AS (SELECT seed, dst AS id, max(act * weight * 0.7) AS act FROM f1 JOIN x ON id = src WHERE act * weight * 0.7 >= 0.01 GROUP BY seed, dst), f2 AS (SELECT n2.* FROM n2 LEFT JOIN b1 USING (seed, id) WHERE b1.act IS NULL OR n2.act > b1.act),
b2 AS (SELECT seed, id, max(act) AS act FROM (FROM b1 UNION ALL FROM f2) GROUP BY seed, id)
SELECT seed, id, round(act, 6) AS act, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY act DESC, id) AS rank FROM b2 WHERE id <> seed) WHERE rank <= 20
""")
def activation(spark, sf_dir):
    """What every artifact activates in two hops, with fourfold weights."""
    rows = log(spark, sf_dir)
    edges = g.graph(rows, "session", "item").withColumn("weight", F.col("weight") * 4)
    seeds = rows.select(F.col("item").alias("seed")).distinct()
    return g.activate(edges, seeds, 2, 20).select("seed", "id", F.round("act", 6).alias("act"), "rank")


@q(r"""
WITH k AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS k FROM conversations GROUP BY conv_id), w AS (SELECT conv_id, unnest(k) AS w FROM k),
r AS (SELECT w FROM w GROUP BY w HAVING count(*) BETWEEN 2 AND 200), u AS (SELECT * FROM w SEMI JOIN r USING (w)), p AS (SELECT DISTINCT a.conv_id AS a, b.conv_id AS b FROM u a JOIN u b USING (w) WHERE a.conv_id < b.conv_id)
SELECT a, b, round(len(list_intersect(x.k, y.k)) / len(list_distinct(list_concat(x.k, y.k))), 6) AS overlap FROM p JOIN k x ON x.conv_id = a JOIN k y ON y.conv_id = b WHERE len(list_intersect(x.k, y.k)) / len(list_distinct(list_concat(x.k, y.k))) >= 0.1
""")
def keyword_graph(spark, sf_dir):
    """Conversations that share a word of at most 200 conversations, by the Jaccard similarity of their words."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list(t.tokens("text")))).alias("k"))
    return g.keyword_edges(rows, "conv_id", "k").select("a", "b", F.round("overlap", 6).alias("overlap"))
