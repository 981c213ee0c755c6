"""Spatial artifacts made of events: each is seen at a place."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberleaf.operators import spatial as s
from emberleaf.queries import Registry, table

q = Registry()
_SEEN = """
seen AS (SELECT sha256('{"kind":"' || event_type || '","place":' || (user_id % 120) || '}') AS sha256, (['hazard_marker', 'route_segment', 'poi', 'room_scan'])[(user_id % 4 + 1)::INT] AS artifact_type, round(value / 1000, 3) AS confidence,
  CASE WHEN event_id % 3 = 0 THEN 'peer' ELSE 'local' END AS source, event_id AS seen_at, CASE user_id % 4 WHEN 0 THEN ['hazard_marker', event_type, 'left'] WHEN 1 THEN ['route_segment', event_type] WHEN 2 THEN ['poi', event_type] ELSE ['room_scan', 'indoor', 'room', 'door'] END AS keywords FROM events),
a AS (SELECT sha256, arg_min(artifact_type, seen_at) AS artifact_type, arg_min(keywords, seen_at) AS keywords, arg_min(source, seen_at) AS source, max(confidence) AS confidence, count(*) FILTER (source = 'peer') AS peer_confirmations, min(seen_at) AS created_at, max(seen_at) AS last_confirmed FROM seen GROUP BY sha256)"""


def artifacts(spark, sf_dir):
    u = F.col("user_id")
    kind = F.get(F.array(*map(F.lit, ("hazard_marker", "route_segment", "poi", "room_scan"))), (u % 4).cast("int"))
    data = F.struct(F.col("event_type").alias("kind"), (u % 120).alias("place"))
    words = s.keywords(kind, {"hazard_type": F.col("event_type"), "direction": F.lit("left"), "detected_objects": F.array("event_type"), "poi_type": F.col("event_type"), "door_count": F.lit(2)})
    rows = table(spark, sf_dir, "events").select(s.identity(data).alias("sha256"), kind.alias("artifact_type"), F.round(F.col("value") / 1000, 3).alias("confidence"), F.when(F.col("event_id") % 3 == 0, "peer").otherwise("local").alias("source"), F.col("event_id").alias("seen_at"), words.alias("keywords"))
    return s.register(rows)


@q(f"WITH {_SEEN} SELECT left(sha256, 16) AS artifact_id, artifact_type, array_to_string(keywords, ' ') AS keywords, source, confidence, peer_confirmations, created_at, last_confirmed FROM a")
def spatial_artifacts(spark, sf_dir):
    """Artifacts registered by content."""
    return artifacts(spark, sf_dir).drop("sha256").withColumn("keywords", F.array_join("keywords", " "))


@q(f"WITH {_SEEN} SELECT left(sha256, 16) AS artifact_id, confidence FROM a WHERE len(list_filter(keywords, lambda w: contains(w, 'click') OR contains(w, 'door'))) > 0")
def spatial_search(spark, sf_dir):
    """Artifacts with a keyword that holds a term."""
    return s.search(artifacts(spark, sf_dir), "Click door").select("artifact_id", "confidence")


@q(f"WITH {_SEEN} SELECT artifact_type, count(*) AS n, count(*) FILTER (source = 'peer') AS peers FROM a GROUP BY 1")
def spatial_stats(spark, sf_dir):
    return s.stats(artifacts(spark, sf_dir))


@q(f"WITH {_SEEN}, p AS (SELECT *, greatest(confidence, CASE WHEN peer_confirmations > 5 THEN 0.95 ELSE 0 END) AS c FROM a) SELECT left(sha256, 16) AS artifact_id, c::DOUBLE AS confidence FROM p WHERE artifact_type = 'hazard_marker' AND c >= 0.6")
def exportable_hazards(spark, sf_dir):
    """Hazards to share, after promotion by peers."""
    rows = artifacts(spark, sf_dir)
    more = rows.where("peer_confirmations > 5").select("sha256", F.lit(0.95).alias("confidence"))
    return s.exportable(s.promote(rows, more)).select("artifact_id", "confidence")


@q("""
SELECT a.c_custkey AS query_id, b.c_custkey AS id, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance
FROM (SELECT c_custkey, c_acctbal AS x, (c_custkey * 7919 % 10007)::DOUBLE AS y FROM customer) a JOIN (SELECT c_custkey, c_acctbal AS x, (c_custkey * 7919 % 10007)::DOUBLE AS y FROM customer) b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 150
""")
def nearby(spark, sf_dir):
    """Customers within 150 of each other, their balance and a number as coordinates."""
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 7919 % 10007).cast("double").alias("y"))
    return s.near(points, points.withColumnRenamed("id", "query_id"), 150.0).withColumn("distance", F.round("distance", 6))


@q(f"WITH {_SEEN} SELECT left(sha256, 16) AS artifact_id, confidence FROM a WHERE artifact_type = 'route_segment' AND confidence >= 0.3")
def spatial_of_type(spark, sf_dir):
    """Route segments of some confidence."""
    return s.of_type(artifacts(spark, sf_dir), "route_segment", 0.3).select("artifact_id", "confidence")
