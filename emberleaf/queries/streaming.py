"""Streams of the table events, run until all is read; windows that the watermark has not closed are left out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberleaf.queries import Registry, table
from emberleaf.sources.tables import checkpoint_dir
from emberleaf.streaming import streams as st

q = Registry()


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return st.source(spark, f"{sf_dir}/events.parquet*", schema).withColumn("at", F.col("ts").cast("timestamp"))


def _finished(spark, df, mode="append"):
    path = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "complete":
        st.latest_table(df, f"{path}/out", f"{path}/checkpoint")
    else:
        st.run_once(df, f"{path}/out", f"{path}/checkpoint", mode)
    return spark.read.schema(df.schema).parquet(f"{path}/out")


_TIME = "%Y-%m-%d %H:%M:%S"


@q(f"""
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS s, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(s, '{_TIME}') AS start, event_type, n FROM w WHERE s + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def tumbling_windows(spark, sf_dir):
    """Events of each six hours and type."""
    df = st.tumbling(_events(spark, sf_dir), "at", "6 hours", "1 hour", F.col("event_type"))
    return _finished(spark, df).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@q(f"""
WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (k) HOUR AS s, count(*) AS n FROM events, range(4) r(k) GROUP BY ALL)
SELECT strftime(s, '{_TIME}') AS start, n FROM w WHERE s + INTERVAL 4 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def sliding_windows(spark, sf_dir):
    """Events of the four hours from each hour."""
    df = st.sliding(_events(spark, sf_dir), "at", "4 hours", "1 hour", "1 hour")
    return _finished(spark, df).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@q(f"""
WITH l AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM l),
g AS (SELECT user_id, s, min(ts) AS start, max(ts) AS last, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM s GROUP BY ALL)
SELECT user_id, strftime(start, '{_TIME}') AS start, n, items FROM g WHERE last + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def session_windows(spark, sf_dir):
    """Sessions of each user with their distinct event types."""
    df = st.sessions(_events(spark, sf_dir), "at", "2 hours", "1 hour", "user_id", F.col("event_type"))
    return _finished(spark, df).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.array_join("items", ",").alias("items"))


@q("SELECT json_extract_string(props, '$.k') AS item, count(*) AS n_a FROM events GROUP BY 1")
def streaming_counts(spark, sf_dir):
    """Running numbers of accesses."""
    return _finished(spark, st.recall_counts(_events(spark, sf_dir), F.get_json_object("props", "$.k")), "complete")


@q("SELECT user_id, event_type FROM events GROUP BY ALL")
def streaming_distinct(spark, sf_dir):
    """Users and types, each once."""
    return _finished(spark, st.deduplicated(_events(spark, sf_dir), "at", "60 days", "user_id", "event_type").select("user_id", "event_type"))


@q("SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 12 HOUR < (SELECT max(ts) FROM events)")
def streaming_expiry(spark, sf_dir):
    """Users without an event for twelve hours of event time."""
    return _finished(spark, st.expiring(_events(spark, sf_dir).select("user_id", "at"), "user_id", "at", 12))


@q("SELECT event_id, event_type AS event, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events")
def streaming_audit(spark, sf_dir):
    """Events appended to an audit log of JSON lines."""
    path = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = _events(spark, sf_dir).select("event_id", F.col("event_type").alias("event"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))
    st.append_audit(rows, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema("event_id long, event string, ts string").json(f"{path}/out")
