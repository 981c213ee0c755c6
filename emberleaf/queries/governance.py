"""Governance of write requests made of events, conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberleaf.functions import lexicon
from emberleaf.operators import governance as g
from emberleaf.queries import Registry, table

q = Registry()
_REQUESTS = """
requests AS (SELECT doc_id AS request_id, text AS content, (['preference', 'fact', 'note'])[(doc_id % 3 + 1)::INT] AS label, (doc_id % 11) / 10.0::DOUBLE AS confidence,
  (['explicit', 'inferred', 'imported', 'guess'])[(doc_id % 4 + 1)::INT] AS source, CASE doc_id % 13 WHEN 0 THEN 'safety.' || lang WHEN 1 THEN NULL ELSE 'key' || (doc_id % 100) END AS key, lang AS namespace FROM documents),
facts AS (SELECT 'fact' || event_id AS artifact_id, 'key' || (event_id % 70) AS key, 'en' AS namespace FROM events)"""


def _first(patterns, col="content"):
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}') THEN '{n}'" for n, p in patterns.items()) + " END"


def requests(spark, sf_dir):
    i = F.col("doc_id")
    pick = lambda n, *vs: F.get(F.array(*map(F.lit, vs)), (i % n).cast("int"))
    key = F.when(i % 13 == 0, F.concat(F.lit("safety."), "lang")).when(i % 13 != 1, F.concat(F.lit("key"), (i % 100).cast("string")))
    return table(spark, sf_dir, "documents").select(i.alias("request_id"), F.col("text").alias("content"), pick(3, "preference", "fact", "note").alias("label"), ((i % 11) / 10).alias("confidence"), pick(4, "explicit", "inferred", "imported", "guess").alias("source"), key.alias("key"), F.col("lang").alias("namespace"))


@q(f"""WITH {_REQUESTS},
x AS (SELECT *, {_first(lexicon.CREDENTIALS)} AS cred, {_first(lexicon.PII)} AS pii, CASE WHEN source = 'inferred' AND confidence > 0.8 THEN 0.8 ELSE confidence END AS capped FROM requests),
d AS (SELECT *, CASE WHEN cred IS NOT NULL THEN 'blocklist.credentials' WHEN pii IS NOT NULL THEN 'blocklist.pii' WHEN regexp_matches(coalesce(key, ''), '^(safety|security|tool_policy)\\.') THEN 'blocklist.security_constraints'
  WHEN source = 'inferred' AND capped < 0.3 THEN 'blocklist.speculative_inference' WHEN source = 'explicit' THEN CASE WHEN label = 'note' THEN 'write_rules.explicit_remember_instruction' ELSE 'write_rules.explicit_' || label END
  WHEN source = 'inferred' THEN 'write_rules.inferred_single_session' WHEN source = 'imported' THEN 'write_rules.imported' ELSE 'unknown' END AS rule_id FROM x),
s AS (SELECT *, CASE WHEN rule_id LIKE 'blocklist%' OR rule_id = 'unknown' THEN 'rejected' WHEN rule_id LIKE '%inferred%' THEN 'pending' ELSE 'ingested' END AS status FROM d),
f AS (SELECT key, namespace, min(artifact_id) AS conflict_id FROM facts GROUP BY ALL)
SELECT request_id, rule_id, status, CASE WHEN rule_id IN ('blocklist.credentials', 'blocklist.pii', 'blocklist.security_constraints', 'unknown') THEN NULL ELSE capped END AS adjusted_confidence, CASE WHEN status <> 'rejected' THEN conflict_id END AS conflict_id
FROM s LEFT JOIN f USING (key, namespace)
""")
def governed_writes(spark, sf_dir):
    """Policy, status and conflicts of a write request for every document."""
    facts = table(spark, sf_dir, "events").select(F.concat(F.lit("fact"), F.col("event_id").cast("string")).alias("artifact_id"), F.concat(F.lit("key"), (F.col("event_id") % 70).cast("string")).alias("key"), F.lit("en").alias("namespace"))
    return g.gate(requests(spark, sf_dir), facts).select("request_id", "rule_id", "status", "adjusted_confidence", "conflict_id")


@q("""
WITH s AS (SELECT event_id, event_type, CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created_at FROM events)
SELECT event_id, CASE WHEN try_cast(nullif(created_at, '') AS TIMESTAMP) IS NULL THEN TRUE ELSE epoch(TIMESTAMP '2024-01-20') - epoch(try_cast(created_at AS TIMESTAMP)) > 72 * 3600 END AS expired FROM s
""")
def expired_sessions(spark, sf_dir):
    """Which sessions are over; those without a valid start are."""
    i = F.col("event_id")
    started = F.when(i % 9 == 0, "").when(i % 9 == 1, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", g.expired(started, F.lit("2024-01-20")).alias("expired"))


_LAYERS = "(['system', 'app', 'env', 'user', 'session'])[(event_id % 5 + 1)::INT]"


@q(f"""
WITH s AS (SELECT {_LAYERS} AS layer, event_id % 5 + 1 AS rank, 'k' || (user_id % 60) AS key, event_type || (event_id % 7) AS value, CASE WHEN user_id % 60 % 4 = 0 AND event_id % 5 = 1 THEN 'immutable' WHEN user_id % 60 % 4 = 1 THEN 'additive' WHEN user_id % 60 % 4 = 2 THEN 'session_only' ELSE 'overridable' END AS mutability FROM events),
r AS (SELECT key, min((rank, value, layer)) FILTER (mutability = 'immutable') AS fixed, max((rank, value, layer)) FILTER (layer = 'session') AS own, max((rank, value, layer)) AS top, max(mutability) FILTER (mutability IN ('additive', 'session_only')) AS kind, string_agg(DISTINCT value, ',' ORDER BY value) AS every FROM s GROUP BY key),
p AS (SELECT key, kind, fixed, every, CASE WHEN fixed IS NOT NULL THEN fixed WHEN kind = 'session_only' THEN own ELSE top END AS pick FROM r)
SELECT key, CASE WHEN fixed IS NULL AND kind = 'additive' THEN every ELSE pick[2] END AS value, pick[3] AS layer FROM p WHERE pick IS NOT NULL
""")
def layered_settings(spark, sf_dir):
    """The setting in force for each key of five layers."""
    i, u = F.col("event_id"), F.col("user_id") % 60
    kind = F.when((u % 4 == 0) & (i % 5 == 1), "immutable").when(u % 4 == 1, "additive").when(u % 4 == 2, "session_only").otherwise("overridable")
    rows = table(spark, sf_dir, "events").select(F.get(F.array(*map(F.lit, g.PRECEDENCE)), (i % 5).cast("int")).alias("layer"), F.concat(F.lit("k"), u.cast("string")).alias("key"), F.concat("event_type", (i % 7).cast("string")).alias("value"), kind.alias("mutability"))
    return g.resolve_layers(rows)


@q("""
WITH f AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'inferred' ELSE 'explicit' END AS source, (event_id % 10) / 10.0::DOUBLE AS confidence, date_diff('day', ts, TIMESTAMP '2024-04-15') AS days, event_id % 6 = 0 AS pinned FROM events),
x AS (SELECT *, CASE WHEN source = 'inferred' AND days > 90 THEN confidence * 0.5 ELSE confidence END AS c, confidence * pow(0.95, floor(days / 7)) AS i FROM f)
SELECT event_id, round(CASE WHEN source = 'inferred' AND c < 0.3 THEN NULL ELSE c END, 6) AS confidence, round(i, 6) AS importance, NOT pinned AND (i < 0.2 OR (floor(days / 7) * 7 > 90 AND i < 0.5)) AS compact,
  round(greatest(0, least(1, confidence + 0.05 * (event_id % 4) - 0.01 * floor(days / 7))), 6) AS strength FROM x
""")
def decay(spark, sf_dir):
    """Confidence, importance and strength after time without use."""
    i = F.col("event_id")
    days = F.datediff(F.lit("2024-04-15"), F.to_date("ts"))
    weeks = F.floor(days / 7).cast("double")
    source, conf = F.when(i % 2 == 0, "inferred").otherwise("explicit"), (i % 10) / 10
    importance, compact = g.episode_state(conf, weeks, i % 6 == 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(g.decayed_confidence(source, conf, days), 6).alias("confidence"), F.round(importance, 6).alias("importance"), compact.alias("compact"), F.round(g.hebbian(conf, i % 4, weeks), 6).alias("strength"))


@q("""
WITH f AS (SELECT event_id AS artifact_id, event_type AS namespace, 'k' || (user_id % 50) AS key, CASE WHEN event_id % 3 = 0 THEN 'explicit' ELSE 'inferred' END AS source, (event_id % 8) / 8.0::DOUBLE AS confidence FROM events),
m AS (SELECT key, namespace, max((source = 'explicit', confidence)) AS top, count(*) AS n FROM f GROUP BY ALL)
SELECT key, namespace, n, min(artifact_id) AS artifact_id, CASE WHEN count(*) > 1 THEN 'review' ELSE 'resolved' END AS outcome FROM f JOIN m USING (key, namespace) WHERE (source = 'explicit', confidence) = top GROUP BY key, namespace, n
""")
def conflict_resolution(spark, sf_dir):
    """Which of several facts of one key holds."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(i.alias("artifact_id"), F.col("event_type").alias("namespace"), F.concat(F.lit("k"), (F.col("user_id") % 50).cast("string")).alias("key"), F.when(i % 3 == 0, "explicit").otherwise("inferred").alias("source"), ((i % 8) / 8).alias("confidence"))
    return g.resolve_conflicts(rows)


@q("SELECT event_type AS namespace, strftime(ts, '%Y-%m-%d') AS day, count(*) AS entries, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def audit_counts(spark, sf_dir):
    """Audit entries of each namespace and day."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("namespace"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("entries"), F.count_distinct("user_id").alias("users"))


@q("SELECT event_type AS namespace, json_extract_string(props, '$.k') AS key, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return g.duplicate_keys(table(spark, sf_dir, "events").select(F.col("event_type").alias("namespace"), F.get_json_object("props", "$.k").alias("key")))


@q("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def latest_entries(spark, sf_dir):
    """The last five hundred rows of a log."""
    return g.latest(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "event_type")


@q(r"SELECT event_id, CASE WHEN event_type = 'click' THEN '[REDACTED: line contained secret material]' ELSE 'SEARCH ' || event_type || ' ' || value END AS line FROM (SELECT event_id, event_type, floor(value)::BIGINT AS value FROM events)")
def redacted_log(spark, sf_dir):
    """Log lines, those that name a secret redacted."""
    value = F.floor("value").cast("string")
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("RECALL password "), value)).otherwise(F.concat(F.lit("SEARCH "), "event_type", F.lit(" "), value))
    return g.redacted(table(spark, sf_dir, "events").select("event_id", line.alias("line")), "line")


@q("""
WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, event_id % 7 AS k, left(sha256(props), 6) AS h, user_id, value FROM events)
SELECT event_id, stamp || ' ' || CASE k WHEN 0 THEN 'TIER hot>warm ' || printf('%.1f', (user_id % 9)::DOUBLE + 0.2) || 'x ' || h WHEN 1 THEN 'RECALL warm ' || h WHEN 2 THEN 'ENCRYPT cold ' || h || CASE WHEN user_id % 2 = 0 THEN ' ok' ELSE ' fail' END
  WHEN 3 THEN 'DECRYPT cold ' || h || CASE WHEN user_id % 2 = 0 THEN ' ok' ELSE ' fail' END WHEN 4 THEN 'ROTATE cold gen' || user_id || '>' || (user_id + 1) || ' ' || event_id || 'headers' WHEN 5 THEN 'SEARCH ' || event_id || 'hits' ELSE 'ERROR compact ?' END AS line FROM e
UNION ALL SELECT -event_id, stamp || ' REDACTED — log line contained potential secret/PII' FROM e WHERE k = 1
""")
def audit_log_lines(spark, sf_dir):
    """Typed log lines of events; those whose tier names a home folder are replaced."""
    k, e, u = F.col("event_id") % 7, F.col("event_id"), F.col("user_id")
    ops = F.get(F.array(*map(F.lit, ["tier", "recall", "encrypt", "decrypt", "rotate", "search", "compact"])), k.cast("int"))
    tier = F.get(F.array(*map(F.lit, ["hot", "warm", "cold", "cold", "cold", "hot", "hot"])), k.cast("int"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), ops.alias("op"), tier.alias("tier"), F.lit("warm").alias("to_tier"), F.when(k < 6, F.sha2("props", 256)).alias("hash"),
        (u % 9 + 0.2).alias("ratio"), (u % 2 == 0).alias("ok"), e.alias("n"), u.alias("gen"),
    )
    bad = rows.where("op = 'recall'").select((-e).alias("event_id"), *(c for c in rows.columns if c not in ("event_id", "tier")), F.lit("/home/u/store").alias("tier"))
    both = rows.unionByName(bad)
    return both.select("event_id", g.audit_line(both).alias("line"))
