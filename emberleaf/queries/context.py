"""Prompt context from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberleaf.operators import context as c
from emberleaf.queries import Registry, table

q = Registry()
_ENTRIES = """
e AS (SELECT '/m/' || doc_id AS path, (['hot', 'warm', 'cold', 'frozen'])[(doc_id % 4 + 1)::INT] AS tier, n_chars AS char_count, doc_id % 50 AS age_days, 1000000 - (doc_id * 7919) % 100003 AS last_accessed,
  left(regexp_replace(text, '\\s+', ' ', 'g'), 80) AS summary, [lang, source] AS keywords, CASE WHEN doc_id % 3 = 0 THEN (doc_id * 31 % 1009) / 1009.0::DOUBLE ELSE 0.0 END AS relevance FROM documents),
l AS (SELECT *, CASE tier WHEN 'hot' THEN '●' WHEN 'warm' THEN '◐' WHEN 'cold' THEN '○' ELSE '◌' END || ' [' || tier || '] ' || path || ' (' || char_count || ' chars, ' || age_days || 'd old) — ' || summary AS line FROM e)"""


def entries(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/m/"), i.cast("string")).alias("path"),
        F.get(F.array(*map(F.lit, ("hot", "warm", "cold", "frozen"))), (i % 4).cast("int")).alias("tier"),
        F.col("n_chars").alias("char_count"),
        (i % 50).alias("age_days"),
        (1000000 - (i * 7919) % 100003).alias("last_accessed"),
        F.left(F.regexp_replace("text", r"\s+", " "), F.lit(80)).alias("summary"),
        F.array("lang", "source").alias("keywords"),
        F.when(i % 3 == 0, (i * 31 % 1009) / 1009).otherwise(0.0).alias("relevance"),
    )


def _sql(budget: int) -> str:
    return f"""WITH RECURSIVE {_ENTRIES},
hot AS (SELECT 1 AS s, row_number() OVER (ORDER BY last_accessed DESC, path) AS r, line || chr(10) AS x FROM l WHERE tier = 'hot' ORDER BY last_accessed DESC, path LIMIT 10),
best0 AS (SELECT * FROM l WHERE relevance > 0 ORDER BY relevance DESC, path LIMIT 20),
best AS (SELECT 2 AS s, row_number() OVER (ORDER BY relevance DESC, path) AS r, line || CASE WHEN tier = 'cold' THEN chr(10) || '  ⏱ Recall: slower recall (~500ms, dictionary decompression, may need encryption key)' WHEN tier = 'frozen' THEN chr(10) || '  ⏱ Recall: slowest recall (~5-10s, Parquet restoration, may need encryption key)' ELSE '' END || chr(10) || '  Keywords: ' || array_to_string(keywords, ', ') || chr(10) AS x FROM best0 WHERE tier <> 'hot'),
warm AS (SELECT 3 AS s, row_number() OVER (ORDER BY last_accessed DESC, path) AS r, line || chr(10) AS x FROM l WHERE tier = 'warm' AND relevance = 0 ORDER BY last_accessed DESC, path LIMIT 5),
rows_ AS (SELECT 0 AS s, 0 AS r, '## Memory Context (auto-loaded)' || chr(10) AS x UNION ALL SELECT 1, 0, '### Recent (hot tier)' || chr(10) UNION ALL SELECT 2, 0, chr(10) || '### Relevant to: "find me"' || chr(10) UNION ALL SELECT 3, 0, chr(10) || '### Archived (warm tier)' || chr(10) UNION ALL FROM hot UNION ALL FROM best UNION ALL FROM warm),
n AS (SELECT *, row_number() OVER (ORDER BY s, r) AS i FROM rows_),
f AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS out, 0::BIGINT AS used, -1 AS stopped UNION ALL
  SELECT n.i, CASE WHEN f.stopped = n.s THEN f.out WHEN n.r = 0 AND n.s = 3 AND {budget} - used <= 200 THEN f.out WHEN n.r = 0 OR used + length(x) <= {budget} THEN f.out || x ELSE f.out END,
    CASE WHEN f.stopped = n.s THEN used WHEN n.r = 0 AND n.s = 3 AND {budget} - used <= 200 THEN used WHEN used + length(x) <= {budget} THEN used + length(x) ELSE used END,
    CASE WHEN f.stopped = n.s THEN f.stopped WHEN n.r = 0 AND n.s = 3 AND {budget} - used <= 200 THEN 3 WHEN n.r > 0 AND used + length(x) > {budget} THEN n.s ELSE f.stopped END
  FROM f JOIN n ON n.i = f.i + 1)
SELECT out || chr(10) || '---' || chr(10) || 'Memory: ' || round(used / {budget} * 100, 1)::DOUBLE || '% of context budget used (~' || (({budget} - used) // 4) || ' tokens remaining).' || chr(10) || '**Archived memories:** ' || (SELECT count(*) FROM e WHERE tier = 'cold') || ' cold, ' || (SELECT count(*) FROM e WHERE tier = 'frozen') || ' frozen.' || chr(10) || chr(10) AS context, used FROM f ORDER BY i DESC LIMIT 1"""


@q(_sql(128000))
def session_context(spark, sf_dir):
    """Context within the usual budget."""
    return c.build(entries(spark, sf_dir), "find me#")


@q(_sql(1500))
def tight_context(spark, sf_dir):
    """Context for which the budget does not reach."""
    return c.build(entries(spark, sf_dir), "find me#", 1500)


@q("""
WITH f AS (SELECT doc_id AS artifact_id, text AS content, source AS source_label, (doc_id % 7) / 6.0::DOUBLE AS confidence, (doc_id % 5) / 5.0::DOUBLE AS significance, (['low', 'medium', 'high'])[(doc_id % 3 + 1)::INT] AS sensitivity, CASE doc_id % 4 WHEN 0 THEN TIMESTAMP '2024-01-01' WHEN 1 THEN TIMESTAMP '2030-01-01' END AS expires_at,
  strftime(DATE '2024-01-01' + (doc_id % 60)::INT, '%Y-%m-%d') AS created_date FROM documents),
a AS (SELECT list('- [' || source_label || '] (conf:' || printf('%.1f', confidence) || ') ' || left(content, 200) ORDER BY confidence DESC, significance DESC, artifact_id) AS x FROM (SELECT * FROM f WHERE sensitivity <> 'high' AND (expires_at IS NULL OR expires_at >= TIMESTAMP '2024-02-01') ORDER BY confidence DESC, significance DESC, artifact_id LIMIT 5)),
b AS (SELECT list('- [' || created_date || '] ' || left(content, 300) ORDER BY created_date DESC, artifact_id) AS x FROM (SELECT * FROM f WHERE artifact_id % 2 = 0 ORDER BY created_date DESC, artifact_id LIMIT 3)),
t AS (SELECT '## System Defaults' || chr(10) || '{"tone": "plain"}' || chr(10) || chr(10) || '## User Preferences' || chr(10) || '{"tone": "short"}' || chr(10) || chr(10) || '## Relevant Facts (5)' || chr(10) || array_to_string(a.x, chr(10)) || chr(10) || chr(10) || '## Recent Episodes (3)' || chr(10) || array_to_string(b.x, chr(10)) AS body FROM a, b),
k AS (SELECT CASE WHEN length(body) > 1200 THEN left(body, 1200) || chr(10) || chr(10) || '[...truncated to token budget]' ELSE body END AS context FROM t)
SELECT context, length(context) // 4 AS token_estimate, 5::BIGINT AS facts_injected, 3::BIGINT AS episodes_injected FROM k
""")
def assembled_context(spark, sf_dir):
    """Layers, the best facts and the latest episodes, cut at a budget."""
    i = F.col("doc_id")
    pick = lambda n, *vs: F.get(F.array(*map(F.lit, vs)), (i % n).cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        i.alias("artifact_id"), F.col("text").alias("content"), F.col("source").alias("source_label"), ((i % 7) / 6).alias("confidence"), ((i % 5) / 5).alias("significance"), pick(3, "low", "medium", "high").alias("sensitivity"),
        F.when(i % 4 == 0, "2024-01-01").when(i % 4 == 1, "2030-01-01").when(i % 4 == 2, "soon").alias("expires_at"), F.lit(None).cast("string").alias("summary"), F.when(i % 2 == 0, "episode").otherwise("note").alias("memory_type"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 60).cast("int")), "yyyy-MM-dd").alias("created_date"),
    )
    layers = spark.createDataFrame([(1, "System Defaults", '{"tone": "plain"}'), (2, "User Preferences", '{"tone": "short"}')], "position int, title string, body string")
    return c.assemble(layers, rows, rows, F.lit("2024-02-01").cast("timestamp"), 300)


@q("""
SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM conversations) WHERE used <= 800
""")
def budgeted_turns(spark, sf_dir):
    """The first turns of every conversation that fit a budget."""
    return c.budgeted(table(spark, sf_dir, "conversations").withColumn("size", F.length("text").cast("long")), "turn", "size", 800, ["conv_id"]).select("conv_id", "turn", "used")
