"""Sessions made of conversations: a user is the human."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberleaf.functions import lexicon
from emberleaf.operators import sessions as s
from emberleaf.queries import Registry, sql_list, table

q = Registry()


def messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return rows.withColumn("role", F.when(F.col("role") == "user", "human").otherwise(F.col("role")))


_SAID = "coalesce(" + ", ".join(f"nullif(left(regexp_extract(text, '{p}'), 100), '')" for p in s.DECISIONS) + ")"


@q(rf"""
WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'human' ELSE role END AS role, text FROM conversations WHERE role <> 'system'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM m),
d AS (SELECT *, CASE WHEN role = 'assistant' AND n <= 10 THEN {_SAID} END AS f FROM n),
g AS (SELECT conv_id, max(CASE WHEN role = 'human' AND n = 1 THEN regexp_replace(left(text, 200), '\[Image:.*?\]', '[image]', 'g') END) AS head, string_agg(f, '. ' ORDER BY turn) AS found, string_agg(left(text, 300), chr(10) || chr(10) ORDER BY turn) AS whole FROM d GROUP BY conv_id)
SELECT conv_id, CASE WHEN left(concat_ws('. ', head, found), 300) <> '' THEN left(concat_ws('. ', head, found), 300) ELSE left(whole, 300) END AS summary FROM g
""")
def session_summaries(spark, sf_dir):
    return s.summaries(messages(spark, sf_dir), "conv_id", "turn", "role", "text")


@q(rf"""
WITH w AS (SELECT conv_id, role, unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(text, '```[\s\S]*?```', '', 'g'), 'https?://\S+', '', 'g')), '[a-zA-Z][a-zA-Z0-9_-]{{2,}}')) AS word FROM conversations WHERE role <> 'system'),
c AS (SELECT conv_id, word, count(*) + 2 * count(*) FILTER (role = 'user') AS score FROM w WHERE NOT list_contains({sql_list(lexicon.SESSION_STOPS)}, word) AND NOT regexp_matches(word, '^[0-9]+$|^[0-9a-f]{{8,}}$') GROUP BY ALL)
SELECT * FROM (SELECT conv_id, word, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, word)::INT AS rank FROM c) WHERE rank <= 30
""")
def session_keywords(spark, sf_dir):
    return s.keywords(messages(spark, sf_dir), "conv_id", "role", "text")


@q("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Human: ' ELSE 'Assistant: ' END || left(text, 500), chr(10) ORDER BY turn) AS conversation FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def conversation_texts(spark, sf_dir):
    return s.conversation_text(messages(spark, sf_dir), "conv_id", "turn", "role", "text")


@q("""
WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'BOILERPLATE_REF:' || left(sha256(text), 32) ELSE text END AS stripped, text AS restored FROM conversations) SELECT * FROM r
""")
def boilerplate(spark, sf_dir):
    """System prompts replaced by references to one table of them, and put back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    stripped, store = s.strip_boilerplate(rows, "text", F.col("role") == "system")
    both = stripped.withColumn("stripped", F.col("text"))
    return s.restore_boilerplate(both, store, "text").select("conv_id", "turn", "stripped", F.col("text").alias("restored"))


@q("""
SELECT 'log' || conv_id AS path, turn AS n, CASE role WHEN 'user' THEN 'human' ELSE 'assistant' END AS role, trim(text, ' ') AS text, 't' || turn AS timestamp, 's' || conv_id AS session_id, '/w' AS cwd
FROM conversations WHERE role <> 'system' AND length(trim(text, ' ')) > 5
""")
def session_logs(spark, sf_dir):
    """Messages parsed from JSON lines of both forms, some of them broken."""
    rows = table(spark, sf_dir, "conversations")
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))
    head = [F.when(F.col("role") == "system", "summary").otherwise(F.col("role")).alias("type"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sessionId"), F.lit("/w").alias("cwd"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("timestamp")]
    plain = F.to_json(F.struct(*head, F.struct(F.col("text").alias("content")).alias("message")))
    listed = F.to_json(F.struct(*head, F.struct(block.alias("content")).alias("message")))
    kind = F.when(F.col("role") == "user", "user").otherwise(F.col("role"))
    good = rows.withColumn("role", kind).select(F.concat(F.lit("log"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("n"), F.when(F.col("turn") % 2 == 0, plain).otherwise(listed).alias("value"))
    bad = good.withColumn("value", F.lit('{"type": "user", broken'))
    return s.parse(good.unionByName(bad.withColumn("n", F.col("n") + 1000)))
