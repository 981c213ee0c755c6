"""Classifiers and detectors over documents and literal cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberleaf.functions import classify as c
from emberleaf.functions import lexicon
from emberleaf.queries import Registry, sql_list, table

q = Registry()


@q("""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'decision|decided|because') THEN 0.85 WHEN regexp_matches(lower(text), 'critical|important|must') THEN 0.8
  WHEN regexp_matches(lower(text), 'error|fix|bug') THEN 0.6 WHEN strlen(text) > 2000 THEN 0.5 ELSE 0.3 END::DOUBLE AS significance FROM documents
""")
def significance(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", c.significance("text").cast("double").alias("significance"))


def _found(terms) -> str:
    terms = list(dict.fromkeys(terms))
    return f"list_filter({sql_list(terms)}, lambda t: CASE WHEN contains(t, ' ') OR contains(t, '_') THEN contains(low, t) ELSE list_contains(own, t) END)"


def _classes(found: str, table_) -> str:
    pairs = "[" + ", ".join("{'w': '%s', 'c': '%s'}" % p for p in table_) + "]"
    return f"coalesce(list_aggregate(list_sort(list_distinct(list_transform(list_filter({pairs}, lambda p: list_contains({found}, p.w)), lambda p: p.c))), 'string_agg', ' '), '')"


_TECH, _DOMAIN = lexicon.pairs(lexicon.TECHNOLOGY, None), lexicon.pairs(lexicon.DOMAINS, ",")
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> ''))"


@q(f"""
WITH turns AS (SELECT doc_id AS id, text, 'document' AS kind FROM documents UNION ALL SELECT conv_id * 1000 + turn, text, 'turn' FROM conversations),
w AS (SELECT id, kind, lower(text) AS low, {_WORDS} AS own FROM turns),
m AS (SELECT *, {_found(w for w, _ in _TECH)} AS tech, {_found(lexicon.ACTIONS)} AS act, {_found(w for w, _ in _DOMAIN)} AS dom,
  len({_found(lexicon.NEGATIVE)}) - len({_found(lexicon.POSITIVE)}) AS d FROM w)
SELECT kind, id, coalesce(list_aggregate(tech, 'string_agg', ' '), '') AS technology, {_classes("tech", _TECH)} AS category, coalesce(list_aggregate(act, 'string_agg', ' '), '') AS action,
  {_classes("dom", _DOMAIN)} AS domain, CASE WHEN d > 2 THEN 'negative' WHEN d < -2 THEN 'positive' ELSE 'neutral' END AS polarity FROM m
""")
def semantic_fields(spark, sf_dir):
    """Technology, category, action, domain and polarity of documents and conversation turns."""
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    s = docs.unionByName(turns).select("kind", "id", c.semantics("text").alias("s"))
    joined = [F.array_join(F.col(f"s.{x}"), " ").alias(x) for x in ("technology", "category", "action", "domain")]
    return s.select("kind", "id", *joined, F.col("s.polarity").alias("polarity"))


@q(rf"""
WITH w AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '[\s,;:()]'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}_-]+|[^\p{{L}}\p{{N}}_-]+$', '', 'g')) AS a FROM documents),
f AS (SELECT doc_id, list_distinct(list_filter(a, lambda w: NOT list_contains({sql_list(lexicon.NOT_ENTITIES)}, w) AND ((strlen(w) >= 3 AND regexp_matches(w, '^[\p{{Lu}}0-9]+$'))
  OR (strlen(w) >= 4 AND regexp_matches(w, '^\p{{Lu}}.*\p{{Lu}}') AND regexp_matches(w, '\p{{Ll}}'))))) AS e FROM w)
SELECT doc_id, len(e) AS n_entities, coalesce(list_aggregate(list_sort(e), 'string_agg', ' '), '') AS entities FROM f
""")
def entities(spark, sf_dir):
    e = c.entities("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(e).cast("long").alias("n_entities"), F.array_join(F.array_sort(e), " ").alias("entities"))


def some(words) -> str:
    return f"len(list_filter({sql_list(words)}, lambda t: contains(low, t))) > 0"


@q(f"""
WITH w AS (SELECT doc_id, lower(text) AS low FROM documents)
SELECT doc_id, coalesce(list_aggregate(list_concat(list_filter({sql_list(lexicon.TOPIC_TECHNOLOGY)}, lambda t: contains(low, t)),
  list_transform(list_filter({sql_list(lexicon.TOPIC_DOMAINS)}, lambda t: contains(low, t)), lambda t: 'domain:' || t)), 'string_agg', ' '), '') AS terms,
  CASE WHEN {some(lexicon.DECISION_MARKERS)} THEN 'decision' WHEN {some(["error", "bug", "fix"])} THEN 'incident' WHEN {some(["todo", "task", "plan"])} THEN 'plan' END AS kind FROM w
""")
def topic_signatures(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(c.topic_terms("text"), " ").alias("terms"), c.topic_kind("text").alias("kind"))


def _first(patterns: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in patterns.items()) + " END"


@q(f"""
WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, 'Bearer ' || md5(text) || ' 555-123-4567' FROM benchmark UNION ALL SELECT -100000 - item_id, 'my ssn 123-45-6789 key sk-' || md5(text) FROM benchmark)
SELECT doc_id, {_first(lexicon.PII)} AS pii, {_first(lexicon.CREDENTIALS)} AS credential, {" OR ".join(f"regexp_matches(text, '{p}')" for p in lexicon.AUDIT_SECRETS)} AS audit_secret FROM t
""")
def detectors(spark, sf_dir):
    """First kinds of personal data and credentials, and the audit log's test, over documents and made-up lines."""
    bench = table(spark, sf_dir, "benchmark")
    hashed = F.md5(F.col("text").cast("binary"))
    more = bench.select((-1 - F.col("item_id")).alias("doc_id"), F.concat(F.lit("Bearer "), hashed, F.lit(" 555-123-4567")).alias("text"))
    rest = bench.select((-100000 - F.col("item_id")).alias("doc_id"), F.concat(F.lit("my ssn 123-45-6789 key sk-"), hashed).alias("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(more).unionByName(rest)
    return rows.select("doc_id", c.pii("text").alias("pii"), c.credential("text").alias("credential"), c.contains_secret("text").alias("audit_secret"))


_RULES = [
    ("id: pattern", r"regexp_matches(id, '^fact_[a-z0-9_]+$')"),
    ("namespace: enum", "namespace IN ('user', 'tenant', 'project', 'system')"),
    ("type: enum", "type IN ('preference', 'identity', 'goal', 'constraint', 'domain_fact', 'exclusion')"),
    ("key: pattern", r"regexp_matches(key, '^[a-z][a-z0-9_\.]*$') AND length(key) BETWEEN 3 AND 128"),
    ("value: required", "value IS NOT NULL"),
    ("confidence: range", "confidence BETWEEN 0 AND 1"),
    ("source: enum", "source IN ('explicit', 'inferred', 'imported')"),
    ("created_at: date-time", "created_at IS NOT NULL"),
    ("updated_at: date-time", "updated_at IS NOT NULL"),
    ("sensitivity: enum", "sensitivity IN ('low', 'medium', 'high')"),
]


@q(f"""
WITH f AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'Fact-' ELSE 'fact_' END || event_id AS id, CASE event_id % 5 WHEN 0 THEN 'other' ELSE 'user' END AS namespace,
  'preference' AS type, event_type AS key, props AS value, value / 100 AS confidence, CASE event_id % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'inferred' ELSE 'guessed' END AS source,
  ts AS created_at, ts AS updated_at, CASE event_id % 4 WHEN 0 THEN NULL ELSE 'low' END AS sensitivity FROM events)
SELECT event_id, concat_ws('; ', {", ".join(f"CASE WHEN NOT coalesce({cond}, FALSE) THEN '{m}' END" for m, cond in _RULES)}) AS errors,
  regexp_matches(sha256(id), '^[0-9a-f]{{64}}$') AND NOT regexp_matches(id, '^[0-9a-f]{{64}}$') AS hash_ok FROM f
""")
def schema_validation(spark, sf_dir):
    """Facts made of events against the fact schema."""
    e, pick = F.col("event_id"), lambda x, *vs: F.get(F.array(*map(F.lit, vs)), x.cast("int"))
    facts = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.when(e % 7 == 0, "Fact-").otherwise("fact_"), e.cast("string")).alias("id"),
        F.when(e % 5 == 0, "other").otherwise("user").alias("namespace"),
        F.lit("preference").alias("type"),
        F.col("event_type").alias("key"),
        F.col("props").alias("value"),
        (F.col("value") / 100).alias("confidence"),
        pick(e % 3, "explicit", "inferred", "guessed").alias("source"),
        F.col("ts").cast("string").alias("created_at"),
        F.col("ts").cast("string").alias("updated_at"),
        F.when(e % 4 != 0, "low").alias("sensitivity"),
    )
    columns = [x for x in facts.columns if x != "event_id"]
    hash_ok = c.valid_hash(F.sha2("id", 256)) & ~c.valid_hash("id")
    return facts.select("event_id", F.array_join(c.schema_errors(columns), "; ").alias("errors"), hash_ok.alias("hash_ok"))


_EPISODE_RULES = [
    ("id: pattern", "regexp_matches(id, '^ep_[a-z0-9_]+$')"),
    ("summary: length", "length(summary) BETWEEN 20 AND 1000"),
    ("entities: items", "len(entities) BETWEEN 1 AND 20 AND len(list_distinct(entities)) = len(entities)"),
    ("timestamp: date-time", "TRY_CAST(stamp AS TIMESTAMP) IS NOT NULL"),
    ("importance: range", "importance BETWEEN 0 AND 1"),
    ("source_conversation_id: required", "conversation IS NOT NULL"),
]


@q(f"""
WITH e AS (SELECT conv_id * 1000 + turn AS key, CASE WHEN turn % 3 = 0 THEN 'ep-' ELSE 'ep_' END || conv_id AS id, text AS summary, regexp_extract_all(lower(text), '[a-z]{{8,}}') AS entities,
  CASE WHEN turn % 4 = 0 THEN 'yesterday' ELSE '2024-01-02 03:04:05' END AS stamp, length(text) / 400 AS importance, CASE WHEN turn % 5 > 0 THEN conv_id::VARCHAR END AS conversation, turn / 3 AS decay_rate FROM conversations)
SELECT key, concat_ws('; ', {", ".join(f"CASE WHEN NOT coalesce({cond}, FALSE) THEN '{m}' END" for m, cond in _EPISODE_RULES)}, CASE WHEN NOT decay_rate BETWEEN 0 AND 1 THEN 'decay_rate: range' END, 'mood: not allowed') AS errors FROM e
""")
def episode_validation(spark, sf_dir):
    """Turns of conversations, as episodes with one column too many, against the episode schema."""
    turn = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + turn).alias("key"),
        F.concat(F.when(turn % 3 == 0, "ep-").otherwise("ep_"), F.col("conv_id").cast("string")).alias("id"),
        F.col("text").alias("summary"),
        F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0)).alias("entities"),
        F.when(turn % 4 == 0, "yesterday").otherwise("2024-01-02 03:04:05").alias("timestamp"),
        (F.length("text") / 400).alias("importance"),
        F.when(turn % 5 > 0, F.col("conv_id").cast("string")).alias("source_conversation_id"),
        (turn / 3).alias("decay_rate"),
        F.lit("calm").alias("mood"),
    )
    return rows.select("key", F.array_join(c.episode_errors([x for x in rows.columns if x != "key"]), "; ").alias("errors"))
