"""Text functions over documents, conversations, events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberleaf.functions import lexicon
from emberleaf.functions import text as t
from emberleaf.queries import Registry, sql_list, table

q = Registry()


def distinct(x: str) -> str:
    """DuckDB's list_distinct loses order."""
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"


@q("""
SELECT doc_id, coalesce(len(a), 0) AS n_tokens, coalesce(list_aggregate(list_sort(a), 'string_agg', ' '), '') AS tokens
FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a FROM documents)
""")
def token_sets(spark, sf_dir):
    """Distinct tokens of every document."""
    a = t.tokens("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(a).cast("long").alias("n_tokens"), F.array_join(F.array_sort(a), " ").alias("tokens"))


@q(r"""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(regexp_replace(regexp_replace(text, '```[\s\S]*?```', '', 'g'), 'https?://\S+', '', 'g')), '[a-zA-Z][a-zA-Z0-9_-]{2,}') AS a FROM conversations)
SELECT conv_id, turn, len(a) AS n_words, list_aggregate(a, 'string_agg', ' ') AS words FROM w
""")
def session_words(spark, sf_dir):
    """Words of every turn outside code and addresses."""
    a = t.session_tokens("text")
    words = F.when(F.size(a) > 0, F.array_join(a, " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(a).cast("long").alias("n_words"), words.alias("words"))


@q(rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_-]+'), lambda x: strlen(x) >= 3 AND NOT list_contains({sql_list(lexicon.FINGERPRINT_STOPS)}, x)) AS a FROM documents)
SELECT doc_id, len(a) AS n_words, len(list_distinct(a)) AS n_distinct FROM w
""")
def fingerprint_words(spark, sf_dir):
    a = t.fingerprint_tokens("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(a).cast("long").alias("n_words"), F.size(F.array_distinct(a)).cast("long").alias("n_distinct"))


@q(rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: strlen(x) >= 3 AND NOT list_contains({sql_list(lexicon.INGEST_STOPS)}, x)) AS a FROM documents),
o AS (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM w) GROUP BY doc_id, w)
SELECT d.doc_id, count(o.w) AS n_keywords, coalesce(string_agg(o.w, ' ' ORDER BY o.i), '') AS keywords FROM documents d LEFT JOIN o USING (doc_id) GROUP BY d.doc_id
""")
def ingest_keywords(spark, sf_dir):
    """Distinct keywords of every document in order of appearance."""
    a = t.keywords("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(a).cast("long").alias("n_keywords"), F.array_join(a, " ").alias("keywords"))


@q(f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE length(w) > 2 AND NOT list_contains({sql_list(lexicon.CONTEXT_STOPS)}, w) GROUP BY doc_id, w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM c)
SELECT doc_id, w AS keyword, n, r AS rank FROM r WHERE r <= 30
""")
def ranked_keywords(spark, sf_dir):
    """The thirty most frequent keywords of every document with their counts."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.term_counts("text")))
    return rows.select("doc_id", F.col("col.term").alias("keyword"), "col.n", (F.col("pos") + 1).cast("long").alias("rank"))


@q(f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE length(w) > 2 AND NOT list_contains({sql_list(lexicon.CONTEXT_STOPS)}, w) GROUP BY doc_id, w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM c)
SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY r), '') AS keywords FROM documents d LEFT JOIN (SELECT * FROM r WHERE r <= 30) x USING (doc_id) GROUP BY d.doc_id
""")
def keyword_column(spark, sf_dir):
    """The same keywords as one Column expression, without a shuffle."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(t.ranked_keywords("text"), " ").alias("keywords"))


@q(r"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) AS a, string_split(trim(text, ' '), chr(10)) AS b FROM documents),
x AS (SELECT doc_id, b, coalesce(list_filter(list_transform(b, lambda x: trim(x, ' ')), lambda x: length(x) > 10)[1], '') AS long,
  trim(regexp_replace(coalesce(list_filter(b, lambda x: x[1] = '#')[1], ''), '^#+', ''), ' ') AS h,
  left(coalesce(list_filter(list_transform(b, lambda x: trim(x, ' ')), lambda x: x <> '' AND x[1] <> '#' AND x[:3] <> '---')[1], ''), 100) AS p,
  trim(regexp_replace(coalesce(list_filter(a, lambda x: x[1] = '#')[1], ''), '^#+', ''), ' ') AS ih,
  coalesce(list_filter(a, lambda x: x <> '' AND x[1] <> '#' AND x[:3] <> '---' AND x[1] <> '|')[1], '') AS il FROM l),
y AS (SELECT *, CASE WHEN length(il) > 200 THEN left(il, 200) || '...' ELSE il END AS cut FROM x)
SELECT doc_id, CASE WHEN long <> '' THEN left(long, 120) ELSE len(b) || ' lines' END AS summary_text,
  CASE WHEN h <> '' AND p <> '' THEN h || ': ' || p WHEN h <> '' THEN h WHEN p <> '' THEN p ELSE 'Empty markdown' END AS summary_md,
  'doc' || doc_id || '.md: ' || CASE WHEN ih <> '' THEN ih || '. ' || cut ELSE cut END AS summary_ingest
FROM y
""")
def summaries(spark, sf_dir):
    """Summaries of every document as plain text, as Markdown and as an ingested file."""
    path = F.concat(F.lit("/notes/doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", t.summarize_text("text").alias("summary_text"), t.summarize_markdown("text").alias("summary_md"), t.ingest_summary("text", path).alias("summary_ingest"))


@q("""
SELECT event_id, 'JSON object with keys: ' || array_to_string(json_keys(props::JSON)[1:5], ', ') AS summary_json,
  '2 entries, fields: ' || array_to_string(json_keys(props::JSON)[1:5], ', ') AS summary_jsonl,
  CAST(props::JSON AS VARCHAR).replace(' ', '') || chr(10) || 'plain text' AS minified, TRUE AS jsonl FROM events
""")
def json_summaries(spark, sf_dir):
    """Summaries and compact forms of the events' JSON; two lines of it look like JSONL."""
    twice = F.concat("props", F.lit("\n"), "props")
    messy = F.concat("props", F.lit("\n\n   plain text  "))
    return table(spark, sf_dir, "events").select("event_id", t.summarize("props", F.lit("a/b.json")).alias("summary_json"), t.summarize(twice, F.lit("a/b.JSONL")).alias("summary_jsonl"), t.minify_json(messy).alias("minified"), t.looks_like_jsonl(twice).alias("jsonl"))


@q(rf"""
SELECT doc_id, trim(array_to_string(list_filter(string_split(left(text, 200), chr(10)), lambda x: len(list_filter({sql_list(lexicon.INJECTIONS)}, lambda p: contains(lower(x), p))) = 0), ' '), ' ') AS plain,
  regexp_replace(left(text, 50), '[\n\r#*`\[\]<>]', '', 'g') AS query,
  'Title' || chr(10) || chr(10) || left(text, 500) AS contextual,
  CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE printf('%.1f KB', n_chars / 1024.0) END AS size
FROM documents
""")
def sanitized(spark, sf_dir):
    """Texts made safe for a prompt, with size labels, for all documents: lines that look like instructions go."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", t.sanitize_summary("text").alias("plain"), t.sanitize_query("text").alias("query"), t.contextualize(F.lit("Title"), "text").alias("contextual"), t.format_size("n_chars").alias("size"))


@q("""
WITH g AS (SELECT doc_id, CASE WHEN length(text) < 4 THEN [lower(text)] ELSE list_transform(range(1, CAST(length(text) AS BIGINT) - 2), lambda i: substr(lower(text), i, 4)) END AS a FROM documents)
SELECT doc_id, len(a) AS n_windows, len(list_distinct(a)) AS n_distinct FROM g
""")
def character_windows(spark, sf_dir):
    """Windows of four characters over every whole text."""
    a = t.shingles("text", 4)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(a).cast("long").alias("n_windows"), F.size(F.array_distinct(a)).cast("long").alias("n_distinct"))


def _groups() -> str:
    groups = {k: "(" + " OR ".join(f'"{s}"' if " " in s else s for s in g) + ")" for k, g in lexicon.synonyms().items()}
    return "MAP {" + ", ".join(f"'{k}': '{g}'" for k, g in groups.items()) + "}"


@q(f"""
SELECT item_id, coalesce(list_aggregate(list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''), lambda w: coalesce({_groups()}[lower(w)], w)), 'string_agg', ' '), '') AS expanded
FROM benchmark
""")
def expanded_queries(spark, sf_dir):
    """The benchmark's passages as queries, their words expanded by synonyms."""
    return table(spark, sf_dir, "benchmark").select("item_id", t.expand_query("text").alias("expanded"))


@q("""
SELECT page_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(md, '(?m)^#{1,3}\\s+(.+)$', 1), lambda h: trim(h, ' ')), lambda h: length(h) > 3))[1:20]) AS n_headers
FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<h[1-3][^>]*>', chr(10) || '## ', 'g'), '<[^>]*>', chr(10), 'g') AS md FROM pages)
""")
def page_headers(spark, sf_dir):
    """Section headings of pages turned to Markdown."""
    md = F.regexp_replace(F.regexp_replace("html", "<h[1-3][^>]*>", "\n## "), "<[^>]*>", "\n")
    return table(spark, sf_dir, "pages").select("page_id", F.size(t.headers(md)).cast("long").alias("n_headers"))
