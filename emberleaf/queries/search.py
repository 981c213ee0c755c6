"""Full-text, keyword and fused search over documents and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberleaf.functions import text as t
from emberleaf.operators import fingerprints as f
from emberleaf.operators import merkle
from emberleaf.operators import search as s
from emberleaf.queries import Registry, sql_list, table
from emberleaf.queries.fingerprint import DISTANCE, simhash_sql
from emberleaf.queries.merkle import merkle_sql
from emberleaf.queries.vectors import QUERY, SQL_QUERY
from emberleaf.sources.tables import checkpoint_dir

q = Registry()
TERMS = ("the", "license", "that")


def bm25_sql(source: str, key: str, field: str, terms) -> str:
    """Scores of one field in DuckDB."""
    return f"""
    (SELECT {key}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM (
      SELECT p.{key}, p.tf, d.len, x.df, st.n, st.avg_len
      FROM (SELECT {key}, w, count(*) AS tf FROM (SELECT {key}, unnest(regexp_extract_all(lower({field}), '[a-z0-9]+')) AS w FROM {source}) WHERE w IN ({", ".join(f"'{x}'" for x in terms)}) GROUP BY {key}, w) p
      JOIN (SELECT {key}, len(regexp_extract_all(lower({field}), '[a-z0-9]+')) AS len FROM {source}) d USING ({key})
      JOIN (SELECT w, count(DISTINCT {key}) AS df FROM (SELECT {key}, unnest(regexp_extract_all(lower({field}), '[a-z0-9]+')) AS w FROM {source}) GROUP BY w) x USING (w)
      CROSS JOIN (SELECT count(*) AS n, avg(len(regexp_extract_all(lower({field}), '[a-z0-9]+'))) AS avg_len FROM {source}) st) GROUP BY {key})"""


@q(f"""SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {bm25_sql("documents", "doc_id", "text", TERMS)} ORDER BY score DESC, doc_id LIMIT 10""")
def bm25_search(spark, sf_dir):
    """The ten documents that score highest for three terms."""
    hits = s.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", ["text"], TERMS, 10)
    return s.ranked(hits, "doc_id", "score").select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_FIELDS = "(SELECT page_id, url, regexp_replace(html, '<[^>]*>', ' ', 'g') AS body FROM pages)"


@q(f"""
SELECT page_id, round(coalesce(a.score, 0) + coalesce(b.score, 0), 6) AS score FROM {bm25_sql(_FIELDS, "page_id", "body", ("com", "example", "en"))} a
FULL JOIN {bm25_sql(_FIELDS, "page_id", "url", ("com", "example", "en"))} b USING (page_id)
""")
def bm25_fields(spark, sf_dir):
    """Scores of all pages over two fields."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("html", "<[^>]*>", " ").alias("body"))
    return s.bm25(pages, "page_id", ["body", "url"], ("com", "example", "en")).select("page_id", F.round("score", 6).alias("score"))


@q("""
SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, round(ln((SELECT count(*) FROM documents) / count(*)) + 1, 6) AS idf
FROM (SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY doc_id, w) GROUP BY term
""")
def inverted_index_terms(spark, sf_dir):
    """Every term with its document frequency, total and inverse document frequency, from the postings."""
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    rows = s.postings(docs, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return rows.withColumn("idf", F.round(F.log(F.lit(n) / F.col("df")) + 1, 6))


@q(f"""
WITH k AS (SELECT doc_id, string_split(lower(source), ' ') AS kws, left(text, 300) AS summary, n_chars FROM documents),
o AS (SELECT doc_id, (doc_id % 40)::DOUBLE AS idle, len(list_intersect({sql_list(TERMS)}, list_distinct(regexp_extract_all(lower(lang || ' license ' || source), '[a-z0-9]+')))) / 3.0 AS kw,
  len(list_intersect({sql_list(TERMS)}, list_distinct(regexp_extract_all(lower(summary), '[a-z0-9]+')))) / 3.0 AS su,
  len(list_intersect({sql_list(TERMS)}, ['notes', 'the', doc_id::VARCHAR])) / 3.0 AS pa FROM k JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id))
SELECT doc_id, round(least(1.0, 0.5 * kw + 0.3 * su + 0.1 * pa + 0.1 * greatest(0.0, 1 - idle / 30)), 6) AS score FROM o
""")
def relevance_search(spark, sf_dir):
    """Weighted keyword relevance of all documents; also those without a term in common score by recent use."""
    docs = table(spark, sf_dir, "documents")
    words = t.tokens(F.concat("lang", F.lit(" license "), "source"))
    score = s.relevance(TERMS, words, F.left("text", F.lit(300)), F.concat(F.lit("/a/notes-the-"), F.col("doc_id").cast("string"), F.lit(".md")), (F.col("doc_id") % 40).cast("double"))
    return docs.select("doc_id", F.round(score, 6).alias("score")).where("score > 0")


@q("""
SELECT doc_id, round(len(list_filter(kws, lambda w: contains(w, 'en'))) / 2.0 + len(list_filter(kws, lambda w: contains(w, 'the'))) / 2.0, 6) AS score,
  (contains(low, 'license')::INT + contains(low, 'that')::INT) / 2.0::DOUBLE AS coverage
FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS kws, lower(text) AS low FROM documents)
""")
def keyword_substring_search(spark, sf_dir):
    """Scores of documents by keywords that hold a query term, and the share of terms found."""
    score = s.keyword_substring(t.tokens("text"), ("en", "the"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score, 6).alias("score"), s.term_coverage(F.col("text"), ("license", "that")).alias("coverage"))


_HYBRID = f"""
WITH kw AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {bm25_sql("documents", "doc_id", "text", TERMS)} ORDER BY score DESC, doc_id LIMIT 30),
vs AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], {SQL_QUERY}) AS score FROM embeddings),
ve AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM vs ORDER BY score DESC, doc_id LIMIT 30)"""


@q(f"""{_HYBRID}
SELECT doc_id, round(coalesce(0.4 / (60 + kw.rank), 0) + coalesce(0.6 / (60 + ve.rank), 0), 9) AS score,
  CASE WHEN kw.rank IS NOT NULL AND ve.rank IS NOT NULL THEN 'both' WHEN kw.rank IS NULL THEN 'vector' ELSE 'keyword' END AS source
FROM kw FULL JOIN ve USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 10
""")
def hybrid_search(spark, sf_dir):
    """Fusion of a keyword and a vector search by weighted reciprocal ranks."""
    from emberleaf.functions.vectors import cosine, literal

    keyword = s.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", ["text"], TERMS)
    vector = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), cosine(F.col("embedding"), literal(QUERY)).alias("score"))
    return s.hybrid(keyword, vector, "doc_id", 10).withColumn("score", F.round("score", 9))


@q(f"""{_HYBRID}
SELECT doc_id, round(1 / (60 + rank), 9) AS score, 'keyword' AS source FROM kw ORDER BY rank LIMIT 10
""")
def hybrid_without_vectors(spark, sf_dir):
    """The same with an empty vector list: weights do not count."""
    keyword = s.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", ["text"], TERMS)
    vector = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0.0).alias("score")).where("false")
    return s.hybrid(keyword, vector, "doc_id", 10).withColumn("score", F.round("score", 9))


@q(f"""{_HYBRID}
SELECT kw.doc_id, round(CASE WHEN embedding IS NOT NULL THEN list_cosine_similarity(embedding::DOUBLE[], {SQL_QUERY}) ELSE kw.score * 0.9 END, 6) AS score
FROM kw LEFT JOIN embeddings e ON e.vec_id = kw.doc_id
""")
def reranked(spark, sf_dir):
    """Keyword hits scored anew by cosine where they have a vector."""
    hits = s.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", ["text"], TERMS, 30).select("doc_id", "score")
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return s.rerank(hits, vectors, "doc_id", QUERY).select("doc_id", F.round("score", 6).alias("score"))


@q(f"""
SELECT doc_id, round(score, 6) AS score, created_date FROM {bm25_sql("documents", "doc_id", "text", TERMS)} JOIN
  (SELECT doc_id, strftime(DATE '2024-01-01' + (doc_id % 60)::INT, '%Y-%m-%d') AS created_date FROM documents) USING (doc_id)
WHERE created_date > '2024-01-10' AND created_date < '2024-02-10' ORDER BY score DESC, doc_id LIMIT 20
""")
def dated_search(spark, sf_dir):
    """Search within a range of dates; statistics are of the whole corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")), "yyyy-MM-dd").alias("created_date"))
    hits = s.bm25(docs, "doc_id", ["text"], TERMS).where("created_date > '2024-01-10' and created_date < '2024-02-10'")
    return s.top(hits, "doc_id", "score", 20).select("doc_id", F.round("score", 6).alias("score"), "created_date")


@q("""
SELECT item_id, doc_id, matched FROM (
  SELECT b.item_id, d.doc_id, len(list_intersect(b.w, d.w)) AS matched, row_number() OVER (PARTITION BY b.item_id ORDER BY len(list_intersect(b.w, d.w)) DESC, d.doc_id) AS r
  FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark) b
  CROSS JOIN (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) d) WHERE r <= 3 AND matched > 0
""")
def benchmark_matches(spark, sf_dir):
    """For each benchmark passage the three documents that share the most words, by an inverted index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", t.tokens("text").alias("w"))
    items = table(spark, sf_dir, "benchmark").select("item_id", t.tokens("text").alias("w"))
    return s.best_shared(docs, "doc_id", "w", items, "item_id", "w", 3).select("item_id", "doc_id", "matched")


def _index(spark, sf_dir) -> str:
    path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    s.write_index(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id", ["text", "source"], path)
    return path


@q(f"""SELECT doc_id, round(coalesce(a.score, 0) + coalesce(b.score, 0), 6) AS score FROM {bm25_sql("documents", "doc_id", "text", TERMS)} a FULL JOIN {bm25_sql("documents", "doc_id", "source", TERMS)} b USING (doc_id)""")
def indexed_search(spark, sf_dir):
    """The scores of all documents with one of three terms, from a stored index."""
    return s.indexed_bm25(spark, _index(spark, sf_dir), TERMS).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@q("""
SELECT 'text' AS field, count(*) AS num_docs, (SELECT count(DISTINCT w) FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)) AS num_terms FROM documents
UNION ALL SELECT 'source', count(*), (SELECT count(DISTINCT w) FROM (SELECT unnest(regexp_extract_all(lower(source), '[a-z0-9]+')) AS w FROM documents)) FROM documents
""")
def index_statistics(spark, sf_dir):
    """Documents and terms of each field of a stored index."""
    return s.index_stats(spark, _index(spark, sf_dir))


@q("""
WITH k AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS k FROM documents)
SELECT count(*) AS artifact_count, count(*) AS leaf_count, (SELECT count(DISTINCT w) FROM (SELECT unnest(k) AS w FROM k)) AS keyword_entries, sum(len(k))::BIGINT AS keyword_refs FROM k
""")
def keyword_statistics(spark, sf_dir):
    """Artifacts, leaves, keywords and references of an index of keywords."""
    return s.keyword_stats(table(spark, sf_dir, "documents").select("doc_id", t.tokens("text").alias("k")), "k")


@q(f"""
WITH kw AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, len(list_filter(k, lambda w: strlen(w) <= 128 AND contains(w, 'en'))) / 2.0 + len(list_filter(k, lambda w: strlen(w) <= 128 AND contains(w, 'the'))) / 2.0 AS score
  FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS k FROM documents)) WHERE score > 0 ORDER BY rank LIMIT 20),
p AS (SELECT * FROM {simhash_sql("documents", "doc_id")}), b AS (SELECT hex FROM {simhash_sql("(SELECT 0 AS k, text FROM benchmark WHERE item_id = 0)", "k")}),
sh AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, 1 - ({DISTANCE}) / 256.0 AS score FROM p a, b) WHERE score >= 0.55 ORDER BY rank LIMIT 20),
f AS (SELECT doc_id, coalesce(1 / (60 + kw.rank), 0) + coalesce(1 / (60 + sh.rank), 0) AS score FROM kw FULL JOIN sh USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 20),
{merkle_sql("documents", "doc_id", 24)}, d AS (SELECT greatest(1, ceil(log2(count(*)))::INT) AS d FROM documents), every AS ({" UNION ALL ".join(f"SELECT {h} AS level, idx, hash FROM l{h}" for h in range(25))}),
i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS leaf_index FROM documents)
SELECT doc_id, round(score, 9) AS score, source, leaf_index, (SELECT hash FROM every, d WHERE level = d AND idx = 0) AS root FROM f JOIN documents USING (doc_id) JOIN i USING (doc_id)
""")
def fused_search(spark, sf_dir):
    """The best twenty of a keyword and a fingerprint search by reciprocal ranks, with their leaves and the root of the Merkle tree."""
    docs = table(spark, sf_dir, "documents")
    scored = docs.select("doc_id", s.keyword_substring(t.tokens("text"), ("en", "the")).alias("score")).where("score > 0")
    asked = f.simhash_table(table(spark, sf_dir, "benchmark").where("item_id = 0"), "item_id", "text").first()["fingerprint"]
    alike = f.search(f.simhash_table(docs, "doc_id", "text"), "doc_id", F.array(*(F.lit(x).cast("long") for x in asked)), 20, f.GATE)
    hits = s.fuse({"keyword": s.ranked(s.top(scored, "doc_id", "score", 20), "doc_id", "score"), "simhash": s.ranked(alike, "doc_id", "score")}, "doc_id", k=20)
    hashes = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    leaves, n = merkle.numbered(hashes, "h", "doc_id"), docs.count()
    out = s.proven(hits.drop("source"), docs.select("doc_id", "source"), leaves, merkle.root(leaves.select("idx", "hash"), n), "doc_id")
    return out.select("doc_id", F.round("score", 9).alias("score"), "source", "leaf_index", "root")
