"""A Merkle tree over the content hashes of documents and of benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberleaf.operators import merkle as m
from emberleaf.queries import Registry, table

q = Registry()


def merkle_sql(source: str, key: str, levels: int) -> str:
    """CTEs l0, l1, ... of up to ``levels`` levels above the leaves; each level ends with one node at least."""
    out = f"l0 AS (SELECT row_number() OVER (ORDER BY {key}) - 1 AS idx, sha256(unhex('00' || sha256(text))) AS hash FROM {source}), z0 AS (SELECT repeat('0', 64) AS z)"
    for h in range(levels):
        out += f""", l{h + 1} AS (SELECT a.idx // 2 AS idx, sha256(unhex('01' || a.hash || coalesce(b.hash, z))) AS hash FROM l{h} a LEFT JOIN l{h} b ON b.idx = a.idx + 1, z{h} WHERE a.idx % 2 = 0),
        z{h + 1} AS (SELECT sha256(unhex('01' || z || z)) AS z FROM z{h})"""
    return out


def _leaves(spark, sf_dir, name, key):
    rows = table(spark, sf_dir, name).select(key, F.sha2("text", 256).alias("h"))
    return m.leaves(rows, "h", key), rows.count()


@q(f"WITH {merkle_sql('benchmark', 'item_id', 12)}, d AS (SELECT greatest(1, ceil(log2(count(*)))::INT) AS d FROM benchmark), every AS ({' UNION ALL '.join(f'SELECT {h} AS level, idx, hash FROM l{h}' for h in range(13))}) SELECT level::INT AS level, idx, hash FROM every, d WHERE level <= d")
def merkle_tree(spark, sf_dir):
    """Every node over the benchmark passages."""
    leaves, n = _leaves(spark, sf_dir, "benchmark", "item_id")
    return m.levels(leaves, n).select("level", "idx", "hash")


@q(f"WITH {merkle_sql('documents', 'doc_id', 24)}, d AS (SELECT greatest(1, ceil(log2(count(*)))::INT) AS d FROM documents), every AS ({' UNION ALL '.join(f'SELECT {h} AS level, idx, hash FROM l{h}' for h in range(25))}) SELECT hash AS root, (SELECT count(*) FROM documents) AS leaves FROM every, d WHERE level = d AND idx = 0")
def merkle_root(spark, sf_dir):
    """The root over all documents."""
    leaves, n = _leaves(spark, sf_dir, "documents", "doc_id")
    return m.root(leaves, n).select(F.col("hash").alias("root"), F.lit(n).cast("long").alias("leaves"))


@q(f"""WITH {merkle_sql("benchmark", "item_id", 12)}, d AS (SELECT greatest(1, ceil(log2(count(*)))::INT) AS d FROM benchmark), every AS ({" UNION ALL ".join(f"SELECT {h} AS level, idx, hash FROM l{h}" for h in range(12))}),
s AS (SELECT level, d, (5 >> level) & 1 AS odd, xor(5 >> level, 1) AS sib FROM range(12) r(level), d WHERE level < d)
SELECT s.level::INT AS level, hash AS sibling, CASE WHEN odd = 1 THEN 'left' ELSE 'right' END AS side, TRUE AS ok FROM s JOIN every e ON e.level = s.level AND e.idx = s.sib""")
def merkle_proof(spark, sf_dir):
    """The proof of leaf 5, which folds to the root."""
    leaves, n = _leaves(spark, sf_dir, "benchmark", "item_id")
    steps = m.proof(leaves, n, 5)
    path = steps.agg(F.array_sort(F.collect_list(F.struct("level", "sibling", "side"))).alias("path"))
    one = path.crossJoin(leaves.where("idx = 5").select(F.col("hash").alias("leaf"))).crossJoin(m.root(leaves, n).select(F.col("hash").alias("root")))
    ok = one.select(m.verify(F.col("leaf"), F.col("path"), F.col("root")).alias("ok"))
    return steps.crossJoin(F.broadcast(ok))


@q("SELECT doc_id, sha256(text) = CASE WHEN doc_id % 50 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS ok, CASE WHEN sha256(text) = CASE WHEN doc_id % 50 = 0 THEN sha256(text || 'x') ELSE sha256(text) END THEN 'passed' ELSE 'failed' END AS status FROM documents")
def verify_hashes(spark, sf_dir):
    """Stored content hashes against recomputed ones; every fiftieth is spoilt."""
    from emberleaf.operators import store

    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 50 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("content_hash"))
    return store.verified(rows, "text", "content_hash").select("doc_id", "ok", F.when(F.col("ok"), "passed").otherwise("failed").alias("status"))


@q("SELECT count(*) AS total, count(*) FILTER (doc_id % 50 <> 0) AS passed, count(*) FILTER (doc_id % 50 = 0) AS failed, string_agg(doc_id, ',' ORDER BY doc_id) FILTER (doc_id % 50 = 0) AS failures FROM documents")
def verify_totals(spark, sf_dir):
    """Totals of a verification with the ids that failed."""
    from emberleaf.operators import store

    return store.verification(verify_hashes(spark, sf_dir), "doc_id")


@q("SELECT doc_id, sha256(text) AS content_hash, lang AS tier FROM documents WHERE sha256(text) = (SELECT min(sha256(text)) FROM documents)")
def lookup_by_hash(spark, sf_dir):
    """The document of the smallest content hash, found by that hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.col("lang").alias("tier"))
    least = docs.agg(F.min("content_hash").alias("content_hash"))
    return docs.join(F.broadcast(least), "content_hash", "left_semi")
