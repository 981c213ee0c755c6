"""Round trips through the store's formats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberleaf.functions import lexicon
from emberleaf.operators import pipelines, store
from emberleaf.queries import Registry, table
from emberleaf.sources import files, sinks
from emberleaf.sources.tables import checkpoint_dir

q = Registry()


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/io-{uuid.uuid4().hex}"


@q("SELECT CAST(doc_id AS VARCHAR) AS artifact_id, sha256(text) AS content_hash, length(text) AS n FROM documents")
def parquet_store(spark, sf_dir):
    """Documents written as a store batch and read back; two columns reach the scan."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("artifact_id"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), F.lit("memory").alias("content_type"))
    sinks.write_batch(rows, path)
    return sinks.read_store(spark, path).select("artifact_id", "content_hash", F.length("content").cast("long").alias("n"))


@q("SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, text FROM conversations")
def jsonl_store(spark, sf_dir):
    """JSON lines as columns of strings and back to rows."""
    path = _folder(spark)
    table(spark, sf_dir, "conversations").write.json(f"{path}/in")
    sinks.jsonl_to_parquet(spark, f"{path}/in", f"{path}/out")
    lines = sinks.parquet_to_jsonl(spark.read.parquet(f"{path}/out"))
    return lines.select(F.from_json("value", "conv_id string, turn string, role string, text string").alias("r")).select("r.*")


@q("SELECT doc_id::VARCHAR AS artifact_id, sha256(text) AS content_hash, TRUE AS ok FROM documents")
def cold_round_trip(spark, sf_dir):
    """Documents through the cold tier with a trained dictionary."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("artifact_id"), F.col("text").alias("content"))
    dictionary = sinks.train_dictionary(rows, "content", "artifact_id")
    stored, blocks = pipelines.store(rows, "cold", dictionary)
    return store.verified(pipelines.restore(stored, blocks, dictionary)).select("artifact_id", "content_hash", "ok")


@q()
def tier_sizes(spark, sf_dir):
    """Bytes of all documents in each tier's form."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("artifact_id"), F.col("text").alias("content"))
    out = None
    for tier in sinks.LEVELS:
        stored, _ = pipelines.store(rows, tier)
        part = stored.groupBy("tier").agg(F.count("*").alias("n"), F.sum("compressed_size").alias("bytes"))
        out = part if out is None else out.unionByName(part)
    return out


@q("SELECT doc_id::VARCHAR AS artifact_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN NULL ELSE sha256(text) END AS hash, CASE doc_id % 4 WHEN 0 THEN 'not found' WHEN 1 THEN 'hash mismatch' ELSE 'ok' END AS status FROM documents")
def recalls(spark, sf_dir):
    """Recall of every document; some are gone, some spoilt."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.col("doc_id").cast("string").alias("artifact_id"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), F.lit("cold").alias("tier"))
    kept = rows.where("i % 4 <> 0").withColumn("content", F.when(F.col("i") % 4 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).drop("i")
    return store.recall(kept, rows.select("artifact_id"), 0.0).select("artifact_id", F.sha2("content", 256).alias("hash"), "status")


@q("""
SELECT left(sha256(text), 16) AS artifact_id, sha256(text) AS content_hash, strlen(text) AS original_size, '2024-01-31' AS created_date, 'documents' AS source_label FROM documents WHERE strlen(trim(text, ' ')) >= 50 AND NOT contains(text, chr(0))
""")
def ingested(spark, sf_dir):
    """Artifacts of documents as raw files."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("/n/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("2024-01-31 10:00:00").cast("timestamp").alias("mtime"), F.col("text").cast("binary").alias("content"))
    return files.ingest(docs, "documents").select("artifact_id", "content_hash", "original_size", "created_date", "source_label")


_HOME, _ROOTS = "/home/u", ["/home/u/notes", "/home/u/.ssh", "/home/u/.claude", "/data"]


def _in(folders) -> str:
    return "(" + " OR ".join(f"p = '{f}' OR starts_with(p, '{f}/')" for f in folders) + ") AND NOT contains(p, '/../') AND NOT ends_with(p, '/..')"


_PATHS = ["/home/u/notes/", "/home/u/notesx/", "/home/u/.ssh/", "/home/u/.claude/plans/", "/data/../etc/", "/data/deep/", "/home/u/.config/gcloud/"]


@q(f"""
WITH d AS (SELECT doc_id, {_PATHS!r}[doc_id % 7 + 1] || source || doc_id AS p FROM documents)
SELECT doc_id, {_in(_ROOTS)} AS inside, {_in([_HOME + "/" + f for f in lexicon.SENSITIVE_FOLDERS])} AS sensitive, {_in([_HOME + "/" + f for f in lexicon.PROTECTED_FOLDERS])} AS protected,
  ({_in(_ROOTS)}) AND NOT ({_in([_HOME + "/" + f for f in lexicon.SENSITIVE_FOLDERS])}) AS admitted FROM d
""")
def path_guards(spark, sf_dir):
    """Which paths lie in scanned, sensitive and protected folders."""
    p = F.concat(F.get(F.array(*map(F.lit, _PATHS)), (F.col("doc_id") % 7).cast("int")), F.col("source"), F.col("doc_id").cast("string"))
    guards = {"inside": files.under(p, _ROOTS), "sensitive": files.sensitive(p, _HOME), "protected": files.protected(p, _HOME), "admitted": files.admitted(p, _ROOTS, _HOME)}
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in guards.items()))


@q("SELECT doc_id::VARCHAR AS artifact_id, length(text) AS n, source AS tier FROM documents")
def hot_store(spark, sf_dir):
    """Documents written as hot JSON by tier and read back with a schema."""
    path = _folder(spark)
    sinks.write_hot(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("artifact_id"), F.col("text").alias("content"), F.col("source").alias("tier")), path)
    rows = spark.read.schema("artifact_id string, content string, tier string").json(path)
    return rows.select("artifact_id", F.length("content").cast("long").alias("n"), "tier")


@q("SELECT conv_id, count(*) AS n, sha256(string_agg(text, chr(10) ORDER BY turn)) AS content_hash FROM conversations WHERE NOT contains(text, chr(10)) AND NOT contains(text, chr(13)) AND trim(text, ' ') <> '' GROUP BY conv_id")
def log_lines(spark, sf_dir):
    """Turns written as lines of text logs and read back by lines, in order."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "conversations").where(~F.contains("text", F.lit("\n")) & ~F.contains("text", F.lit("\r")))
    sort = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    sort.select("conv_id", "text").write.partitionBy("conv_id").text(path)
    lines = files.jsonl_lines(spark, path)
    whole = lines.groupBy(F.regexp_extract("path", "conv_id=(\\d+)", 1).cast("long").alias("conv_id")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("n", "value"))).alias("l"))
    return whole.select("conv_id", "n", F.sha2(F.array_join("l.value", "\n"), 256).alias("content_hash"))


@q("SELECT count(*) AS artifacts, sum(length(text))::BIGINT AS chars, TRUE AS files, TRUE AS bytes FROM documents")
def store_statistics(spark, sf_dir):
    """Rows, characters, files and bytes of a store batch."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("artifact_id"), F.col("text").alias("content"))
    sinks.write_batch(rows, path)
    found = sinks.store_stats(spark, path).first()
    assert found["files"] == len(sinks.list_files(sinks.read_store(spark, path)))
    back = sinks.read_store(spark, path)
    return back.agg(F.count("*").alias("artifacts"), F.sum(F.length("content")).cast("long").alias("chars")).select("*", F.lit(found["files"] > 0).alias("files"), F.lit(found["bytes"] > 0).alias("bytes"))


@q("SELECT item_id, length(left(text || chr(10), 102400)) AS n, sha256(left(text || chr(10), 102400)) AS content_hash FROM benchmark")
def gzip_texts(spark, sf_dir):
    """Passages written as compressed text files, one each, and read whole."""
    path = _folder(spark)
    table(spark, sf_dir, "benchmark").select("item_id", "text").repartition("item_id").write.partitionBy("item_id").option("compression", "gzip").text(path)
    rows = files.gzip_text(spark, path)
    return rows.select(F.regexp_extract("path", "item_id=(\\d+)", 1).cast("long").alias("item_id"), F.length("content").cast("long").alias("n"), F.sha2("content", 256).alias("content_hash"))


@q("SELECT item_id::VARCHAR AS artifact_id, length(text) AS n FROM benchmark")
def hot_artifacts(spark, sf_dir):
    """Passages as one JSON file each, beside one that is broken, read as artifacts."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").cast("string").alias("artifact_id"), F.col("text").alias("content"))
    rows.repartition("item_id").write.partitionBy("item_id").json(path)
    spark.createDataFrame([('{"artifact_id": "broken',)], "value string").coalesce(1).write.text(f"{path}/item_id=-1")
    return files.hot_json(spark, f"{path}/*", "artifact_id string, content string").where("artifact_id is not null").select("artifact_id", F.length("content").cast("long").alias("n"))


@q("SELECT count(*) AS n, sum(strlen(text) + 1)::BIGINT AS bytes FROM benchmark")
def file_counts(spark, sf_dir):
    """Number and bytes of scanned files, of which tiers have written one more."""
    path = _folder(spark)
    table(spark, sf_dir, "benchmark").select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(path)
    spark.range(1).write.parquet(f"{path}/item_id=-1")
    return files.count(files.scan(spark, path).where(F.col("path").endswith(".txt") | F.col("path").endswith(".parquet")))
