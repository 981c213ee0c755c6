"""File sources: scans with change detection, ingestion of raw files, JSON and compressed text."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberleaf.functions import classify, lexicon, text

SKIPPED = (".zst", ".encf", ".tmp", ".parquet")
LEAST_BYTES, GZIP_CHARS = 50, 102_400
# Folders and patterns of each assistant's files.
ASSISTANTS = {
    "claude": """
        ~/.claude history.jsonl
        ~/.claude/projects **/*.jsonl
        ~/.claude/projects **/*.jsonl.gz
        ~/.claude/projects **/memory/**/*
        ~/.claude/debug *.txt
        ~/.claude/file-history **/*
        ~/.claude/tasks **/*.json
        ~/.claude/todos *.json
        ~/.claude/plans *.md
        ~/.claude/skills **/*.md
        ~/.claude settings*.json
        ~/.claude/paste-cache *
        ~/.claude/shell-snapshots *.sh
        ~/.claude/sessions *.json
        ~/.claude/backups *.json
        ~/.claude/subagents *.jsonl
        ~/Library/Caches/claude-cli-nodejs **/*
    """,
    "chatgpt": "~/Library/Application Support/com.openai.chat **/*.json",
    "cursor": "~/.cursor **/*.jsonl",
    "copilot": "~/.config/github-copilot **/*.json",
    "openclaw": """
        ~/.openclaw MEMORY.md
        ~/.openclaw/memory *.md
        ~/.openclaw sessions/**/*.jsonl
        ~/.openclaw context/**/*
    """,
    "generic": "~/.local/share/ai-memory *",
}
# End of the fixed values.


def artifact_schema() -> str:
    """Columns of an artifact."""
    return (
        "artifact_id string, content string, content_hash string, summary string, keywords array<string>, significance float, source_label string, source_path string, created_date string, original_size bigint, supersedes string, "
        "semantic struct<technology:array<string>,category:array<string>,action:array<string>,domain:array<string>,polarity:string,entities:array<string>>, namespace string, memory_type string, confidence float, "
        "source_provenance string, sensitivity string, tags string, expires_at string, session_id string"
    )


def scan(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Paths, times of change and sizes of files below ``root``; only metadata is read. Files that tiers have written are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(root)
    return files.select("path", F.col("modificationTime").alias("mtime"), "length").where(~_skipped(F.col("path")))


def _skipped(path: Column) -> Column:
    out = F.lit(False)
    for s in SKIPPED:
        out |= path.endswith(s)
    return out


def count(files: DataFrame) -> DataFrame:
    """Number and bytes of scanned files."""
    return files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def read_bytes(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(root)
    return files.where(~_skipped(F.col("path"))).select("path", F.col("modificationTime").alias("mtime"), "length", "content")


def ingest(files: DataFrame, label: str) -> DataFrame:
    """Artifacts of files with ``path``, ``mtime`` and binary ``content``.

    Files with a zero byte, that are no UTF-8, or of fewer than 50 bytes without outer space give none.
    """
    raw = F.col("content")
    ok = F.call_function("is_valid_utf8", raw.cast("string")) & (F.instr(raw.cast("string"), "\0") == 0) & (F.octet_length(F.trim(raw.cast("string"))) >= LEAST_BYTES)
    body = F.col("body")
    rows = files.where(ok).select("path", "mtime", F.sha2(raw, 256).alias("content_hash"), raw.cast("string").alias("body"), F.octet_length(raw).cast("long").alias("original_size"))
    none = F.lit(None).cast("string")
    return rows.select(
        F.left("content_hash", F.lit(16)).alias("artifact_id"), body.alias("content"), "content_hash", text.ingest_summary(body, "path").alias("summary"), text.keywords(body).alias("keywords"),
        classify.significance(body).cast("float").alias("significance"), F.lit(label).alias("source_label"), F.col("path").alias("source_path"), F.date_format("mtime", "yyyy-MM-dd").alias("created_date"), "original_size",
        none.alias("supersedes"), classify.semantics(body).alias("semantic"), F.lit("user").alias("namespace"), F.lit("note").alias("memory_type"), F.lit(0.5).cast("float").alias("confidence"), F.lit("explicit").alias("source_provenance"),
        F.lit("low").alias("sensitivity"), none.alias("tags"), none.alias("expires_at"), none.alias("session_id"),
    )


def gzip_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole compressed text files, the first 102,400 characters of each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.left("value", F.lit(GZIP_CHARS)).alias("content"))


def hot_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One artifact for each JSON file of a folder; malformed ones are skipped."""
    return spark.read.schema(schema or artifact_schema()).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path)


def jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files with their file and ``n``, a number that grows from line to line of a file.

    Files are read by lines and in parts, so no row holds a file. A part of a file starts at a byte that is greater than
    the number of all lines of a task that reads a part before, so ``n``, that byte plus the line's number in its task, keeps the order.
    """
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), place.alias("n"), "value")
    return rows.where(F.trim("value") != "")


def installed_assistants(home: str) -> dict[str, list[tuple[str, str]]]:
    """For each assistant with a folder below ``home`` its existing folders and their patterns."""
    out: dict[str, list[tuple[str, str]]] = {}
    for name, listing in ASSISTANTS.items():
        for line in listing.strip().splitlines():
            folder, pattern = line.strip().rsplit(" ", 1)
            where = Path(home) / folder.removeprefix("~/")
            if where.is_dir():
                out.setdefault(name, []).append((str(where), pattern))
    return out


def under(path: Column, roots: Sequence[str]) -> Column:
    """Whether a normal path lies in one of ``roots``."""
    out = F.lit(False)
    for r in roots:
        r = r.rstrip("/")
        out |= (path == r) | path.startswith(r + "/")
    return out & ~path.contains("/../") & ~path.endswith("/..")


def sensitive(path: Column, home: str) -> Column:
    """Whether a path is in a folder of keys or credentials below ``home``, which no scan may read."""
    return under(path, [f"{home.rstrip('/')}/{f}" for f in lexicon.SENSITIVE_FOLDERS])


def protected(path: Column, home: str) -> Column:
    """Whether a path is in a folder that an assistant manages: to be read, never moved or deleted."""
    return under(path, [f"{home.rstrip('/')}/{f}" for f in lexicon.PROTECTED_FOLDERS])


def admitted(path: Column, roots: Sequence[str], home: str) -> Column:
    """Whether a path may be scanned: in one of ``roots``, with no step upwards, and not sensitive."""
    return under(path, roots) & ~sensitive(path, home)
