"""Sinks: Parquet batches, JSON, compressed bytes and dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = {"warm": 3, "cold": 9, "frozen": 19}
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES, LEAST_SAMPLES = 112_640, 500, 50_000, 10


def write_batch(artifacts: DataFrame, path: str, level: int = 3, mode: str = "append") -> None:
    """A batch of the store; the committer makes it visible at once or not at all.

    Rows are sorted by id within files, so that a lookup skips row groups.
    """
    rows = artifacts.sortWithinPartitions("artifact_id") if "artifact_id" in artifacts.columns else artifacts
    rows.write.mode(mode).option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def list_files(df: DataFrame) -> list[str]:
    return sorted(df.inputFiles())


def store_stats(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of a store and its rows, from file metadata and footers."""
    each = read_store(spark, path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.max("_metadata.file_size").alias("b"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def jsonl_to_parquet(spark: SparkSession, source: str, path: str, level: int = 19) -> None:
    """JSON lines as columns of strings; a bad line goes to ``_raw``, an empty file becomes one row ``_empty``."""
    rows = spark.read.option("primitivesAsString", "true").option("columnNameOfCorruptRecord", "_raw").json(source)
    if not rows.columns:
        rows = spark.range(1).select(F.lit("true").alias("_empty"))
    columns = [F.col(f"`{c}`") if t == "string" else F.to_json(f"`{c}`").alias(c) for c, t in rows.dtypes]
    rows.select(*columns).write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)


def parquet_to_jsonl(rows: DataFrame) -> DataFrame:
    """Rows as JSON without nulls and without ``_empty``."""
    return rows.drop("_empty").select(F.to_json(F.struct("*")).alias("value"))


def write_hot(artifacts: DataFrame, path: str, mode: str = "append") -> None:
    """Hot artifacts as JSON lines by tier: one table, not a file for each row."""
    artifacts.write.mode(mode).partitionBy("tier").json(path)


def compress(rows: DataFrame, column: str, level: int, dictionary: bytes | None = None) -> DataFrame:
    """``rows`` with ``compressed``, the column's bytes as zstd, and its ``compressed_size``."""
    import zstandard as z

    names = rows.columns
    shipped = rows.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dict_ = z.ZstdCompressionDict(shipped.value) if shipped.value else None
        coder = z.ZstdCompressor(level=level, dict_data=dict_)
        for b in batches:
            out = [None if x is None else coder.compress(x if isinstance(x, bytes) else x.encode()) for x in b.column(names.index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*names, "compressed"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "compressed binary"])
    return rows.mapInArrow(run, schema).withColumn("compressed_size", F.octet_length("compressed").cast("long"))


def decompress(rows: DataFrame, column: str = "compressed", dictionary: bytes | None = None) -> DataFrame:
    """``rows`` with ``restored``, the text that ``compress`` took."""
    import zstandard as z

    names = rows.columns
    shipped = rows.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(shipped.value) if shipped.value else None)
        for b in batches:
            out = [None if x is None else coder.decompress(x).decode() for x in b.column(names.index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*names, "restored"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "restored string"])
    return rows.mapInArrow(run, schema)


def train_dictionary(rows: DataFrame, column: str, key: str) -> bytes | None:
    """A zstd dictionary from at most 500 samples, chosen by hash, of 50,000 bytes each; none from fewer than ten."""
    import zstandard as z

    picked = rows.where(F.col(column).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLES).select(F.left(column, F.lit(SAMPLE_BYTES)).alias("s"))
    samples = [r["s"].encode()[:SAMPLE_BYTES] for r in picked.collect()]  # bounded by SAMPLES
    if len(samples) < LEAST_SAMPLES:
        return None
    try:
        return z.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except z.ZstdError:
        return None
