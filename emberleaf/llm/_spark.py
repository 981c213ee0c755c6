"""Sources, written intermediate tables and the Arrow bridge of the llm operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. A local session that names none, as in tests, gets a temporary one;
    on a cluster that is an error, since executors do not see each other's folders.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="emberleaf-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Removes a query's shuffle files at its end; those of a written table are of no more use.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a table written to the shared folder, with ``options`` of the writer: its lineage ends there.

    A lost executor then costs a read, not a recomputation. The table goes when the JVM ends, or before by ``dropped``;
    the shuffle files behind it go at the end of the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/emberleaf-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = where
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` gave, once nothing is to be read of them."""
    for t in tables:
        t._stored_at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(t._stored_at, True)


#: Least number that stands for a null id.
NULL_ID = 1 << 62


def numbered(key: Column, *told_by: Column) -> Column:
    """``key`` as a long, a null one as a number from NULL_ID that ``told_by`` gives, so that only rows alike in these share it."""
    return F.coalesce(key.cast("long"), F.xxhash64(F.lit("id"), *told_by).bitwiseAND(NULL_ID - 1).bitwiseOR(NULL_ID))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker returns free memory to the system, so that what one task took does not stay with an idle worker."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return out


#: Bytes of an Arrow batch, in the JVM and in a Python worker.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches are held to BATCH_BYTES, so that long texts do not fill a worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.sub(r"\D", "", conf.get(key))) <= BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df
