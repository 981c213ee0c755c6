"""Shared folders for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. A local session without one, as in tests, gets a temporary folder; on a
    cluster that is an error, since executors do not see each other's folders.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="emberleaf-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Makes ``df``'s session ready for checkpoint()."""
    checkpoint_dir(df.sparkSession)
    return df


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder, where its lineage ends; it goes when the JVM ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/emberleaf-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
