"""Usable vectors, shards and the choice between beams and whole products, shared by the vector operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberleaf.llm._spark import numbered

#: Rows whose distances one matrix product takes for the price of one that a beam gathers.
GATHER = 8
#: Distances that one matrix product holds.
BLOCK = 1 << 23


def cheaper_exactly(width: int, degree: int, size: int) -> bool:
    """Whether comparing a query with all rows costs no more than a beam of ``width``."""
    return width * degree * GATHER >= size


def slices(queries: int, size: int) -> Iterator[slice]:
    """Query ranges whose products with all rows hold at most BLOCK distances, one query at least."""
    step = max(1, BLOCK // max(1, size))
    for lo in range(0, queries, step):
        yield slice(lo, lo + step)


def usable(vectors: Column) -> Column:
    """Whether a vector has only finite components and not just zeros."""
    bad = F.exists(vectors, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vectors.isNotNull() & ~bad & F.exists(vectors, lambda c: c != 0), F.lit(False))


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """A row for each row of ``df``: ``id``, ``v`` in double precision, its length ``dim`` and a 128-bit ``h1``, ``h2``, null for an unusable vector.

    A null id is a number from NULL_ID that the vector gives, so that only equal vectors share it.
    """
    v = F.when(usable(F.col(vector)), F.transform(F.col(vector), lambda c: c.cast("double") + F.lit(0.0)))
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v"))
    hashed = lambda k: F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(k), "v"))
    rows = rows.withColumn("dim", F.when(F.col("v").isNotNull(), F.size("v"))).withColumn("h1", hashed(1)).withColumn("h2", hashed(2))
    return rows.withColumn("id", numbered(F.col("id"), F.col("h1"), F.col("h2")))


def shards(size: int, least: int, most: int) -> int:
    """How many parts of about ``most`` hold ``size``, ``least`` at least."""
    return max(least, -(-size // most))
