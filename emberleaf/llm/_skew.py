"""Joins whose hot keys are dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberleaf.llm._spark import stored

#: Rows from which a key may count as hot, and the most keys that can.
HOT_ROWS, HOT_KEYS = 256, 50_000


def hot(many: DataFrame, keys: list[str]) -> DataFrame:
    """The hot keys of ``many``, a stored table, and in how many shares their rows are to be dealt.

    Hot keys have more than HOT_ROWS and more than 1 / HOT_KEYS of all rows, so there are fewer than HOT_KEYS, few enough to broadcast.
    """
    least = max(HOT_ROWS, many.count() // HOT_KEYS)
    counts = many.groupBy(*keys).agg(F.count("*").alias("n_")).where(F.col("n_") > least)
    return stored(counts.select(*keys, F.ceil(F.col("n_") / least).cast("int").alias("shares_")))


def dealt(many: DataFrame, keys: list[str], of: DataFrame, share: str = "share_") -> DataFrame:
    """``many`` with the ``share`` of its key that a row belongs to, by a hash of the whole row."""
    at = F.pmod(F.xxhash64(*many.columns), F.coalesce("shares_", F.lit(1))).cast("int")
    return many.join(F.broadcast(of), keys, "left").withColumn(share, at).drop("shares_")


def copied(one: DataFrame, keys: list[str], of: DataFrame, share: str = "share_") -> DataFrame:
    """``one`` with its rows of hot keys once for each ``share``."""
    every = F.sequence(F.lit(0), F.coalesce("shares_", F.lit(1)) - 1)
    return one.join(F.broadcast(of), keys, "left").withColumn(share, F.explode(every)).drop("shares_")


def spread(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``many``, a stored table, joined with ``one`` on ``keys``, no task with more than a share of a hot key.

    ``how`` is inner or left. Null keys have no partner. Without hot keys, as with empty tables, it is a plain join.
    """
    of = hot(many, keys)
    if of.isEmpty():
        return many.join(one, keys, how)
    return dealt(many, keys, of).join(copied(one, keys, of), [*keys, "share_"], how).drop("share_")


def lookup(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """As ``spread``, for a stored table ``one`` of short rows, which is broadcast if it has at most HOT_KEYS of them."""
    return many.join(F.broadcast(one), keys, how) if one.count() <= HOT_KEYS else spread(many, one, keys, how)
