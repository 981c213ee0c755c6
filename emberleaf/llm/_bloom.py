"""A Bloom filter of join keys, so that rows without a partner are not shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that a filter has at most, 16 MB, and for each key.
MOST, PER_KEY = 1 << 27, 16


def partnered(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``keys``; see ``may_be_in``."""
    return rows.where(may_be_in(keys, column))


def may_be_in(keys: DataFrame, column: str) -> Column:
    """A condition that holds for all rows whose ``column`` is in ``keys``, a stored table of one long column, and for few others.

    The bits are set by a distributed aggregation; their number is bounded, and tests read them
    from a scalar subquery within generated code. With more keys than a filter of that size can tell
    apart it holds for all rows.
    """
    n = keys.count()
    if n * 2 > MOST:
        return F.lit(True)
    bits = min(MOST, 1 << max(16, (n * PER_KEY - 1).bit_length()))
    at = lambda c, i: F.pmod(F.xxhash64(F.lit(i), c), F.lit(bits))
    key = F.col(keys.columns[0])
    set_ = keys.select(F.explode(F.array(at(key, 1), at(key, 2))).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    got = set_.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    held = keys.sparkSession.createDataFrame(pa.table({"words": pa.array([words.view(np.int64)], pa.list_(pa.int64()))})).scalar()
    test = lambda a: F.call_function("getbit", F.get(held, F.shiftright(a, 6).cast("int")), a.bitwiseAND(63).cast("int")) == 1
    return test(at(F.col(column), 1)) & test(at(F.col(column), 2))
