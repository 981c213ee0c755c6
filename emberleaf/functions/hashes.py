"""Digests that Spark lacks, over Arrow batches."""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.arrow_udf(StringType())
def sha3_256(data: pa.Array) -> pa.Array:
    """Hexadecimal SHA3-256 of binary values."""
    return pa.array([None if x is None else hashlib.sha3_256(x).hexdigest() for x in data.to_pylist()], pa.string())


def sha2_256(data: Column) -> Column:
    return F.sha2(data, 256)


def seal(key: bytes, data: Column) -> Column:
    """Hexadecimal HMAC-SHA3-256 of binary values."""

    @F.arrow_udf(StringType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else hmac.new(key, x, hashlib.sha3_256).hexdigest() for x in values.to_pylist()], pa.string())

    return run(data)


def derive_key(secret: bytes, info: bytes, length: int = 32) -> bytes:
    """HKDF with SHA3-256 and no salt."""
    inner = hmac.new(bytes(32), secret, hashlib.sha3_256).digest()
    out, block = b"", b""
    for i in range(1, -(-length // 32) + 1):
        block = hmac.new(inner, block + info + bytes([i]), hashlib.sha3_256).digest()
        out += block
    return out[:length]
