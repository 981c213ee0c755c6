"""Similarities and quantisations of vectors as Column expressions, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberleaf.functions.text import let


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of other lengths or of norm 0."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def truncate(v: Column, dims: int) -> Column:
    """The first ``dims`` components, normalised."""
    return let(F.slice(doubles(v), 1, dims), lambda s: let(norm(s), lambda n: F.transform(s, lambda x: F.when(n > 0, x / n).otherwise(x))))


def int8(v: Column, dims: int) -> Column:
    """The truncated vector in steps of 1/127, towards zero."""
    return F.transform(truncate(v, dims), lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), x * 127)).cast("int").cast("tinyint"))


def bits(v: Column, dims: int | None = None, strict: bool = False) -> Column:
    """Signs as longs of up to 32 bits, the first component highest; 0 counts as positive unless ``strict``."""
    own = F.slice(v, 1, dims) if dims else v
    one = lambda x: F.when((x > 0) if strict else (x >= 0), 1).otherwise(0).cast("long")
    return let(own, lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 32).cast("int")), lambda i: F.aggregate(F.slice(a, i * 32 + 1, 32), F.lit(0).cast("long"), lambda s, x: s * 2 + one(x))))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_similarity(a: Column, b: Column, total: int) -> Column:
    return 1 - hamming(a, b) / F.lit(float(total))


def sign_hash(v: Column, planes: Sequence[Sequence[float]]) -> Column:
    """An integer of the sides of hyperplanes on which a vector lies."""
    return sum(((dot(v, literal(p)) > 0).cast("long") * (1 << i) for i, p in enumerate(planes)), F.lit(0).cast("long"))


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nearest(v: Column, centroids: Sequence[Sequence[float]]) -> Column:
    """The index of the centroid at the least distance, the first at a tie."""
    table = F.array(*(literal(c) for c in centroids))
    d = F.transform(table, lambda c: squared(v, c))
    return let(d, lambda a: F.array_position(a, F.array_min(a)).cast("int") - 1)
