"""Vector functions and searches over embeddings."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from emberleaf.functions import vectors as v
from emberleaf.operators import vector_search as vs
from emberleaf.queries import Registry, table

q = Registry()
DIMS = 64
QUERY = [round(math.cos(3 * i) + 0.3, 6) for i in range(DIMS)]
SQL_QUERY = "[" + ", ".join(map(str, QUERY)) + "]::DOUBLE[]"
TIERS = {"hot": (64, "float"), "warm": (48, "float"), "cold": (32, "int8"), "frozen": (16, "bits")}
SQL_TIER = "(['hot', 'warm', 'cold', 'frozen'])[(vec_id % 4 + 1)::INT]"


def unit(x: str, d: int) -> str:
    return f"list_transform(({x})[1:{d}], lambda y: y / sqrt(list_dot_product(({x})[1:{d}], ({x})[1:{d}])))"


def word(x: str, lo: int, hi: int, op: str = ">=") -> str:
    return f"list_reduce(list_prepend(0::BIGINT, list_transform(({x})[{lo}:{hi}], lambda y: (y {op} 0)::BIGINT)), lambda a, b: a * 2 + b)"


_E = "embedding::DOUBLE[]"


def tier():
    return F.get(F.array(*map(F.lit, TIERS)), (F.col("vec_id") % 4).cast("int"))


@q(f"SELECT vec_id, round(list_cosine_similarity({_E}, {SQL_QUERY}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity({_E}, {SQL_QUERY}) DESC, vec_id LIMIT 10")
def cosine_top(spark, sf_dir):
    """The ten vectors nearest to a query by cosine."""
    return vs.exact(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY, 10).select("vec_id", F.round("score", 6).alias("score"))


@q(f"""
SELECT vec_id, round(list_aggregate(list_transform({unit(_E, 48)}, lambda x: x * 1.0), 'sum'), 6) AS sum_48,
  list_aggregate(list_transform({unit(_E, 32)}, lambda x: trunc(greatest(-127.0, least(127.0, x * 127)))::BIGINT), 'sum')::BIGINT AS sum_int8,
  {word(_E, 1, 32)} AS w0, {word(_E, 33, 64)} AS w1, {word(_E, 1, 32, ">")} AS strict0 FROM embeddings
""")
def quantised(spark, sf_dir):
    """Truncated, 8-bit and sign forms of every vector."""
    e = F.col("embedding")
    total = lambda a, zero: F.aggregate(a, zero, lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(total(v.truncate(e, 48), F.lit(0.0)), 6).alias("sum_48"),
        total(F.transform(v.int8(e, 32), lambda x: x.cast("long")), F.lit(0).cast("long")).alias("sum_int8"),
        F.get(v.bits(e), 0).alias("w0"),
        F.get(v.bits(e), 1).alias("w1"),
        F.get(v.bits(e, strict=True), 0).alias("strict0"),
    )


def _tiered() -> str:
    qn = np.asarray(QUERY)
    cut = {d: qn[:d] / np.linalg.norm(qn[:d]) for d in (64, 48, 32, 16)}
    lit = lambda a: "[" + ", ".join(repr(float(x)) for x in a) + "]::DOUBLE[]"
    bits = int("".join("1" if x >= 0 else "0" for x in cut[16]), 2)
    int8 = lit(np.trunc(np.clip(cut[32] * 127, -127, 127)))
    return f"""CASE vec_id % 4 WHEN 0 THEN list_dot_product({unit(_E, 64)}, {lit(cut[64])}) WHEN 1 THEN list_dot_product({unit(_E, 48)}, {lit(cut[48])})
      WHEN 2 THEN list_cosine_similarity(list_transform({unit(_E, 32)}, lambda x: trunc(greatest(-127.0, least(127.0, x * 127)))::DOUBLE), {int8})
      ELSE 1 - bit_count(xor({word(_E, 1, 16)}, {bits}::BIGINT)) / 16.0 END"""


@q(f"SELECT vec_id, {SQL_TIER} AS tier, round({_tiered()}, 6) AS score FROM embeddings")
def tier_scores(spark, sf_dir):
    """Similarity of every vector in its tier's form."""
    return table(spark, sf_dir, "embeddings").select("vec_id", tier().alias("tier"), F.round(vs.tier_similarity(tier(), F.col("embedding"), QUERY, TIERS), 6).alias("score"))


@q(f"SELECT vec_id, tier, round(score, 6) AS score FROM (SELECT vec_id, {SQL_TIER} AS tier, {_tiered()} AS score FROM embeddings) ORDER BY score DESC, vec_id LIMIT 15")
def tiered_search(spark, sf_dir):
    """The best of all tiers, each in its own form."""
    rows = table(spark, sf_dir, "embeddings").withColumn("tier", tier())
    return vs.tiered(rows, "vec_id", "embedding", "tier", QUERY, 15, TIERS).withColumn("score", F.round("score", 6))


def _predict() -> str:
    lit = "[" + ", ".join(map(str, QUERY)) + "]::DOUBLE[]"
    bits = int("".join("1" if x > 0 else "0" for x in QUERY[:16]), 2)
    cos = lambda d: f"list_cosine_similarity(({_E})[1:{d}], ({lit})[1:{d}])"
    return f"CASE vec_id % 4 WHEN 0 THEN {cos(64)} WHEN 1 THEN {cos(48)} WHEN 2 THEN {cos(32)} ELSE 1 - bit_count(xor({word(_E, 1, 16, '>')}, {bits}::BIGINT)) / 16.0 END"


@q(f"""
WITH s AS (SELECT vec_id, {SQL_TIER} AS tier, {_predict()} AS score FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, vec_id) AS r FROM s WHERE score >= 0.25)
SELECT vec_id, tier, round(score, 6) AS score FROM r WHERE r <= CASE tier WHEN 'hot' THEN 5 WHEN 'warm' THEN 10 WHEN 'cold' THEN 20 ELSE 50 END ORDER BY r.score DESC, vec_id LIMIT 20
""")
def predictions(spark, sf_dir):
    """Vectors likely to be needed: the best of each tier above a least similarity."""
    rows = table(spark, sf_dir, "embeddings").withColumn("tier", tier())
    return vs.predict(rows, "vec_id", "embedding", "tier", QUERY, 20, TIERS).withColumn("score", F.round("score", 6))


PLANES = vs.planes(DIMS, tables=4, per_table=6)


def _hash(p: np.ndarray, x: str = _E) -> str:
    lit = lambda a: "[" + ", ".join(repr(float(y)) for y in a) + "]::DOUBLE[]"
    return "(" + " + ".join(f"(list_dot_product({x}, {lit(row)}) > 0)::BIGINT * {1 << i}" for i, row in enumerate(p)) + ")"


@q("SELECT vec_id, " + ", ".join(f"{_hash(p)} AS bucket{i}" for i, p in enumerate(PLANES)) + " FROM embeddings")
def sign_buckets(spark, sf_dir):
    """Buckets of every vector in each table of hyperplanes."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", *(v.sign_hash(F.col("embedding"), p.tolist()).alias(f"bucket{i}") for i, p in enumerate(PLANES)))


@q(f"""
SELECT vec_id, round(list_cosine_similarity({_E}, {SQL_QUERY}), 6) AS score FROM embeddings
WHERE {" OR ".join(f"{_hash(p)} = {_hash(p, SQL_QUERY)}" for p in PLANES)} ORDER BY list_cosine_similarity({_E}, {SQL_QUERY}) DESC, vec_id LIMIT 10
""")
def sign_search(spark, sf_dir):
    """Nearest vectors among those that share a bucket with the query."""
    return vs.sign_search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY, PLANES, 10).select("vec_id", F.round("score", 6).alias("score"))


BOOK = np.random.default_rng(5).standard_normal((8, 16, 8)).round(6)


def _book() -> str:
    return "[" + ", ".join("[" + ", ".join("[" + ", ".join(map(repr, map(float, c))) + "]" for c in part) + "]" for part in BOOK) + "]::DOUBLE[][][]"


_NEAREST = "list_position(list_transform(b[i], lambda c: list_aggregate(list_transform(range(1, 9), lambda k: (e[(i - 1) * 8 + k] - c[k]) * (e[(i - 1) * 8 + k] - c[k])), 'sum')), list_min(list_transform(b[i], lambda c: list_aggregate(list_transform(range(1, 9), lambda k: (e[(i - 1) * 8 + k] - c[k]) * (e[(i - 1) * 8 + k] - c[k])), 'sum')))) - 1"


@q(f"SELECT vec_id, list_aggregate(list_transform(range(1, 9), lambda i: {_NEAREST}), 'string_agg', ',') AS codes FROM (SELECT vec_id, {_E} AS e, {_book()} AS b FROM embeddings)")
def product_codes(spark, sf_dir):
    """Product-quantisation codes of every vector for a fixed codebook."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(vs.encode(F.col("embedding"), BOOK), ",").alias("codes"))


@q(f"""
WITH c AS (SELECT vec_id, b, list_transform(range(1, 9), lambda i: {_NEAREST}) AS codes FROM (SELECT vec_id, {_E} AS e, {_book()} AS b FROM embeddings)),
d AS (SELECT vec_id, list_aggregate(list_transform(range(1, 9), lambda i: list_aggregate(list_transform(range(1, 9), lambda k: pow(b[i][codes[i] + 1][k] - ({SQL_QUERY})[(i - 1) * 8 + k], 2)), 'sum')), 'sum') AS distance FROM c)
SELECT vec_id, round(distance, 6) AS distance FROM d ORDER BY d.distance, vec_id LIMIT 10
""")
def product_search(spark, sf_dir):
    """Nearest vectors by their codes."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vs.encode(F.col("embedding"), BOOK).alias("codes"))
    return vs.product_search(rows, "vec_id", "codes", QUERY, BOOK, 10).select("vec_id", F.round("distance", 6).alias("distance"))


_QW = [int("".join("1" if x > 0 else "0" for x in QUERY[i : i + 32]), 2) for i in (0, 32)]


@q(f"""SELECT vec_id, (bit_count(xor({word(_E, 1, 32, ">")}, {_QW[0]}::BIGINT)) + bit_count(xor({word(_E, 33, 64, ">")}, {_QW[1]}::BIGINT)))::INT AS distance FROM embeddings ORDER BY 2, 1 LIMIT 10""")
def bit_search(spark, sf_dir):
    """Vectors that differ in the fewest signs."""
    return vs.bit_search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY, 10).select("vec_id", F.col("distance").cast("int").alias("distance"))


@q()
def trained_codebook(spark, sf_dir):
    """Codes after k-means on the vectors themselves, and how far decoding is off."""
    rows = table(spark, sf_dir, "embeddings")
    book = vs.codebook(rows, "embedding", 4, 8)
    codes = vs.encode(F.col("embedding"), book)
    return rows.select("vec_id", F.array_join(codes, ",").alias("codes"), v.squared(F.col("embedding"), vs.decode(codes, book)).alias("error"))


_PAIR = f"list_cosine_similarity(a.{_E}, b.{_E})"


@q(f"SELECT a.vec_id, b.vec_id AS other, round({_PAIR}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_PAIR} > 0.2")
def label_pairs(spark, sf_dir):
    """All pairs of similar vectors of the same label."""
    pairs = vs.label_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 0.2)
    return pairs.select(F.col("a").alias("vec_id"), F.col("b").alias("other"), F.round("score", 6).alias("score"))


def _cut_cosine() -> str:
    return " ".join(f"WHEN {i} THEN list_cosine_similarity(({_E})[1:{d}], ({SQL_QUERY})[1:{d}])" for i, (d, _) in enumerate(TIERS.values()))


@q(f"SELECT vec_id, {SQL_TIER} AS tier, round(CASE vec_id % 4 {_cut_cosine()} END, 5) AS score FROM embeddings ORDER BY CASE vec_id % 4 {_cut_cosine()} END DESC, vec_id LIMIT 10")
def graph_search(spark, sf_dir):
    """The ten nearest vectors by small-world graphs of each tier; here these find the exact answer."""
    index = vs.graph_index(table(spark, sf_dir, "embeddings").withColumn("tier", tier()), "vec_id", "embedding", "tier", TIERS)
    return vs.graph_search(index, QUERY, 10, tiers=TIERS).select(F.col("id").alias("vec_id"), "tier", F.round("score", 5).alias("score"))
