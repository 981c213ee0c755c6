"""Merkle trees over content hashes: root, proofs and their verification.

Leaf and inner hashes are SHA-256 with a one-byte prefix; leaves are padded by a block of zeros to a power of
two, at least two. All nodes come level by level, each one aggregation of the one below by ``idx / 2``; the root alone folds
eight levels in each aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberleaf.functions.hashes import sha2_256
from emberleaf.functions.text import let
from emberleaf.sources.tables import stored

ZERO = "0" * 64


def leaf(content_hash: Column, digest=sha2_256) -> Column:
    """The hash of a leaf; ``digest`` makes hexadecimal digests of binary values."""
    return digest(F.unhex(F.concat(F.lit("00"), content_hash)))


def node(left: Column, right: Column, digest=sha2_256) -> Column:
    return digest(F.unhex(F.concat(F.lit("01"), left, right)))


def leaves(df: DataFrame, content_hash: str, order: str, digest=sha2_256) -> DataFrame:
    """``idx`` from 0 and leaf ``hash`` in order of a unique column.

    Rows are range-partitioned, numbered within partitions and shifted by the sizes of those before.
    """
    return numbered(df, content_hash, order, digest).select("idx", "hash")


def numbered(df: DataFrame, content_hash: str, order: str, digest=sha2_256) -> DataFrame:
    """``leaves`` with their ``order`` column.

    Ranges come of a sample and differ from run to run, so rows are stored with the number of their partition before they are counted.
    """
    rows = stored(df.select(F.col(order).alias("o"), leaf(F.col(content_hash), digest).alias("hash")).repartitionByRange("o").withColumn("p", F.spark_partition_id()))
    sizes = rows.groupBy("p").agg(F.count("*").alias("n"))
    start = sizes.select("p", (F.sum("n").over(W.orderBy("p")) - F.col("n")).alias("start"))  # a row for each partition
    within = F.row_number().over(W.partitionBy("p").orderBy("o")) - 1
    return rows.withColumn("i", within).join(F.broadcast(start), "p").select(F.col("o").alias(order), (F.col("start") + F.col("i")).cast("long").alias("idx"), "hash")


def depth(n: int) -> int:
    """Levels above the leaves."""
    return max(1, (n - 1).bit_length())


def _pad(level: int, digest=sha2_256) -> Column:
    """The hash of a subtree of ``level`` levels that holds padding alone."""
    out = F.lit(ZERO)
    for _ in range(level):
        out = node(out, out, digest)
    return out


def next_level(level: DataFrame, height: int, digest=sha2_256) -> DataFrame:
    """Parents of the nodes of ``level``, whose own height is ``height``."""
    side = lambda bit: F.max(F.when(F.col("idx") % 2 == bit, F.col("hash")))
    pairs = level.groupBy(F.floor(F.col("idx") / 2).alias("idx")).agg(side(0).alias("l"), side(1).alias("r"))
    return pairs.select("idx", node(F.col("l"), F.coalesce("r", _pad(height, digest)), digest).alias("hash"))


def levels(leaf_rows: DataFrame, n: int) -> DataFrame:
    """All nodes as ``level``, ``idx`` and ``hash``; ``n`` is the number of leaves."""
    at = leaf_rows.select("idx", "hash")
    out = at.withColumn("level", F.lit(0))
    for h in range(depth(n)):
        at = next_level(at, h)
        out = out.unionByName(at.withColumn("level", F.lit(h + 1)))
    return out


#: Levels that one aggregation folds, so a group has at most 2^FOLD nodes.
FOLD = 8


def fold(level: DataFrame, height: int, steps: int, digest=sha2_256) -> DataFrame:
    """The nodes ``steps`` levels above those of ``level``, whose own height is ``height``, by one aggregation."""
    width = 1 << steps
    place = (F.col("idx") % width).cast("int")
    groups = level.groupBy(F.floor(F.col("idx") / width).alias("idx")).agg(F.map_from_entries(F.collect_list(F.struct(place, "hash"))).alias("own"))
    nodes = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at(F.col("own"), i), _pad(height, digest)))

    def parents(a: Column) -> Column:
        return F.transform(F.filter(a, lambda x, i: i % 2 == 0), lambda x, i: node(x, F.get(a, 2 * i + 1), digest))

    for _ in range(steps):
        nodes = let(nodes, parents)
    return groups.select("idx", F.get(nodes, F.lit(0)).alias("hash"))


def root(leaf_rows: DataFrame, n: int, digest=sha2_256) -> DataFrame:
    """One row: the root ``hash`` of ``n`` leaves, FOLD levels by each aggregation, or one by each if ``digest`` is none of Catalyst's own."""
    at, d = leaf_rows.select("idx", "hash"), depth(n)
    most = FOLD if digest is sha2_256 else 1
    for h in range(0, d, most):
        at = fold(at, h, most if h + most <= d else d - h, digest) if most > 1 else next_level(at, h, digest)
    return at.select("hash")


def proof(leaf_rows: DataFrame, n: int, idx: int) -> DataFrame:
    """The sibling at each level with the side on which it stands."""
    want = [(h, (idx >> h) ^ 1) for h in range(depth(n))]
    hit = F.lit(False)
    for h, i in want:
        hit |= (F.col("level") == h) & (F.col("idx") == i)
    nodes = levels(leaf_rows, n).where(hit).select("level", "hash")
    spark = leaf_rows.sparkSession
    steps = spark.range(depth(n)).select(F.col("id").cast("int").alias("level"))
    side = F.lit(None).cast("string")
    for h in range(depth(n)):
        side = F.when(F.col("level") == h, "left" if idx >> h & 1 else "right").otherwise(side)
    pads = F.array(*(_pad(h) for h in range(depth(n))))
    return steps.join(nodes, "level", "left").select("level", F.coalesce("hash", F.get(pads, F.col("level"))).alias("sibling"), side.alias("side"))


def verify(leaf_hash: Column, siblings: Column, root_hash: Column) -> Column:
    """Whether folding an array of (sibling, side) onto a leaf gives the root."""
    step = lambda acc, s: F.when(s["side"] == "right", node(acc, s["sibling"])).otherwise(node(s["sibling"], acc))
    return F.aggregate(siblings, leaf_hash, step) == root_hash
