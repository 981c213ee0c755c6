"""Co-recall and keyword graphs, edge weights and spreading activation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberleaf.sources.tables import stored

MIN_RECALLS, PPMI_MOST = 3, 10.0
BUCKET, NEIGHBOURS, SESSION = 200, 100, 1000
DECAY, LEAST = 0.7, 0.01
#: Keywords of a block of rows, of which every two blocks meet in one task.
BLOCK_WORDS = 2_000_000


def sessions_limited(log: DataFrame, session: str, item: str, most: int = SESSION) -> DataFrame:
    """Distinct items of each session, the first ``most`` of them by order: the length of a session's buffer."""
    one = log.select(session, item).distinct()
    return one.withColumn("r", F.row_number().over(W.partitionBy(session).orderBy(item))).where(F.col("r") <= most).drop("r")


def co_recalls(log: DataFrame, session: str, item: str) -> DataFrame:
    """``a`` < ``b`` and ``n_ab``, the number of sessions that hold both."""
    rows = sessions_limited(log, session, item)
    a, b = rows.select(session, F.col(item).alias("a")), rows.select(session, F.col(item).alias("b"))
    return a.join(b, session).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_ab"))


def recalls(log: DataFrame, session: str, item: str, distinct_sessions: bool = False) -> DataFrame:
    """``n_a``: accesses of each item, or sessions with it."""
    return log.groupBy(F.col(item).alias("id")).agg((F.count_distinct(session) if distinct_sessions else F.count("*")).alias("n_a"))


def keyword_edges(sets: DataFrame, key: str, keywords: str, least: float = 0.1, bucket: int = BUCKET) -> DataFrame:
    """Pairs that share a keyword held by at most ``bucket`` rows, with the Jaccard similarity of their whole sets if it is ``least`` or more.

    Keywords become numbers. Rows are dealt by a hash of the key into blocks of about BLOCK_WORDS keywords, every two of which meet in a
    task of their own; pairs are found and measured there and no candidate moves.
    """
    rows = stored(sets.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.explode(F.array_distinct(keywords)).alias("w")))
    words = stored(rows.groupBy("w").agg(F.count("*").alias("n")).withColumn("no", F.monotonically_increasing_id()))
    total = words.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS), min(8, -(-10 * total // BLOCK_WORDS)))  # a smaller table is cut for as many tasks
    # rare keywords have numbers from 0, others from -1 down
    coded = words.select("w", F.when(F.col("n").between(2, bucket), F.col("no")).otherwise(-1 - F.col("no")).alias("no"))
    own = rows.join(coded, "w").groupBy("id").agg(F.collect_list("no").alias("k")).withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "own", "k")
    kind = sets.schema[key].dataType.simpleString()
    return met.groupBy("i", "j").applyInArrow(_overlaps(least), f"a {kind}, b {kind}, overlap double")


def _overlaps(least: float):
    def run(key, table):
        i, j = key[0].as_py(), key[1].as_py()
        own, ids, k = table["own"].to_numpy(), table["id"].combine_chunks(), table["k"].combine_chunks()
        value = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        size = k.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        numbers, code = np.unique(k.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        rare = numbers[code] >= 0
        row = np.repeat(np.arange(len(own)), size)
        left, right = own == i, own == j
        # of each rare keyword the rows of the right block
        at = np.flatnonzero(rare & right[row])
        at = at[np.argsort(code[at], kind="stable")]
        first = np.searchsorted(code[at], np.arange(len(numbers) + 1))
        holders, mark = row[at], np.zeros(len(numbers), bool)
        a, b, s = [], [], []
        for x in np.flatnonzero(left):
            mine = code[off[x] : off[x + 1]]
            near = [holders[first[c] : first[c + 1]] for c in mine[rare[off[x] : off[x + 1]]]]
            near = np.unique(np.concatenate(near)) if near else np.zeros(0, np.int64)
            # within one block each pair is met from both sides
            near = near[value[near] > value[x]] if i == j else near[near != x]
            near = near[np.minimum(size[near], size[x]) >= least * np.maximum(size[near], size[x])]
            mark[mine] = True
            for lo in range(0, len(near), 4096):
                part = near[lo : lo + 4096]
                ends = np.cumsum(size[part])
                every = np.arange(ends[-1]) + np.repeat(off[part] - ends + size[part], size[part])
                both = np.add.reduceat(mark[code[every]].astype(np.int64), ends - size[part])
                score = both / (size[part] + size[x] - both)
                ok = score >= least
                a.append(np.full(int(ok.sum()), x))
                b.append(part[ok])
                s.append(score[ok])
            mark[mine] = False
        a, b, s = (np.concatenate(v) if v else np.zeros(0, kind) for v, kind in ((a, np.int64), (b, np.int64), (s, float)))
        swap = value[a] > value[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "overlap": s})

    return run


def weight(n_ab: Column, n_a: Column, n_b: Column, sessions: Column, overlap: Column) -> Column:
    """Positive pointwise mutual information of three and more co-recalls, joined with keyword overlap."""
    ppmi = F.greatest(F.lit(0.0), F.log2(n_ab * F.greatest(sessions, F.lit(1)) / (F.coalesce(n_a, F.lit(1)) * F.coalesce(n_b, F.lit(1)))))
    p = F.when(n_ab >= MIN_RECALLS, F.least(ppmi / PPMI_MOST, F.lit(1.0))).otherwise(0.0)
    return F.when((p > 0) & (overlap > 0), 0.6 * p + 0.4 * overlap).when(p > 0, p).otherwise(overlap)


def graph(log: DataFrame, session: str, item: str, overlaps: DataFrame | None = None, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Directed edges ``src``, ``dst``, ``n_ab``, ``overlap`` and ``weight``; each node keeps its ``neighbours`` heaviest."""
    pairs = co_recalls(log, session, item)
    if overlaps is not None:
        pairs = pairs.join(overlaps, ["a", "b"], "full")
    else:
        pairs = pairs.withColumn("overlap", F.lit(0.0))
    n = recalls(log, session, item)
    total = log.select(session).distinct().count()
    rows = pairs.join(n.select(F.col("id").alias("a"), F.col("n_a").alias("na")), "a", "left").join(n.select(F.col("id").alias("b"), F.col("n_a").alias("nb")), "b", "left")
    w = weight(F.coalesce("n_ab", F.lit(0)), F.col("na"), F.col("nb"), F.lit(total), F.coalesce("overlap", F.lit(0.0)))
    one = rows.select("a", "b", F.coalesce("n_ab", F.lit(0)).alias("n_ab"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"), w.alias("weight"))
    both = one.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "n_ab", "overlap", "weight").select("e.*", "n_ab", "overlap", "weight")
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return both.withColumn("r", rank).where(F.col("r") <= neighbours).drop("r")


def activate(edges: DataFrame, seeds: DataFrame, depth: int = 2, k: int = 20) -> DataFrame:
    """The ``k`` nodes most activated from each of ``seeds`` (``seed``), without the seed itself.

    Each hop multiplies by the weight and 0.7 to the power of hops before; only nodes that
    improve spread further. Hops are joins on ``src``, three at most.
    """
    front = seeds.select("seed", F.col("seed").alias("id"), F.lit(1.0).alias("act"))
    best = front
    step = edges.select("src", "dst", "weight")
    for d in range(min(depth, 3)):
        spread = front.join(step, front["id"] == step["src"]).select("seed", F.col("dst").alias("id"), (F.col("act") * F.col("weight") * DECAY**d).alias("act"))
        new = spread.where(F.col("act") >= LEAST).groupBy("seed", "id").agg(F.max("act").alias("act"))
        old = best.withColumnRenamed("act", "old")
        front = new.join(old, ["seed", "id"], "left").where("old is null or act > old").select("seed", "id", "act")
        best = best.unionByName(front).groupBy("seed", "id").agg(F.max("act").alias("act"))
    rank = F.row_number().over(W.partitionBy("seed").orderBy(F.desc("act"), "id"))
    return best.where("id <> seed").withColumn("rank", rank).where(F.col("rank") <= k).select("seed", "id", "act", "rank")


def stats(edges: DataFrame, log: DataFrame, session: str) -> DataFrame:
    """Nodes, directed edges, sessions and recalls."""
    e = edges.agg(F.count("*").alias("edges"), F.count_distinct("src").alias("nodes"))
    return e.crossJoin(F.broadcast(log.agg(F.count_distinct(session).alias("sessions"), F.count("*").alias("recalls"))))


def save(edges: DataFrame, path: str) -> None:
    """Edges as a table clustered by ``src``, so that a hop reads few row groups; overlaps are held within 0 and 1."""
    rows = edges.withColumn("overlap", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("overlap"))))
    rows.repartitionByRange("src").sortWithinPartitions("src").write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
