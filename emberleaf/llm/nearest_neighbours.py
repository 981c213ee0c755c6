"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are dealt to shards by a hash; each shard is one task's graph. A row's neighbours are proposed by
a greedy search from the shard's medoid and thinned by relaxed distance pruning, which keeps
diverse and some long edges; a second pass relaxes more. Every query is searched in every shard by a beam, and
the best of all shards are measured again in double precision. Of each block of queries some are compared with the
whole shard; beams widen until these find RECALL of their neighbours, at last to the whole shard. Equal vectors are one
row of the index that stands for its smallest ids, as many as a query may ask.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberleaf.functions.proximity import BATCH, beam, connect, distances, insert
from emberleaf.llm._proximity import cheaper_exactly, shards, slices, vectors
from emberleaf.llm._spark import stored

#: Least number of shards, and bytes of the vectors of one shard and of one block of queries.
SHARDS, SHARD_BYTES, QUERY_BYTES = 8, 64 << 20, 16 << 20
DEGREE, BUILD, WIDTH = 32, 64, 192
ALPHA = 1.2
#: Queries of a block that are compared with the whole shard, and the share of their neighbours that beams must find.
AUDIT, RECALL = 64, 0.97
SALT = 64
#: Times a shard's own size at which a query counts as infinitely far.
FAR = 1e6


class Graph:
    """A robust-pruned directed graph over the rows of ``x``."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.norms = x, (x * x).sum(1)
        self.medoid = int(((x - x.mean(0)) ** 2).sum(1).argmin())
        self.graph = np.full((len(x), DEGREE), -1, np.int32)
        rows = np.random.default_rng(0).permutation(len(x))
        rows = np.concatenate([[self.medoid], rows[rows != self.medoid]])
        for alpha in (1.0, ALPHA):
            insert(x, self.norms, self.graph, rows, self.entry, BUILD, alpha * alpha)
        self.graph = connect(x, self.norms, self.graph, rows, self.medoid)

    def entry(self, own: np.ndarray) -> np.ndarray:
        return np.full((len(own), 1), self.medoid, np.int64)

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """The rows found nearest to each query, nearest first, -1 after the last; all rows compared if a beam costs as much."""
        size = len(self.x)
        if width < size and not (width > WIDTH and cheaper_exactly(width, DEGREE, size)):
            return np.concatenate([beam(self.x, self.norms, self.graph, q[i : i + BATCH], self.entry(q[i : i + BATCH]), width)[0] for i in range(0, len(q), BATCH)])
        return self.exact(q, min(width, size))

    def exact(self, q: np.ndarray, width: int) -> np.ndarray:
        """The ``width`` nearest rows of each query, by all distances."""
        out = np.empty((len(q), width), np.int64)
        for part in slices(len(q), len(self.x)):
            d = self.norms - 2 * q[part] @ self.x.T
            top = np.argpartition(d, width - 1, 1)[:, :width]
            out[part] = np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), 1, kind="stable"), 1)
        return out

    def audited(self, q: np.ndarray, k: int, width: int) -> int:
        """The least width, ``width`` doubled as often as need be, at which RECALL of the ``k`` nearest rows of a sample of ``q`` are found."""
        own = q[np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))]
        k = min(k, len(self.x))
        far = distances(self.x, self.norms, self.exact(own, k), own).max(1)
        far += 1e-5 * (np.abs(far) + (own * own).sum(1))  # rows as near as the last one are as good
        while width < len(self.x):
            found = self.search(own, width)[:, :k]
            near = (found >= 0) & (distances(self.x, self.norms, found, own) <= far[:, None])
            if near.sum() >= RECALL * near.size:
                break
            width *= 2
        return width


def _matrix(col: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.asarray(col.combine_chunks().flatten()).reshape(n, -1)


def _framed(q: np.ndarray, middle: np.ndarray, scale: float) -> np.ndarray:
    """Queries in a shard's frame; of one too far away for single precision the direction."""
    unit = np.maximum(np.abs(q).max(1, keepdims=True), scale)
    out = q / unit - middle / unit
    long = unit / scale
    return (out * np.minimum(long, FAR)).astype(np.float32)


def _far(diff: np.ndarray) -> np.ndarray:
    """Lengths of rows, also of such whose squares overflow or vanish."""
    with np.errstate(over="ignore", under="ignore"):
        d = np.sqrt((diff * diff).sum(1))
    odd = ~np.isfinite(d) | (d < 1e-150)
    if odd.any():
        most = np.maximum(np.abs(diff[odd]).max(1), np.finfo(float).tiny)
        d[odd] = most * np.sqrt(((diff[odd] / most[:, None]) ** 2).sum(1))
    return d


def _build(key, table):
    table = table.sort_by("rep")
    v = _matrix(table["v"], len(table))
    scale = np.abs(v).max()
    middle = (v / scale).mean(0) * scale
    data = pickle.dumps((table["ids"].combine_chunks().to_pylist(), v, middle, scale, Graph(((v - middle) / scale).astype(np.float32))))
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})


def _search(k: int, width: int):
    def run(_key, left, right):
        out: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            ids, v, middle, scale, index = pickle.loads(left["data"][0].as_py())
            right = right.sort_by("id")
            q = _matrix(right["v"], len(right))
            framed = _framed(q, middle, scale)
            found = index.search(framed, index.audited(framed, k + 1, max(width, 2 * k)))
            for i, (own, row) in enumerate(zip(right["id"].to_pylist(), found, strict=True)):
                row = row[row >= 0]
                d = _far(v[row] - q[i])
                best = [(float(x), y) for x, r in zip(d, row, strict=True) for y in ids[r] if y != own]
                out += [(own, y, x) for x, y in sorted(best)[:k]]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"q": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "d": pa.array(c, pa.float64())})

    return run


def search(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, width: int = WIDTH) -> DataFrame:
    """``query_id``, ``rank`` from 1, id and ``score``, the Euclidean distance, of the ``k`` nearest rows found for each row in ``queries``.

    ``queries`` is a condition on ``id``. All usable rows are indexed; a row is no candidate of its own query. Ties go to the smaller id. Vectors that are
    null, zero or hold a null or non-finite component take no part, nor do rows with a null id;
    vectors of another length are no candidates. Of rows that repeat an id one counts. An empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    rows = vectors(df.where(F.col(key).isNotNull()), key, vector).where("dim is not null").dropDuplicates(["id"])
    rows = stored(rows)
    kept = rows.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALT)))
    for by in (["dim", "h1", "h2", "salt"], ["dim", "h1", "h2"]):  # the smallest ids of equal vectors, in two steps
        kept = kept.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("id"))).where(F.col("r") <= k + 1)
    one = stored(kept.groupBy("dim", "h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("v").alias("v")))
    number = shards(8 * (one.agg(F.sum("dim")).first()[0] or 0), SHARDS, SHARD_BYTES)
    index = stored(one.select("dim", F.pmod("h1", F.lit(number)).cast("int").alias("shard"), F.col("ids")[0].alias("rep"), "ids", "v").groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, data binary"))
    asked = rows.where(queries).select("dim", "id", "v", "h2")
    parts = shards(8 * (asked.agg(F.sum("dim")).first()[0] or 0), 1, QUERY_BYTES)
    by = ["dim", "shard", "part"]
    every = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.withColumn("part", F.pmod("h2", F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    found = every.select(*by, "data").groupBy(*by).cogroup(asked.select(*by, "id", "v").groupBy(*by)).applyInArrow(_search(k, width), "q long, id long, d double")
    rank = F.row_number().over(W.partitionBy("q").orderBy("d", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", F.col("id").alias(key), F.col("d").alias("score"))
