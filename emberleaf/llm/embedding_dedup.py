"""Near-duplicate embeddings by hierarchical navigable small-world graphs per shard.

Equal vectors are one. Vectors are dealt to shards of bounded bytes by a hash; each shard is one task's graph of layers. Of each two
shards one is searched for all vectors of the other, and each for its own: from the top layer greedily down, then by a beam in the
lowest layer. A beam that holds links only is widened, at last to the whole shard, as soon as comparing all its rows costs no more.

Two audits set the width of beams, which doubles until neither misses a link. When a graph is built it must find rows
from queries made at all cosines from the threshold up, so an audit has links however few the
data have; and of each block of queries a sample is compared with the whole shard. Links near the threshold are
measured in double precision. A task sends counts and the stars of its links, never pairs.

Rows and graphs are stored and moved in pieces of PIECE bytes. A task holds one shard and one block of queries, whatever the
table's size; shards are searched in rounds, so that the shuffle files of one round are about twice the table at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberleaf.functions.proximity import BATCH, Layers
from emberleaf.llm._graph import components, smallest
from emberleaf.llm._proximity import cheaper_exactly, shards, slices, vectors
from emberleaf.llm._skew import spread
from emberleaf.llm._spark import NULL_ID, bounded, dropped, stored, trimmed

THRESHOLD = 0.95
#: Least number of shards, bytes of the vectors and graph of one shard, of these a row's beside its vector, and bytes of the vectors of one block of queries.
SHARDS, SHARD_BYTES, ROW_BYTES, QUERY_BYTES = 8, 96 << 20, 256, 16 << 20
#: Bytes of a piece; shards that one task asks at most; shards searched in a round, as many at least and more up to so many bytes of vectors.
PIECE, AHEAD, ROUND, ROUND_BYTES = 128 << 10, 4, 4, 1 << 30
DEGREE, BUILD, WIDTH = 24, 48, 32
#: Queries made for the audit of a graph, and queries of a block that are compared with the whole shard.
PLANTED, AUDIT = 256, 48
#: Links that are taken at a time, those that a task holds before it shrinks them to stars, and bytes of vectors measured in double precision at a time.
PAIRS, HELD, NEAR_BYTES = 1 << 18, 1 << 19, 4 << 20


def margin(dim: int) -> float:
    """How far a cosine in single precision may be off."""
    return 2.0**-22 * (dim + 16)


def within(index: Layers, q: np.ndarray, low: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (query, row) found by beams of ``width`` and more, with single-precision cosines of at least ``low``, of unit vectors.

    A beam that has been widened gives way to all rows of the shard once comparing these costs no more. About PAIRS at a time, or those of one query.
    """
    size = len(index.x)
    full = []
    exact = width >= size or (width > WIDTH and cheaper_exactly(width, DEGREE, size))
    for lo in range(0, 0 if exact else len(q), BATCH):
        ids, d = index.search(q[lo : lo + BATCH], width)
        hit = d <= 1 - 2 * low
        more = hit.all(1)
        full.append(np.flatnonzero(more) + lo)
        hit[more] = False
        r, c = np.nonzero(hit)
        yield r + lo, ids[r, c], (1 - d[r, c]) / 2
    todo = np.arange(len(q)) if exact else np.concatenate([*full, np.zeros(0, np.int64)])
    if not exact and len(todo) and not cheaper_exactly(4 * width, DEGREE, size):
        for r, c, cos in within(index, q[todo], low, 4 * width):
            yield todo[r], c, cos
        return
    for part in slices(len(todo), size):
        cos = q[todo[part]] @ index.x.T
        hit = cos >= low
        ends = np.cumsum(hit.sum(1))
        lo = 0
        while lo < len(hit):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            r, c = np.nonzero(hit[lo:hi])
            yield todo[part][r + lo], c, cos[r + lo, c]
            lo = hi


def complete(index: Layers, q: np.ndarray, low: float, sure: float, width: int) -> int:
    """The least width, ``width`` doubled as often as need be, at which all links of ``q`` of a cosine ``sure`` are found among those of ``low``.

    Between the two lie links that rounding may find or not.
    """
    size = len(index.x)

    def missed(some: np.ndarray) -> bool:
        left = some @ index.x.T >= sure
        for r, c, _ in within(index, some, low, width):
            left[r, c] = False
        return bool(left.any())

    while width < size and any(missed(q[part]) for part in slices(len(q), size)):
        width *= 2
    return width


def planted(x: np.ndarray, low: float) -> np.ndarray:
    """Unit vectors at cosines from ``low`` to 1 to rows of ``x``."""
    rng = np.random.default_rng(2)
    own = x[np.unique(np.linspace(0, len(x) - 1, min(PLANTED, len(x))).astype(int))]
    c = low + (1 - low) * rng.random((len(own), 1))
    away = rng.standard_normal(own.shape)
    away -= (away * own).sum(1, keepdims=True) * own
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-30)
    return _unit(c * own + np.sqrt(1 - c * c) * away)


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows in double precision with a greatest component of 1, whose squares neither overflow nor vanish."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v


def _units(v: np.ndarray) -> np.ndarray:
    out = np.empty(v.shape, np.float32)
    for lo in range(0, len(v), BATCH):
        out[lo : lo + BATCH] = _unit(_scaled(v[lo : lo + BATCH]))
    return out


def _short(v: np.ndarray) -> np.ndarray:
    """``v`` in single precision if that loses nothing."""
    with np.errstate(over="ignore", under="ignore"):
        out = v.astype(np.float32)
    return out if (out == v).all() else v


def _restored(x: np.ndarray, graphs: list[np.ndarray]) -> Layers:
    """The index over ``x``, rows of higher layers first, that has ``graphs``."""
    out = Layers.__new__(Layers)
    out.x, out.norms, out.rows, out.graphs, out.tops = x, (x * x).sum(1), np.arange(len(x)), graphs, len(graphs) - 1
    return out


#: Kinds of pieces, in the order in which a task needs them: the rows of its shard, its graphs, queries.
ROWS, GRAPH, QUERIES = range(3)
PACKED = "dim int, shard int, kind int, seq int, data binary"
#: Parquet is to look at a table of pieces after each few and to keep its groups small, which are read as a whole.
SMALL = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "8"}


def _cut(tag: int, *columns: np.ndarray) -> Iterator[bytes]:
    """Arrays of one length, the last a matrix, in pieces: a head of ``tag``, first row, rows in all, rows of the piece, and width and bytes of a component of the matrix; then the arrays."""
    last = columns[-1]
    step = max(1, PIECE // sum(x[:1].nbytes for x in columns))
    for lo in range(0, len(last), step):
        part = [np.ascontiguousarray(x[lo : lo + step]) for x in columns]
        head = np.array([tag, lo, len(last), len(part[-1]), last.shape[1], last.itemsize], np.int64)
        yield b"".join(x.tobytes() for x in (head, *part))


def _rows(data: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, copies and vectors of a piece of rows."""
    _, _, _, n, dim, bytes_ = np.frombuffer(data, np.int64, 6).tolist()
    ids, copies = np.frombuffer(data, np.int64, n, 48), np.frombuffer(data, np.int64, n, 48 + 8 * n)
    return ids, copies, np.frombuffer(data, np.float32 if bytes_ == 4 else np.float64, n * dim, 48 + 16 * n).reshape(n, dim)


def _graph(data: pa.Buffer) -> tuple[np.ndarray]:
    _, _, _, n, columns, _ = np.frombuffer(data, np.int64, 6).tolist()
    return (np.frombuffer(data, np.int32, n * columns, 48).reshape(n, columns),)


def _joined(pieces: Iterator[pa.Buffer], opened) -> dict[int, tuple[np.ndarray, ...]]:
    """The arrays of all pieces by tag."""
    out: dict[int, tuple[np.ndarray, ...]] = {}
    for data in pieces:
        tag, lo, total, n, _, _ = np.frombuffer(data, np.int64, 6).tolist()
        part = opened(data)
        for whole, x in zip(out.setdefault(tag, tuple(np.empty((total, *x.shape[1:]), x.dtype) for x in part)), part, strict=True):
            whole[lo : lo + n] = x
    return out


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Stretches of rows of equal ``keys``, of each batch."""
    for b in batches:
        if b.num_rows:
            k = np.stack([b.column(x).to_numpy() for x in keys])
            ends = [*(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                yield tuple(k[:, lo].tolist()), b.slice(lo, hi - lo)


def _build(threshold: float):
    """Rows by shard and length, in order, to the pieces of each index."""

    def pieces(dim: int, parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        held = [(b.column("id").to_numpy(), b.column("copies").to_numpy(), _short(np.asarray(b.column("v").flatten()).reshape(-1, dim))) for b in parts]
        ids, copies, v = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        index = Layers(_units(v), DEGREE, BUILD)
        width = complete(index, planted(index.x, threshold), threshold - margin(dim), threshold + margin(dim), WIDTH)
        order, graphs = index.rows, index.graphs
        del index
        place = np.append(np.argsort(order), -1).astype(np.int32)
        for k, graph in enumerate(graphs):  # of the rows of higher layers, which come first, a layer's own
            linked = np.concatenate([place[:-1][(graph >= 0).any(1)], place[graph].max(1)])
            n = len(order) if k == len(graphs) - 1 else int(linked.max()) + 1
            yield from ((GRAPH, data) for data in _cut(k, place[graph[order[: max(1, n)]]]))
        yield from ((ROWS, data) for data in _cut(width, ids[order], copies[order], v[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, dim), parts in groupby(_runs(batches, "shard", "dim"), lambda x: x[0]):
            for seq, (kind, data) in enumerate(pieces(dim, (b for _, b in parts))):
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (dim, shard, kind, seq)), pa.array([data], pa.binary())], names=["dim", "shard", "kind", "seq", "data"])

    return trimmed(run)


def _found(ids: np.ndarray, links: np.ndarray, stars: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Counts of links, and the stars."""
    at = np.flatnonzero(links)
    node, root = smallest(*map(np.concatenate, zip(*stars, strict=True))) if stars else (ids[:0], ids[:0])
    n = np.concatenate([links[at].astype(np.int64), np.zeros(len(node), np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([ids[at], node]), n, np.concatenate([ids[at], root]))], names=["id", "n", "root"])


def _ask(threshold: float, index: Layers, width: int, own: tuple[np.ndarray, ...], block: tuple[np.ndarray, ...], back: np.ndarray | None = None) -> pa.RecordBatch:
    """Links of a block of queries to the rows of an index; ``back`` gets the counts of these rows, if the queries are of another shard."""
    (ids, copies, v), (qid, times, q) = own, block
    unit, off = _units(q), margin(q.shape[1])
    low = threshold - off
    probe = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    width = complete(index, unit[probe], low, threshold + off, width)
    links, held, stars = np.zeros(len(q)), 0, []
    step = max(1, NEAR_BYTES // (8 * q.shape[1]))
    for a, b, cos in within(index, unit, low, width):
        near = np.flatnonzero(cos < threshold + off)
        ok = qid[a] != ids[b]
        for lo in range(0, len(near), step):
            at = near[lo : lo + step]
            x, y = _scaled(q[a[at]]), _scaled(v[b[at]])
            ok[at] &= (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= threshold
        a, b = a[ok], b[ok]
        links += np.bincount(a, copies[b], len(q))
        if back is not None:
            back += np.bincount(b, times[a], len(back))
        stars.append((qid[a], ids[b]))
        held += len(a)
        if held > HELD:
            stars = [smallest(*map(np.concatenate, zip(*stars, strict=True)))]
            held = 0
    return _found(qid, links, stars)


def _search(threshold: float, parts: int):
    """Pieces by task and length, in order, to counts and stars of the links found; the first of each ``parts`` tasks asks for the shard's own rows too."""

    def links(first: bool, dim: int, pieces: Iterator[tuple[int, pa.Buffer]]) -> Iterator[pa.RecordBatch]:
        most, own, block = max(1, QUERY_BYTES // (8 * dim)), None, []
        for kind, some in groupby(pieces, lambda x: x[0]):
            data = (x for _, x in some)
            if kind == ROWS:
                ((width, own),) = _joined(data, _rows).items()
            elif kind == GRAPH:
                index = _restored(_units(own[2]), [g for _, (g,) in sorted(_joined(data, _graph).items())])
                back = np.zeros(len(own[0]))
                for lo in range(0, len(back) if first else 0, most):
                    yield _ask(threshold, index, width, own, tuple(x[lo : lo + most] for x in own))
            elif own:
                for x in data:
                    block.append(_rows(x))
                    if sum(len(x[0]) for x in block) >= most:
                        yield _ask(threshold, index, width, own, tuple(map(np.concatenate, zip(*block, strict=True))), back)
                        block = []
        if block:
            yield _ask(threshold, index, width, own, tuple(map(np.concatenate, zip(*block, strict=True))), back)
        if own:
            yield _found(own[0], back, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (task, dim), some in groupby(_runs(batches, "task", "dim", "kind"), lambda x: x[0][:2]):
            yield from links(task % parts == 0, dim, ((key[2], x.as_buffer()) for key, b in some for x in b.column("data")))

    return trimmed(run)


def _links(packed: DataFrame, number: int, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Counts (id, n) and stars (id, root) of all links of ``number`` shards of ``size`` bytes together.

    Of two shards one is searched: that from which the other is at most half of the ring of shards ahead.
    """
    step = min(AHEAD, max(1, number // SHARDS))
    parts = number // 2 // step + 1
    once = max(ROUND, ROUND_BYTES // (size // 2 + 1))
    counts, stars = None, None
    for first in range(0, number, once):
        last = min(number, first + once) - 1
        ahead = lambda target: F.pmod(F.col("shard") - target, F.lit(number))
        asks = lambda target: (ahead(target) > 0) & ((2 * ahead(target) < number) | ((2 * ahead(target) == number) & (F.col("shard") < target)))
        task = lambda target, part: ((target - first) * parts + part).cast("int")
        indices = packed.where(F.col("shard").between(first, last)).withColumn("task", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: task(F.col("shard"), p))))
        asked = packed.where(F.col("kind") == ROWS).withColumn("kind", F.lit(QUERIES))
        asked = asked.withColumn("task", F.explode(F.transform(F.filter(F.sequence(F.lit(first), F.lit(last)), asks), lambda t: task(t, F.floor(ahead(t) / step)))))
        every = indices.unionByName(asked).repartitionById((last - first + 1) * parts, F.col("task")).sortWithinPartitions("task", "dim", "kind", "shard", "seq")
        found = stored(bounded(every).mapInArrow(_search(threshold, parts), "id long, n long, root long"))
        if once >= number:
            return found.groupBy("id").agg(F.sum("n").alias("n")), found.where("id <> root").select("id", "root")
        n = found.select("id", "n")
        folded = stored((n.unionByName(counts) if counts else n).groupBy("id").agg(F.sum("n").alias("n")))
        some = stored(found.where("id <> root").select("id", "root"))
        dropped(found, *([counts] if counts else []))
        counts, stars = folded, stars.unionByName(some) if stars else some
    return counts, stars


def groups(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each vector: id, ``n_links``, ``component_id`` and ``kept``.

    Two vectors of one length are linked if their cosine in double precision is ``threshold`` or more. Vectors that are null, zero,
    or hold a null or non-finite component, have no links. n_links counts rows, copies included;
    component_id is the smallest id reachable. Ids are below 2^62; a null id counts as a greater number that the vector
    gives, so that only equal vectors share it, and shows as null, as does a component of null ids alone. Rows that
    share an id are vectors of their own in n_links and one in components. An empty table gives no rows; other columns, whatever
    their names, are not read.
    """
    rows = vectors(df, key, vector)
    every = stored(rows.drop("v"))
    one = stored(rows.where("dim is not null").groupBy("dim", "h1", "h2").agg(F.min("id").alias("id"), F.min("v").alias("v"), F.count("*").alias("copies")))
    total, n = one.agg(F.coalesce(F.sum("dim"), F.lit(0)), F.count("*")).first()
    number = shards(8 * total + ROW_BYTES * n, SHARDS, SHARD_BYTES)
    dealt = one.select(F.pmod("h1", F.lit(number)).cast("int").alias("shard"), "dim", "id", "copies", "v").repartitionById(number, F.col("shard")).sortWithinPartitions("shard", "dim", "id")
    packed = stored(bounded(dealt).mapInArrow(_build(threshold), PACKED), **SMALL)
    links, stars = _links(packed, number, 8 * total, threshold)
    same = ["dim", "h1", "h2"]
    sizes = one.select(*same, F.col("id").alias("root"), "copies").join(links.withColumnRenamed("id", "root"), "root", "left").select(*same, "root", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    sizes = stored(sizes)
    dropped(packed, one)
    out = stored(spread(every, sizes, same, "left").select("id", "root", "n_links"))
    label = components(stars.unionByName(out.where("id <> root").select("id", "root")))
    out = out.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    return out.select(F.when(F.col("id") < NULL_ID, F.col("id")).alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("c") < NULL_ID, F.col("c")).alias("component_id"), (F.col("c") == F.col("id")).alias("kept"))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
c(node, comp) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.comp FROM c JOIN l ON l.a = c.node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT node AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(comp) AS component_id, min(comp) = node AS kept FROM c LEFT JOIN n ON n.a = node GROUP BY node
"""
