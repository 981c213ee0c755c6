"""Proximity graphs in numpy: batched beam search, diverse pruning and batch insertion.

A graph is a matrix of neighbour rows, -1 where there is none. Distances are squared Euclidean in
single precision; callers measure what they return again in double.
"""

from __future__ import annotations

import numpy as np

BATCH = 1024
#: Bytes of gathered vectors at a time.
GATHERED = 8 << 20


def distances(x: np.ndarray, norms: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each query to its own candidate rows, less the query's squared norm."""
    out = norms[at]
    step = max(1, GATHERED // max(1, at.shape[1] * x[:1].nbytes))
    for lo in range(0, len(at), step):
        part = slice(lo, lo + step)
        out[part] -= 2 * np.matmul(x[at[part]], q[part][:, :, None])[:, :, 0]
    return out


def beam(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest rows that beam search finds for each query, nearest first, -1 and inf after the last.

    ``entry`` has some first rows for each query. In each round every query expands its ``step`` nearest
    candidates not yet expanded, until its whole beam is.
    """
    n, first = len(q), entry.shape[1]
    ids = np.full((n, width), -1, np.int64)
    dist = np.full((n, width), np.inf, np.float32)
    ids[:, :first] = entry
    dist[:, :first] = distances(x, norms, entry, q)
    for k in range(1, first):
        twice = (entry[:, :k] == entry[:, k : k + 1]).any(1)
        ids[twice, k], dist[twice, k] = -1, np.inf
    order = np.argsort(dist, 1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    done = ids < 0
    live = np.arange(n)
    while len(live):
        open_ = ~done[live]
        rank = np.cumsum(open_, 1)
        pick = open_ & (rank <= step)
        busy = pick.any(1)
        live, pick, rank = live[busy], pick[busy], rank[busy]
        if not len(live):
            break
        done[live] |= pick
        chosen = np.full((len(live), step), -1, np.int64)
        r, c = np.nonzero(pick)
        chosen[r, rank[r, c] - 1] = ids[live[r], c]
        near = graph[chosen].reshape(len(live), -1).astype(np.int64)
        near[np.repeat(chosen < 0, graph.shape[1], 1)] = -1
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        own = np.sort(ids[live], 1)
        known = _contains(own, near)
        near[known] = -1
        d = distances(x, norms, near, q[live])
        d[near < 0] = np.inf
        all_d = np.concatenate([dist[live], d], 1)
        all_i = np.concatenate([ids[live], near], 1)
        all_e = np.concatenate([done[live], near < 0], 1)
        top = np.argpartition(all_d, width - 1, 1)[:, :width]
        top = np.take_along_axis(top, np.argsort(np.take_along_axis(all_d, top, 1), 1, kind="stable"), 1)
        dist[live], ids[live], done[live] = (np.take_along_axis(v, top, 1) for v in (all_d, all_i, all_e))
    return ids, dist


def _contains(sorted_rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in its row of ``sorted_rows``."""
    n, m = sorted_rows.shape
    gap = int(max(sorted_rows.max(initial=0), values.max(initial=0))) + 2
    base = np.arange(n)[:, None] * gap + 1
    flat, want = (sorted_rows + base).ravel(), values + base
    at = np.minimum(np.searchsorted(flat, want.ravel()), n * m - 1)
    return (flat[at] == want.ravel()).reshape(values.shape)


def prune(x: np.ndarray, own: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of rows ``own`` out of candidates ``ids``.

    The nearest candidate is kept, and those go to which it is nearer than ``1/alpha`` times their distance
    to the row; so on with the next.
    """
    step = max(1, GATHERED // max(1, ids.shape[1] * (x[:1].nbytes + ids.shape[1] * x.itemsize)))
    if len(own) > step:
        return np.concatenate([prune(x, own[lo : lo + step], ids[lo : lo + step], degree, alpha) for lo in range(0, len(own), step)])
    ids = ids.copy()
    ids[ids == own[:, None]] = -1
    v = x[ids]
    d = ((v - x[own][:, None]) ** 2).sum(2)
    d[ids < 0] = np.inf
    order = np.argsort(d, 1, kind="stable")
    ids, d, v = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    norms = (v * v).sum(2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    out = np.full((len(own), degree), -1, np.int32)
    row = np.arange(len(own))
    open_ = np.isfinite(d)
    for k in range(degree):
        any_ = open_.any(1)
        if not any_.any():
            break
        first = open_.argmax(1)
        out[any_, k] = ids[row, first][any_]
        open_ &= ~((alpha * between[row, first] <= d) & any_[:, None])
        open_[row, first] = False
    return out


def link_back(x: np.ndarray, graph: np.ndarray, own: np.ndarray, alpha: float) -> None:
    """Adds the reverse of the links of rows ``own``; a row with too many is pruned."""
    degree = graph.shape[1]
    to, source = graph[own].ravel(), np.repeat(own, degree)
    ok = to >= 0
    to, source = to[ok], source[ok]
    known = (graph[to] == source[:, None]).any(1)
    to, source = to[~known], source[~known]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    rows, start, count = np.unique(to, return_index=True, return_counts=True)
    most = 2 * degree
    new = np.full((len(rows), most), -1, np.int64)
    nth = np.arange(len(to)) - np.repeat(start, count)
    use = nth < most
    new[np.repeat(np.arange(len(rows)), count)[use], nth[use]] = source[use]
    used = (graph[rows] >= 0).sum(1)
    fits = used + count <= degree
    for i in np.flatnonzero(fits):
        graph[rows[i], used[i] : used[i] + count[i]] = new[i, : count[i]]
    full = np.flatnonzero(~fits)
    for lo in range(0, len(full), BATCH):
        at = full[lo : lo + BATCH]
        graph[rows[at]] = prune(x, rows[at], np.concatenate([graph[rows[at]].astype(np.int64), new[at]], 1), degree, alpha)


def insert(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, rows: np.ndarray, entry, width: int, alpha: float) -> None:
    """Inserts ``rows`` in batches that double; ``entry`` gives the first rows of a search for queries."""
    degree, lo = graph.shape[1], 1
    while lo < len(rows):
        own = rows[lo : lo + min(max(lo, 32), BATCH)]
        found, _ = beam(x, norms, graph, x[own], entry(own), width)
        with_ = min(len(own), 16)
        d = norms[own] - 2 * x[own] @ x[own].T
        near = own[np.argpartition(d, with_ - 1, 1)[:, :with_]]
        graph[own] = prune(x, own, np.concatenate([found, graph[own].astype(np.int64), near], 1), degree, alpha)
        link_back(x, graph, own, alpha)
        lo += len(own)


def connect(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, rows: np.ndarray, start: int) -> np.ndarray:
    """``graph`` with links, in further columns if need be, so that a walk from ``start`` can reach all ``rows``.

    A row that no walk reaches gets a link from the nearest of up to BATCH rows that one does.
    """
    seen = np.zeros(len(x), bool)

    def walk(first: int) -> None:
        front = np.array([first])
        seen[first] = True
        while len(front):
            near = graph[front].ravel()
            near = np.unique(near[near >= 0])
            front = near[~seen[near]]
            seen[front] = True

    walk(start)
    rng = np.random.default_rng(1)
    while len(lost := rows[~seen[rows]]):
        one = int(lost[0])
        reached = rows[seen[rows]]
        own = reached if len(reached) <= BATCH else rng.choice(reached, BATCH, replace=False)
        own = own[np.argsort(norms[own] - 2 * x[own] @ x[one], kind="stable")]
        free = (graph[own] < 0).any(1)
        if not free.any():
            graph = np.concatenate([graph, np.full((len(graph), 1), -1, graph.dtype)], 1)
            free[:] = True
        at = own[free.argmax()]
        graph[at, (graph[at] < 0).argmax()] = one
        walk(one)
    return graph


class Layers:
    """A hierarchical navigable small-world graph; layer 0 holds all rows, each next one about one in 16 of those below."""

    def __init__(self, x: np.ndarray, degree: int = 24, build: int = 48) -> None:
        self.x, self.norms = x, (x * x).sum(1)
        rng = np.random.default_rng(0)
        level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(16)).astype(int)
        self.rows = np.argsort(-level, kind="stable")
        self.graphs: list[np.ndarray] = []
        self.tops = int(level.max(initial=0))
        for k in range(self.tops, -1, -1):
            graph = np.full((len(x), degree), -1, np.int32)
            above = list(self.graphs)
            insert(x, self.norms, graph, self.rows[: int((level >= k).sum())], lambda own, above=above: self.descend(x[own], above), build, 1.0)
            self.graphs.append(connect(x, self.norms, graph, self.rows[: int((level >= k).sum())], int(self.rows[0])))

    def descend(self, q: np.ndarray, graphs: list[np.ndarray]) -> np.ndarray:
        """First rows of a search in the layer below ``graphs``."""
        at = np.full((len(q), 1), self.rows[0], np.int64)
        for g in graphs:
            ids, _ = beam(self.x, self.norms, g, q, at, 4, 2)
            at = ids[:, :1]
        return at

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return beam(self.x, self.norms, self.graphs[-1], q, self.descend(q, self.graphs[:-1]), min(width, len(self.x)))
