"""Operators on embeddings against brute force in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd

from emberleaf.functions import proximity
from emberleaf.llm import embedding_dedup, nearest_neighbours, queries
from pyspark.sql import functions as F


def vectors(sf):
    d = pd.read_parquet(f"{sf}/embeddings.parquet")
    return d.vec_id.to_numpy(), np.stack(d.embedding.to_numpy()).astype(float)


def linked(ids, v, least=0.95):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = unit @ unit.T >= least
    np.fill_diagonal(hit, False)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(hit), strict=True):
        x, y = find(ids[a]), find(ids[b])
        root[max(x, y)] = min(x, y)
    return {i: (int(n), find(i)) for i, n in zip(ids, hit.sum(1), strict=True)}


def test_embedding_dedup_against_brute_force(spark, sf):
    for size in ("0.001", "0.1"):
        at = sf.replace("0.001", size)
        want = linked(*vectors(at))
        got = queries.op3_embedding_dedup(spark, at).collect()
        assert len(got) == len(want)
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_embedding_dedup_of_dense_groups(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    v = np.concatenate([c + rng.normal(size=(n, 16)) * s for c, n, s in zip(centres, (300, 100, 40, 5, 1, 60), (0.0, 0.05, 0.15, 0.2, 0.1, 0.3), strict=True)])
    ids = rng.permutation(len(v))
    frame = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.groups(frame).collect()}
    assert got == linked(ids.tolist(), v)


ODD = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.001]), (9, []), (10, [1e-200, 0.0]), (11, [1e200, 0.0]), (12, [-1.0, 0.0])]


def test_embedding_dedup_edges(spark):
    frame = spark.createDataFrame([(*x, "n") for x in ODD], "vec_id long, embedding array<double>, n_links string")
    got = embedding_dedup.groups(frame).collect()
    assert len(got) == len(ODD)
    by = {r["vec_id"]: r for r in got}
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (3, 4, 5, 6, 7, 8, 9, 12))
    assert by[1]["n_links"] == 5 and {by[i]["component_id"] for i in (1, 2, 10, 11)} == {1}
    assert embedding_dedup.groups(frame.where("false")).isEmpty()


def test_nearest_neighbours_recall(spark, sf):
    sf = sf.replace("0.001", "0.1")
    ids, v = vectors(sf)
    got = queries.op6_nearest_neighbours(spark, sf).toPandas().sort_values(["query_id", "rank"])
    asked = [i for i in ids if i % 100 == 0]
    assert sorted(got.query_id.unique()) == sorted(asked)
    hits = 0
    at = {x: k for k, x in enumerate(ids)}
    for q, rows in got.groupby("query_id"):
        d = np.sqrt(((v - v[at[q]]) ** 2).sum(1))
        best = [x for _, x in sorted(zip(d, ids, strict=True)) if x != q][:10]
        assert rows["rank"].tolist() == list(range(1, 11)) and (np.diff(rows.score) >= 0).all()
        assert np.allclose(rows.score, d[[at[x] for x in rows.vec_id]], rtol=1e-12)
        hits += len(set(best) & set(rows.vec_id))
    assert hits >= 0.9 * 10 * len(asked)


def test_nearest_neighbours_ties_and_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 300)] + [(1000 + i, [1.0, 2.0, 3.0 + i]) for i in range(1, 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest_neighbours.search(frame, F.col("id").isin(0, 250, 1001)).collect()
    by = {q: [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] for q in (0, 250, 1001)}
    assert by[0] == list(range(1, 11)) and by[250] == list(range(10))
    assert by[1001] == list(range(10))  # as near as 1002, and of smaller ids


def test_nearest_neighbours_edges(spark):
    frame = spark.createDataFrame([(*x, "n") for x in ODD], "vec_id long, embedding array<double>, score string")
    got = nearest_neighbours.search(frame, F.lit(True)).collect()
    assert {r["query_id"] for r in got} == {1, 2, 10, 11, 12}
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 1), key=lambda r: r["rank"])] == [2, 10, 12, 11]
    assert nearest_neighbours.search(frame.where("false"), F.lit(True)).isEmpty()


def test_embedding_dedup_of_sparse_pairs(spark):
    """Few links among many vectors that are far from each other."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(12_000, 32))
    for i in range(60):
        a = v[i] / np.linalg.norm(v[i])
        away = rng.normal(size=32)
        away -= (away @ a) * a
        c = 0.94 + 0.001 * i
        v[6000 + i] = 3 * (c * a + np.sqrt(1 - c * c) * away / np.linalg.norm(away))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.groups(frame).collect()}
    assert got == linked(list(range(len(v))), v)
    assert sum(n for n, _ in got.values()) >= 90


def test_embedding_dedup_with_null_ids(spark):
    rows = [(4, [1.0, 0.0]), (None, [2.0, 0.0]), (7, [0.0, 1.0]), (None, [0.0, 3.0]), (None, [-1.0, 0.0]), (None, None)]
    got = embedding_dedup.groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, 0, True), (0, 0, 0, True), (0, 1, 4, False), (0, 1, 7, False), (4, 1, 4, True), (7, 1, 7, True)]


def test_walks_reach_islands():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(50, 4)) + c for c in (0, 100, 200)]).astype(np.float32)
    graph = np.concatenate([(np.arange(150)[:, None] // 50 * 50 + rng.integers(0, 50, (150, 3)))]).astype(np.int32)
    graph = proximity.connect(x, (x * x).sum(1), graph, np.arange(150), 0)
    seen, front = {0}, [0]
    while front:
        front = [int(j) for i in front for j in graph[i] if j >= 0 and j not in seen and not seen.add(int(j))]
    assert len(seen) == 150


def test_audits_widen_beams():
    """Vectors without structure, on which a narrow beam finds too little."""
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(5000, 128)).astype(np.float32), rng.normal(size=(300, 128)).astype(np.float32)
    index = nearest_neighbours.Graph(x)
    true = index.exact(q, 10)
    share = lambda found: (true[:, :, None] == found[:, None, :10]).any(2).mean()
    assert share(index.search(q, 20)) < 0.9
    assert share(index.search(q, index.audited(q, 10, 20))) >= 0.95
    assert (index.exact(q, 10) == np.argsort((x * x).sum(1) - 2 * q @ x.T, 1, kind="stable")[:, :10]).all()


def test_embedding_dedup_moves_pieces_in_rounds(spark, monkeypatch):
    """What is stored and moved has bounded cells, however large a shard is; rounds and tasks of several shards lose no link."""
    cells, stored = [], embedding_dedup.stored

    def watched(df, **options):
        out = stored(df, **options)
        cells.extend(r[0] for c, kind in out.dtypes if kind == "binary" for r in out.select(F.max(F.length(c))).collect())
        return out

    monkeypatch.setattr(embedding_dedup, "stored", watched)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(6000, 32))
    v[3000:3400] = 2 * v[:400] + rng.normal(size=(400, 32)) * 0.4  # about as far as the threshold
    v[4000:4100] = v[4000] + rng.normal(size=(100, 32)) * 0.15
    v[4100:4150] = v[4000:4050]
    want = linked(list(range(len(v))), v)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embedding_dedup, "SHARDS", 2)
    monkeypatch.setattr(embedding_dedup, "ROUND_BYTES", 0, raising=False)
    for number in (9, 2):  # in three rounds of tasks for up to four shards, and in one
        monkeypatch.setattr(embedding_dedup, "SHARD_BYTES", 6000 * 32 * 8 * 2 // number)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.groups(frame).collect()}
        assert got == want
    assert sum(n for n, _ in want.values()) > 10_000
    assert cells and max(cells) <= 1 << 18


def test_gathered_vectors_are_bounded():
    """Wide vectors are compared in parts, to the same graph."""
    import tracemalloc

    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 768)).astype(np.float32)
    own, ids = np.arange(512), rng.integers(0, 1500, (512, 88))
    tracemalloc.start()
    kept = proximity.prune(x, own, ids, 24, 1.0)
    far = proximity.distances(x, (x * x).sum(1), ids, x[own])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 96 << 20
    assert (kept == np.concatenate([proximity.prune(x, own[i : i + 1], ids[i : i + 1], 24, 1.0) for i in own])).all()
    assert np.allclose(far, (x * x).sum(1)[ids] - 2 * np.einsum("ijk,ik->ij", x[ids], x[own]), atol=1e-2)
