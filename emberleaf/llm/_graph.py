"""Connected components of links between ids.

Each task shrinks its links to stars. While more links remain than one task may hold, nodes toss coins: a node of
one side joins its smallest neighbour of the other, so that about a quarter of the nodes or more go in a round, whatever
their shape, and no chain of joins forms. The rest is solved in one task, and the rounds are read backwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberleaf.llm._skew import spread
from emberleaf.llm._spark import stored

#: Links that a task holds at once, and that one task may solve.
HELD = 1 << 20


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b and the smallest node that each reaches by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if not (x != y).any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _contract(held: int):
    """Stars (node, root), root the smallest node, of the links of a task, of about ``held`` at a time."""

    def star(parts: list) -> pa.RecordBatch:
        node, root = smallest(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))
        return pa.RecordBatch.from_arrays([pa.array(x[node != root]) for x in (node, root)], names=["node", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            parts.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n > held:
                yield star(parts)
                parts, n = [], 0
        if n:
            yield star(parts)

    return run


def _joined(links: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Fewer links after one round of coins, and the nodes that went with the neighbours that they joined."""
    coin = lambda c: F.xxhash64(F.lit(turn), c).bitwiseAND(1)
    both = links.unionByName(links.select(F.col("root").alias("node"), F.col("node").alias("root")))
    up = stored(both.where((coin("node") == 0) & (coin("root") == 1)).groupBy("node").agg(F.min("root").alias("up")))
    first = spread(links, up, ["node"], "left").select(F.coalesce("up", "node").alias("a"), "root")
    both = spread(stored(first), up.withColumnRenamed("node", "root"), ["root"], "left").select("a", F.coalesce("up", "root").alias("b"))
    return stored(both.where("a <> b").mapInArrow(_contract(HELD), "node long, root long")), up


def components(edges: DataFrame, held: int = HELD) -> DataFrame:
    """``node`` and ``component``, the smallest node that it reaches, for the nodes of ``edges`` that reach a smaller one.

    ``edges`` has two columns of longs without nulls; direction, order and repetition do not matter. No links give no rows.
    ``held`` changes the number of rounds alone.
    """
    links, ups = stored(edges.mapInArrow(_contract(HELD), "node long, root long")), []
    while links.count() > held:
        links, up = _joined(links, len(ups))
        ups.append(up)
    label = stored(links.coalesce(1).mapInArrow(_contract(2 * HELD), "node long, component long"))
    if not ups:
        return label
    for up in reversed(ups):
        through = spread(up, label.withColumnRenamed("node", "up"), ["up"], "left").select("node", F.coalesce("component", "up").alias("component"))
        label = stored(label.unionByName(through))
    # a component's name is so far a node of the last round
    least = stored(label.groupBy("component").agg(F.min("node").alias("least")).select("component", F.least("component", "least").alias("least")))
    named = spread(label, least, ["component"]).select("node", F.col("least").alias("component"))
    centres = least.select(F.col("component").alias("node"), F.col("least").alias("component"))
    return stored(named.unionByName(centres).where("node <> component"))
