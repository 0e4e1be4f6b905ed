"""Connected components of an edge list: contraction inside tasks, then alternating large and small stars.

A task replaces at most ``EDGE_BLOCK`` edges at a time by a star forest with the
same components (every node points to the smallest it reaches there), so
memory is bounded and chains inside a block vanish at once. The edges
that are left go to as many tasks as they fill blocks; one block is exact.
While there are more, each round adds a large star and a small star, which
are two group-bys and two joins. The rounds grow with the logarithm of the
longest chain of blocks. Every round is written to the shared folder, so a lost
executor costs a reread, and the round before it is removed. A node with
very many edges is aggregated before it is shuffled; the driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import forget, importable, materialize

#: Edges that one task contracts at a time.
EDGE_BLOCK = 1_000_000


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of edges a-b that reach a smaller one; root is the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    far = np.flatnonzero(root != np.arange(len(root)))
    return nodes[far], nodes[root[far]]


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v) with the components of ``edges``, by blocks of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_u: list[np.ndarray] = []
        held_v: list[np.ndarray] = []

        def emit() -> pa.RecordBatch:
            u, v = star_forest(np.concatenate(held_u), np.concatenate(held_v))
            held_u.clear()
            held_v.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            held_u.append(b.column(0).to_numpy())
            held_v.append(b.column(1).to_numpy())
            if sum(map(len, held_u)) >= EDGE_BLOCK:
                yield emit()
        if held_u:
            yield emit()

    return edges.mapInArrow(run, "u bigint, v bigint")


def _stars(e: DataFrame) -> DataFrame:
    """A large star, then a small star."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where(F.col("u") != F.col("v"))
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(down, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(down.select("u", F.col("m").alias("v"))).distinct()


def _is_star_forest(e: DataFrame) -> bool:
    """Whether every node points to one root, and no root points on."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(e.select("v", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges`` that has a smaller node in its component; root is the smallest."""
    importable(edges.sparkSession)
    e = materialize(_contracted(edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    while True:
        blocks = max(1, -(-e.count() // EDGE_BLOCK))
        before, e = e, materialize(_contracted(e.coalesce(blocks)), "edges")
        forget(before)
        if blocks == 1 or _is_star_forest(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, e = e, materialize(_stars(e), "edges")
        forget(before)
