"""Embedding near-dedup (operator 2): an exact range join in the metric of angles.

Vectors of one label whose cosine is at least ``cosine`` are linked. The
angle between vectors is a metric, and the link's radius is
r = arccos(cosine). Pivots part the vectors into cells: a vector's home is
its nearest pivot. For a pair x, y within r, y at home in cell j, the
triangle inequality gives angle(x, p_j) <= angle(x, p_home) + 2 r; and x then
lies within r of the great circle between both pivots. A vector visits
just the cells that pass both tests, so each cell joins alone: its home
vectors with home vectors and visitors.

Identical vectors of a label are one class with a number and a count before anything else,
so a hot vector costs one row. A cell with more rows than a block is joined
block by block on separate tasks; no task holds an unbounded group. A task
sends out one row per vector (its number of links and the smallest linked
vector that it reaches there), never its pairs.

Pivots are at most about ``MOST_PIVOTS`` vectors, chosen by a hash and shared by all labels; their number
grows with the largest label up to that documented bound.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite
components, or has no label, links with nothing, nor do vectors of different
length. Rows with the same id are vectors of their own, each with its own links and component
(under different labels they never meet, near ones under one label are links of
each other); a row with a null id takes no part. Extra columns are ignored.
Empty tables give empty results. Cosines are computed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.components import connected
from docketry.llm.vectors import by_dimension, matrix, sample_by_dimension, usable
from docketry.session import importable, materialize

COSINE = 0.98
MOST_PIVOTS = 256
ROWS_PER_PIVOT = 4000
BLOCK = 2048


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _assigned(classes: DataFrame, pivots: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """(label, d, cell, home, id, n, vector): each class in its home cell and in those it visits."""
    radius = math.acos(cosine)
    near = math.sin(radius)
    units = {d: _unit(p) for d, p in pivots.items()}
    kind = classes.schema["vector"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, rows, x in by_dimension(b, "vector"):
                p = units[d]
                c = np.clip(_unit(x) @ p.T, -1.0, 1.0)
                angle, gap = np.arccos(c), np.sqrt(np.maximum(2 - 2 * np.clip(p @ p.T, -1, 1), 0))
                home = angle.argmin(1)
                at = np.arange(len(x))
                goes = (angle <= angle[at, home][:, None] + 2 * radius + 1e-9) & (c[at, home][:, None] - c <= near * gap[home] + 1e-9)
                goes[at, home] = True
                r, cell = np.nonzero(goes)
                took = b.take(pa.array(rows[r]))
                yield pa.RecordBatch.from_arrays([took.column("label"), pa.array(np.full(len(r), d, np.int32)), pa.array(cell.astype(np.int32)), pa.array(cell == home[r]), took.column("id"), took.column("n"), took.column("vector")], ["label", "d", "cell", "home", "id", "n", "vector"])

    return classes.select("label", "id", "n", "vector").mapInArrow(run, f"label string, d int, cell int, home boolean, id bigint, n bigint, vector {kind.simpleString()}")


def _joined(assigned: DataFrame, cosine: float) -> DataFrame:
    """(id, n, root): per class and block its links there, and the smallest class that it reaches there."""
    counts = assigned.groupBy("label", "d", "cell").agg(F.count_if("home").alias("homes"), F.count("id").alias("rows"))
    counts = counts.select("label", "d", "cell", F.ceil(F.col("homes") / F.lit(float(BLOCK))).alias("left_blocks"), F.ceil(F.col("rows") / F.lit(float(BLOCK))).alias("right_blocks"))
    rows = assigned.join(counts, ["label", "d", "cell"]).withColumn("draw", F.xxhash64(F.lit("block"), "id"))
    keys = ["label", "d", "cell", "lb", "rb"]
    left = rows.where("home").select("label", "d", "cell", F.pmod("draw", "left_blocks").alias("lb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("right_blocks") - 1)).alias("rb"), F.lit(True).alias("left"), "id", "n", "vector")
    right = rows.select("label", "d", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left_blocks") - 1)).alias("lb"), F.pmod("draw", "right_blocks").alias("rb"), F.lit(False).alias("left"), "id", "n", "vector")

    def join(table: pa.Table) -> pa.Table:
        side = table.column("left").to_numpy(zero_copy_only=False)
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        x = _unit(matrix(table.column("vector")))
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        linked = (x[b] @ x[a].T >= cosine) & (ids[b][:, None] != ids[a][None, :])
        found = linked @ n[a].astype(np.float64)
        root_a, root_b, none = ids[a].copy(), ids[b].copy(), np.iinfo(np.int64).max
        while linked.any():
            new_b = np.minimum(root_b, np.where(linked, root_a[None, :], none).min(1))
            new_a = np.minimum(root_a, np.where(linked, new_b[:, None], none).min(0))
            if (new_a == root_a).all() and (new_b == root_b).all():
                break
            root_a, root_b = new_a, new_b
        far = root_a != ids[a]
        return pa.table({"id": np.concatenate([ids[b], ids[a][far]]), "n": np.concatenate([found.astype(np.int64), np.zeros(far.sum(), np.int64)]), "root": np.concatenate([root_b, root_a[far]])})

    return left.unionByName(right).groupBy(*keys).applyInArrow(join, "id bigint, n bigint, root bigint")


def near_duplicates(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) per row."""
    importable(rows.sparkSession)
    table = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    takes_part = usable("vector") & F.col("label").isNotNull() & F.col("id").isNotNull()
    good = table.where(takes_part)
    classes = good.groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("id").alias("n"))
    # The table is written once, so the numbers of classes stay.
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    sizes = classes.groupBy("label", F.size("vector").alias("d")).count().groupBy("d").agg(F.sum("count").alias("n"), F.max("count").alias("most"))
    sizes = {r["d"]: (r["n"], r["most"]) for r in sizes.collect()}  # one row per dimension
    # Cells are joined label by label, so the largest label says how many of them are of use.
    largest = max((most for _, most in sizes.values()), default=0)
    have = {d: n for d, (n, _) in sizes.items()}
    wanted = min(MOST_PIVOTS, max(1, math.ceil(largest / ROWS_PER_PIVOT)))
    pivots = sample_by_dimension(classes, "id", "vector", wanted, "pivots", have) if have else {}
    if set(have) - set(pivots):
        first = classes.groupBy(F.size("vector").alias("d")).agg(F.min_by("vector", "id").alias("v"))
        pivots |= {r["d"]: np.array([r["v"]], np.float64) for r in first.collect() if r["d"] not in pivots}  # one row per dimension
    assigned = materialize(_assigned(classes, pivots, cosine), "cells")
    found = materialize(_joined(assigned, cosine), "links")
    links = found.groupBy("id").agg(F.sum("n").alias("linked"))
    roots = connected(found.where(F.col("root") != F.col("id")), "id", "root")
    low = classes.join(roots, classes["id"] == roots["node"]).groupBy("root").agg(F.min("least").alias("low"))
    low = low.join(classes.select(F.col("id").alias("root"), "least"), "root").select("root", F.least("low", "least").alias("low"))
    named = classes.join(links, "id", "left").join(roots, classes["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id"))
    named = named.join(materialize(low, "least-ids"), "root", "left")
    per_class = named.select("label", "vector", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("low", "least").alias("component_id"))
    linked = good.join(per_class, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = table.where(~takes_part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select("id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
