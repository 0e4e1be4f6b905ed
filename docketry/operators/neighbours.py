"""Exact nearest neighbours in a metric, by pivots: rows are dealt to the cell of their nearest pivot, and the triangle
inequality says which cells can hold something near enough.

A first round inside part of a row's own cell gives a bound of its k-th distance; in the second one the row visits only the
cells whose ball reaches that bound. Cells and their visitors meet in blocks of bounded size, so no group grows with the data.
Distances are summed over the dimensions in their order, so both ends of a pair see the same number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.session import importable, materialize

#: Rows of a side that meet in one task, and at most how many pivots a driver and a task hold.
BLOCK, MOST_PIVOTS = 16384, 4096
#: Rows of a tile inside a task, and the dimensions from which candidates come from a matrix product first.
TILE, WIDE = 64, 16


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of two matrices."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        off = a[:, k, None] - b[None, :, k]
        off *= off
        out += off
    return np.sqrt(out, out=out)


def pivots(rows: DataFrame, n: int, key: str = "id", vector: str = "x") -> np.ndarray:
    """About the square root of n rows, at least one and at most MOST_PIVOTS, by a hash of the key."""
    want = min(MOST_PIVOTS, max(1, math.isqrt(n)))
    share = F.pmod(F.xxhash64(F.lit("pivot"), key), F.lit(1_000_000_000)) < F.lit(math.ceil(1e9 * min(1.0, want / max(n, 1))))
    found = rows.where(share).orderBy(F.xxhash64(F.lit("pivot"), key)).limit(2 * want).select(vector).collect()  # at most 2 * MOST_PIVOTS rows
    return np.array([r[0] for r in (found or rows.select(vector).limit(1).collect())], np.float64)


def in_cells(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` (id, x, ...) with ``cell`` and the distance ``off`` of its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"))
            cell, off = np.zeros(len(x), np.int32), np.zeros(len(x))
            for k in range(0, len(x), TILE):
                d = distances(x[k : k + TILE], centres)
                cell[k : k + TILE], off[k : k + TILE] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(off)], [*b.schema.names, "cell", "off"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, cell int, off double")


def places(centres: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A group for each cell: cells in an order that halves the widest dimension again and again, cut after about BLOCK rows."""
    order, todo = [], [np.arange(len(centres))]
    while todo:
        some = todo.pop()
        if len(some) <= 2:
            order += some.tolist()
            continue
        wide = int(np.ptp(centres[some], axis=0).argmax())
        some = some[np.argsort(centres[some, wide], kind="stable")]
        todo += [some[len(some) // 2 :], some[: len(some) // 2]]
    before = np.cumsum(counts[order]) - counts[order]
    group = np.zeros(len(centres), np.int64)
    group[order] = np.unique(before // BLOCK, return_inverse=True)[1]
    return group


def with_visits(asks: DataFrame, centres: np.ndarray, radius: np.ndarray, group: np.ndarray, bound: str) -> DataFrame:
    """A row of ``asks`` (with x) for each ``visit``: a group with a cell whose ball comes as near as the row's ``bound``."""
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(group.max() + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, most = matrix(b.column("x")), b.column(bound).to_numpy(zero_copy_only=False)
            for k in range(0, len(x), TILE):
                near = distances(x[k : k + TILE], centres) - radius
                # A little slack for the rounding of the distances.
                reached = near <= most[k : k + TILE, None] * (1 + 1e-9) + 1e-12
                row, place = np.nonzero(np.logical_or.reduceat(reached[:, order], starts, axis=1))
                for s in range(0, len(row), 10_000):
                    took = b.take(pa.array(row[s : s + 10_000] + k))
                    yield pa.RecordBatch.from_arrays([*took.columns, pa.array(place[s : s + 10_000].astype(np.int32))], [*b.schema.names, "visit"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asks.schema.fields)
    return asks.mapInArrow(run, f"{schema}, visit int")


def met(asks: DataFrame, holds: DataFrame, cells: DataFrame) -> DataFrame:
    """Visitors and rows of each group in pairs of blocks (visit, ask_block, block), with ``side`` true for visitors. ``cells``: (cell, visit, n), one row a pivot."""
    visits = asks.groupBy("visit").agg(F.count("*").alias("asking"))
    plan = F.broadcast(visits.join(cells.select("visit", "n").distinct(), "visit").select("visit", *(F.ceil(F.col(c) / F.lit(float(BLOCK))).alias(k) for c, k in (("asking", "ka"), ("n", "kc")))))  # at most 2 * MOST_PIVOTS rows
    draw = F.xxhash64(F.lit("block"), "id")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    a = asks.join(plan, "visit").withColumns({"ask_block": F.pmod(draw, "ka"), "block": every("kc"), "side": F.lit(True)})
    h = holds.join(F.broadcast(cells.select("cell", "visit")), "cell").drop("cell").join(plan, "visit").withColumns({"block": F.pmod(draw, "kc"), "ask_block": every("ka"), "side": F.lit(False)})
    return a.drop("ka", "kc").unionByName(h.drop("ka", "kc"), allowMissingColumns=True)


def squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all rows of two matrices from one product, and by how much rounding may have moved those of a row."""
    middle = y.mean(0)
    x0, y0 = x - middle, y - middle
    xx, yy = (x0 * x0).sum(1), (y0 * y0).sum(1)
    return xx[:, None] + yy[None, :] - 2 * (x0 @ y0.T), 1e-11 * (xx[:, None] + yy.max())


def pair_distances(x: np.ndarray, y: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Distances of some pairs, summed as ``distances`` does."""
    d = np.zeros(len(row))
    for j in range(x.shape[1]):
        d += (x[row, j] - y[column, j]) ** 2
    return np.sqrt(d)


def _candidates(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Distances of all rows of two matrices; of wide ones only those that may be among a row's k nearest, the rest is infinite."""
    if x.shape[1] < WIDE or len(y) <= 2 * k:
        return distances(x, y)
    rough, slack = squares(x, y)
    # The k-th and the row itself, and what rounding may have moved.
    least = np.partition(rough, k, axis=1)[:, k, None] + slack
    row, column = np.nonzero(rough <= least)
    out = np.full(rough.shape, np.inf)
    out[row, column] = pair_distances(x, y, row, column)
    return out


def _best(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, distance) of the k nearest others of each row; ties to the smaller id."""
    order = np.argsort(others, kind="stable")
    others, y = others[order], y[order]
    out: list[tuple[np.ndarray, ...]] = []
    for s in range(0, len(ids), TILE):
        d = _candidates(x[s : s + TILE], y, k)
        d[ids[s : s + TILE, None] == others[None, :]] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :k] if d.shape[1] <= 4 * k else None
        if near is None:
            least = np.partition(d, k - 1, axis=1)[:, k - 1, None]
            near = np.argsort(np.where(d <= least, d, np.inf), axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(d, near, 1)
        row, column = np.nonzero(np.isfinite(value))
        out.append((ids[s : s + TILE][row], others[near[row, column]], value[row, column]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


class Cells:
    """Rows (id, x) of one dimension in cells, as a table; the driver holds pivots, radii and counts of cells."""

    def __init__(self, rows: DataFrame):
        importable(rows.sparkSession)
        ready = rows.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
        self.n = ready.count()
        self.centres = pivots(ready, self.n) if self.n else np.zeros((1, 1))
        self.table = materialize(in_cells(ready, self.centres), "cells")
        stats = self.table.groupBy("cell").agg(F.max("off").alias("off"), F.count("*").alias("n")).collect()  # one row a pivot
        self.radius = np.full(len(self.centres), -np.inf)
        for r in stats:
            self.radius[r["cell"]] = r["off"]
        sizes = np.zeros(len(self.centres), np.int64)
        for r in stats:
            sizes[r["cell"]] = r["n"]
        self.group = places(self.centres, sizes)
        whole = np.bincount(self.group, sizes).astype(int)
        self.counts = rows.sparkSession.createDataFrame([(r["cell"], int(self.group[r["cell"]]), int(whole[self.group[r["cell"]]])) for r in stats], "cell int, visit int, n long")

    def nearest(self, k: int) -> DataFrame:
        """(id, rank, other, distance) of the k nearest others of each row, ranks from 1; ties to the smaller id."""

        def bound(table: pa.Table) -> pa.Table:
            ids, x = table.column("id").to_numpy(), matrix(table.column("x"))
            row, _, d = _best(ids, x, ids, x, k)
            most = np.full(len(ids), np.inf)
            order = np.argsort(ids)
            at, n = np.unique(row, return_counts=True)
            full = at[n == k]
            top = np.full(len(full), 0.0)
            np.maximum.at(top, np.searchsorted(full, row[np.isin(row, full)]), d[np.isin(row, full)])
            most[order[np.searchsorted(ids[order], full)]] = top
            return table.select(["id", "x"]).append_column("most", pa.array(most))

        home = self.table.join(F.broadcast(self.counts), "cell").withColumn("sub", F.pmod(F.xxhash64(F.lit("home"), "id"), F.ceil(F.col("n") / F.lit(float(BLOCK)))))  # one row a pivot
        asks = materialize(home.select("visit", "sub", "id", "x").groupBy("visit", "sub").applyInArrow(bound, "id bigint, x array<double>, most double"), "bounds")
        visits = with_visits(asks, self.centres, self.radius, self.group, "most").drop("most")

        def search(table: pa.Table) -> pa.Table:
            side = table.column("side").to_numpy(zero_copy_only=False)
            ids, x = table.column("id").to_numpy(), matrix(table.column("x"))
            return pa.table(_best(ids[side], x[side], ids[~side], x[~side], k), names=["id", "other", "distance"])

        found = met(visits, self.table.select("id", "x", "cell"), self.counts).groupBy("visit", "ask_block", "block").applyInArrow(search, "id bigint, other bigint, distance double")
        place: Column = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
        return found.withColumn("rank", place).where(F.col("rank") <= k).select("id", "rank", "other", "distance")
