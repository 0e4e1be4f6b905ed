"""A layout of few dimensions that keeps neighbours: fuzzy weights of the graph of nearest neighbours, and its leading
eigenvectors by block power iteration, sped up by Chebyshev polynomials.

The graph and the block are tables; a step joins them and sums by row. After a few steps the driver sees products of the block with itself,
a matrix of as many rows and columns as the block has vectors, and makes from it the next orthonormal block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators.neighbours import Cells
from docketry.session import forget, importable, materialize

#: Vectors of the block beyond the wanted ones, steps between two orthonormal blocks, most blocks, and when the values stand still.
EXTRA, STEPS, MOST, STILL = 4, 6, 8, 1e-3


def bandwidths(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rho, sigma) of each row of distances (missing ones infinite): sum of exp(-(d - rho)+ / sigma) is log2(k), rho the least positive distance."""
    rho = np.where(d > 0, d, np.inf).min(1)
    rho = np.where(np.isfinite(rho), rho, 0.0)
    over = np.maximum(d - rho[:, None], 0)
    scale = np.where(np.isfinite(over), over, 0).max(1) + 1e-12
    low, high = scale * 1e-6, scale * 1e6
    for _ in range(80):
        mid = np.sqrt(low * high)
        much = np.exp(-over / mid[:, None]).sum(1) > math.log2(k)
        low, high = np.where(much, low, mid), np.where(much, mid, high)
    return rho, high


def fuzzy_graph(near: DataFrame, k: int) -> DataFrame:
    """(a, b, w) both ways from (id, other, distance), k a row: p + q - p q of the two weights of a pair, each by its own row's bandwidth."""
    importable(near.sparkSession)
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("l")).select("id", F.col("l.other").alias("other"), F.col("l.distance").alias("distance"))  # k a row

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("other").value_lengths().to_numpy(zero_copy_only=False)
            held = np.arange(k)[None, :] < n[:, None]
            d = np.full((len(n), k), np.inf)
            d[held] = b.column("distance").flatten().to_numpy()
            rho, sigma = bandwidths(d, k)
            w = np.exp(-np.maximum(d - rho[:, None], 0) / sigma[:, None])
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(np.repeat(np.arange(len(n)), n))), b.column("other").flatten(), pa.array(w[held])], ["a", "b", "w"])

    one = lists.mapInArrow(weigh, "a bigint, b bigint, w double")
    both = one.select("a", "b", "w", F.lit(0.0).alias("back")).union(one.select("b", "a", F.lit(0.0), "w"))
    return both.groupBy("a", "b").agg(F.max("w").alias("p"), F.max("back").alias("q")).select("a", "b", (F.col("p") + F.col("q") - F.col("p") * F.col("q")).alias("w"))


def spectral(graph: DataFrame, dims: int, seed: int = 42) -> DataFrame:
    """(id, x) of the nodes of a symmetric graph (a, b, w): the eigenvectors of the normalised graph after the first, divided by the root of the degree."""
    degree = graph.groupBy("a").agg(F.sum("w").alias("degree"))
    d = lambda name: degree.select(F.col("a").alias(name), F.col("degree").alias(f"d_{name}"))
    edges = materialize(graph.join(d("a"), "a").join(d("b"), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("d_a") * F.col("d_b"))).alias("s")), "layout-graph")
    m = dims + 1 + EXTRA
    names = [f"y{k}" for k in range(m)]
    draw = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "id") / F.lit(2.0**63)
    # The first vector is the one of eigenvalue 1, the others are drawn.
    start = degree.select(F.col("a").alias("id"), "degree").select("id", "degree", F.sqrt("degree").alias("y0"), *(draw(k).alias(names[k]) for k in range(1, m)))
    block, before, cut = materialize(start, "layout"), np.zeros(dims + 1), 0.5

    def product(rows: DataFrame) -> DataFrame:
        """``rows`` with ``z``: the graph's product with ``y``."""
        sums = edges.join(rows.select(F.col("id").alias("b"), *names), "b").groupBy("a").agg(*(F.sum(F.col("s") * F.col(c)).alias(f"z{k}") for k, c in enumerate(names)))
        return rows.join(sums.withColumnRenamed("a", "id"), "id")

    for _ in range(MOST):
        # The polynomial that stays small on [-1, cut], scaled to 1 at 1: what has a value below the block's least one is damped.
        c, h = (cut - 1) / 2, (cut + 1) / 2
        sigma = first = h / (1 - c)
        moved = product(block).select("id", "degree", *(F.col(n).alias(f"o{k}") for k, n in enumerate(names)), *(((F.col(f"z{k}") - c * F.col(n)) * (first / h)).alias(n) for k, n in enumerate(names)))
        for _ in range(STEPS - 1):
            next_sigma = 1 / (2 / first - sigma)
            now = [((F.col(f"z{k}") - c * F.col(n)) * (2 * next_sigma / h) - sigma * next_sigma * F.col(f"o{k}")).alias(n) for k, n in enumerate(names)]
            moved = product(moved).select("id", "degree", *(F.col(n).alias(f"o{k}") for k, n in enumerate(names)), *now)
            sigma = next_sigma
        moved = materialize(moved.select("id", "degree", *names), "layout")
        image = materialize(product(moved), "layout")
        forget(moved)
        cells = [(i, j) for i in range(m) for j in range(i, m)]
        got = image.agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in cells), *(F.sum(F.col(names[i]) * F.col(f"z{j}")).alias(f"h{i}_{j}") for i, j in cells)).first()
        g, h = (np.array([[got[f"{c}{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)]) for c in "gh")
        size, basis = np.linalg.eigh(g)
        good = size > 1e-12 * size[-1]
        root = basis[:, good] / np.sqrt(size[good])
        value, turn = np.linalg.eigh(root.T @ h @ root)
        turn, value = root @ turn[:, ::-1], value[::-1]
        cut = min(max(float(value[-1]), -0.5), 1 - 1e-6)
        turn = np.pad(turn, ((0, 0), (0, m - turn.shape[1])))
        # The sign is fixed by the largest entry of the turn, so reruns agree.
        turn *= np.where(turn[np.abs(turn).argmax(0), np.arange(m)] < 0, -1, 1)
        block = image.select("id", "degree", *(sum((F.col(names[i]) * float(turn[i, j]) for i in range(m)), F.lit(0.0)).alias(names[j]) for j in range(m)))
        now = np.pad(value, (0, m))[: dims + 1]
        if np.abs(now - before).max() <= STILL * max(1e-12, 1 - now[-1]):
            break
        before = now
    return block.select("id", F.array(*(F.col(c) / F.sqrt("degree") for c in names[1 : dims + 1])).alias("x"))


def laid_out(rows: DataFrame, dims: int = 5, neighbours: int = 15, *, key: str = "id", vector: str = "x", seed: int = 42) -> DataFrame:
    """(key, x): each row of unit length, then by its neighbours in ``dims`` dimensions; rows whose vector is null, zero or holds null or missing entries are left out."""
    v = F.transform(vector, lambda e: e.cast("double"))
    ready = rows.select(F.col(key).cast("long").alias("id"), v.alias("x")).where("id is not null and x is not null and size(x) > 0 and not exists(x, e -> e is null or isnan(e))").dropDuplicates(["id"])
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e))
    unit = materialize(ready.withColumn("l", length).where("l > 0").select("id", F.transform("x", lambda e: e / F.col("l")).alias("x")), "unit")
    if unit.limit(2).count() < 2:
        return unit.select(F.col("id").alias(key), F.array_repeat(F.lit(0.0), dims).alias("x"))
    graph = fuzzy_graph(Cells(unit).nearest(neighbours), neighbours)
    return spectral(graph, dims, seed).withColumnRenamed("id", key)
