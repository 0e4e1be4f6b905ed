"""Vector columns as numpy matrices, for the two vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is neither null, empty nor zero and holds finite numbers only."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce((F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def whole(vector: str, factor: int = 256) -> Column:
    """floor(factor * x) of each entry as longs; null where the vector is null or holds a null or non-finite entry."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(F.coalesce(F.forall(v, finite), F.lit(False)), F.transform(v, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("long")))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as float64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def by_dimension(batch: pa.RecordBatch, vector: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) for each length of vector in a batch."""
    lengths = batch.column(vector).value_lengths().to_numpy()
    out = []
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        out.append((d, rows, matrix(batch.column(vector).take(pa.array(rows)))))
    return out


def count_by_dimension(rows: DataFrame, vector: str) -> dict[int, int]:
    return {r["d"]: r["count"] for r in rows.groupBy(F.size(vector).alias("d")).count().collect()}  # one row per dimension


def sample_by_dimension(rows: DataFrame, key: str, vector: str, most: int, seed: str, have: dict[int, int] | None = None) -> dict[int, np.ndarray]:
    """At most about ``most`` rows of each dimension, chosen by a hash of the key: a bounded, repeatable sample."""
    have = count_by_dimension(rows, vector) if have is None else have
    draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000_000))
    bound: Column = F.lit(1_000_000_000)
    for d, n in have.items():
        if n > most:
            bound = F.when(F.size(vector) == d, F.lit(int(1_000_000_000 * most / n))).otherwise(bound)
    found: dict[int, list] = {d: [] for d in have}
    for r in rows.where(draw < bound).select(key, vector).orderBy(key).collect():  # about ``most`` rows a dimension
        found[len(r[vector])].append(r[vector])
    return {d: np.array(x, np.float64) for d, x in found.items() if x}
