"""Whitening of vectors by their leading principal components.

The covariance is never formed: a round of the solver multiplies it with a thin
block of vectors by one pass over the rows, summed by partition. A Chebyshev
polynomial of those products damps what isn't wanted, QR makes the block
orthonormal again, and Rayleigh-Ritz reads the components off, until they are
certified. The driver holds blocks of dimensions x ``wanted + EXTRA``.

Cases: rows with a null vector or a null or non-finite entry are dropped; a
null id stays null. Each length of vector is fitted by itself. Repeated rows
each get their result, but a vector counts once in the fit. Components without
variance (all of them, where one distinct vector is left) aren't returned, as
nothing can be scaled by their deviation. A deviation that doesn't fit a long
is null. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import importable, materialize

#: Vectors of the block beyond the wanted ones, the polynomial's degree, steps of the estimate of the spectrum's lower end, most steps of a certificate.
EXTRA, DEGREE, STEPS, PROOF = 16, 10, 8, 64
#: Bytes of a stored block of vectors.
BLOCK_BYTES = 1 << 16
#: Residuals of unit components relative to the largest variance: certified at GOOD once they stop falling, at BEST at once.
GOOD, BEST = 1e-11, 1e-14
#: A component whose variance is below this share of the largest has none.
NOTHING = 1e-13

Product = Callable[[np.ndarray], np.ndarray]


def _orthonormal(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x)[0]


def ends(product: Product, start: np.ndarray, steps: int, beside: np.ndarray | None = None, enough: float = -np.inf) -> tuple[float, float]:
    """Estimates (below the smallest, above the largest) of the eigenvalues by Lanczos steps, widened by the residual.

    ``beside``: on the space orthogonal to these columns; ``enough``: the steps end once all is below it, or something above.
    """
    out = (lambda x: x - beside @ (beside.T @ x)) if beside is not None else (lambda x: x)
    q = out(start)
    basis, image = [q / np.linalg.norm(q)], []
    for _ in range(steps):
        image.append(out(product(basis[-1][:, None])[:, 0]))
        b, v = np.array(basis).T, np.array(image).T
        theta = np.linalg.eigvalsh((b.T @ v + v.T @ b) / 2)
        rest = image[-1] - b @ (b.T @ image[-1])
        rest -= b @ (b.T @ rest)
        left = float(np.linalg.norm(rest))
        if left <= 1e-12 * max(abs(theta[-1]), 1e-300) or len(basis) >= len(start):
            left = 0.0
            break
        if theta[-1] + left <= enough or theta[-1] > enough > -np.inf:
            break
        basis.append(rest / left)
    return float(theta[0] - left), float(theta[-1] + left)


def leading(product: Product, d: int, wanted: int, seed: int = 13, log: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns; ``product(Q)`` is V Q for a symmetric V without negative eigenvalues.

    Certified: each residual is small, and the largest eigenvalue outside of the block is below the last wanted one. A
    block that can't be certified is doubled; one of all ``d`` dimensions is exact at once.
    """
    rng = np.random.default_rng(seed)
    wanted = min(wanted, d)
    low = max(0.0, ends(product, rng.normal(size=d), STEPS)[0])
    k = min(d, wanted + EXTRA)
    q = _orthonormal(rng.normal(size=(d, k)))
    before = np.inf
    for turn in range(1, 1000):
        image = product(q)
        theta, w = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
        theta, w = theta[::-1], w[:, ::-1]
        q, image = q @ w, image @ w
        top = max(theta[0], 0.0)
        residual = float(np.linalg.norm(image - q * theta, axis=0)[:wanted].max())
        if log is not None:
            log.append((turn, q.shape[1], residual))
        stuck = residual > before / 2
        settled = residual <= BEST * top or (residual <= GOOD * top and stuck)
        if q.shape[1] == d:
            return theta[:wanted], q[:, :wanted]
        last = theta[wanted - 1] * (1 + 1e-12)
        if settled and (top == 0.0 or ends(product, rng.normal(size=d), PROOF, q, last)[1] <= last):
            return theta[:wanted], q[:, :wanted]
        cut = theta[-1]
        if settled or stuck or cut <= low * (1 + 1e-12):
            # Nothing to damp between the ends, or too little apart from what is wanted: a wider block.
            q, before, low = _orthonormal(np.hstack([q, rng.normal(size=(d, min(q.shape[1], d - q.shape[1])))])), np.inf, min(low, 0.5 * cut)
            continue
        before = residual
        # T_DEGREE of V, mapped so that [low, cut] becomes [-1, 1], and scaled by its value at the largest eigenvalue.
        c, h = (cut + low) / 2, (cut - low) / 2
        sigma = first = h / (top - c)
        old, now = q, (image - c * q) * (first / h)
        for _ in range(DEGREE - 1):
            new_sigma = 1 / (2 / first - sigma)
            old, now = now, 2 * new_sigma / h * (product(now) - c * now) - sigma * new_sigma * old
            sigma = new_sigma
        q = _orthonormal(now)
    raise RuntimeError("the components can't be certified")


@dataclass
class Whitening:
    """What a fit holds: the number of distinct vectors, exact sums, variances, components as columns, their shares, and the error of the identity."""

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float


def _rows(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), d)


def _packed(distinct: DataFrame) -> DataFrame:
    """(d, block): vectors of one length as bytes, BLOCK_BYTES or a vector a row, so that a pass reads no lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                x = _rows(b.take(pa.array(np.flatnonzero(lengths == d))), "x", d)
                step = max(1, BLOCK_BYTES // (8 * d))
                blocks = [x[k : k + step].tobytes() for k in range(0, len(x), step)]
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], ["d", "block"])

    return distinct.mapInArrow(run, "d int, block binary")


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for b in batches:
        for block in b.column("block"):
            yield np.frombuffer(block.as_buffer(), np.int64).reshape(-1, d)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _furthest(x: np.ndarray, n: int, sums: list[int]) -> int:
    """A bound of the entries of n x - S."""
    return n * _largest(x) + max((abs(s) for s in sums), default=0)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, rounded once where n x - S fits a long."""
    if _furthest(x, n, sums) < 2**63:
        return (n * x - np.array(sums, np.int64)) / n
    return x - np.array([s / n for s in sums])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The exact sum of (n x - S)^2 over the dimensions of each row."""
    if len(sums) * _furthest(x, n, sums) ** 2 < 2**63:
        y = n * x - np.array(sums, np.int64)
        return pa.array((y * y).sum(1))
    each = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array([v if v < 2**63 else None for v in each], pa.int64())


def _summed(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over partitions of the array that ``part`` makes of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = part(batches).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value))), pa.array(value)], ["i", "v"])

    got = rows.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # one number an entry of a thin block
    out = np.zeros(len(got))
    for r in got:
        out[r["i"]] = r["v"]
    return out


def _exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for x in _blocks(batches, d):
            n += len(x)
            own = x.sum(0).tolist() if _largest(x) * len(x) < 2**63 else [sum(c) for c in x.T.tolist()]
            sums = [s + o for s, o in zip(sums, own, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int64()), pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(38, 0))], ["i", "v"])

    got = {r["i"]: int(r["v"]) for r in rows.mapInArrow(run, "i bigint, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()}  # one number a dimension
    return got[-1], [got[k] for k in range(d)]


def fit(rows: DataFrame, *, vector: str = "x", components: int = 4, seed: int = 13) -> dict[int, Whitening]:
    """A whitening for each length of vector. ``vector`` is an array of longs; each distinct one counts once."""
    importable(rows.sparkSession)
    packed = materialize(_packed(rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(vector).alias("x")).distinct()), "distinct-vectors")
    lengths = [r["d"] for r in packed.select("d").distinct().collect()]  # one row a length
    return {d: _fit(packed.where(F.col("d") == d).select("block"), d, components, seed) for d in sorted(lengths)}


def _fit(distinct: DataFrame, d: int, components: int, seed: int) -> Whitening:
    n, sums = _exact_sums(distinct, d)

    def product(q: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros((d, q.shape[1]))
            for x in _blocks(batches, d):
                c = _centred(x, n, sums)
                total += c.T @ (c @ q)
            return total

        return _summed(distinct, part).reshape(d, -1) / n

    def squares(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        return np.array([sum(float((_centred(x, n, sums) ** 2).sum()) for x in _blocks(batches, d))])

    trace = float(_summed(distinct, squares)[0]) / n
    values, vectors = leading(product, d, components, seed) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    good = values > NOTHING * max(trace, 0.0)
    values, vectors = values[good], vectors[:, good]
    scaled, k = vectors / np.sqrt(values), len(values)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((k + 1, k))
        for x in _blocks(batches, d):
            w = _centred(x, n, sums) @ scaled
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        return total

    error = 0.0
    if k:
        m = _summed(distinct, moments).reshape(k + 1, k) / n
        error = float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())
    return Whitening(n, sums, values, vectors, values / trace if k else values, error)


def whitened(rows: DataFrame, fits: dict[int, Whitening], *, key: str = "id", vector: str = "x") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each row with a fit of its length."""
    kind = rows.schema[key].dataType.simpleString()
    names = ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for d, f in fits.items():
                at, k = np.flatnonzero(lengths == d), len(f.variances)
                if not len(at) or not k:
                    continue
                own = b.take(pa.array(at))
                x = _rows(own, "x", d)
                w = _centred(x, f.n, f.sums) @ (f.components / np.sqrt(f.variances))
                each = np.repeat(np.arange(len(x)), k)
                number = np.tile(np.arange(k), len(x))
                yield pa.RecordBatch.from_arrays(
                    [own.column("key").take(pa.array(each)), pa.array(number.astype(np.int32) + 1), pa.array(np.full(len(each), f.n)), _deviations(x, f.n, f.sums).take(pa.array(each)), pa.array(w.ravel()), pa.array(f.explained[number]), pa.array(np.full(len(each), f.identity_error))],
                    names,
                )

    ready = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("x"))
    return ready.mapInArrow(run, f"key {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").withColumnRenamed("key", key)
