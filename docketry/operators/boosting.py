"""Second-order boosting of trees for one or several labels at once.

Each tree is grown level by level from sums of gradients and hessians. A feature's values
are cut into bins at its quantiles; in every task a level's rows are summed into cells
(node, feature, bin), cells are added by group, and cumulative sums over a feature's
bins give the gain of each split,

    sum over labels of  GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2),

of which the largest is taken, ties to the smaller feature, then the lower bin. A tree has one
value a label in each leaf, -rate * G / (H + l2). The loss is the logistic one of each label.

Gradients and hessians are whole numbers of 2^-24, so their sums are exact: they don't depend on the order
of tasks, and a lost executor changes nothing. What is shuffled is at most a cell per partition; the driver sees one row
per node of a level. A task holds 2^depth x features x bins sums a label. Rows are drawn for a tree by a hash of their key. Margins are
written to a table after ``WRITTEN`` trees, so a row is never sent through more trees than that.

Defined cases: rows with a null vector, key or label take no part in a fit, and a null vector has a null
probability. A NaN or null component is below every cut. Rows that repeat a key are drawn together.
Without rows, or where no split gains, trees are leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.session import forget, importable, materialize

#: Gradients and hessians are whole numbers of this.
GRAIN = 2.0**-24
#: Trees after which the rows' margins are written.
WRITTEN = 10
#: A bin is one byte.
MOST_BINS = 256


@dataclass
class Tree:
    """Node n has the children 2n + 1 and 2n + 2; a leaf's feature is -1. Rows whose bin is at most ``bin`` go left."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row after ``depth`` levels."""
        at = np.zeros(len(bins), np.int64)
        row = np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (bins[row, np.maximum(f, 0)] > self.bin[at]))
        return at


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each component: the number of its feature's edges below it; NaN is below all."""
    out = np.zeros(x.shape, np.uint8)
    for k, e in enumerate(edges):
        out[:, k] = np.where(np.isnan(x[:, k]), 0, np.searchsorted(e, x[:, k]))
    return out


def drawn(hashes: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Which rows a tree is grown on: those whose mixed hash falls below the share."""
    z = hashes.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (tree + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share


def slopes(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the logistic loss, in whole grains."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - y) / GRAIN).astype(np.int64), np.rint(p * (1 - p) / GRAIN).astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column as doubles, null components as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def quantile_edges(rows: DataFrame, x: str, features: int, bins: int) -> list[np.ndarray]:
    """The cuts of each feature: its approximate quantiles, once each. At most ``bins`` - 1 numbers a feature come back."""
    cuts = F.percentile_approx("v", F.array(*(F.lit(k / bins) for k in range(1, bins))), F.lit(10_000)).alias("e")
    each = rows.select(F.posexplode(x).alias("k", "v")).where("v is not null and not isnan(v)")
    found = {r["k"]: np.unique(r["e"]) for r in each.groupBy("k").agg(cuts).collect()}  # one row a feature
    return [found.get(k, np.empty(0)) for k in range(features)]


@dataclass
class BoostedModel:
    """Trees over the bins of ``edges``; a label's margin begins at ``base``."""

    features_col: str
    edges: list[np.ndarray]
    base: np.ndarray
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """The margin of each row and label."""
        out = np.tile(self.base, (len(bins), 1))
        for tree in self.trees:
            out += tree.value[tree.nodes(bins, self.depth)]
        return out

    def probabilities(self, x: Column) -> Column:
        """The chance of each label, as an array."""
        model, width, labels = self, len(self.edges), len(self.base)

        @F.arrow_udf("array<double>")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                here = b.is_valid().to_numpy(zero_copy_only=False)
                p = 1 / (1 + np.exp(-model.margins(binned(_matrix(b.drop_null(), width), model.edges))))
                ends = np.concatenate([[0], np.cumsum(np.where(here, labels, 0))]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(p.ravel()), mask=pa.array(~here))

        return score(x)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``probability`` (against, for) of the first label."""
        importable(rows.sparkSession)
        there = F.col(self.features_col).isNotNull()
        p = F.get(self.probabilities(F.when(there, vector_to_array(self.features_col))), 0)
        return rows.withColumn("_p", p).withColumn("probability", F.when(F.col("_p").isNotNull(), array_to_vector(F.array(1 - F.col("_p"), "_p")))).drop("_p")

    @property
    def featureImportances(self) -> DenseVector:
        """Each feature's share of all gain."""
        total = np.zeros(len(self.edges))
        for tree in self.trees:
            split = tree.feature >= 0
            np.add.at(total, tree.feature[split], tree.gain[split])
        return Vectors.dense(total / (total.sum() or 1.0))


@dataclass
class NewtonBoost:
    """Fits ``BoostedModel`` on vectors ``features_col`` and 0/1 columns ``labels``.

    share: part of the rows that each tree is grown on, by a hash of ``key`` (default: of the vector).
    """

    labels: list[str]
    features_col: str = "x"
    rounds: int = 20
    depth: int = 3
    rate: float = 0.3
    l2: float = 1.0
    least_gain: float = 0.0
    least_weight: float = 1.0
    share: float = 1.0
    bins: int = 32
    seed: int = 7
    key: str | None = None

    def setParams(self, **params: object) -> NewtonBoost:
        for k, v in params.items():
            if k not in self.__dataclass_fields__:
                raise ValueError(f"no such parameter: {k}")
            setattr(self, k, v)
        return self

    def fit(self, rows: DataFrame) -> BoostedModel:
        if not 2 <= self.bins <= MOST_BINS:
            raise ValueError(f"bins must be from 2 to {MOST_BINS}")
        importable(rows.sparkSession)
        x = vector_to_array(self.features_col)
        y = F.array(*(F.col(c).cast("double") for c in self.labels))
        known = rows.where(F.col(self.features_col).isNotNull()).select(F.xxhash64(F.lit(self.seed), self.key or x).alias("k"), x.alias("x"), y.alias("y"), *([F.col(self.key).alias("own")] if self.key else []))
        known = known.where(~F.exists("y", lambda v: v.isNull()))
        known = known.where("own is not null").drop("own") if self.key else known
        rates = known.agg(F.max(F.size("x")).alias("width"), *(F.avg(F.get("y", k)).alias(f"r{k}") for k in range(len(self.labels)))).first()
        prior = np.clip([0.5 if rates[f"r{k}"] is None else rates[f"r{k}"] for k in range(len(self.labels))], 1e-6, 1 - 1e-6)
        edges = quantile_edges(known, "x", rates["width"] or 0, self.bins)
        model = BoostedModel(self.features_col, edges, np.log(prior / (1 - prior)), self.depth)
        table = materialize(self._with_bins(known, model), "boosting")
        done = 0
        for number in range(self.rounds):
            if number - done == WRITTEN:
                moved = materialize(self._moved(table, model.trees[done:]), "boosting")
                forget(table)
                table, done = moved, number
            model.trees.append(self._grown(table, model.trees[done:], number))
        forget(table)
        return model

    def _with_bins(self, known: DataFrame, model: BoostedModel) -> DataFrame:
        """(k, b, y, m): hash, bins as bytes, labels, margins."""
        edges, base = model.edges, model.base

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = binned(_matrix(b.column(1), len(edges)), edges)
                margins = pa.array([base.tolist()] * len(b), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in cells], pa.binary()), b.column(2), margins], ["k", "b", "y", "m"])

        return known.select("k", "x", "y").mapInArrow(run, "k bigint, b binary, y array<double>, m array<double>")

    def _rows(self, b: pa.RecordBatch, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, bins, labels, and margins after ``trees``."""
        bins = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(b), -1)
        margin = _matrix(b.column(3), len(self.labels))
        for tree in trees:
            margin = margin + tree.value[tree.nodes(bins, self.depth)]
        return b.column(0).to_numpy(), bins, _matrix(b.column(2), len(self.labels)), margin

    def _moved(self, table: DataFrame, trees: list[Tree]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    margins = pa.array(self._rows(b, trees)[3].tolist(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], margins], ["k", "b", "y", "m"])

        return table.mapInArrow(run, table.schema)

    def _cells(self, table: DataFrame, before: list[Tree], tree: Tree, level: int, number: int) -> DataFrame:
        """(node, feature, bin, g.., h..): sums over the drawn rows of a level's nodes."""
        labels, share, width, first = len(self.labels), self.share, self.bins, 2**level - 1
        names = [f"{c}{k}" for c in "gh" for k in range(labels)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: np.ndarray | None = None
            for b in batches:
                if not len(b):
                    continue
                hashes, bins, y, margin = self._rows(b, before)
                at = tree.nodes(bins, level) - first
                take = drawn(hashes, number, share) & (at >= 0)
                g, h = slopes(margin[take], y[take])
                at, bins = at[take], bins[take]
                if total is None:
                    total = np.zeros((2 * labels, 2**level * bins.shape[1] * width), np.int64)
                for f in range(bins.shape[1]):
                    cell = (at * bins.shape[1] + f) * width + bins[:, f]
                    for k in range(labels):
                        np.add.at(total[k], cell, g[:, k])
                        np.add.at(total[labels + k], cell, h[:, k])
            if total is not None and total.shape[1]:
                full = np.flatnonzero(total.any(0))
                node, rest = np.divmod(full, total.shape[1] >> level)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (node + first, rest // width, rest % width, *total[:, full])], ["node", "feature", "bin", *names])

        cells = table.mapInArrow(run, ", ".join(f"{c} bigint" for c in ("node", "feature", "bin", *names)))
        return cells.groupBy("node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in names))

    def _best(self, cells: DataFrame) -> DataFrame:
        """(node, best, g.., h..): the best split of each node and its whole sums; best is null where no split may be."""
        labels = range(len(self.labels))
        names = [f"{c}{k}" for c in "gh" for k in labels]
        all_bins = Window.partitionBy("node", "feature")
        so_far = all_bins.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = cells.select("node", "feature", "bin", *(F.sum(c).over(so_far).alias(f"l{c}") for c in names), *(F.sum(c).over(all_bins).alias(c) for c in names))
        term = lambda g, h: (g * GRAIN) * (g * GRAIN) / (h * GRAIN + self.l2)
        gain = F.lit(0.0)
        for k in labels:
            g, h, lg, lh = (F.col(c) for c in (f"g{k}", f"h{k}", f"lg{k}", f"lh{k}"))
            gain = gain + (term(lg, lh) + term(g - lg, h - lh) - term(g, h))
        weight = lambda cs: sum(cs[1:], cs[0]) * (GRAIN / len(labels))
        left = weight([F.col(f"lh{k}") for k in labels])
        right = weight([F.col(f"h{k}") - F.col(f"lh{k}") for k in labels])
        allowed = (left >= self.least_weight) & (right >= self.least_weight) & (F.col("gain") > self.least_gain)
        split = F.when(allowed, F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), *(f"l{c}" for c in names)))
        return sums.withColumn("gain", gain).groupBy("node").agg(F.max(split).alias("best"), *(F.first(c).alias(c) for c in names))

    def _grown(self, table: DataFrame, before: list[Tree], number: int) -> Tree:
        size, labels = 2 ** (self.depth + 1) - 1, len(self.labels)
        tree = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros((size, labels)), np.zeros(size))
        leaf = lambda g, h: [-self.rate * (a * GRAIN) / (b * GRAIN + self.l2) for a, b in zip(g, h, strict=True)]
        for level in range(self.depth):
            grown = False
            for r in self._best(self._cells(table, before, tree, level, number)).collect():  # one row a node of the level
                n, best = r["node"], r["best"]
                g, h = ([r[f"{c}{k}"] for k in range(labels)] for c in "gh")
                tree.value[n] = leaf(g, h)
                if best is None:
                    continue
                grown = True
                tree.feature[n], tree.bin[n], tree.gain[n] = -best["f"], -best["b"], best["gain"]
                lg, lh = ([best[f"l{c}{k}"] for k in range(labels)] for c in "gh")
                tree.value[2 * n + 1] = leaf(lg, lh)
                tree.value[2 * n + 2] = leaf([a - b for a, b in zip(g, lg, strict=True)], [a - b for a, b in zip(h, lh, strict=True)])
            if not grown:
                break
        return tree
