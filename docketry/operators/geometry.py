"""Distances and directions of vectors: summaries, histograms, pooling, subspaces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, population deviation, min, 5 %, 50 %, 95 % and max of a column."""
    q = lambda p: F.percentile(value, F.lit(p))
    return rows.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.max(value).alias("max"))


def counted_summary(rows: DataFrame, value: str, n: str, by: list[str]) -> DataFrame:
    """As ``summary`` for values that stand for n rows each."""
    # One map of values to counts for all three.
    q = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)), F.col(n))
    total, mean = F.sum(n), F.sum(F.col(value) * F.col(n)) / F.sum(n)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col(value) * F.col(value) * F.col(n)) / F.sum(n) - mean * mean))
    out = rows.groupBy(*by).agg(total.alias("n"), mean.alias("mean"), spread.alias("std"), F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max"))
    return out.select(*by, "n", "mean", "std", "min", *(F.get("q", k).alias(c) for k, c in enumerate(("p05", "p50", "p95"))), "max")


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, n: str | None = None) -> DataFrame:
    """(bin, n, density): equal bins over a closed range; the last one holds its upper end. ``n``: a column of counts."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = rows.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg((F.sum(n) if n else F.count("*")).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("bin", "n", (F.col("n") / (F.col("total") * width)).alias("density"))  # one row


def mean_pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, pooled): the mean of a key's vectors, scaled to length 1."""
    parts = rows.select(key, F.posexplode(vector).alias("at", "x")).groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    whole = parts.groupBy(key).agg(F.max("n").alias("n"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    return whole.select(key, "n", F.transform("v", lambda e: F.try_divide(e["x"], F.col("length"))).alias("pooled"))


def mean_pairwise_cosine(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, n, value): the mean cosine of all pairs of a group, from the sum of its unit vectors: (|s|^2 - n) / (n (n - 1))."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = rows.select(by, F.transform(vector, lambda x: x.cast("double") / length).alias("u"))
    sums = unit.select(by, F.posexplode("u").alias("at", "x")).groupBy(by, "at").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return sums.groupBy(by).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).where("n > 1").select(by, "n", ((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("value"))


class SubspaceProjection:
    """Removes the span of a few directions from vectors and scales what is left to length 1."""

    def __init__(self, directions: np.ndarray, tolerance: float = 1e-5):
        _, s, vt = np.linalg.svd(np.asarray(directions, np.float64), full_matrices=False)
        self.basis = vt[s > tolerance * s[0]] if len(s) else vt[:0]

    @property
    def rank(self) -> int:
        return len(self.basis)

    def project(self, x: np.ndarray, nothing: float = 1e-6) -> np.ndarray:
        """A vector that lies in the span becomes zero."""
        left = x - (x @ self.basis.T) @ self.basis
        length = np.linalg.norm(left, axis=1, keepdims=True)
        keep = length > nothing * np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(left, length, out=np.zeros_like(left), where=keep)

    def column(self, vector: Column) -> Column:
        """The projection as a column."""
        basis = self.basis

        @F.pandas_udf("array<double>")
        def run(vectors: pd.Series) -> pd.Series:
            own = SubspaceProjection.__new__(SubspaceProjection)
            own.basis = basis
            return pd.Series(list(own.project(np.stack([np.asarray(v, np.float64) for v in vectors])))) if len(vectors) else vectors

        return run(vector)


class OrthogonalTo(Transformer):
    """The projection as a stage of an ML pipeline."""

    def __init__(self, projection: SubspaceProjection, vector: str, out: str):
        super().__init__()
        self.projection, self.vector, self.out = projection, vector, out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.out, self.projection.column(F.col(self.vector)))


def mean_directions(rows: DataFrame, by: str, vector: str) -> dict:
    """The mean vector of each group; groups are few (a label, a country)."""
    parts = rows.select(by, F.posexplode(vector).alias("at", "x")).groupBy(by, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    got = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).orderBy(by).collect()
    return {r[by]: np.array([e["x"] for e in r["v"]]) for r in got}


def shift_decomposition(rows: DataFrame, doc: str, variant: str, base: str, shifted: str) -> DataFrame:
    """(variant, n, shift, fraction, consistency): how far a variant moves a document, and how much of that is its own.

    shift: mean cosine distance of both vectors. A document's moves have a mean common to its variants; the rest is the
    variant's. fraction: length of the rest by length of the move. consistency:
    mean cosine of all pairs of a variant's rests.
    """
    vectors = _rests(rows, doc, variant, base, shifted)
    stable = mean_pairwise_cosine(vectors.where("own > 0"), variant, "v").select(variant, F.col("value").alias("consistency"))
    out = vectors.groupBy(variant).agg(F.count("*").alias("n"), F.avg("shift").alias("shift"), F.avg(F.try_divide("own", "move")).alias("fraction"))
    return out.join(stable, variant, "left")


def direction_cosines(rows: DataFrame, doc: str, variant: str, base: str, shifted: str) -> DataFrame:
    """(left, right, value): cosine of the mean rests of each pair of variants, which are few."""
    parts = _rests(rows, doc, variant, base, shifted).select(variant, F.posexplode("v").alias("at", "x")).groupBy(variant, "at").agg(F.avg("x").alias("x"))
    length = parts.groupBy(variant).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    unit = parts.join(length, variant).select(F.col(variant).alias("left"), "at", F.try_divide("x", "length").alias("a"))
    other = unit.select(F.col("left").alias("right"), "at", F.col("a").alias("b"))
    return unit.join(other, "at").groupBy("left", "right").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def _rests(rows: DataFrame, doc: str, variant: str, base: str, shifted: str) -> DataFrame:
    """(variant, shift, own, move, v) of each document and variant: cosine distance, lengths of the rest and the move, the rest."""
    d = lambda x: x.cast("double")
    both = F.zip_with(shifted, base, lambda a, b: F.struct(d(a).alias("s"), d(b).alias("b")))
    moves = rows.select(doc, variant, F.posexplode(both).alias("at", "e")).select(doc, variant, "at", F.col("e.s").alias("s"), F.col("e.b").alias("b"), (F.col("e.s") - F.col("e.b")).alias("d"))
    common = moves.groupBy(doc, "at").agg(F.avg("d").alias("g"))
    left = F.col("d") - F.col("g")
    cosine = F.try_divide(F.sum(F.col("s") * F.col("b")), F.sqrt(F.sum(F.col("s") ** 2)) * F.sqrt(F.sum(F.col("b") ** 2)))
    rest = moves.join(common, [doc, "at"]).groupBy(doc, variant).agg(
        (1 - cosine).alias("shift"), F.sqrt(F.sum(left**2)).alias("own"), F.sqrt(F.sum(F.col("d") ** 2)).alias("move"), F.array_sort(F.collect_list(F.struct("at", left.alias("x")))).alias("v")
    )
    return rest.select(variant, "shift", "own", "move", F.transform("v", lambda e: e["x"]).alias("v"))
