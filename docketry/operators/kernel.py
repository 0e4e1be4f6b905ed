"""A kernel machine out of linear parts: random Fourier features of the Gaussian kernel before a linear support vector machine.

The features' inner products approximate exp(-gamma |x - y|^2); their error falls with the root of their number, whatever
the number of rows, so the fit stays a distributed linear one. Features are made in Arrow batches from a closure of
dimensions x features numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FourierFeatures(Transformer):
    """``out``: a vector of ``features`` entries of the vector ``column``; rows with a null vector get null."""

    def __init__(self, dims: int, gamma: float, features: int = 256, seed: int = 7, column: str = "x", out: str = "z"):
        super().__init__()
        rng = np.random.default_rng(seed)
        self.column, self.out = column, out
        self.frequencies = rng.normal(size=(dims, features)) * np.sqrt(2 * gamma)
        self.phases = rng.uniform(0, 2 * np.pi, features)

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.cos(x @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        frequencies, phases = self.frequencies, self.phases

        @F.pandas_udf("array<double>")
        def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                have = x.notna()
                out = pd.Series([None] * len(x), index=x.index, dtype=object)
                if have.any():
                    z = np.cos(np.stack(x[have].tolist()) @ frequencies + phases) * np.sqrt(2 / len(phases))
                    out[have] = pd.Series(list(z), index=x.index[have])
                yield out

        there = F.col(self.column).isNotNull()
        lifted = dataset.withColumn("_a", made(F.when(there, vector_to_array(self.column))))
        return lifted.withColumn(self.out, F.when(there, array_to_vector("_a"))).drop("_a")


class KernelSVC(Estimator):
    """A support vector machine with a Gaussian kernel; gamma is one over the dimensions times their mean variance unless given."""

    def __init__(self, label: str, column: str = "x", gamma: float | None = None, features: int = 256, seed: int = 7, iterations: int = 30, penalty: float = 1e-3):
        super().__init__()
        self.label, self.column, self.gamma, self.features, self.seed, self.iterations, self.penalty = label, column, gamma, features, seed, iterations, penalty

    def setParams(self, **params: float) -> KernelSVC:
        for k, v in params.items():
            if k not in ("gamma", "features", "seed", "iterations", "penalty"):
                raise ValueError(f"no such parameter: {k}")
            setattr(self, k, v)
        return self

    def _fit(self, dataset: DataFrame) -> KernelModel:
        variance = dataset.select(Summarizer.metrics("variance").summary(F.col(self.column)).alias("s")).select("s.variance").first()[0].toArray()
        gamma = self.gamma or 1 / max(1e-12, len(variance) * float(variance.mean()))
        lift = FourierFeatures(len(variance), gamma, self.features, self.seed, self.column, "_z")
        machine = LinearSVC(featuresCol="_z", labelCol=self.label, maxIter=self.iterations, regParam=self.penalty, standardization=False)
        return KernelModel(lift, machine.fit(lift.transform(dataset)))


class KernelModel(Model):
    def __init__(self, lift: FourierFeatures, machine: Model):
        super().__init__()
        self.lift, self.machine = lift, machine

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.machine.transform(self.lift.transform(dataset)).drop("_z")
