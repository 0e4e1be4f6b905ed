import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from docketry.operators import classify, kernel

SCHEMA = "id long, v array<double>, y int"


def rings(n, seed):
    """Two classes that no plane parts: an inner and an outer ring."""
    rng = np.random.default_rng(seed)
    y, turn = rng.integers(0, 2, n), rng.uniform(0, 2 * np.pi, n)
    r = 1 + 1.5 * y + rng.normal(size=n) * 0.15
    return np.c_[r * np.cos(turn), r * np.sin(turn), rng.normal(size=n) * 0.05], y


def test_features_approximate_the_kernel(spark):
    x, _ = rings(60, 1)
    exact = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(2))
    worst = {}
    for features in (64, 4096):
        lift = kernel.FourierFeatures(3, 0.7, features)
        rows = spark.createDataFrame([(k, v, 0) for k, v in enumerate(x.tolist())] + [(99, None, 0)], SCHEMA).withColumn("x", F.when(F.col("v").isNotNull(), array_to_vector("v")))
        got = {r["id"]: r["z"] for r in lift.transform(rows).select("id", F.when(F.col("z").isNotNull(), vector_to_array("z")).alias("z")).collect()}
        assert got.pop(99) is None
        z = np.array([got[k] for k in range(60)])
        assert np.allclose(z, lift.features(x))
        worst[features] = np.abs(z @ z.T - exact).mean()
    assert worst[4096] < 0.015 and worst[4096] < worst[64] / 3


def test_machine_is_as_good_as_an_exact_kernel_solve(spark):
    (x, y), (xt, yt) = rings(500, 2), rings(300, 3)
    rows = lambda a, b: spark.createDataFrame([(k, v, int(c)) for k, (v, c) in enumerate(zip(a.tolist(), b))], SCHEMA)
    found = {}
    for kind in ("rbf", "svm"):
        model = classify.fit(rows(x, y), "v", ["y"], kind, 2)
        scored = model.scores(rows(xt, yt), "v")
        found[kind] = (scored.where((F.col("score_y") >= 0.5) == (F.col("y") == 1)).count() / 300, classify.mean_entropy(scored, ["y"]))
        if kind == "rbf":
            with pytest.raises(ValueError, match="permutation_importance"):
                classify.importance(model)
            with pytest.raises(ValueError, match="stored"):
                classify.save(model, "/nowhere")
    gram = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / (2 * x[:, :2].var()))
    weights = np.linalg.solve(gram(x[:, :2], x[:, :2]) + 0.1 * np.eye(500), 2.0 * y - 1)
    exact = ((gram(xt[:, :2], x[:, :2]) @ weights > 0) == yt).mean()
    assert exact > 0.97 and found["rbf"][0] > exact - 0.02
    assert found["svm"][0] < 0.8 and found["rbf"][1] < found["svm"][1]


def test_parameters(spark):
    assert kernel.KernelSVC("y").setParams(gamma=0.5, features=32).features == 32
    with pytest.raises(ValueError, match="no such parameter"):
        kernel.KernelSVC("y").setParams(depth=3)
