import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from docketry.operators import boosting, classify

SCHEMA = "id long, v array<double>, y int, z int"


def sample(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    noise = rng.normal(size=n) * 0.3
    return x, (x[:, 0] * x[:, 1] + noise > 0).astype(int), (x[:, 2] + noise > 0.5).astype(int)


def frame(spark, x, *labels):
    rows = [(k, v, *(int(c[k]) for c in labels)) for k, v in enumerate(x.tolist())]
    return spark.createDataFrame(rows, ", ".join(SCHEMA.split(", ")[: 2 + len(labels)])).withColumn("x", array_to_vector("v"))


def plain(x, y, hashes, edges, base, boost):
    """The same trees, node by node: every split of every node is tried and its sums are made anew."""
    bins = np.stack([[sum(v > e for e in edges[k]) for v in x[:, k]] for k in range(x.shape[1])], 1)
    margin, trees = np.tile(base, (len(x), 1)), []
    for number in range(boost.rounds):
        take = boosting.drawn(hashes, number, boost.share)
        g, h = boosting.slopes(margin, y)
        splits, values, at = {}, {}, np.zeros(len(x), int)
        term = lambda a, b: (a * boosting.GRAIN) * (a * boosting.GRAIN) / (b * boosting.GRAIN + boost.l2)
        for node in range(2 ** (boost.depth + 1) - 1):
            own = take & (at == node)
            if node and (node - 1) // 2 not in splits:
                continue
            G, H = g[own].sum(0), h[own].sum(0)
            values[node] = -boost.rate * (G * boosting.GRAIN) / (H * boosting.GRAIN + boost.l2)
            found = None
            for f in range(x.shape[1]) if node < 2**boost.depth - 1 else ():
                for b in range(boost.bins):
                    left = own & (bins[:, f] <= b)
                    lg, lh = g[left].sum(0), h[left].sum(0)
                    gain = 0.0
                    for k in range(y.shape[1]):
                        gain = gain + (term(lg[k], lh[k]) + term(G[k] - lg[k], H[k] - lh[k]) - term(G[k], H[k]))
                    small = min(lh.sum(), (H - lh).sum()) * (boosting.GRAIN / y.shape[1])
                    if small >= boost.least_weight and gain > boost.least_gain and (found is None or gain > found[0]):
                        found = (gain, f, b)
            if found:
                splits[node] = found[1:]
                at = np.where(at == node, 2 * node + 1 + (bins[:, found[1]] > found[2]), at)
        margin = margin + np.stack([values[n] for n in at])
        trees.append((splits, values))
    return trees, margin


@pytest.mark.parametrize("share", [1.0, 0.7])
def test_trees_equal_a_plain_version_split_by_split(spark, share, monkeypatch):
    # Margins are written between the trees too.
    monkeypatch.setattr(boosting, "WRITTEN", 2)
    x, y, z = sample(400, 1)
    rows = frame(spark, x, y, z)
    boost = boosting.NewtonBoost(["y", "z"], rounds=3, depth=3, share=share, bins=8, key="id")
    model = boost.fit(rows.repartition(3))
    hashes = np.array([r[0] for r in rows.orderBy("id").select(F.xxhash64(F.lit(7), "id")).collect()])
    trees, margin = plain(x, np.stack([y, z], 1).astype(float), hashes, model.edges, model.base, boost)
    for tree, (splits, values) in zip(model.trees, trees, strict=True):
        assert {n: (int(tree.feature[n]), int(tree.bin[n])) for n in np.flatnonzero(tree.feature >= 0)} == splits
        for n, v in values.items():
            assert np.allclose(tree.value[n], v, atol=1e-12)
    assert sum(len(s) for s, _ in trees) > 9
    got = np.array([r[0] for r in rows.orderBy("id").select(model.probabilities(vector_to_array("x"))).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))


def test_partitions_change_nothing(spark):
    rows = frame(spark, *sample(300, 2)[:2])
    one, many = (boosting.NewtonBoost(["y"], rounds=2, depth=2, key="id").fit(rows.repartition(n)) for n in (1, 7))
    assert all((a.feature == b.feature).all() and (a.bin == b.bin).all() and (a.value == b.value).all() for a, b in zip(one.trees, many.trees, strict=True))


def test_it_learns_what_a_plane_cannot(spark):
    x, y, _ = sample(1500, 3)
    rows, test = frame(spark, x, y).drop("x"), frame(spark, *sample(500, 4)[:2]).drop("x")
    loss = {}
    for kind, params in (("newton", {"rounds": 12, "depth": 3}), ("logistic", {})):
        model = classify.fit(rows, "v", ["y"], kind, 4, params)
        loss[kind] = classify.mean_entropy(model.scores(test, "v"), ["y"])
    assert loss["newton"] < 0.55 < loss["logistic"]
    model = classify.fit(rows, "v", ["y"], "newton", 4, {"rounds": 2, "depth": 2})
    assert abs(sum(classify.importance(model)["y"]) - 1) < 1e-9
    with pytest.raises(ValueError, match="stored"):
        classify.save(model, "/nowhere")


def test_odd_rows(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1, [0.0, nan], 0), (2, [1.0, nan], 1), (2, [1.0, 3.0], 1), (None, [1.0, 2.0], 1), (4, None, 1), (5, [9.0, 9.0], None)] + [(k, [float(k % 2), 0.0], k % 2) for k in range(10, 60)], "id long, v array<double>, y int")
    rows = rows.withColumn("x", F.when(F.col("v").isNotNull(), array_to_vector("v"))).withColumn("_p", F.lit("kept"))
    model = boosting.NewtonBoost(["y"], rounds=2, depth=2, key="id").fit(rows)
    got = {r["id"]: r["p"] for r in rows.select("id", F.get(model.probabilities(F.when(F.col("x").isNotNull(), vector_to_array("x"))), 0).alias("p")).collect()}
    assert got[4] is None and got[11] > 0.6 and got[10] < 0.4 and got[1] == got[10]
    flat = boosting.NewtonBoost(["y"], rounds=1).fit(rows.where("id = 2"))
    assert (flat.trees[0].feature == -1).all()
    none = boosting.NewtonBoost(["y"], rounds=1).fit(rows.where("false"))
    assert (none.trees[0].feature == -1).all()
    with pytest.raises(ValueError, match="no such parameter"):
        boosting.NewtonBoost(["y"]).setParams(leaves=3)
