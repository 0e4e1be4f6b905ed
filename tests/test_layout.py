import numpy as np

from docketry.operators import layout, neighbours, topics

SCHEMA = "id long, x array<double>"


def test_bandwidths_reach_the_sum():
    rng = np.random.default_rng(1)
    d = np.sort(rng.exponential(size=(50, 15)), 1)
    d[3, 10:] = np.inf
    rho, sigma = layout.bandwidths(d, 15)
    assert np.allclose(np.exp(-np.maximum(d - rho[:, None], 0) / sigma[:, None]).sum(1), np.log2(15), atol=1e-6) and np.allclose(rho, d[:, 0])


def test_graph_is_symmetric(spark):
    near = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (2, 1, 1.0), (2, 3, 1.5), (3, 2, 1.5), (3, 1, 2.0), (4, 1, 3.0), (4, 2, 4.0)], "id long, other long, distance double")
    w = {(r["a"], r["b"]): r["w"] for r in layout.fuzzy_graph(near, 2).collect()}
    assert all(abs(w[b, a] - v) < 1e-12 and 0 < v <= 1 for (a, b), v in w.items()) and len(w) == 10


def test_neighbours_are_kept_and_runs_agree(spark):
    rng = np.random.default_rng(2)
    turn = rng.uniform(0, 2 * np.pi, 160)
    x = np.c_[np.cos(turn), np.sin(turn)] @ np.linalg.qr(rng.normal(size=(30, 2)))[0].T + rng.normal(size=(160, 30)) * 0.01
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], SCHEMA)
    got = {r["id"]: r["x"] for r in layout.laid_out(rows, 2, 12).collect()}
    flat = np.array([got[k] for k in range(160)])
    first, second = (np.argsort(neighbours.distances(v, v), 1)[:, 1:11] for v in (x / np.linalg.norm(x, axis=1, keepdims=True), flat))
    kept = np.mean([len({*a} & {*b}) / 10 for a, b in zip(first.tolist(), second.tolist())])
    assert kept > 0.6, kept
    # The dense solve of the same graph spans the same plane.
    graph = layout.fuzzy_graph(neighbours.Cells(spark.createDataFrame([(k, v) for k, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist())], SCHEMA)).nearest(12), 12)
    w = np.zeros((160, 160))
    for r in graph.collect():
        w[r["a"], r["b"]] = r["w"]
    degree = w.sum(1)
    vectors = np.linalg.eigh(w / np.sqrt(np.outer(degree, degree)))[1][:, ::-1][:, 1:3]
    mine = np.linalg.qr(flat * np.sqrt(degree)[:, None])[0]
    assert np.linalg.svd(vectors.T @ mine)[1].min() > 0.95


def test_topics_of_groups(spark, monkeypatch):
    monkeypatch.setattr(layout, "MOST", 2)
    monkeypatch.setattr(layout, "STEPS", 3)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 24)) * 3
    group = np.arange(200) % 4
    rows = spark.createDataFrame([(k, v) for k, v in enumerate((centres[group] + rng.normal(size=(200, 24)) * 0.2).tolist())] + [(900, None)], SCHEMA)
    found = {r["id"]: r["topic"] for r in topics.density_topics(rows, "id", "x", dims=3, neighbours=10, min_size=8).collect()}
    assert found.pop(900) == -1 and len(found) == 200
    for g in range(4):
        assert len({found[k] for k in range(200) if group[k] == g} - {-1}) >= 1
    assert all(len({group[k] for k in found if found[k] == t}) == 1 for t in set(found.values()) - {-1})
    assert sum(t == -1 for t in found.values()) < 40


def test_few_rows(spark):
    assert layout.laid_out(spark.createDataFrame([], SCHEMA), 2).count() == 0
    assert [r["x"] for r in layout.laid_out(spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0])], SCHEMA), 2).collect()] == [[0.0, 0.0]]
