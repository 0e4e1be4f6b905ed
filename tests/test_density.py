import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from docketry.operators import density, neighbours

SCHEMA = "id long, x array<double>"


def brute_labels(data, min_size, min_samples):
    """All pairs, Kruskal, a condensed tree from the top down, excess of mass: another way than the library's, on plain lists."""
    nodes = {}
    for i, x in data:
        nodes.setdefault(tuple(x), []).append(i)
    x = np.array(list(nodes), float)
    ids, count = np.array([min(v) for v in nodes.values()]), np.array([len(v) for v in nodes.values()])
    n = len(x)
    d = np.sqrt(sum((x[:, None, k] - x[None, :, k]) ** 2 for k in range(x.shape[1])))
    core = np.zeros(n)
    for k in range(n):
        have = count[k]
        for j in np.lexsort((ids, d[k])):
            if have >= min_samples:
                break
            if j != k:
                have, core[k] = have + count[j], d[k, j]
    w = np.maximum(np.maximum(d, np.maximum(core[:, None], core[None, :])), density.LEAST)
    edges = sorted((w[i, j], *sorted((ids[i], ids[j])), i, j) for i in range(n) for j in range(i))
    up, kids, size, tree = list(range(n)), {}, {k: count[k] for k in range(n)}, n

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for weight, _, _, i, j in edges:
        a, b = root(i), root(j)
        if a != b:
            up.append(tree)
            up[a] = up[b] = tree
            kids[tree], size[tree] = (a, b, weight), size[a] + size[b]
            tree += 1

    def leaves(k):
        out, todo = [], [k]
        while todo:
            k = todo.pop()
            if k in kids:
                todo += kids[k][:2]
            else:
                out.append(k)
        return out

    def cluster(k, born):
        """(stability, flagged: lists of nodes) of the cluster whose top is node k."""
        mass = 0.0
        while True:
            if k not in kids:
                mass += size[k] * (1 / density.LEAST - born)
                return mass, [], []
            a, b, weight = kids[k]
            big = [c for c in (a, b) if size[c] >= min_size]
            if len(big) == 2:
                mass += size[k] * (1 / weight - born)
                parts = [cluster(c, 1 / weight) for c in big]
                below, chosen = 0.0, []
                for c, (own, under, lists) in zip(big, parts):
                    value = sum(u for u, _ in under)
                    take = own >= value
                    below += max(own, value)
                    chosen += [(own, leaves(c))] if take else under
                return mass, chosen, None
            if not big:
                mass += size[k] * (1 / weight - born)
                return mass, [], []
            small = a if big[0] == b else b
            mass += size[small] * (1 / weight - born)
            k = big[0]

    out = dict.fromkeys(range(n), density.NOISE)
    top = tree - 1
    if size[top] >= min_size:
        for _, members in cluster(top, 0.0)[1]:
            # Points of a flagged cluster's subtree; what fell out above it isn't among its leaves.
            for k in members:
                out[k] = min(ids[members])
    return {i: int(out[k]) for k, own in enumerate(nodes.values()) for i in own}


def blobs(seed, n, d, centres, spread=0.15):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d)) * 2
    x = np.vstack([c[rng.integers(0, centres, n * 4 // 5)] + rng.normal(size=(n * 4 // 5, d)) * spread * rng.uniform(0.3, 2, (n * 4 // 5, 1)), rng.uniform(-4, 4, (n - n * 4 // 5, d))])
    return [(int(k), v.tolist()) for k, v in enumerate(x)]


def labels(spark, data, **options):
    found = {}
    for r in density.clustered(spark.createDataFrame(data, SCHEMA), **options).collect():
        assert found.setdefault(r["id"], r["topic"]) == r["topic"]
    return found


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    data = blobs(1, 700, 5, 6) + [(5000 + k, [0.25 * (k % 4)] * 5) for k in range(40)]
    x, ids = np.array([v for _, v in data]), np.array([i for i, _ in data])
    d = neighbours.distances(x, x)
    got = {}
    cells = neighbours.Cells(spark.createDataFrame(data, SCHEMA))
    for r in cells.nearest(6).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["other"], r["distance"]))
    for k, i in enumerate(ids.tolist()):
        order = [j for j in np.lexsort((ids, d[k])) if j != k][:6]
        assert [o for o, _ in got[i]] == ids[order].tolist() and np.allclose([v for _, v in got[i]], d[k, order])
    assert cells.group.max() >= 6
    visits = neighbours.with_visits(cells.table.withColumn("most", F.lit(0.1)), cells.centres, cells.radius, cells.group, "most").count()
    assert visits < len(data) * (cells.group.max() + 1) * 0.8  # groups out of reach aren't visited


@pytest.mark.parametrize("seed, n, d, size, samples", [(2, 2000, 3, 12, 6)])
def test_labels_equal_brute_force(spark, seed, n, d, size, samples):
    data = blobs(seed, n, d, 9)
    got = labels(spark, data, min_size=size, min_samples=samples)
    assert got == brute_labels(data, size, samples)
    assert len(set(got.values())) > 3


def test_copies_ties_and_odd_rows(spark):
    data = blobs(4, 120, 2, 4) + [(1000 + k, [3.0, 3.0]) for k in range(30)] + [(2000 + k, [float(k % 5), float(k // 5)]) for k in range(25)] + [(3000 + k, [2.5, -1.0]) for k in range(3)]
    want = brute_labels(data, 6, 4)
    odd = [(4000, None), (4001, []), (4002, [None, 1.0]), (4003, [float("nan"), 1.0])]
    assert labels(spark, data + odd, min_size=6, min_samples=4) == want | dict.fromkeys((4000, 4001, 4002, 4003), density.NOISE)
    assert want[1000] == 1000


def test_tree_is_the_smallest_and_bands_change_nothing(spark):
    data = blobs(5, 200, 2, 7)
    nodes = spark.createDataFrame([(i, x, 1) for i, x in data], SCHEMA + ", n long")
    tree = density.spanning_tree(nodes, 3, 3)  # lists so short that rounds must look further
    x = np.array([v for _, v in data])
    d = neighbours.distances(x, x)
    core = np.sort(d, 1)[:, 2]
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    inside, total, best = {0}, 0.0, w[0].copy()
    while len(inside) < 200:
        best[list(inside)] = np.inf
        k = int(best.argmin())
        total, best = total + best[k], np.minimum(best, w[k])
        inside.add(k)
    assert tree.count() == 199 and tree.agg(F.sum("w")).first()[0] == pytest.approx(total)
    results = []
    for band in (10**6, 80):
        fallen, clusters = density.condensed(tree, nodes, 6, band)
        named = fallen.join(density.selected(clusters), "cluster").select("id", "w", "label").collect()
        groups = {}
        for r in named:
            groups.setdefault(r["label"], []).append(r["id"])
        results.append((sorted((r["id"], round(r["w"], 12)) for r in named), sorted(sorted(v) for k, v in groups.items() if k is not None)))
    assert results[0] == results[1] and len(results[0][1]) > 1


def test_wide_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 40)) * 50 + 1e4
    x[100:110] = x[0]
    got = {}
    for r in neighbours.Cells(spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], SCHEMA)).nearest(5).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    d = neighbours.distances(x, x)
    assert got == {k: [j for j in np.lexsort((np.arange(300), d[k])) if j != k][:5] for k in range(300)}


def test_few_and_none(spark):
    assert labels(spark, []) == {}
    assert labels(spark, [(1, [0.0]), (2, [1.0])]) == {1: -1, 2: -1}
    assert labels(spark, [(k, [0.0]) for k in range(9)]) == dict.fromkeys(range(9), -1)


def test_a_band_is_merged_in_arrays():
    n = 30_000
    rng = np.random.default_rng(4)
    a = np.array([rng.integers(0, k) for k in range(1, n)])
    edges = {"w": rng.random(n - 1) + 0.1, "a": a, "b": np.arange(1, n), "e": np.arange(n - 1), "fa": a, "fb": np.arange(1, n)}
    state = {"f": np.arange(n), "size": np.ones(n, np.int64), "cluster": np.zeros(n, np.int64), "has": np.zeros(n, bool), "inside": np.zeros(n), "below": np.zeros(n)}
    density.merge_band(edges, state, 5)  # what is loaded on the first call doesn't count
    tracemalloc.start()
    events = density.merge_band(edges, state, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * n  # 752 as lists, tuples and dicts, without those of the table's columns
    kinds = events.column("kind").to_pylist()
    assert kinds.count("f") == n and kinds.count("m") == n - 1 and kinds.count("s") == 1
    assert events.filter(pc.equal(events.column("kind"), "s")).column("size").to_pylist() == [n]


def test_lightest_edges_of_wide_vectors():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 20)) * 30 + 1e4
    x[50:90] = np.round(x[50:90] / 40) * 40  # ties
    x[90:95] = x[50]
    x[100:110] = x[100] + rng.normal(size=(10, 20)) * 1e-7  # nearer than the product tells
    frag, core, side = rng.integers(0, 9, 400), np.where(rng.random(400) < 0.5, 0.0, 150.0), rng.random(400) < 0.4
    got = density._lightest(pa.table({"side": side, "id": np.arange(400), "c": frag, "core": core, "x": pa.array(x.tolist())})).to_pylist()
    w = np.maximum(np.maximum(neighbours.distances(x, x), np.maximum(core[:, None], core[None, :])), density.LEAST)
    want = {}
    for i, j in itertools.product(np.flatnonzero(side).tolist(), np.flatnonzero(~side).tolist()):
        if frag[i] != frag[j]:
            edge = (w[i, j], min(i, j), max(i, j), frag[j])
            want[frag[i]] = min(want.get(frag[i], edge), edge)
    assert {r["c"]: (r["w"], r["a"], r["b"], r["to"]) for r in got} == want


def test_the_query_uses_all_components(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = np.full((90, 20), 0.5)
    x[:, :3] += rng.normal(size=(90, 3)) * 0.01  # one group by the first components
    x[:, 10:] += rng.normal(size=(90, 10)) * 0.02 + (np.arange(90) % 3 * 4)[:, None]
    data = [(k, v) for k, v in enumerate(x.tolist())]
    spark.createDataFrame(data, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r["topic"] for r in queries()["density_clusters"](spark, str(tmp_path)).collect()}
    assert got == brute_labels(data, 5, 5)
    assert {t: {k % 3 for k in got if got[k] == t} for t in (0, 1, 2)} == {0: {0}, 1: {1}, 2: {2}}
