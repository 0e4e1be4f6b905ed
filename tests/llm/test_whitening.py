import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import vectors, whitening
from docketry.llm.queries import op13_whitening

SCHEMA = "id long, x array<long>"


@pytest.mark.parametrize("d, wanted", [(1, 4), (3, 4), (30, 4), (90, 2)])
def test_leading_equals_a_dense_solve(d, wanted):
    rng = np.random.default_rng(d)
    for a in (rng.normal(size=(400, d)), rng.normal(size=(400, d)) * 0.8 ** np.arange(d), rng.normal(size=(3, d)), np.repeat(rng.normal(size=(400, 1)), d, 1)):
        v = a.T @ a / len(a)
        values, x = whitening.leading(lambda q, v=v: v @ q, d, wanted)
        dense = np.linalg.eigvalsh(v)[::-1][:wanted]
        assert np.allclose(values, dense, rtol=1e-10, atol=1e-12 * dense[0])
        assert np.allclose(x.T @ x, np.eye(len(values)), atol=1e-12) and np.linalg.norm(v @ x - x * values) <= 1e-10 * dense[0]


def test_equal_and_no_variances_are_certified_too():
    for v in (np.eye(40) * 3, np.zeros((40, 40)), np.diag([5.0] * 30 + [1.0] * 10)):
        values, x = whitening.leading(lambda q, v=v: v @ q, 40, 4)
        assert np.allclose(values, v[0, 0]) and np.allclose(v @ x, x * values)


def test_few_passes_where_the_spectrum_has_a_gap():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(900, 200)) * np.r_[np.full(4, 9.0), np.ones(196)]
    v, passes = a.T @ a / 900, []
    whitening.leading(lambda q: (passes.append(q.shape[1]), v @ q)[1], 200, 4)
    assert len(passes) < 60 and max(passes) == 4 + whitening.EXTRA


def check(spark, data, components=4):
    rows = spark.createDataFrame(data, SCHEMA)
    got = whitening.whitened(rows, whitening.fit(rows, components=components)).collect()
    for d in {len(x) for _, x in data if x}:
        of = [(i, x) for i, x in data if x and len(x) == d]
        u = np.array(sorted({tuple(x) for _, x in of}), object)
        n, sums = len(u), u.sum(0)
        c = ((n * u - sums) / n).astype(float)
        values, e = np.linalg.eigh(c.T @ c / n)
        values, e = values[::-1], e[:, ::-1]
        k = min(components, int((values > 1e-12 * values.sum()).sum()))
        mine = [r for r in got if r["n"] == n and r["deviation"] in {sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in of}]
        assert len(mine) == len(of) * k
        for j in range(k):
            z = {}
            for i, x in of:
                z.setdefault(i, []).append(float(((n * np.array(x, object) - sums) / n).astype(float) @ e[:, j] / np.sqrt(values[j])))
            own = [r for r in mine if r["component"] == j + 1]
            big = max(own, key=lambda r: abs(r["whitened"]))
            sign = 1 if any(np.isclose(big["whitened"], v, atol=1e-6) for v in z[big["id"]]) else -1
            for i in z:
                assert np.allclose(sorted(sign * r["whitened"] for r in own if r["id"] == i), sorted(z[i]), atol=1e-7)
            assert all(abs(r["explained"] - values[j] / values.sum()) < 1e-9 and r["identity_error"] < 1e-9 for r in own)
    return got


def test_equals_brute_force_with_repeats_lengths_and_nulls(spark):
    rng = np.random.default_rng(3)
    data = [(k, (rng.integers(-90, 90, 24) * (1 + (np.arange(24) < 3) * 4)).tolist()) for k in range(300)]
    data += [(1000 + k, data[5][1]) for k in range(150)] + [(None, data[9][1]), (3, data[3][1]), (3000, None), (3001, [])]
    data += [(4000 + k, rng.integers(-9, 9, 3).tolist()) for k in range(40)]
    assert {r["n"] for r in check(spark, data)} >= {300}


def test_large_entries(spark):
    rng = np.random.default_rng(4)
    got = check(spark, [(k, rng.integers(-(2**24), 2**24, 5).tolist()) for k in range(40)])
    assert max(r["deviation"] for r in got) > 2**58
    huge = [(k, rng.integers(-(2**60), 2**60, 5).tolist()) for k in range(40)]
    rows = spark.createDataFrame(huge, SCHEMA)
    assert {r["deviation"] for r in whitening.whitened(rows, whitening.fit(rows)).collect()} == {None}


def test_empty_and_without_variance(spark):
    for data in ([], [(1, [5, 5])], [(1, [5, 5]), (2, [5, 5])], [(1, None), (2, [])]):
        rows = spark.createDataFrame(data, SCHEMA)
        assert whitening.whitened(rows, whitening.fit(rows)).collect() == []


def test_whole_numbers_of_odd_vectors(spark):
    rows = spark.createDataFrame([([0.5, -0.001],), ([1.0, None],), ([1.0, float("nan")],), ([float("inf")],), (None,), ([],)], "v array<float>")
    assert [r[0] for r in rows.select(vectors.whole("v")).collect()] == [[128, -1], None, None, None, None, []]


def test_query(spark, sf):
    got = op13_whitening(spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert got.count() == 4 * table.where(vectors.whole("embedding").isNotNull()).count()
    assert got.groupBy("component").agg(F.max("identity_error").alias("e")).where("e < 1e-10").count() == 4
