import numpy as np

from docketry.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def brute(rows, cosine):
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    n, parent = [0] * len(good), {r[0]: r[0] for r in good}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(good):
        for j in range(i):
            b = good[j]
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    p, q = root(a[0]), root(b[0])
                    parent[max(p, q)] = min(p, q)
    return sorted((r[0], k, root(r[0])) for r, k in zip(good, n, strict=True))


def data(seed=0):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            c = rng.normal(size=8)
            for _ in range(rng.integers(1, 8)):
                rows.append((k, (c + rng.normal(size=8) * 0.08 * rng.random()).astype(np.float32).tolist(), label, "x"))
                k += 1
    hot = rng.normal(size=8).astype(np.float32).tolist()
    rows += [(k + i, hot, 1, "x") for i in range(60)]
    return rows + [(9001, None, 1, "x"), (9002, [], 1, "x"), (9003, [0.0] * 8, 1, "x"), (9004, [float("nan")] * 8, 1, "x"), (9005, [None] + [1.0] * 7, 1, "x"), (9006, [1.0] * 3, 1, "x"), (None, hot, 1, "x"), (9007, [float("inf")] * 8, 1, "x")]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "ROWS_PER_PIVOT", 20)
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rows = data()
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), cosine=0.98).collect()
    assert len(got) == len(rows)
    want = brute(rows, 0.98)
    ids = {w[0] for w in want}
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in got if r["id"] in ids) == want
    assert all(r["n_links"] == 0 and r["kept"] for r in got if r["id"] not in ids)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got if r["id"] is not None)


def test_repeated_ids_under_labels(spark):
    near = [[1.0, 0.01 * k] for k in range(5)]
    rows = [(1, near[0], 0, "x"), (2, near[1], 0, "x"), (3, near[2], 0, "x"), (1, near[3], 1, "x"), (4, near[4], 1, "x"), (7, near[0], 2, "x"), (7, near[1], 2, "x"), (7, near[1], 2, "x"), (1, [0.0, 1.0], 3, "x"), (5, [0.01, 1.0], 4, "x")]
    got = sorted((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 1, False), (5, 0, 5, True), (7, 2, 7, True), (7, 2, 7, True), (7, 2, 7, True)]


def test_a_component_of_one_label_doesnt_name_rows_of_another(spark):
    rows = [(9, [1.0, 0.0], 0, "x"), (3, [1.0, 0.01], 0, "x"), (9, [1.0, 0.0], 1, "x"), (12, [1.0, 0.01], 1, "x")]
    got = sorted((r["id"], r["component_id"]) for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(3, 3), (9, 3), (9, 9), (12, 9)]


def test_empty(spark):
    assert vector_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
