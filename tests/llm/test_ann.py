import numpy as np
from pyspark.sql import functions as F

from docketry.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, k, query):
    good = [r for r in rows if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    out = {}
    for q in good:
        if query(q[0]):
            best = out.setdefault(q[0], {})  # rows that repeat a query's id ask together
            for c in good:
                if c[0] != q[0] and len(c[1]) == len(q[1]):
                    s = float((np.array(c[1], np.float32).astype(float) * np.array(q[1], np.float32).astype(float)).sum())
                    best[c[0]] = max(s, best.get(c[0], -1e300))
    return {q: sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k] for q, best in out.items()}


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_whole_search_is_exact_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 32)
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=6).astype(np.float32).tolist(), 0) for k in range(200)]
    rows += [(1000 + k, rows[3][1], 0) for k in range(40)] + [(3, rows[3][1], 0), (40, rows[7][1], 0)]
    rows += [(500, None, 0), (520, [], 0), (540, [0.0] * 6, 0), (560, [float("nan")] * 6, 0), (None, [1.0] * 6, 0), (580, [1.0, 2.0], 0)]
    got, want = run(spark, rows, share=100.0), exact(rows, 20, lambda i: i % 20 == 0)
    assert set(got) == {k for k, v in want.items() if v}
    for q, best in got.items():
        assert [i for i, _ in best] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in best], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], 0) for r in table.collect()]
    got, want = run(spark, rows), exact(rows, 20, lambda i: i % 20 == 0)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9


def recall(spark, rows, **options):
    got, want = run(spark, rows, **options), exact(rows, 20, lambda i: i % 20 == 0)
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])


def test_recall_without_structure_and_on_clusters(spark):
    rng = np.random.default_rng(3)
    loose = [(k, rng.normal(size=48).astype(np.float32).tolist(), 0) for k in range(3000)]
    assert recall(spark, loose) >= 0.9
    centers = rng.normal(size=(40, 48)) * 3
    tight = [(k, (centers[k % 40] + rng.normal(size=48) * 0.3).astype(np.float32).tolist(), 0) for k in range(3000)]
    assert recall(spark, tight, share=0.25) >= 0.9


def test_large_norms_are_exact(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=16) * 1e6
    rows = [(k, (base + rng.normal(size=16)).astype(np.float32).tolist(), 0) for k in range(300)]
    got, want = run(spark, rows, share=100.0), exact(rows, 20, lambda i: i % 20 == 0)
    assert {q: [i for i, _ in b] for q, b in got.items()} == {q: [i for i, _ in b] for q, b in want.items()}


def test_rows_are_scored_once(spark, sf):
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("size(embedding) = 64").collect()], np.float64)
    forest = ann.Forest(x, 4, 5, 5)
    leaf = forest.leaves(x)
    filled = np.array([np.bincount(leaf[:, t], minlength=32) for t in range(4)])
    for q in x[:20]:
        opened = forest.walk(np.einsum("d,tnd->tn", q, forest.w) - forest.median, filled, len(x), 21)
        assert (filled * opened).sum() < len(x) + filled.max() and sum(opened[t, leaf[:, t]] for t in range(4)).astype(bool).sum() <= len(x)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0, 0.0], 0), (1, [0.5, 0.0], 0)]) == {0: [(1, 0.5)]}
    assert run(spark, []) == {}
