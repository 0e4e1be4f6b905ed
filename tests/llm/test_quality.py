import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.llm import arrays, quality
from docketry.llm.queries import op11_quality


def of(*texts):
    (_, data, offsets), = arrays.chunks(pa.array(texts, pa.string()))
    return [dict(zip(quality.STATISTICS, r)) for r in quality.text_statistics(data, offsets)]


def test_statistics_of_texts():
    a, b, c, none, empty = of("The cat sat. The dog, too!", "AB!! CD!!\nAB!! CD!!", "ä | ä | ä", None, "")
    assert np.isclose(a["words"], np.log(7)) and a["distinct_words"] == 5 / 6 and a["top_word"] == 2 / 6 and a["capital_words"] == 2 / 6 and a["tailed_words"] == 0
    assert b["shouted_words"] == 1 and b["tailed_words"] == 1 and b["repeated_lines"] == 0.5 and b["distinct_pairs"] == 2 / 3 and np.isclose(b["lines"], np.log(3))
    assert c["lone_symbols"] == 2 / 5 and c["high"] == 6 / 12 and c["word_entropy"] == pytest.approx(-0.6 * np.log2(0.6) - 0.4 * np.log2(0.4))
    assert none == empty and empty["empty"] == 1 and empty["bytes"] == 0


def test_statistics_do_not_depend_on_the_chunk():
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcAB.!9ü\n"), 5)) for _ in range(n)) for n in (0, 1, 2, 40, 900, 30_000)]
    column = pa.array([*texts, None, " \n "], pa.string())
    alone = np.vstack([quality.text_statistics(d, o) for _, d, o in arrays.chunks(column, 1)])
    together = np.vstack([quality.text_statistics(d, o) for _, d, o in arrays.chunks(column)])
    assert len(alone) == 8 and np.allclose(alone, together) and np.isfinite(alone).all()


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 10))
    model = quality.Quality(np.zeros(10), np.ones(10), *quality.frequencies(10, 4000, 1), None, None, None)
    z = model.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 20)
    assert np.abs(z @ z.T - exact).max() < 0.1 and np.abs(z @ z.T - exact).mean() < 0.02


def test_pooling_gives_the_nearest_rising_sequence():
    rng = np.random.default_rng(3)
    for _ in range(30):
        w, v = rng.integers(1, 5, 9).astype(float), rng.normal(size=9)
        got = quality.pooled(w, v)
        # The largest over starts of the smallest over ends of a run's mean.
        mean = lambda i, j: (w[i : j + 1] * v[i : j + 1]).sum() / w[i : j + 1].sum()  # noqa: B023, E731
        assert np.allclose(got, [max(min(mean(i, j) for j in range(k, 9)) for i in range(k + 1)) for k in range(9)])


def test_equals_a_plain_fit(spark, sf):
    """All of the fit again with whole matrices."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label")
    stats = quality.statistics(docs)
    model = quality.learn(stats, labels, features=40)
    rows = stats.join(labels, "doc_id").select("stats", "label", F.pmod(F.xxhash64(F.lit("fold"), "stats"), F.lit(quality.FOLDS)).alias("fold")).collect()
    s, y, fold = np.array([r["stats"] for r in rows]), np.array([r["label"] for r in rows], float), np.array([r["fold"] for r in rows])
    deviation = np.where(s.std(0) > 1e-9, s.std(0), 1)
    assert np.allclose(model.mean, s.mean(0)) and np.allclose(model.deviation, deviation)
    z = model.features(s)

    def solved(some, penalty):
        ridge = np.full(41, penalty * (z.T @ z if some is None else z[some].T @ z[some]).trace() / 41)
        ridge[-1] = 1e-12 * ridge[0]
        zz, yy = (z, y) if some is None else (z[some], y[some])
        return np.linalg.solve(zz.T @ zz + np.diag(ridge), zz.T @ yy)

    lost = {p: sum(((z[fold == f] @ solved(fold != f, p) - y[fold == f]) ** 2).sum() for f in range(quality.FOLDS)) for p in quality.PENALTIES}
    best = min(lost, key=lost.get)
    assert np.allclose(z @ model.weights, z @ solved(None, best), atol=1e-6)
    raw = np.concatenate([z[fold == f] @ solved(fold != f, best) for f in range(quality.FOLDS)])
    own = np.concatenate([y[fold == f] for f in range(quality.FOLDS)])
    at = ((np.clip(raw, *quality.RANGE) - quality.RANGE[0]) * quality.BINS).astype(int)
    bins = np.unique(at)
    means = np.array([own[at == b].mean() for b in bins])
    assert np.allclose(model.value, quality.pooled(np.array([(at == b).sum() for b in bins]), means), atol=1e-6) and (np.diff(model.value) >= 0).all()


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = op11_quality(spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    table = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(table) > 500 and (table["predicted"] == table["quality"]).mean() > 0.97 and table["score"].between(0, 1).all()
    rank, y = table["score"].rank(), table["quality"]
    assert (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum())) > 0.97
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (5, 0), (7, None), (None, 1)], "doc_id long, label int")
    got = quality.scored(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1 and len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
    assert quality.scored(none, labels).count() == 0
    for given, want in (([], 0.5), ([(1, 1)], 1.0), ([(3, 0), (1, None)], 0.0)):
        assert {round(r["score"], 12) for r in quality.scored(odd, spark.createDataFrame(given, "doc_id long, label int")).collect()} == {want}
    clash = quality.statistics(odd).withColumn("score", F.lit("x")).withColumn("lang", F.lit(1))
    assert quality.score(clash, quality.learn(clash, labels)).columns == ["doc_id", "lang", "score"]
