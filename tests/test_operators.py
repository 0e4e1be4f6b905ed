import math

import numpy as np
from pyspark.sql import functions as F

from docketry.operators import classify, embedding, figures, geometry, graph, lookup, similarity, store, topics
from docketry.plans.ladder import Figure, ladder


def test_split_weights(spark):
    rows = spark.createDataFrame([("A", "B", 1200.0, "y"), ("A", "nan", 100.0, "s"), ("C", None, 8.0, "y"), ("D", "NAN", 4.0, "y"), ("E", "", 1.0, "?")], "a string, b string, v double, s string")
    weight = F.when(F.col("s") == "y", 1.0).when(F.col("s") == "s", 0.25).otherwise(F.lit(float("nan")))
    got = {r["country"]: r["value"] for r in figures.split_weights(rows, "a", "b", "v", weight).collect()}
    assert got["A"] == 925.0 and got["B"] == 300.0 and got["C"] == 8.0 and got["D"] == 3.0 and got["NAN"] == 1.0 and math.isnan(got["E"])


def test_approval_pairs(spark):
    rows = spark.createDataFrame([(1, "Argentina *\n11/05/2016\n\nChile\nPeru *\n01/01/2000"), (2, "")], "k int, t string")
    got = sorted((r["k"], r["country"], r["year"]) for r in figures.approval_pairs(rows, "k", "t").collect())
    assert got == [(1, "Argentina *", 2016), (1, "Chile", None), (1, "Peru *", 2000)]


def test_longest_key(spark):
    keys = [("university", "x"), ("norwegian polar", "norway"), ("polar", "uk"), ("inst a", "chile"), ("inst b", "peru")]
    rows = spark.createDataFrame([("Norwegian Polar Institute",), ("inst a and inst b",), ("none",), ("Polar club",)], "t string")
    assert [r["country"] for r in figures.longest_key(rows, "t", keys).collect()] == ["norway", None, None, "uk"]


def test_periods_and_grid(spark):
    rows = spark.createDataFrame([(1999,), (2000,), (2009,), (2026,)], "year int")
    assert [(r["year"], r["period"]) for r in figures.in_periods(rows, "year").orderBy("year").collect()] == [(2000, "2000s"), (2009, "2000s")]
    counts = spark.createDataFrame([("a", 2001, 3)], "country string, year int, value int")
    grid = figures.dense_grid(counts, (2000, 2002), spark.createDataFrame([("a",), ("b",)], "country string"))
    assert grid.count() == 6 and grid.agg(F.sum("value")).first()[0] == 3


def test_edges_repeats_and_katz(spark):
    papers = spark.createDataFrame([("p", ["b", "a", "b"]), ("p", ["a", "c"]), ("p", ["d"])], "period string, parties array<string>")
    edges = graph.coauthor_edges(papers, by=["period"])
    assert {(r["source"], r["target"], r["weight"]) for r in edges.collect()} == {("a", "b", 2), ("b", "b", 1), ("a", "c", 1)}
    got = {r["country"]: r["value"] for r in graph.katz(edges).collect()}
    assert set(got) == {"a", "b", "c"} and abs(sum(v * v for v in got.values()) - 1) < 1e-6
    assert {(r["country"], r["value"]) for r in graph.collaborators(papers).collect()} == {("a", 2), ("b", 1), ("c", 1)}


def test_earliest_match_ties(spark):
    left = spark.createDataFrame([(1, 2000, [1.0, 0.0]), (2, 1990, [0.0, 1.0])], "id long, year long, vector array<double>")
    right = spark.createDataFrame([(10, 1995, [0.9, 0.1]), (11, 1995, [0.95, 0.0]), (9, 1995, [0.95, 0.0]), (12, 2001, [1.0, 0.0])], "id long, year long, vector array<double>")
    got = {r["instrument"]: r["right_id"] for r in similarity.earliest_match(left, right, 0.85).collect()}
    assert got == {1: 9, 2: None}
    assert {r["instrument"]: r["available"] for r in similarity.available_history(left, right).collect()} == {1: 5, 2: None}


def test_credit_weighs_survivors(spark):
    rows = spark.createDataFrame([(1, 5, 2, 0.5), (1, 6, 4, 0.75), (2, 7, 1, 1.0)], "left_id long, right_id long, rank int, sim double")
    got = {(r["left_id"], r["right_id"]): r["weight"] for r in similarity.inverse_distance_credit(rows).collect()}
    assert abs(got[1, 5] - 1 / 3) < 1e-12 and abs(got[1, 6] - 2 / 3) < 1e-12 and got[2, 7] is None


def test_projection_is_idempotent_and_orthogonal():
    rng = np.random.default_rng(1)
    d = rng.normal(size=(5, 12))
    d -= d.mean(0)
    p = geometry.SubspaceProjection(d.astype(np.float32))
    x = rng.normal(size=(7, 12))
    once = p.project(x)
    assert p.rank == 4 and np.allclose(p.project(once), once) and np.allclose(once @ d.T, 0, atol=1e-5)
    assert (p.project(d[:1]) == 0).all()


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    up = store.upsert(old, new, ["k"])
    assert sorted(map(tuple, up.collect())) == sorted(map(tuple, store.upsert(up, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, None)]
    assert sorted(map(tuple, store.insert_missing(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, None)]
    assert sorted(map(tuple, store.patched(old, new, "k", ["v"]).collect())) == [(1, "a"), (2, "c")]
    assert store.fingerprint(old, [F.col("v")]).first() == store.fingerprint(old.orderBy(F.desc("k")), [F.col("v")]).first()
    assert store.fingerprint(old, [F.col("v")]).first() != store.fingerprint(new, [F.col("v")]).first()


def test_pages_joined_fills_gaps(spark):
    pages = spark.createDataFrame([(1, 0, "a"), (1, 2, "c")], "d int, p long, t string")
    assert store.pages_joined(pages, "d", "p", "t").first()["text"] == "a\n\nc\n"


def test_stem_fallback(spark):
    rows = spark.createDataFrame([("wp01_x",), ("wp02",), ("zzz9",), ("wp01",)], "stem string")
    table = spark.createDataFrame([("wp01", 1), ("long_wp02_e", 2), ("wp02_b", 3)], "name string, v int")
    first = {r["stem"]: r["v"] for r in lookup.by_stem(rows, table, "stem", "name", "v").collect()}
    assert first == {"wp01_x": 1, "wp02": 2, "zzz9": None, "wp01": 1}
    merged = {r["stem"]: r["v"] for r in lookup.by_stem(rows, table, "stem", "name", "v", merge=True).collect()}
    assert merged["wp02"] == [2, 3] and merged["wp01"] == [1]


def test_ladder_sums_spellings_and_fills(spark):
    spine = spark.createDataFrame([("United Kingdom",), ("Chile",)], "country string")
    aliases = spark.createDataFrame([("United Kingdom", "UK"), ("United Kingdom", "Great Britain")], "country string, alias string")
    f = spark.createDataFrame([("uk", 2.0), ("UNITED KINGDOM", 3.0), ("Peru", 9.0)], "country string, value double")
    got = {r["country"]: (r["n"], r["m"]) for r in ladder([Figure("n", f), Figure("m", f.where("country = 'uk'"), None)], spine, aliases).collect()}
    assert got == {"United Kingdom": (5.0, 2.0), "Chile": (0.0, None)}


def test_segments_rebuild_and_store_fills_once(spark):
    body = "word " * 300
    parts = embedding.segments(body, most_tokens=50, most_chars=200)
    assert "".join(parts) == body and max(map(len, parts)) < 200
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, " ")], "k int, t string")
    filled = embedding.embed_missing(embedding.with_segments(docs, "k", "t"), spark.createDataFrame([], "uuid string, embedding array<double>"))
    assert filled.count() == 1


def test_classifier_learns_and_handles_one_class(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, (rng.normal(size=6) + (k % 2) * 3).tolist(), k % 2, 1) for k in range(120)], "doc long, v array<double>, y int, always int")
    model = classify.fit(rows, "v", ["y", "always"], "logistic", 3)
    scored = classify.per_document(model.scores(rows, "v"), "doc", ["y", "always"])
    assert scored.where("pred_y = y").count() > 110 and scored.where("pred_always = 1").count() == 120
    assert len(classify.importance(model)["y"]) == 3 and classify.dimensions(64, 30) == [2, 4, 8, 16]
    classify.save(model, str(tmp_path / "m"))
    again = classify.load(str(tmp_path / "m")).scores(rows, "v").select("doc", F.round("score_y", 9), "score_always")
    assert again.exceptAll(model.scores(rows, "v").select("doc", F.round("score_y", 9), "score_always")).count() == 0


def test_projection_as_a_stage_and_clusters(spark):
    rows = spark.createDataFrame([(k, [1.0, 0.1 * (k % 3)] if k % 2 else [-0.1, 1.0 + k % 4], "red apple" if k % 2 else "blue sky") for k in range(40)] + [(99, [-1.0, -1.0], "odd")], "k long, v array<double>, t string")
    away = geometry.OrthogonalTo(geometry.SubspaceProjection([[1.0, 0.0]]), "v", "left")
    assert all(abs(r["left"][0]) < 1e-12 for r in away.transform(rows).collect())
    found = topics.clustered(rows, "v", 3)
    assert {r["topic"] for r in found.where("k = 99").collect()} == {-1} and found.where("topic >= 0").select("topic").distinct().count() == 2
    words = {r["word"] for r in topics.sizes_with_words(found.where("topic >= 0"), "topic", "t").collect()}
    assert words <= {"red", "apple", "blue", "sky"} and len(words) == 2


def test_stem_lookup_of_short_strings_equals_brute_force(spark):
    stems, names = ["a", "ab", "abc", "abcd", "xabcdx", "zz", "", "q", None], ["ab", "b", "xabcd", "abcdefg", "a1b", "zzz"]
    rows, table = spark.createDataFrame([(s,) for s in stems], "stem string"), spark.createDataFrame([(n, k) for k, n in enumerate(names)] + [(None, 9)], "name string, v int")
    for extra in ([], [("", 7)]):
        all_names = [*((n, k) for k, n in enumerate(names)), *extra]
        known = table.union(spark.createDataFrame(extra, table.schema))
        got = {r["stem"]: r["v"] for r in lookup.by_stem(rows, known, "stem", "name", "v", merge=True).collect()}
        for s in stems:
            same = [v for n, v in all_names if n == s]
            want = same or [v for n, v in sorted(all_names) if s is not None and (s in n or n in s)]
            assert (got[s] or []) == want, s
