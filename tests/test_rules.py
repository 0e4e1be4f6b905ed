"""Rules of the inventory's source, case by case."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.functions import dates, replies, text
from docketry.operators import classify, embedding, graph, lookup, similarity, store


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_names_in_a_reply(spark):
    known = F.array(F.lit("united kingdom"), F.lit("chile"), F.lit("peru"))
    read = lambda x: one(spark, x, "string", lambda c: replies.names_in_reply(c, known))
    assert read("Sure: [ 'Chile',\n\"United Kingdom\" ] and [Peru]") == ["united kingdom", "chile"]
    assert read("[]") == [] and read("x [nobody]") == []
    with pytest.raises(Exception, match="no bracketed list"):
        read("nobody")
    with pytest.raises(Exception, match="no bracketed list"):
        read(None)


def test_phrases_in_a_reply(spark):
    read = lambda x: one(spark, x, "string", replies.phrases_in_reply)
    assert read('ok ["a [b]", " c\\n", "", "  "] bye') == ["a [b]", "c"] and read("[]") == []
    for bad in ("none", "[a, b]", None):
        with pytest.raises(Exception, match="no JSON array"):
            read(bad)


def test_title_case_and_typos(spark):
    assert one(spark, "UNITED kingdom  x", "string", replies.title_case) == "United Kingdom  X"
    fix = lambda x: one(spark, x, "string", lambda c: replies.corrected(c, {"Chlie": "Chile"}))
    assert [fix("Chlie"), fix("Chlie "), fix(None)] == ["Chile", "Chlie ", None]
    assert replies.noun_of(["A", "B"], "w", plural=True) == "A/Bs" and replies.noun_of(None, "w") == "w"


def test_garbled_bytes(spark):
    read = lambda x: one(spark, x, "binary", text.is_garbled)
    assert read(b"\x0b\x0cabc") and not read(b"\x7f\x7fabc") and not read(b"\t\n\r abc") and not read(b"\x0b\x0c \n")
    assert not read(b"") and not read(None) and not read(b"a" * 500 + b"\x01" * 500)
    assert read("é".encode() * 200 + b"\x01" * 100) and not read("é".encode() * 230 + b"\x01" * 40)


def test_adoption_year_of_two_digits(spark):
    read = lambda x: one(spark, x, "string", lambda c: dates.adoption_year(c, two_digits=True))
    assert [read(x) for x in ("Effective 01/02/1999", "Effective 1/2/1999", "31/02/2001", "a 1/1/1999 b 03/04/2005")] == [1999, None, None, 2005]


def test_segments_of_equal_tokens():
    assert embedding.segments("x" * 89, 30, 1000) == ["x" * 89] and embedding.segments("") == []
    parts = embedding.segments("ab " * 100, 40, 1000)
    assert [len(p.split()) for p in parts] == [34, 34, 32] and "".join(parts) == "ab " * 100
    dense = embedding.segments("a " * 50 + "b" * 30 + " " + "c" * 30, 10, 40)
    assert all(len(p) < 40 for p in dense) and "".join(dense) == "a " * 50 + "b" * 30 + " " + "c" * 30
    numbers = embedding.segments("0123456789" * 2, 3, 100, encode=lambda x: [int(c) for c in x], decode=lambda t: "".join(map(str, t)))
    assert numbers == ["012", "345", "678", "901", "234", "567", "89"]


def test_credit_of_coauthors(spark):
    rows = [
        (1, 2000, 1, 0.5, 1999, ["a", "b"]), (1, 2000, 2, 0.4, 1999, []), (1, 2000, 3, 0.4, 2001, ["z"]), (1, 2000, 4, 0.4, 1999, None), (1, 2000, 5, 0.25, 2000, ["a"]),
        (1, 2000, 6, 0.25, 1990, ["c", "c"]), (1, 2000, 7, 0.25, 1990, ["never"]), (2, 2000, 1, 1.0, 1990, ["d"]), (3, 2000, 1, 0.3, None, ["e"]),
    ]
    frame = spark.createDataFrame(rows, "left_id long, left_year long, rank int, sim double, right_year long, parties array<string>")
    got = {(r["left_id"], r["party"]): r["weight"] for r in similarity.introduction_credit(frame).collect()}
    w = [2.0, 4 / 3, 4 / 3]
    assert got == {(1, "a"): round((w[0] + w[1]) / sum(w), 10), (1, "b"): round(w[0] / sum(w), 10), (1, "c"): round(2 * w[2] / sum(w), 10), (2, "d"): None}


def test_stems_of_a_hot_piece_and_repeats(spark):
    names = spark.createDataFrame([(f"common{k:03d}", k) for k in range(60)] + [("common007", 99)], "name string, v int")
    rows = spark.createDataFrame([("common007",), ("mmon01",), ("xcommon059y",), ("common",), ("nothing",), ("07",)], "stem string")
    got = {r["stem"]: r["v"] for r in lookup.by_stem(rows, names, "stem", "name", "v", merge=True).collect()}
    assert got["common007"] == [7] and got["mmon01"] == list(range(10, 20)) and got["xcommon059y"] == [59]
    assert len(got["common"]) == 61 and got["nothing"] is None and got["07"] == [7, 99]


def test_found_and_missing(spark):
    rows, have = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (None, "b")], "k long, g string"), spark.createDataFrame([(2,), (2,)], "k long")
    assert {tuple(r) for r in lookup.found_and_missing(rows, have, "k", ["g"]).collect()} == {("a", 2, 1, 1), ("b", 2, 1, 1)}


def test_year_blocks_give_the_same_matches(spark, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(similarity, "BLOCK", 7)
    schema = "id long, year long, vector array<double>"
    side = lambda n, first: [(first + k, None if k == 3 else int(1990 + rng.integers(0, 6)), rng.normal(size=3).tolist()) for k in range(n)]
    a, b = side(40, 0), side(60, 100)
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    pairs = {(i, j): float(np.dot(x, y)) for i, p, x in a for j, q, y in b if p is not None and q is not None and q <= p and np.dot(x, y) >= 1.0}
    assert {(r["left_id"], r["right_id"]) for r in similarity.pairs_above(left, right, 1.0, backward=True).collect()} == set(pairs)
    year = {j: q for j, q, _ in b}
    for r in similarity.matches_by_threshold(left, right, [1.0]).collect():
        own = {j: s for (i, j), s in pairs.items() if i == r["left_id"]}
        assert r["n"] == len(own) and r["first"]["id"] == min(own, key=lambda j: (year[j], -round(own[j], 9), j)) and r["nearest"]["id"] == min(own, key=lambda j: (-round(own[j], 9), j))
    assert similarity.matches_by_threshold(left.where("false"), right, [1.0]).count() == 0 == similarity.matches_by_threshold(left, right.where("false"), [1.0]).count()


def test_ratio_equals_the_table_of_subsequences():
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for k, y in enumerate(b, 1):
                before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
        return row[-1]

    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abc é"), rng.integers(1, n))) for n in (9, 40))
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        windows = [long[max(0, k) : k + len(short)] for k in range(1 - len(short), len(long))]
        assert text.partial_ratio(a, b) == round(max(200.0 * common(short, w) / (len(short) + len(w)) for w in windows))


def test_upsert_of_two_new_rows_of_a_key(spark):
    old, new = spark.createDataFrame([(1, "z", 0)], "k int, v string, at int"), spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 1), (2, "c", 0)], "k int, v string, at int")
    assert sorted(map(tuple, store.upsert(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "c", 0)]
    assert sorted(map(tuple, store.upsert(old, new, ["k"], order=[F.desc("at")]).collect())) == [(1, "b", 2), (2, "c", 1)]


def test_katz_solves_its_equation(spark):
    rows = [("p", "a", "b", 4), ("p", "a", "c", 2), ("p", "c", "d", 1), ("p", "d", "d", 3), ("q", "x", "y", 5)]
    got = {(r["period"], r["country"]): r["value"] for r in graph.katz(spark.createDataFrame(rows, "period string, source string, target string, weight long")).collect()}
    for period in ("p", "q"):
        own = [r for r in rows if r[0] == period]
        most, near = max(r[3] for r in own), {}
        for _, s, t, w in own:
            near[s, t] = near[t, s] = w / most
        x = {c: v for (p, c), v in got.items() if p == period}
        rest = [x[c] - 0.1 * sum(near.get((c, o), 0.0) * x[o] for o in x) for c in x]
        assert np.allclose(rest, rest[0], atol=1e-8) and abs(sum(v * v for v in x.values()) - 1) < 1e-8


def test_distances_within_a_set(spark):
    x = [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8], [1.0, 0.0]]
    rows = spark.createDataFrame([(k, 2000, v, 0) for k, v in enumerate(x)], "id long, year long, vector array<double>, part long")
    got = {r["distance"]: r["n"] for r in similarity.distance_counts(rows, rows, 3, once=True).collect()}
    assert got == {0.0: 1, 1.0: 2, 0.4: 2, 0.2: 1}


def _spread(monkeypatch):
    """90 vectors, some a little longer than 1, in many small blocks."""
    for name, n in (("LEFT", 20), ("RIGHT", 30), ("LEAST_ROWS", 10), ("TILE", 4), ("WIDTH", 7)):
        monkeypatch.setattr(similarity, name, n)
    x = np.random.default_rng(2).normal(size=(90, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7], x[50] = x[3] * 1.001, x[3] * 1.001
    return x, {(i, j): round(float(1 - x[i] @ x[j]), 4) for i in range(90) for j in range(90)}


def test_summary_of_a_sets_own_pairs(spark, monkeypatch):
    x, d = _spread(monkeypatch)
    ids = [7 * k % 90 if k % 2 else k for k in range(90)]  # any order, some ids twice
    rows = spark.createDataFrame([(k, k % 3, x[k].tolist()) for k in ids], "id long, part long, vector array<double>")
    for r in similarity.own_distances(rows, 4).collect():
        want = [d[i, j] for i in ids for j in ids if i < j and i % 3 == r["part"]]
        assert (r["n"], r["min"], r["max"]) == (len(want), min(want), max(want)) and abs(r["mean"] - np.mean(want)) < 1e-12
    assert similarity.own_distances(rows.where("id = 0"), 4).count() == 0


def test_counts_of_distances_in_blocks(spark, monkeypatch):
    x, d = _spread(monkeypatch)
    rows = spark.createDataFrame([(k, 2000, k % 2, x[k].tolist()) for k in range(90)], "id long, year long, part long, vector array<double>")
    want = {}
    for i in range(40):
        for j in range(90):
            want[i % 2, d[i, j]] = want.get((i % 2, d[i, j]), 0) + 1
    assert {(r["part"], r["distance"]): r["n"] for r in similarity.distance_counts(rows.where("id < 40"), rows, 4).collect()} == want
    assert min(v for _, v in want) < 0  # counted as it is, not at 0
    assert similarity.distance_counts(rows.where("id < 0"), rows, 4).count() == 0
    far = spark.createDataFrame([(0, 2000, 0, [1e6]), (1, 2000, 0, [-1e6])], rows.schema)
    assert {r["distance"]: r["n"] for r in similarity.distance_counts(far, far, 4).collect()} == {1 - 1e12: 2, 1 + 1e12: 2}


def test_importance_by_permutation_and_search(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, [float(rng.normal() * 3 + (k % 2) * 9), float(rng.normal()), float(rng.normal() * 0.5)], k % 2) for k in range(150)], "doc long, v array<double>, y int")
    model = classify.fit(rows, "v", ["y"], "svm", 3)
    got = {r["component"]: r["importance"] for r in classify.permutation_importance(model, rows, "v", ["y"], "doc", bucket=40).collect()}
    assert sorted(got) == [0, 1, 2] and max(got, key=got.get) == 0 and got[0] > 5 * max(abs(got[1]), abs(got[2]))
    grid = [{"dims": 1, "regParam": 5.0}, {"dims": 2, "regParam": 0.0}, {"dims": 1, "regParam": 0.01}]
    found = classify.searched(rows, "doc", "v", ["y"], "logistic", grid, folds=2)
    assert [c for c, _ in found][-1] == grid[0] and found[0][1] < found[-1][1]
    worst = classify.searched(rows, "doc", "v", ["y"], "logistic", grid, folds=2, scorer=lambda scored, labels: -classify.mean_entropy(scored, labels))
    assert worst[0][0] == grid[0]


def test_wide_values_are_spread_by_row(spark, monkeypatch):
    monkeypatch.setattr(lookup, "ROWS", 10)
    rows = spark.createDataFrame([(k, "hot" if k < 95 else None if k < 97 else "none") for k in range(100)], "k long, stem string")
    out = lookup.spread(rows, spark.createDataFrame([("hot", "1,2,3")], "stem string, keys string"), "stem", "k")
    assert {r["k"]: r["keys"] for r in out.collect()} == {k: "1,2,3" if k < 95 else None for k in range(100)}
    held = [n for n in out.rdd.glom().map(len).collect()]
    assert len(held) == 10 and max(held) < 40  # by stem, 95 rows were in one task


def test_no_pieces_and_no_values_pass_through_the_driver(spark, sf, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    table = spark.read.parquet(f"{sf}/supplier.parquet")
    rows = table.select("s_suppkey", F.concat(F.lit("x"), "s_name").alias("stem"))
    for merge in (False, True):
        assert "Broadcast" not in plan(lookup.by_stem(rows.select("stem").distinct(), table.select("s_name", F.col("s_suppkey").alias("v")), "stem", "s_name", "v", merge=merge))
    monkeypatch.setattr(lookup, "BYTES", 100)
    many = spark.createDataFrame([(k, "wide" if k < 40 else "thin" if k < 80 else "none") for k in range(90)], "k long, stem string")
    values = spark.createDataFrame([("wide", "1" * 50), ("thin", "2"), ("unused", "3" * 1000)], "stem string, keys string")
    out = lookup.spread(many, values, "stem", "k")
    assert {r["k"]: r["keys"] for r in out.collect()} == {k: "1" * 50 if k < 40 else "2" if k < 80 else None for k in range(90)}
    wide = [sum(r["stem"] == "wide" for r in part) for part in out.rdd.glom().collect()]
    assert len(wide) == 21 and max(wide) <= 12  # 2,040 bytes of values in parts of about 100; they were one task
    assert lookup.spread(many.where("k < 0"), values, "stem", "k").count() == 0
