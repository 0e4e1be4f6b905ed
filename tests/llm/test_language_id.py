from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docketry.llm import language_id


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = language_id.learn(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, model).where(language_id.held_out())
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    assert found.where("lang_score < 0 or lang_score > 1").count() == 0


def test_odd_rows(odd, none, spark):
    model = language_id.learn(odd)
    got = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["lang_score"] == 0 for k in (2, 3, 5, 8))
    assert got[4]["lang_pred"] in ("de", "en") and got[6]["lang_pred"] in ("de", "en")
    assert language_id.identify(none, model).count() == 0
    untaught = language_id.learn(none)
    assert {r["lang_pred"] for r in language_id.identify(odd, untaught).collect()} == {"und"}


def test_many_languages_use_more_planes(spark):
    rows = [(k, f"{chr(0x4E00 + k)}{chr(0x5E00 + k)} " * 20, f"l{k:03d}") for k in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.learn(docs)).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_prediction_ignores_the_label(spark, docs):
    model = language_id.learn(docs)
    swapped = docs.withColumn("lang", F.lit("xx"))
    a = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert a == {r["doc_id"]: r["lang_pred"] for r in language_id.identify(swapped, model).collect()}


def test_stage_keeps_columns_and_texts_with_letters(odd):
    out = language_id.with_known_language(odd)
    assert out.columns == odd.columns and sorted(str(r["doc_id"]) for r in out.collect()) == sorted(["1", "1", "None", "4", "6", "7"])


def plain_grams(text):
    """N-grams of letters, with a 0 for the edge of a word, one by one."""
    code = [0, *(ord(c) if c.isalpha() else 0 for c in (text or "").lower()), 0]
    out = [(c,) for c in code if c]
    out += [p for p in zip(code, code[1:]) if any(p)]
    return out + [p for p in zip(code, code[1:], code[2:]) if p[1]]


def test_equals_brute_force(spark, docs):
    rows = docs.where("lang is not null").collect()
    counts = {}
    for r in rows:
        counts.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    total = {x: sum(c.values()) for x, c in counts.items()}
    best = {g: max(counts[x][g] / total[x] for x in counts) for x in counts for g in counts[x]}
    typical = {x: {g for g, n in c.items() if n >= 3 and n / total[x] >= 0.5 * best[g]} for x, c in counts.items()}
    model = language_id.learn(docs)
    assert model["languages"] == sorted(counts)
    same = 0
    for r in rows:
        grams = plain_grams(r["text"])
        exact = np.array([sum(g in typical[x] for g in grams) for x in model["languages"]], float)
        got = language_id.votes(model, [r["text"]])[0][0]
        # A filter forgets nothing, and its false positives are taken off again.
        assert (got * (1 - model["fpr"]) + len(grams) * model["fpr"] >= exact - 1e-6).all()
        assert (abs(got - exact) <= 6 * np.sqrt(len(grams) * model["fpr"] + 1) + 3).all()
        same += model["languages"][int(got.argmax())] == model["languages"][int(exact.argmax())]
    assert same >= 0.99 * len(rows)


def test_sample_of_the_labelled_rows(spark, docs):
    """The documented bound: fewer rows of each language, whole texts, and nearly the same answers."""
    few = language_id.learn(docs, rows_per_language=20)
    assert few["languages"] == language_id.learn(docs)["languages"]
    found = language_id.identify(docs, few).where("lang is not null and lang_pred <> 'und'")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.9


def test_stage_gives_the_language_found(docs):
    model = language_id.learn(docs.where(~language_id.held_out()))
    want = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).where("lang_pred <> 'und'").collect()}
    assert {r["doc_id"]: r["lang"] for r in language_id.with_known_language(docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))).collect()}.keys() == want.keys()
    assert {r["doc_id"]: r["lang"] for r in language_id.with_known_language(docs).collect()} == want
