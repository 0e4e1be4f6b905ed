import random
import re

import numpy as np
import pytest

from docketry.llm import license_scan
from docketry.llm.queries import op1_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(label, k) for phrase, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def brute_blocks(text):
    """All runs of every length and place; of those of one template that overlap, the one that holds most of it, in its order."""
    low = (text or "").translate(LOWER)
    found = [(m[0], m.start()) for m in WORD.finditer(low)]
    words = [w for w, _ in found]
    lines, over = set(), set()
    for label, t in license_scan.TEMPLATES:
        said = t.split()
        need, width = set(said), len(said) + len(said) // 2
        if len(need & set(words)) < license_scan.CONTAINMENT * len(need):
            continue
        name = next((w for w in license_scan.NAMES.get(label, "").split() if w in said), None)
        runs = []
        for a in range(len(words)):
            for z in range(a + 1, min(a + width, len(words)) + 1):
                have = need & set(words[a:z])
                if words[a] in need and words[z - 1] in need and len(have) / len(need) >= license_scan.CONTAINMENT:
                    part = [w for w in words[a:z] if w in need]
                    loose = z - 1 - a - sum(p in list(zip(said, said[1:])) for p in zip(part, part[1:]))
                    runs.append((-len(have), name is not None and name not in have, loose, z - 1 - a, a, z))
        taken = []
        for common, _, _, _, a, z in sorted(runs):
            if all(z <= x or a >= y for x, y in taken):
                taken.append((a, z))
                wraps = "\n" in low[found[a][1] : found[z - 1][1]]
                (over if wraps else lines).add((label, a, z - a, round(-common / len(need), 9)))
    return lines, over


def check(frame):
    want = {}
    for r in frame.select("doc_id", "text").collect():
        want.setdefault(r["doc_id"], []).append((brute(r["text"]), brute_blocks(r["text"])))
    rows = license_scan.scan(frame).collect()
    assert len(rows) == sum(map(len, want.values()))
    for r in rows:
        told = lambda blocks: {(b["label"], b["first_word"], b["n_words"], round(b["containment"], 9)) for b in blocks}
        got = ((r["n_words"], sorted((p["label"], p["word"]) for p in r["places"])), (told(r["blocks"]), told(r["wrapped"])))
        assert got in want[r["doc_id"]]
    return rows


def test_equals_brute_force(docs):
    assert sum(len(r["blocks"]) > 0 for r in check(docs)) > 0


def test_odd_rows(odd, none):
    check(odd)
    assert license_scan.scan(none).count() == 0


def test_long_lines_and_near_notices(spark):
    filler = " ".join(f"w{k}" for k in range(400))
    rows = spark.createDataFrame([
        (1, filler + " licensed under the apache license version 2 0 " + filler),
        (2, "This work is licensed under the GNU General Public License, version 2"),
        (3, "gnu general\npublic license; CC-BY; the MIT License"),
        (4, "all of the work is public"),
    ], "doc_id long, text string")
    got = {r["doc_id"]: {b["label"] for b in r["blocks"] if b["best"]} for r in check(rows)}
    assert "apache" in got[1] and got[2] == {"gpl"} and not got[4]


def test_like_notices_give_no_label_of_another_license(spark):
    rows = spark.createDataFrame([
        (1, "Released under the BSD license."),
        (2, "Licensed under CC BY 4.0."),
        (3, "Licensed under CC BY-SA 4.0."),
        (4, "This work is licensed under the GNU Lesser General Public License, version 3."),
        (5, "This work is licensed under the GNU Affero General Public License, version 3."),
        (6, "Released under the MIT license. Licensed under the Apache License, version 2.0."),
    ], "doc_id long, text string")
    got = {r["doc_id"]: {b["label"] for b in r["blocks"] if b["best"]} for r in check(rows)}
    assert got == {1: set(), 2: set(), 3: {"cc-by-sa"}, 4: {"lgpl"}, 5: {"agpl"}, 6: {"mit", "apache"}}


def test_query_columns(spark, sf):
    rows = op1_license_scan(spark, sf).collect()
    assert all((r["n_base"] == 0) == (r["first_word"] is None) for r in rows)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1 for r in rows)


APACHE = "You may not use this file except in compliance with the License.\n{}You may obtain a copy of the License at\n{}    http://example.org/LICENSE-2.0"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\n{}of this software and associated documentation files (the Software), to deal"
BSD = "Redistribution and use in source and binary forms, with or without\n{}modification, are permitted provided that the following conditions are met:"
GPL = "This program is free software; you can redistribute it and/or modify\n{}it under the terms of the GNU {}General Public License as published"


def test_notices_wrapped_over_lines(spark):
    texts = {
        "apache": APACHE.format("# ", "# "), "mit": MIT.format(" * "), "bsd": BSD.format("dnl "), "gpl": GPL.format("rem ", ""), "lgpl": GPL.format("// ", "Lesser "), "agpl": GPL.format("", "Affero "),
        "gpl,lgpl": "This work is licensed under the GNU\nGeneral Public License, version 3.\nThis work is licensed under the GNU Lesser\nGeneral Public License, version 3.",
        "mit,mpl": "x\n" * 300 + "Released under\nthe MIT license.\nThis Source Code Form is subject to the terms\nof the Mozilla Public License, v. 2.0",
        "": "You may not use this file\n" + "except by law " * 30 + "\nobtain a copy of the License at",
    }
    rows = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {r["doc_id"]: r for r in check(rows)}
    for k, want in enumerate(texts):
        assert ",".join(sorted({b["label"] for b in got[k]["wrapped"] if b["best"]})) == want
    assert all(not b["n_words"] > 40 for r in got.values() for b in r["wrapped"])


def test_a_notice_on_one_line_counts_once(spark):
    rows = spark.createDataFrame([(1, "the license of\nThis work is licensed under the GNU Lesser General Public License, version 3.\nthe public version")], "doc_id long, text string")
    assert not check(rows)[0]["wrapped"]


def test_query_counts_wrapped_notices(spark, tmp_path):
    spark.createDataFrame([(1, MIT.format("# "))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = op1_license_scan(spark, str(tmp_path)).first()
    assert (row["labels"], row["n_blocks"], row["score"]) == ("mit", 1, 1.0)


def test_long_creative_commons_notices(spark):
    texts = {
        "Attribution": {"cc-by"}, "Attribution-NonCommercial": {"cc-by-nc"}, "Attribution-ShareAlike": {"cc-by-sa"}, "Attribution-NoDerivatives": {"cc-by-nd"}, "Attribution-Share Alike": {"cc-by-sa"},
        "Attribution-NonCommercial-ShareAlike": {"cc-by-nc", "cc-by-sa"}, "Attribution-NonCommercial-\nNoDerivatives": {"cc-by-nc", "cc-by-nd"}, "Attribution-Non-Commercial-No Derivatives": {"cc-by-nc", "cc-by-nd"},
    }
    rows = spark.createDataFrame([(k, f"This work is licensed under a Creative Commons {t} 4.0 International License.") for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: {b["label"] for b in r["blocks"] + r["wrapped"] if b["best"]} for r in check(rows)}
    assert list(texts.values()) == [got[k] for k in range(len(texts))]


def test_one_rule_for_every_length(spark):
    notice = "This work is licensed under the GNU General Public License, version 3"
    rows = spark.createDataFrame([(k, " ".join(["w"] * k + [notice] + ["w"] * 5)) for k in (0, 238, 239, 240, 500, 5000)], "doc_id long, text string")
    got = [[(b["label"], b["n_words"]) for b in r["blocks"] if b["best"]] for r in check(rows)]
    assert got == [[("gpl", 12)]] * 6


def test_templates_of_a_table(spark, monkeypatch):
    table = spark.createDataFrame([("own", "all rights go to the house of words"), ("other", "nothing of this may be copied at all")], "label string, text string")
    rows = spark.createDataFrame([(1, "All rights\ngo to the House, of Words."), (2, "all rights to words")], "doc_id long, text string")
    got = {r["doc_id"]: [b["label"] for b in r["wrapped"] + r["blocks"]] for r in license_scan.scan(rows, templates=table).collect()}
    assert got == {1: ["own"], 2: []}
    assert all(not r["blocks"] for r in license_scan.scan(rows, templates=table.where("false")).collect())
    monkeypatch.setattr(license_scan, "MOST_WORDS", 10)
    with pytest.raises(ValueError):
        license_scan.scan(rows, templates=table)


def test_score_is_that_of_the_labels(spark, tmp_path):
    rows = [(1, "Released under the BSD license."), (2, "licensed under the apache license version 2"), (3, None), (4, "the MIT License")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["labels"], round(r["score"], 3)) for r in op1_license_scan(spark, str(tmp_path)).collect()}
    assert got == {1: ("", 0.0), 2: ("apache", 1.0), 3: ("", 0.0), 4: ("mit", 1.0)}


def test_closing_notices_of_the_gnu_licenses(spark):
    line = "You should have received a copy of the GNU {}General Public License along with this {}."
    rows = [(k, line.format(*x)) for k, x in enumerate([("", "program"), ("Lesser ", "library"), ("Lesser ", "program"), ("Affero ", "program")])]
    got = {r["doc_id"]: {b["label"] for b in r["blocks"] if b["best"]} for r in check(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {0: {"gpl"}, 1: {"lgpl"}, 2: {"lgpl"}, 3: {"agpl"}}


def own_template(text, order):
    return license_scan._Template("own", text, {w: k for k, w in enumerate(order.split())}, 0.8, {})


def test_positional_filter_rejects_what_the_other_filters_pass():
    x = own_template("a b c d e f g h i j", "a b c d e f g h i j")
    assert (x.need, x.prefix, x.span) == (8, [0, 1, 2], 15)
    # Eight of its words stand near the place of c, but only six of them come at or after it; so neither d nor what is left reaches eight.
    near, far = np.array([2, 0, 1, 3, 4, 5, 6, 7]), np.arange(8) * 3
    assert x.leads(np.arange(8), near).tolist() == [1]
    assert x.leads(np.arange(8), np.array([2, 3, 4, 5, 6, 7, 8, 9])).tolist() == [0]
    assert x.leads(far, near).tolist() == []


def test_positional_filter_loses_no_block():
    draw = random.Random(3)
    words, rejected = "a b c d e f g h i j", 0
    for _ in range(400):
        x = own_template(" ".join(draw.sample(words.split(), 8)), words)
        at = np.array(sorted(draw.sample(range(60), 30)))
        token = np.array([draw.choice(x.ids) for _ in at])
        _, place = x.own(token)
        lead = np.sort(x.leads(at, place))
        rejected += int((place < len(x.prefix)).sum()) - len(lead)
        near = license_scan._near(lead, at, x.span)
        end = [100] * len(at)
        assert x.blocks(at[near].tolist(), token[near].tolist(), end) == x.blocks(at.tolist(), token.tolist(), end)
    assert rejected > 0


def test_many_notices_in_one_text(spark):
    notice = MIT.format("") + " a word between "
    rows = spark.createDataFrame([(n, notice * n) for n in (1, 30, 8_000)], "doc_id long, text string")
    check(rows.where("doc_id <= 30"))
    got = license_scan.scan(rows).collect()
    assert {r["doc_id"]: sum(b["best"] for b in r["blocks"] + r["wrapped"] if b["label"] == "mit") for r in got} == {n: n for n in (1, 30, 8_000)}


def test_a_table_of_many_templates(spark):
    table = [(f"t{k}", " ".join(f"w{k}x{j}" for j in range(20))) for k in range(2_000)]
    rows = spark.createDataFrame([(1, table[17][1] + " and " + table[1_999][1].upper())], "doc_id long, text string")
    assert [b["label"] for b in license_scan.scan(rows, templates=table).first()["blocks"]] == ["t17", "t1999"]
