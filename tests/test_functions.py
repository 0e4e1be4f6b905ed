import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.functions import dates, names, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def values(spark, kind, rows, f):
    return [r["x"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(rows)], f"k int, v {kind}").orderBy("k").select(f(F.col("v")).alias("x")).collect()]


def test_split_parties_keeps_order_repeats_and_empty_names(spark):
    assert values(spark, "array<string>", [["UK| Chile ", "Peru|"], []], names.split_parties) == [["uk", "chile", "peru", ""], []]


def test_aliases_must_be_unambiguous(spark):
    rows = spark.createDataFrame([("Chile", "CL"), ("Peru", "cl")], "country string, alias string")
    with pytest.raises(ValueError):
        names.checked_aliases(rows)


@pytest.mark.parametrize(("numeral", "value"), [("I", 1), ("IV", 4), ("XIX", 19), ("XLIV", 44), ("LXXXIX", 89)])
def test_roman(spark, numeral, value):
    assert one(spark, dates.roman_value(F.lit(numeral))) == value


def test_meeting_names(spark):
    cases = {"ATCM XXIV": 2001, "Report of ATCM24": 2001, "ATCM 50": 2028, "SATCM XI (Utrecht, 1994)": 1994, "ATCM Information Paper": None, "Meeting (1991)": 1991, "ATCM I - Canberra": 1961}
    assert values(spark, "string", list(cases), dates.year_of_meeting_name) == list(cases.values())


def test_statuses(spark):
    cases = {"Effective 11/05/2016": 2016, "Not yet effective": 2025, "Effective 30/04/1962. No longer current:D 1 (2014)": 2014, "Did not enter into effect. Withdrawn:M 3 (2012)": 2012}
    assert values(spark, "string", list(cases), dates.end_year) == list(cases.values())
    assert values(spark, "string", ["Effective 31/02/2016", "Effective 1/2/1999", "x"], dates.adoption_year) == [None, 1999, None]


def test_unknown_status_raises(spark):
    with pytest.raises(Exception, match="no year in status"):
        values(spark, "string", ["pending"], dates.end_year)


def test_cells(spark):
    assert values(spark, "string", ["40-60", "12", "", "many"], text.first_figure) == [40, 12, 0, 0]
    assert values(spark, "string", ["1,200", " ", "7"], text.thousands) == [1200.0, 0.0, 7.0]
    assert values(spark, "string", ["Fauna - Flora", "sub-polar", "-", "A - - - B"], text.spaced_topics) == [["Fauna", "Flora"], ["sub-polar"], [], ["A", "B"]]
    assert values(spark, "string", ['["a","b"]', "plain"], text.tag_list) == [["a", "b"], ["plain"]]


def test_paths(spark):
    assert values(spark, "string", ["https://x.org/a/b/wp001_e.PDF?x=1", "http://x.org/c.docx", "http://x.org"], text.url_to_path) == ["a/b/wp001_e.txt", "c.txt", ""]
    assert values(spark, "string", ["/a/b/wp001_e.txt", "noext", "a.b.c"], text.stem) == ["wp001_e", "noext", "a.b"]


def test_invisible_and_garbled(spark):
    assert values(spark, "string", ["a​b\x01\n\tc"], text.without_invisible) == ["ab\n\tc"]
    assert values(spark, "string", ["\x01\x02abc", "clean text", "   ", None], text.is_garbled) == [True, False, False, False]


def test_censor(spark):
    f = lambda c: text.censor(c, ["United States", "States", "US", "Chilé"], "X", frozenset({"US"}))
    assert values(spark, "string", ["The united\n states and us, US; statesman chilé.", "nothing"], f) == ["The X and us, X; statesman X.", "nothing"]
    assert values(spark, "string", ["same"], lambda c: text.censor(c, [])) == ["same"]


def test_spans_are_ordered_and_rebuild_the_text(spark):
    body = 'First one. Second "two!" Third?\n\nFourth without end'
    spans = text.sentence_spans(body)
    assert [body[a:b] for a, b in spans] == ["First one.", 'Second "two!"', "Third?", "Fourth without end"]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert text.chunk_spans(body, 3)[0] == (0, spans[2][1]) and text.sentence_spans("  ") == []
    rows = spark.createDataFrame([(body,), (None,), ("",)], "t string").select(text.sentence_chunks(2)("t").alias("c")).collect()
    assert [len(r["c"]) for r in rows] == [2, 0, 0]


def test_span_censor_only_inside_its_span(spark):
    rows = spark.createDataFrame([("the cat the dog", [(0, 7, ["the"])])], "t string, s array<struct<start:int,end:int,phrases:array<string>>>")
    assert rows.select(text.censor_spans("#")("t", "s").alias("x")).first()["x"] == "# cat the dog"


def test_partial_ratio():
    assert text.partial_ratio("norway", "the norway paper") == 100
    assert text.partial_ratio("the united kingdom", "kingdom") == 100
    assert text.partial_ratio("norway", "norwey said") == 83
    assert text.partial_ratio("", "abc") == 0


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<double>")
    got = rows.select(vectors.dot(F.col("a"), F.col("b")).alias("d"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.unit(F.col("a")).alias("u")).collect()
    assert got[0]["d"] == 8.0 and got[0]["c"] == pytest.approx(0.8) and np.allclose(got[0]["u"], [0.6, 0.8])
    assert got[1]["c"] is None and got[1]["u"] == [0.0, 0.0]


def test_meeting_names_cut_at_their_abbreviation(spark):
    cases = {
        "ATCM XI (Buenos Aires, 1981)": 1981, "SATCM XI (Utrecht, 1994)": 1994, "ATCM24": 2001, "ATCM 24 - Town": 2001, "ATCM XXIV": 2001, "ATCM Information Paper": None,
        "ATCM Information (2003)": 2003, "SATCM IV and ATCM XV": 1989, "ATCMATCM I": None, "ATCM": None, "none": None, "": None, "a) b, 1994)": None, "(Bonn), x (Oslo,  1975)": 1975,
        "Town (CEP, 1999) (2004)": 2004, "ATCM\tII": 1962, "ATCM 50": 2028, "x-ATCM V.": 1968, "(1999": None, "(19999)": None,
    }
    assert values(spark, "string", list(cases), dates.year_of_meeting_name) == list(cases.values())
    assert values(spark, "string", [None], dates.year_of_meeting_name) == [None]


def test_statuses_by_exact_words(spark):
    cases = {
        "Not yet effective": 2025, "  Not yet effective\n": 2025, "Not yet effective (2014)": 2014, "Effective 11/05/2016": 2016, "Effective  06/10/2009 (Fast Approval)": 2009,
        "Did not enter into effect. Withdrawn:M 10 (2008)": 2008, "Effective 01/02/2003. No longer current (2011) ": 2011, "Now Effective\t01/02/2003!": 2003,
    }
    assert values(spark, "string", list(cases), dates.end_year) == list(cases.values())
    for wrong in ("Effective 1/2/2003", "Not yet effective.", "Effective on 01/02/2003"):
        with pytest.raises(Exception, match="no year in status"):
            values(spark, "string", [wrong], dates.end_year)
