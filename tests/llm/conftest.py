import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, an extra column with a name that operators use."""
    long = "\n".join(f"line {k} of a very long text that goes on and on for a while" for k in range(2000))
    rows = [
        (1, "The same line stands in many of these documents, again and again.\nown line one", "en", "a", 5, "x"),
        (1, "The same line stands in many of these documents, again and again.\nown line one", "en", "a", 5, "x"),
        (2, None, "en", "a", None, "y"),
        (3, "", None, None, 0, None),
        (None, "A text without an id, of some words.", "en", "b", 3, "z"),
        (4, long, "en", "b", len(long), "z"),
        (5, "!!! ??? ...", "de", "b", 11, "z"),
        (6, "日本語の文章 ▁ und mehr\tText", "de", None, 9, "z"),
        (7, "one", "de", "c", 3, "z"),
        (8, " \t\n ", None, "c", 4, "z"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string")
    clashing = ["lang_pred", "lang_score", "pieces", "decoded", "size", "target", "times", "kept", "key", "text_hash", "n_lines", "kept_text", "gone", "h", "k", "n"]
    return frame.withColumns({c: F.lit(c) for c in clashing})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
