"""Meeting numbers, years and statuses read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The year of each numbered meeting, from the first on.
MEETING_YEARS = [1961, 1962, 1964, 1966, 1968, 1970, 1972, 1975, 1977, 1979, 1981, 1983, 1985, 1987, 1989, 1991, 1992, 1994, 1995, 1996, 1997, 1998, 1999, 2001, 2002, 2003, 2004, 2005, 2006, 2007, 2008, 2009, 2010, 2011, 2012, 2013, 2014, 2015, 2016, 2017, 2018, 2019, 2021, 2022]
#: What a measure that isn't in force yet is counted up to.
OPEN_END = 2025
_BLANKS = " \t\n\x0b\x0c\r"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def roman_value(numeral: Column) -> Column:
    """I, V, X, L numerals: a letter before a larger one is subtracted."""
    digit = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).otherwise(0)
    values = F.transform(F.filter(F.split(numeral, ""), lambda c: c != ""), digit)
    signed = F.transform(values, lambda v, k: F.when(v < F.coalesce(F.get(values, k + 1), F.lit(0)), -v).otherwise(v))
    return F.aggregate(signed, F.lit(0), lambda a, x: a + x)


def meeting_year(number: Column) -> Column:
    """Year of a numbered meeting; numbers outside the table are counted on from its end, one a year."""
    table = F.array(*(F.lit(y) for y in MEETING_YEARS))
    n = len(MEETING_YEARS)
    return F.when((number >= 1) & (number <= n), F.get(table, (number - 1).cast("int"))).otherwise(number - n + MEETING_YEARS[-1]).cast("int")


def _first(values: Column) -> Column:
    """The first of an array that isn't null."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), 0)


def year_of_meeting_name(name: Column) -> Column:
    """Roman number, then Arabic number, then a year in brackets; a special meeting's number isn't one of these.

    The name is cut at the meetings' abbreviation: what begins a cut's right side is its number, unless a letter ends the
    left side, as in the abbreviation of the special meetings.
    """
    cut = F.split(name, "ATCM")
    apart = lambda k: F.when(F.get(cut, k - 1) == "", k == 1).otherwise(~F.right(F.get(cut, k - 1), F.lit(1)).rlike("[A-Za-z]"))
    behind = F.transform(cut, lambda p, k: F.when((k > 0) & apart(k), F.ltrim(F.translate(p, _BLANKS, " " * len(_BLANKS)))))
    letters = F.transform(behind, lambda p: F.regexp_extract(p, "^[A-Za-z]+", 0))
    roman = _first(F.transform(letters, lambda x: F.when((x != "") & (F.translate(x, "IVXL", "") == ""), x)))
    arabic = _first(F.transform(behind, lambda p: F.regexp_extract(p, "^[0-9]+", 0).try_cast("int")))
    # Each closing bracket's text: a year right after the opening one comes before a year that follows a comma inside.
    closed = F.split(name, "[)]")
    closed = F.slice(closed, 1, F.size(closed) - 1)
    year = lambda p: F.right(p, F.lit(4))
    lead = lambda p: F.left(p, F.length(p) - 4)
    whole = lambda p: (F.length(p) > 4) & year(p).rlike("^[0-9]{4}$")
    alone = _first(F.transform(closed, lambda p: F.when(whole(p) & (F.right(lead(p), F.lit(1)) == "("), year(p))))
    before = lambda p: F.rtrim(F.translate(lead(p), _BLANKS, " " * len(_BLANKS)))
    opened = lambda p, k: F.array_join(F.slice(closed, 1, k), "").contains("(") | lead(p).contains("(")
    listed = _first(F.transform(closed, lambda p, k: F.when(whole(p) & (F.right(before(p), F.lit(1)) == ",") & opened(p, k), year(p))))
    return F.coalesce(meeting_year(roman_value(roman)), meeting_year(arabic), F.coalesce(alone, listed).cast("int"))


def adoption_year(status: Column, two_digits: bool = False) -> Column:
    """Year of the first day/month/year in a status; null for an impossible date. two_digits: a day or month of one digit is no date, as in the corpus's own statuses."""
    digits = "[0-9]{2}" if two_digits else "[0-9]{1,2}"
    return F.year(F.try_to_timestamp(found(status, f"({digits}/{digits}/[0-9]{{4}})"), F.lit("dd/MM/yyyy" if two_digits else "d/M/yyyy")))


def end_year(status: Column) -> Column:
    """The year up to which a measure was open: not effective yet, then a closing year in brackets, then its date of two-digit day and month. Anything else is an error."""
    text = F.btrim(status, F.lit(_BLANKS))
    end = F.right(text, F.lit(6))
    closing = F.when(F.translate(end, "0123456789", "0000000000") == "(0000)", F.substring(end, 2, 4))
    words = F.filter(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), lambda w: w != "")
    date = lambda w: F.translate(F.left(w, F.lit(10)), "0123456789", "0000000000") == "00/00/0000"
    dated = _first(F.transform(words, lambda w, k: F.when((k > 0) & F.endswith(F.get(words, k - 1), F.lit("Effective")) & date(w), F.substring(w, 7, 4))))
    wrong = F.raise_error(F.concat(F.lit("no year in status: "), F.coalesce(status, F.lit("null")))).cast("int")
    return F.when(text == "Not yet effective", OPEN_END).when(closing.isNotNull(), closing.cast("int")).when(dated.isNotNull(), dated.cast("int")).otherwise(wrong)


def instrument_type(title: Column) -> Column:
    """Resolution, Decision, Measure or Recommendation at the start of a title."""
    return found(title, r"^(Resolution|Decision|Measure|Recommendation)")


# Patterns of meeting names, the kind that each stands for, in the order in which they are tried.
MEETING_KINDS = [("CCAMLR", "CCAMLR"), ("CCAS", "CCAS"), ("SATCM", "SATCM"), ("ATCM|CEP|Antarctic Conference|ATIP", "ATCM")]


def meeting_type(name: Column) -> Column:
    """The first of the known kinds of meeting that a name holds."""
    return F.coalesce(*(F.when(name.rlike(pattern), kind) for pattern, kind in MEETING_KINDS), F.lit("Unknown"))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")
