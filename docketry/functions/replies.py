"""Readers of a language model's replies: lists in brackets. A reply without one is an error, so it is asked again and never taken for an empty answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is stripped at both ends of an entry before its quotes.
BLANK = " \t\n\r\x0b\x0c"


def _or_error(found: Column, value: Column, what: str, reply: Column) -> Column:
    return F.when(found, value).otherwise(F.raise_error(F.concat(F.lit(f"no {what} in reply: "), F.coalesce(reply, F.lit("null")))))


def title_case(name: Column) -> Column:
    """Every space-separated word with a capital first letter and small ones after it."""
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), " ")


def names_in_reply(reply: Column, names: Column) -> Column:
    """Those of ``names`` (an array) that the first bracketed list of a reply holds, whatever their case and quotes, in the array's order."""
    inside = F.regexp_extract(reply, r"(?s)\[(.*?)\]", 1)
    said = F.transform(F.split(inside, ","), lambda p: F.lower(F.trim(F.trim(p, F.lit(BLANK)), F.lit("\"'"))))
    own = F.filter(names, lambda n: F.array_contains(said, F.lower(n)) | F.array_contains(said, F.lower(title_case(n))))
    return _or_error(F.coalesce(reply.rlike(r"(?s)\[.*?\]"), F.lit(False)), own, "bracketed list", reply)


def phrases_in_reply(reply: Column) -> Column:
    """The phrases of the JSON array from a reply's first to its last bracket, trimmed, without blank ones."""
    inside = F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), "array<string>")
    trimmed = F.filter(F.transform(inside, lambda p: F.trim(p, F.lit(BLANK))), lambda p: p != "")
    return _or_error(inside.isNotNull(), trimmed, "JSON array", reply)


def corrected(cell: Column, typos: dict[str, str]) -> Column:
    """A cell that is exactly one of the literals becomes what it should be."""
    out = cell
    for wrong, right in typos.items():
        out = F.when(cell == wrong, right).otherwise(out)
    return out


def noun_of(kinds: list[str] | None, whole: str, plural: bool = False) -> str:
    """What a choice of kinds is called in a title: ``whole`` for all kinds, else the kinds joined by a slash."""
    return ("/".join(kinds) if kinds is not None else whole) + ("s" if plural else "")
