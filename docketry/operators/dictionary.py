"""Dictionaries of many phrases looked up in one pass over each text, by an automaton of all phrases.

The phrases are a table. They are dealt to passes of at most about
``PASS_BYTES`` of phrases, so a worker's automaton is bounded whatever the
dictionary's size; each pass is one scan of the texts, and the passes' results
are combined exactly. Where one pass isn't enough, the rows are written
between passes, so a lost executor costs a reread of the last one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import materialize

#: Bytes of phrases in a pass; an automaton takes some fifty times as much.
PASS_BYTES = 4 << 20
#: Bytes that a phrase counts beside its text.
ENTRY_BYTES = 64


def _passes(phrases: DataFrame, text: str, pass_bytes: int) -> list[DataFrame]:
    """``phrases`` (distinct rows) in groups by a hash of their text."""
    size = phrases.agg(F.sum(F.octet_length(text) + ENTRY_BYTES)).first()[0] or 0
    n = max(1, math.ceil(size / pass_bytes))
    return [phrases.where(F.pmod(F.xxhash64(text), F.lit(n)) == k) for k in range(n)] if n > 1 else [phrases]


def longest_key(rows: DataFrame, text: str, keys: DataFrame, out: str = "country", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``rows`` with the value of the longest key that the text holds anywhere; null without one, or where the longest ones disagree.

    keys: (key, value). Both sides are compared in lower case; a length is
    counted in characters. Empty and null keys and null values are left out;
    repeated rows count once. Null and empty texts hold nothing.
    """
    spark = rows.sparkSession
    folded = keys.select(F.lower("key").alias("key"), F.col("value").cast("string").alias("value")).where("key <> '' and value is not null").distinct()
    parts = _passes(folded, "key", pass_bytes)
    if len(parts) > 1:
        folded = materialize(folded, "keys")
        parts = _passes(folded, "key", pass_bytes)
    rows = rows.withColumn("_found", F.lit(None).cast("struct<length:int,value:string,many:boolean>"))
    for k, part in enumerate(parts):
        # Bounded by the size of a pass, as dealt above.
        found: dict[str, set[str]] = {}
        for r in part.collect():
            found.setdefault(r["key"], set()).add(r["value"])
        here = spark.sparkContext.broadcast(found)

        @F.pandas_udf("struct<length:int,value:string,many:boolean>")
        def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            auto = ahocorasick.Automaton()
            for key, values in here.value.items():  # noqa: B023  pickled before the next pass
                auto.add_word(key, (len(key), values))
            if len(auto):
                auto.make_automaton()
            for texts in batches:
                yield pd.DataFrame([_longest(auto, x) for x in texts], columns=["length", "value", "many"]).astype({"length": "Int32", "value": object, "many": "boolean"})

        rows = rows.withColumn("_here", look(F.lower(text)))
        old, new = F.col("_found"), F.col("_here")
        same = F.struct(old["length"].alias("length"), old["value"].alias("value"), (old["many"] | new["many"] | (old["value"] != new["value"])).alias("many"))
        better = F.when(new["length"].isNull(), old).when(old.isNull() | (new["length"] > old["length"]), new).when(new["length"] < old["length"], old).otherwise(same)
        rows = rows.withColumn("_found", better).drop("_here")
        if k + 1 < len(parts):
            rows = materialize(rows, "looked")
    return rows.withColumn(out, F.when(~F.col("_found.many"), F.col("_found.value"))).drop("_found")


def _longest(auto: ahocorasick.Automaton, text: str | None) -> tuple[int | None, str | None, bool | None]:
    """(length, a value, whether there are several) of the longest keys in a text."""
    best, values = 0, set()
    if text and len(auto):
        for _, (length, of) in auto.iter(text):
            if length > best:
                best, values = length, of
            elif length == best and not of <= values:
                values = values | of
    return (best, min(values), len(values) > 1) if best else (None, None, None)


#: What counts as white space in a text.
_SPACES = np.array([k for k in range(0x3001) if chr(k).isspace()], dtype=np.uint32)


def _folded(text: str) -> tuple[str, str, np.ndarray]:
    """(lower case, as it stands, where each character begins), each with white space as one space; the last place is the text's end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    blank = np.isin(codes, _SPACES)
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    keep[:1] = True
    codes[blank] = 32
    plain = codes[keep].tobytes().decode("utf-32-le", "surrogatepass")
    low = plain.lower()
    if len(low) != len(plain):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in plain)
    return low, plain, np.append(np.flatnonzero(keep), len(text))


def _joins(c: str) -> bool:
    return c.isalnum() or c == "_"


def phrase_automaton(phrases: list[tuple[str, bool]]) -> ahocorasick.Automaton:
    """An automaton of (phrase, whether its case counts); blank phrases are left out. Each entry holds None, or the spellings whose case counts."""
    forms: dict[str, set[str] | None] = {}
    for phrase, cased in phrases:
        plain = " ".join((phrase or "").split())
        if not plain:
            continue
        low = _folded(plain)[0]
        if not cased:
            forms[low] = None
        elif forms.get(low, set()) is not None:
            forms.setdefault(low, set()).add(plain)
    auto = ahocorasick.Automaton()
    for low, spellings in forms.items():
        auto.add_word(low, (len(low), spellings))
    if len(auto):
        auto.make_automaton()
    return auto


def phrase_spans(auto: ahocorasick.Automaton, text: str | None) -> list[tuple[int, int]]:
    """Spans of phrases in a text, leftmost first and of those the longest, without overlaps.

    A phrase stands between characters that aren't letters, digits or ``_``;
    any white space may stand between its words.
    """
    if not text or not len(auto):
        return []
    low, plain, places = _folded(text)
    hits = []
    for last, (length, spellings) in auto.iter(low):
        a, b = last + 1 - length, last + 1
        if (a == 0 or not _joins(plain[a - 1])) and (b == len(plain) or not _joins(plain[b])) and (spellings is None or plain[a:b] in spellings):
            hits.append((a, -b))
    out, at = [], 0
    for a, b in sorted(hits):
        if a >= at:
            at = -b
            # A run of white space belongs to its first character, so an end is the place after the last kept one.
            out.append((int(places[a]), int(places[at - 1]) + 1))
    return out


def marked(auto: ahocorasick.Automaton, text: str | None, mark: str) -> tuple[str | None, int]:
    """A text with every phrase replaced, and how many there were."""
    spans = phrase_spans(auto, text)
    if not spans:
        return text, 0
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]]), len(spans)


def censor(rows: DataFrame, text: str, phrases: DataFrame, mark: str = "[CENSORED]", out: str = "censored", most_bytes: int = PASS_BYTES) -> DataFrame:
    """``rows`` with ``out``: (text, n), the text with every phrase replaced by ``mark`` and the number of places.

    phrases: (phrase, cased). Longest phrases must win over all others at a
    place, so they belong to one automaton: a table of more than
    ``most_bytes`` is refused. Null texts stay null, with no places.
    """
    spark = rows.sparkSession
    wanted = phrases.select("phrase", F.coalesce("cased", F.lit(False)).alias("cased")).where("phrase is not null").distinct()
    size = wanted.agg(F.sum(F.octet_length("phrase") + ENTRY_BYTES)).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of phrases are more than {most_bytes}")
    here = spark.sparkContext.broadcast([(r["phrase"], r["cased"]) for r in wanted.collect()])

    @F.pandas_udf("struct<text:string,n:int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = phrase_automaton(here.value)
        for texts in batches:
            yield pd.DataFrame([marked(auto, x, mark) for x in texts], columns=["text", "n"])

    return rows.withColumn(out, run(text))
