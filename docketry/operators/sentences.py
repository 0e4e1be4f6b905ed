"""A sentence splitter that learns from the corpus which dotted words are abbreviations and which words open sentences.

Learning counts words in Spark (Kiss and Strunk, 2006): a word is an
abbreviation if its uses with a full stop pass what chance gives, the more so
the shorter it is and the more stops stand inside it; a word opens sentences
if it follows sure ends more often than chance gives, or if it is never
capitalised elsewhere; a word leads numbers (``No. 3``) if digits follow its
full stop more often than chance gives. Splitting reads the learned words in
Arrow batches. A word that stands at ends of sentences only can't be told from
an abbreviation; openers after it still end its sentence.

The word lists are bounded by shares and not by cuts: an abbreviation or a
lead holds at least ``RARE_STOP`` of all full stops and an opener at least
``RARE_START`` of all sentence starts, so there are at most 100,000, 100,000
and 5,000 of them in a corpus of any size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.session import materialize

SPACE = "[\\t\\n\\r ]+"
#: Quotes and brackets that may stand around a word and don't belong to it.
AROUND = "\"'()[]«»“”‘’"
#: What may follow a word beside a full stop.
MARKS = ",;:!?."
#: Longer words are counted, but are no type: the factor for length leaves nothing of their score.
LONGEST = 32
LEAST_SCORE = 0.3
LEAST_SCORE_OF_PAIRS = 30.0
RARE_STOP = 1e-5
RARE_START = 2e-4


@dataclass(frozen=True)
class Splitter:
    """Learned words in lower case: ``abbreviations`` and ``leads`` without their last full stop, ``openers``."""

    abbreviations: frozenset[str] = frozenset()
    leads: frozenset[str] = frozenset()
    openers: frozenset[str] = frozenset()


def _dotted(core: Column) -> Column:
    """Whether a word ends in one full stop (and not in an ellipsis)."""
    return F.endswith(core, F.lit(".")) & ~F.endswith(core, F.lit(".."))


def _word(core: Column) -> Column:
    return F.lower(F.when(_dotted(core), F.expr("substring(core, 1, length(core) - 1)")).otherwise(F.rtrim(core, F.lit(MARKS))))


def _is_type(word: Column) -> Column:
    return (F.length(word) <= LONGEST) & word.rlike(r"\p{L}")


def _neighbours(rows: DataFrame, text: str) -> DataFrame:
    """(before, core, after): each word of the texts, without what stands around it, beside its neighbours (``!`` and empty at the ends), by one walk over a text's words."""
    words = F.filter(F.transform(F.split(F.col(text), SPACE), lambda w: F.trim(w, F.lit(AROUND))), lambda w: w != "")
    shifted = F.arrays_zip(F.col("_w").alias("core"), F.concat(F.array(F.lit("!")), "_w").alias("before"), F.concat(F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))), F.array(F.lit(""))).alias("after"))
    return rows.select(words.alias("_w")).select(F.explode(shifted).alias("p")).select("p.before", "p.core", "p.after").where("core is not null")


def word_counts(rows: DataFrame, text: str) -> DataFrame:
    """(word, dotted, plain, numbered): how often each word stands with and without a full stop, and with one before digits. Null and empty texts have no words."""
    dot, digits = _dotted(F.col("core")), F.substring("after", 1, 1).rlike("[0-9]")
    words = _neighbours(rows, text).select(_word(F.col("core")).alias("word"), dot.cast("long").alias("dot"), (dot & digits).cast("long").alias("number")).where(_is_type(F.col("word")))
    return words.groupBy("word").agg(F.sum("dot").alias("dotted"), F.sum(1 - F.col("dot")).alias("plain"), F.sum("number").alias("numbered"))


def abbreviations(counts: DataFrame, stops: int, words: int) -> DataFrame:
    """(word, dotted, plain, score) of the words that are abbreviations, from ``word_counts`` and its sums.

    The likelihood that full stops follow a word by chance is compared with
    that of an abbreviation's (99 of 100 uses). Where full stops follow all
    words of a corpus, chance counts as 99 of 100 too, and nothing passes.
    """
    if not stops:
        return counts.withColumn("score", F.lit(0.0)).where("false")
    chance = min(stops / words, 0.99)
    gain = 2 * (F.col("dotted") * F.lit(math.log(0.99) - math.log(chance)) + F.col("plain") * F.lit(math.log(0.01) - math.log(1 - chance)))
    bare = F.length(F.replace("word", F.lit("."))).cast("double")
    stops_inside = F.length("word") - F.length(F.replace("word", F.lit(".")))
    score = gain * F.exp(-bare) * (stops_inside + 1) * F.pow(bare, -F.col("plain"))
    return counts.where(F.col("dotted") >= F.lit(RARE_STOP * stops)).withColumn("score", score).where(F.col("score") >= LEAST_SCORE)


def start_counts(rows: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """(word, starts, capital_starts, capital_inside, small_inside) of each word, by whether it follows a sure end of a sentence.

    A sure end is ``!``, ``?`` or the full stop of a word that isn't in
    ``known`` (a table of abbreviations, bounded as above), isn't one letter
    and isn't a number. The first word of a text follows a sure end.
    """
    pairs = _neighbours(rows, text)
    pairs = pairs.select("before", F.substring("core", 1, 1).rlike(r"\p{Lu}").alias("capital"), _word(F.col("core")).alias("word")).where(_is_type(F.col("word")))
    pairs = pairs.select("word", "capital", F.right("before", F.lit(1)).isin("!", "?").alias("shout"), F.when(_dotted(F.col("before")), F.expr("lower(substring(before, 1, length(before) - 1))")).alias("stopped"))
    pairs = pairs.join(F.broadcast(known.select(F.col("word").alias("stopped"), F.lit(True).alias("_known"))), "stopped", "left")
    sure = F.coalesce(F.col("shout") | (F.col("_known").isNull() & (F.length("stopped") > 1) & F.col("stopped").rlike(r"\p{L}")), F.lit(False))

    def count(of: Column) -> Column:
        return F.sum(of.cast("long"))

    pairs = pairs.select("word", "capital", sure.alias("sure"))
    return pairs.groupBy("word").agg(count(F.col("sure")).alias("starts"), count(F.col("sure") & F.col("capital")).alias("capital_starts"), count(~F.col("sure") & F.col("capital")).alias("capital_inside"), count(~F.col("sure") & ~F.col("capital")).alias("small_inside"))


def _likely(hits: Column, of: Column, rate: Column) -> Column:
    """Log likelihood of ``hits`` in ``of`` trials; no hits or all hits add nothing by their empty part."""
    return F.when(hits > 0, hits * F.ln(rate)).otherwise(0.0) + F.when(of > hits, (of - hits) * F.ln(1 - rate)).otherwise(0.0)


def _association(hits: Column, of: Column, other_hits: Column, other: Column) -> Column:
    """Twice the log likelihood ratio of two rates against one common rate."""
    both = (hits + other_hits) / (of + other)
    return 2 * (_likely(hits, of, hits / of) + _likely(other_hits, other, other_hits / other) - _likely(hits, of, both) - _likely(other_hits, other, both))


def leads(counts: DataFrame, stops: int, numbers: int) -> DataFrame:
    """(word, numbered, dotted, score) of the words whose full stop leads to a number, from ``word_counts`` and its sums. A word that holds all full stops has nothing to be compared with."""
    hits, of = F.col("numbered").cast("double"), F.col("dotted").cast("double")
    some = counts.where((F.col("dotted") >= F.lit(RARE_STOP * stops)) & (F.col("dotted") > 0) & (F.col("dotted") < stops) & (F.col("numbered") * F.lit(stops) > F.col("dotted") * F.lit(numbers)))
    scored = some.withColumn("score", _association(hits, of, numbers - hits, stops - of))
    return scored.where(F.col("score") >= LEAST_SCORE_OF_PAIRS).select("word", "numbered", "dotted", "score")


def openers(counts: DataFrame, starts: int, words: int) -> DataFrame:
    """(word, starts, inside, score) of the words that open sentences, from ``start_counts`` and its sums."""
    if not starts or words == starts:
        return counts.select("word", "starts", F.lit(0).cast("long").alias("inside"), F.lit(0.0).alias("score")).where("false")
    inside = F.col("capital_inside") + F.col("small_inside")
    first, rest = F.col("starts").cast("double"), inside.cast("double")
    n, m = float(starts), float(words - starts)
    score = _association(first, F.lit(n), rest, F.lit(m))
    scored = counts.where(F.col("capital_starts") >= F.lit(RARE_START * starts)).select("*", inside.alias("inside"), score.alias("score"))
    often = (F.col("score") >= LEAST_SCORE_OF_PAIRS) & (F.col("starts") / n > F.col("inside") / m)
    never = (F.col("capital_inside") == 0) & (F.col("small_inside") > 0)
    return scored.where(often | never).select("word", "starts", "inside", "score")


def learn_tables(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of ``abbreviations``, ``leads`` and ``openers`` of a corpus. Two passes over the texts; what is shuffled is a count per word and task."""
    counted = materialize(word_counts(rows, text), "words")
    sums = counted.agg(F.sum("dotted").alias("stops"), F.sum(F.col("dotted") + F.col("plain")).alias("words"), F.sum("numbered").alias("numbers")).first()
    known = materialize(abbreviations(counted, sums["stops"] or 0, sums["words"] or 0), "abbreviations")
    begun = materialize(start_counts(rows, text, known), "starts")
    begins = begun.agg(F.sum("starts").alias("starts"), F.sum(F.col("starts") + F.col("capital_inside") + F.col("small_inside")).alias("words")).first()
    return known, leads(counted, sums["stops"] or 0, sums["numbers"] or 0), openers(begun, begins["starts"] or 0, begins["words"] or 0)


def learn(rows: DataFrame, text: str) -> Splitter:
    """A splitter learned from all texts; its lists are bounded as the module says, so the driver holds at most 205,000 words."""
    return Splitter(*(frozenset(r["word"] for r in table.select("word").collect()) for table in learn_tables(rows, text)))


#: Marks that may end a sentence with what closes after them, before white space; or a blank line. A run of marks is tried once.
_END = re.compile(r"(?<![.!?])([.!?]++)[\"')\]»”’]*+(?=\s|\Z)|\n[^\S\n]*\n\s*")


def _ends_here(text: str, start: int, m: re.Match, splitter: Splitter) -> bool:
    """Whether marks end a sentence: an abbreviation, a number or a letter with a full stop does so only before a word that opens sentences."""
    rest = m.end()
    while rest < len(text) and (text[rest].isspace() or text[rest] in AROUND):
        rest += 1
    small = rest < len(text) and text[rest].islower()
    if m[1] != ".":
        return not (m[1].startswith("..") and set(m[1]) == {"."} and small)
    at = m.start()
    while at > start and not text[at - 1].isspace():
        at -= 1
    word = text[at : m.start()].strip(AROUND).lower()
    letter, number = len(word) == 1 and word.isalpha(), not any(map(str.isalpha, word))
    if number:
        return not small
    if word in splitter.leads and rest < len(text) and text[rest] in "0123456789":
        return False
    if not letter and word not in splitter.abbreviations:
        return True
    if rest == len(text):
        return True
    end = rest
    while end < len(text) and end - rest <= LONGEST + 1 and not text[end].isspace():
        end += 1
    following = text[rest:end].strip(AROUND).rstrip(MARKS).lower()
    return text[rest].isupper() and following in splitter.openers


def sentence_spans(text: str, splitter: Splitter) -> list[tuple[int, int]]:
    """Ordered spans of sentences that don't overlap; only white space stands between them. Time grows with the text's length."""
    out: list[tuple[int, int]] = []
    start = 0

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    for m in _END.finditer(text):
        if m[1] is None:
            add(start, m.start())
            start = m.end()
        elif _ends_here(text, start, m, splitter):
            add(start, m.end())
            start = m.end()
    add(start, len(text))
    return out


def chunk_spans(text: str, splitter: Splitter, size: int) -> list[tuple[int, int]]:
    """Spans of ``size`` sentences each; the last may be shorter."""
    spans = sentence_spans(text, splitter)
    return [(spans[k][0], spans[min(k + size, len(spans)) - 1][1]) for k in range(0, len(spans), size)]


def chunks(splitter: Splitter, size: int = 6) -> Callable[[Column | str], Column]:
    """A column function: text -> array of (start, end) of chunks of ``size`` sentences, in characters; null and blank texts have none."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda x: chunk_spans(x or "", splitter, size))

    return run


def with_chunks(rows: DataFrame, text: str, splitter: Splitter, size: int = 6, out: str = "chunks") -> DataFrame:
    """``rows`` with ``out``: chunks as (start, end, chunk), each the text between its ends. The texts don't return from Python."""
    spans = rows.withColumn(out, chunks(splitter, size)(text))
    return spans.withColumn(out, F.transform(out, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.substring(F.col(text), c["start"] + 1, c["end"] - c["start"]).alias("chunk"))))
