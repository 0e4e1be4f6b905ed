"""Text columns: paths, cells, censoring, sentences, garbled text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def url_to_path(url: Column) -> Column:
    """Path part of a URL without the leading slash; .pdf and .doc(x) become .txt."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(path, r"^/+", ""), r"(?i)\.(pdf|docx?)$", ".txt")


def first_figure(cell: Column) -> Column:
    """The first number of a cell like ``40-60``; 0 for anything else."""
    return F.coalesce(F.trim(F.split_part(cell, F.lit("-"), F.lit(1))).try_cast("int"), F.lit(0))


def thousands(cell: Column) -> Column:
    """``1,200`` as 1200; blank as 0."""
    return F.coalesce(F.regexp_replace(F.trim(cell), ",", "").try_cast("double"), F.lit(0.0))


def without_invisible(text: Column) -> Column:
    """Without control, format, surrogate, private and unassigned characters; line ends and tabs stay."""
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}&&[^\n\r\t]]", "")


#: The bytes below a space but for tab and line ends.
UNPRINTABLE = "".join(chr(b) for b in range(32) if b not in (9, 10, 13))


def is_garbled(content: Column, head: int = 500, most: float = 0.1) -> Column:
    """Whether more than a tenth of the first bytes (of a file, or of a text's UTF-8) are unprintable; content that starts blank isn't."""
    # Each byte as one character.
    start = F.decode(F.substring(content.cast("binary"), 1, head), "ISO-8859-1")
    bad = F.length(start) - F.length(F.translate(start, UNPRINTABLE, ""))
    blank = F.trim(start, F.lit(" \t\n\r\x0b\x0c")) == ""
    return F.coalesce(~blank & (bad > F.length(start) * F.lit(most)), F.lit(False))


def one_line(text: Column, most: int) -> Column:
    """White space collapsed; cut with an ellipsis beyond ``most`` characters."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def spaced_topics(cell: Column) -> Column:
    """Topics split at a hyphen between spaces; a lone hyphen is no topic."""
    return F.filter(F.transform(F.split(cell, r"\s+-\s+"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "-"))


def tag_list(cell: Column) -> Column:
    """A JSON array of tags, or one plain tag."""
    return F.when(F.startswith(F.trim(cell), F.lit("[")), F.from_json(cell, "array<string>")).otherwise(F.array(cell))


def censor_pattern(phrases: list[str], case_sensitive: frozenset[str] = frozenset()) -> str:
    """One Java pattern for all phrases: longest first, any white space between words, whole words, any case except for the listed ones."""
    parts = []
    for p in sorted(set(filter(str.strip, phrases)), key=lambda x: (-len(x), x)):
        body = r"\s+".join(re.escape(w) for w in p.split())
        parts.append(body if p in case_sensitive else f"(?i:{body})")
    return r"(?U)(?<!\w)(?:" + "|".join(parts) + r")(?!\w)" if parts else ""


def censor(text: Column, phrases: list[str], mark: str = "[CENSORED]", case_sensitive: frozenset[str] = frozenset()) -> Column:
    """Every phrase replaced by ``mark``; without phrases the text stays."""
    pattern = censor_pattern(phrases, case_sensitive)
    return F.regexp_replace(text, pattern, mark.replace("\\", r"\\").replace("$", r"\$")) if pattern else text


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Ordered spans of sentences that don't overlap: they end at . ! ? before white space, or at a blank line."""
    out, start = [], 0
    for m in re.finditer(r"[.!?]+[\"')\]]*(?=\s|\Z)|\n\s*\n", text):
        end = m.end() if not m[0].startswith("\n") else m.start()
        if text[start:end].strip():
            lead = len(text[start:end]) - len(text[start:end].lstrip())
            out.append((start + lead, start + len(text[start:end].rstrip())))
        start = m.end()
    if text[start:].strip():
        lead = len(text[start:]) - len(text[start:].lstrip())
        out.append((start + lead, start + len(text[start:].rstrip())))
    return out


def chunk_spans(text: str, sentences: int) -> list[tuple[int, int]]:
    """Spans of ``sentences`` sentences each."""
    spans = sentence_spans(text)
    return [(spans[k][0], spans[min(k + sentences, len(spans)) - 1][1]) for k in range(0, len(spans), sentences)]


def sentence_chunks(sentences: int = 6):
    """A column function: text -> array of (start, end, chunk); each chunk is the text between its ends."""

    @F.pandas_udf("array<struct<start:int,end:int,chunk:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [(s, e, x[s:e]) for s, e in chunk_spans(x or "", sentences)])

    return run


def censor_spans(mark: str = "[CENSORED]"):
    """A column function: text, array of (start, end, phrases) -> text with each span's phrases replaced inside that span only."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text: str | None, of: list | None) -> str | None:
            if text is None:
                return None
            out, at = [], 0
            for s in sorted(list(of) if of is not None else [], key=lambda s: s["start"]):
                out.append(text[at : s["start"]])
                inside = text[s["start"] : s["end"]]
                words = sorted(filter(str.strip, list(s["phrases"]) if s["phrases"] is not None else []), key=lambda p: (-len(p), p))
                if words:
                    inside = re.sub(r"(?<!\w)(?:" + "|".join(r"\s+".join(map(re.escape, p.split())) for p in words) + r")(?!\w)", lambda _: mark, inside, flags=re.I)
                out.append(inside)
                at = s["end"]
            return "".join([*out, text[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)])

    return run


def _places(a: str) -> dict[str, int]:
    """Where each character stands in a string, as bits."""
    out: dict[str, int] = {}
    for k, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << k
    return out


def _ratio(a: str, b: str, places: dict[str, int]) -> float:
    """100 times the share of characters in a longest common subsequence of two strings; all of a row's cells are one number's bits."""
    if not a and not b:
        return 100.0
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & every
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> int:
    """The best ratio of the shorter string with a window of the longer one, as a whole number."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100 if not long else 0
    if short in long:
        return 100
    n, best, places = len(short), 0.0, _places(short)
    # How many characters before each place are letters of the short string.
    known = [0]
    for c in long:
        known.append(known[-1] + (c in places))
    for k in range(1 - n, len(long)):
        first, last = max(0, k), min(k + n, len(long))
        # A window's ratio can't pass what its letters allow.
        if 200.0 * (known[last] - known[first]) / (n + last - first) > best:
            best = max(best, _ratio(short, long[first:last], places))
    return round(best)


def fuzzy_mentions(terms: list[str], cutoff: int = 90):
    """A column function: sentence -> the terms whose partial ratio with it reaches ``cutoff``."""

    @F.pandas_udf("array<string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda x: [t for t in terms if x and partial_ratio(t, x.lower()) >= cutoff])

    return run
