"""License scans (operator 1): an exact set-similarity join of text blocks with license templates.

A block is a run of words anywhere in a whole text, over lines or not, at most half as long
again as the template (which leaves room for a comment word on each line). It
meets the template when it holds at least ``containment`` of the template's distinct
words. All runs of all texts are joined, whatever the text's length; of runs of one template
that overlap, the one that holds most of the template, in its order, counts. The join is exact:

* global order - the words of all templates are counted over all documents;
  each template's words are ordered from rare to frequent (ties by word);
* prefix filter - a block with enough of the template's words must hold one
  of the template's first ``n - need + 1`` words, so only the words that stand within a
  block's length of such a word are looked at;
* length filter - a run with fewer known words than ``need`` can't match;
* positional filter - the rarest word that a run shares with the template stands at some position of the
  template's order; all others that they share come at or after it, so where too few such words stand within
  a block's length of the place, the place leads to nothing and is dropped before anything is counted;
* what is left is verified by counting the whole overlap.

Templates are rows of a table (label, text): the packaged ``license_templates.tsv``, or any
other. Their prefix postings go to the tasks with the function, so the table is bounded:
more than ``MOST_WORDS`` words are refused, and can be scanned in parts. Counts of its words come back
as one number per word. Texts never leave their row: no text is shuffled.
Of a text's blocks only neighbours are compared, so thousands of notices in one text cost their number, not its square.

Phrases are found beside it: places where a phrase's words stand consecutively.

Defined cases: a null or empty text has no words and matches nothing.
Repeated rows are scanned each. Extra columns are ignored. An empty table
gives an empty result. Ties in frequency are ordered by the word.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.arrays import ALNUM, chunks, hash_of, lowered, word_hashes, words
from docketry.session import importable

# Phrases and the labels that they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


def packaged_templates() -> list[tuple[str, str]]:
    """(label, text): short notices and opening sentences of public licenses, in lower case."""
    lines = Path(__file__).with_name("license_templates.tsv").read_text(encoding="utf-8").splitlines()[1:]
    return [tuple(x.split("\t")) for x in lines]


TEMPLATES = packaged_templates()
# The word that tells a license from those with a like notice, or one for each form of its templates; where a template has it, its label needs it.
NAMES = {
    "agpl": "affero",
    "apache": "apache",
    "cc-by-nc": "nc noncommercial commercial",
    "cc-by-nd": "nd noderivatives derivatives",
    "cc-by-sa": "sa sharealike alike",
    "cc0": "cc0",
    "gpl": "gnu",
    "lgpl": "lesser",
    "mit": "mit",
    "mpl": "mozilla",
}
CONTAINMENT = 0.8
#: Documented bound of a template table.
MOST_WORDS = 1_000_000


class _Template:
    """A template's distinct word ids in the global order, what it needs of them, its prefix, and its name."""

    def __init__(self, label: str, text: str, order: dict[str, int], containment: float, names: dict[str, str]):
        said = text.split()
        self.label = label
        self.ids = sorted({order[w] for w in said})
        self.need = max(1, math.ceil(containment * len(self.ids) - 1e-9))
        self.prefix = self.ids[: len(self.ids) - self.need + 1]
        self.span = len(said) + len(said) // 2
        self.follow = {(order[v], order[w]) for v, w in zip(said, said[1:], strict=False)}
        name = next((w for w in names.get(label, "").split() if w in said), None)
        self.name = None if name is None else order[name]
        self.sorted = np.array(self.ids, np.int64)

    def own(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``tokens`` are its words, and where each of these stands in its order."""
        place = np.minimum(np.searchsorted(self.sorted, tokens), len(self.ids) - 1)
        mine = np.flatnonzero(self.sorted[place] == tokens)
        return mine, place[mine]

    def leads(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The places that pass the positional filter.

        at, place: where its words stand in the text, in order, and in its own order. A place of the prefix stays
        if at least ``need`` of them that come at or after it in that order stand less than a block's length from it.
        """
        kept = []
        for k in np.unique(place[place < len(self.prefix)]).tolist():
            later = np.concatenate([[0], np.cumsum(place >= k)])
            lead = at[place == k]
            enough = later[np.searchsorted(at, lead + self.span)] - later[np.searchsorted(at, lead - self.span, "right")] >= self.need
            kept.append(lead[enough])
        return np.concatenate(kept) if kept else at[:0]

    def blocks(self, at: list[int], ids: list[int], text_end: list[int]) -> list[tuple[int, int, int, bool]]:
        """(first word, end, common words, whether its name is among them) of the runs that meet it.

        at, ids: places and ids of its words, in order; text_end: where each one's text ends.
        """
        found, count, distinct, end = [], dict.fromkeys(self.ids, 0), 0, 0
        for k, first in enumerate(at):
            limit = min(first + self.span, text_end[k])
            while end < len(at) and at[end] < limit:
                count[ids[end]] += 1
                distinct += count[ids[end]] == 1
                end += 1
            if distinct >= self.need:
                found.append(self._shortest(at, ids, k, end, distinct))
            count[ids[k]] -= 1
            distinct -= count[ids[k]] == 0
        # Blocks taken so far don't overlap, so only the next one on either side of a place can be in the way.
        out: list[tuple[int, int, int, bool]] = []
        for common, nameless, _, _, a, z in sorted(found):
            k = bisect_left(out, (a,))
            if (k == len(out) or z <= out[k][0]) and (not k or out[k - 1][1] <= a):
                out.insert(k, (a, z, -common, not nameless))
        return out

    def _shortest(self, at: list[int], ids: list[int], first: int, end: int, distinct: int) -> tuple[int, bool, int, int, int, int]:
        """The shortest run from ``first`` with as many of its words, as a key that sorts the best first."""
        seen: set[int] = set()
        last = first
        while len(seen) < distinct:
            seen.add(ids[last])
            last += 1
        part = ids[first:last]
        width = at[last - 1] - at[first]
        # Of two notices side by side, each keeps its own words.
        loose = width - sum(pair in self.follow for pair in zip(part, part[1:], strict=False))
        return -distinct, self.name is not None and self.name not in seen, loose, width, at[first], at[last - 1] + 1


def word_frequencies(docs: DataFrame, vocabulary: list[str], *, text: str = "text") -> dict[str, int]:
    """How often each word of a fixed vocabulary stands in all texts."""
    importable(docs.sparkSession)
    if not vocabulary:
        return {}
    hashes = np.array([hash_of(w) for w in vocabulary], np.uint64)
    sort = np.argsort(hashes)
    known = hashes[sort]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for b in batches:
            for _, data, offsets in chunks(b.column(0)):
                low = lowered(data)
                starts, ends, _ = words(low, offsets, ALNUM)
                h = word_hashes(low, starts, ends)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                total += np.bincount(at[known[at] == h], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(sort.astype(np.int64)), pa.array(total)], ["k", "n"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    found = {r["k"]: r["n"] for r in counted.collect()}  # one row per word of the vocabulary
    return {w: found.get(k, 0) for k, w in enumerate(vocabulary)}


def _near(places: np.ndarray, here: np.ndarray, span: int) -> np.ndarray:
    """Indexes into ``here`` (sorted) of what stands less than ``span`` words from one of ``places``."""
    low, high = np.searchsorted(here, places - span, "right"), np.searchsorted(here, places + span)
    step = np.zeros(len(here) + 1, np.int64)
    np.add.at(step, low, 1)
    np.add.at(step, high, -1)
    return np.flatnonzero(np.cumsum(step)[:-1] > 0)


BLOCK_TYPE = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64()), ("best", pa.bool_())]))
PLACE_TYPE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_BLOCKS = "array<struct<label:string,first_word:bigint,n_words:bigint,containment:double,best:boolean>>"


def scan(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: list[tuple[str, str]] | DataFrame = TEMPLATES,
    containment: float = CONTAINMENT,
    names: dict[str, str] = NAMES,
) -> DataFrame:
    """Per row: ``key``, n_words, places (label, word) of phrases, blocks (label, first_word, n_words, containment, best) that meet a template, and ``wrapped``: those of them that go over lines.

    ``templates`` are (label, text) rows, texts in lower case with one space between words.
    ``best`` marks the blocks that give their label: those that hold the
    template's name, if it has one, and overlap no block of a wider template that holds as much of its own.
    """
    importable(docs.sparkSession)
    if isinstance(templates, DataFrame):
        held = templates.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
        if held > MOST_WORDS:
            raise ValueError(f"{held} words of templates; at most {MOST_WORDS} go into one scan")
        templates = [(r["label"], r["text"]) for r in templates.select("label", "text").orderBy("label", "text").collect()]
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    frequency = word_frequencies(docs, vocabulary, text=text)
    ordered = sorted(vocabulary, key=lambda w: (frequency[w], w))
    order = {w: k for k, w in enumerate(ordered)}
    index = [_Template(label, t, order, containment, names) for label, t in templates]
    postings: dict[int, list[int]] = {}
    for t, x in enumerate(index):
        for w in x.prefix:
            postings.setdefault(w, []).append(t)
    hashes = np.array([hash_of(w) for w in ordered], np.uint64)
    sort = np.argsort(hashes)
    known = hashes[sort]
    holders: dict[int, list[int]] = {}
    for t, x in enumerate(index):
        for w in x.ids:
            holders.setdefault(w, []).append(t)
    sought = [(label, [np.uint64(hash_of(w)) for w in phrase.split()]) for phrase, label in phrases.items()]

    def met(here: np.ndarray, token: np.ndarray, text_end: np.ndarray) -> list[tuple[int, int, int, float, bool]]:
        """(template, first word, end, containment, named) of the blocks of a chunk of texts; here, token: places and ids of known words."""
        leads: dict[int, list[np.ndarray]] = {}
        by_word = np.argsort(token, kind="stable")
        cuts = np.searchsorted(token[by_word], np.arange(len(ordered) + 1))
        for w, of in postings.items():
            if cuts[w] < cuts[w + 1]:
                for t in of:
                    leads.setdefault(t, []).append(here[by_word[cuts[w] : cuts[w + 1]]])
        out = []
        for t, places in leads.items():
            x = index[t]
            near = _near(np.concatenate(places), here, x.span)
            mine, place = x.own(token[near])
            near = near[mine]
            lead = x.leads(here[near], place)
            if len(lead):
                near = near[_near(np.sort(lead), here[near], x.span)]
                for a, z, common, named in x.blocks(here[near].tolist(), token[near].tolist(), text_end[near].tolist()):
                    out.append((t, a, z, common / len(x.ids), named))
        return out

    def wider(t: int) -> list[int]:
        """The templates that hold all words of one and more: looked up by its word that the fewest hold."""
        own = index[t].ids
        few = holders[min(own, key=lambda w: len(holders[w]))]
        return [u for u in few if len(index[u].ids) > len(own) and not len(np.setdiff1d(index[t].sorted, index[u].sorted, assume_unique=True))]

    def best(own: list[tuple[int, int, int, float, bool]]) -> list[bool]:
        """Of each block of a text, whether it gives its label. The blocks of one template don't overlap, so a bisection finds those near."""
        of: dict[int, list[tuple[int, int, float, bool]]] = {}
        for t, a, z, c, named in sorted(own):
            of.setdefault(t, []).append((a, z, c, named))
        over = {t: [of[u] for u in wider(t) if u in of] for t in of}

        def covered(t: int, a: int, z: int, c: float) -> bool:
            for blocks in over[t]:
                k = max(0, bisect_left(blocks, (a,)) - 1)
                while k < len(blocks) and blocks[k][0] < z:
                    if a < blocks[k][1] and blocks[k][3] and blocks[k][2] >= c:
                        return True
                    k += 1
            return False

        return [named and not covered(t, a, z, c) for t, a, z, c, named in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words = np.zeros(len(b), np.int64)
            places: dict[int, list] = {}
            blocks: dict[int, list] = {}
            wrapped: dict[int, list] = {}
            for base, data, offsets in chunks(b.column(1)):
                low = lowered(data)
                starts, ends, row = words(low, offsets, ALNUM)
                count = np.bincount(row, minlength=len(offsets) - 1)
                n_words[base : base + len(offsets) - 1] = count
                if not len(starts):
                    continue
                first_word = np.concatenate([[0], np.cumsum(count)])
                h = word_hashes(low, starts, ends)
                for label, phrase in sought:
                    at = np.flatnonzero(h[: len(h) - len(phrase) + 1] == phrase[0])
                    for k in range(1, len(phrase)):
                        at = at[h[at + k] == phrase[k]]
                    for k in at[row[at] == row[at + len(phrase) - 1]].tolist():
                        places.setdefault(base + int(row[k]), []).append({"label": label, "word": int(k - first_word[row[k]])})
                if not len(known):
                    continue
                found = np.minimum(np.searchsorted(known, h), len(known) - 1)
                here = np.flatnonzero(known[found] == h)
                by_row: dict[int, list[tuple[int, int, int, float, bool]]] = {}
                for block in met(here, sort[found[here]], first_word[row[here] + 1]):
                    by_row.setdefault(int(row[block[1]]), []).append(block)
                for r, own in by_row.items():
                    own.sort(key=lambda x: (x[1], x[0]))
                    for (t, a, z, c, _), gives in zip(own, best(own), strict=True):
                        over = (low[starts[a] : starts[z - 1]] == 10).any()
                        told = {"label": index[t].label, "first_word": a - int(first_word[r]), "n_words": z - a, "containment": c, "best": gives}
                        (wrapped if over else blocks).setdefault(base + r, []).append(told)
            columns = [pa.array([x.get(k, []) for k in range(len(b))], kind) for x, kind in ((places, PLACE_TYPE), (blocks, BLOCK_TYPE), (wrapped, BLOCK_TYPE))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words), *columns], ["key", "n_words", "places", "blocks", "wrapped"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, n_words bigint, places array<struct<label:string,word:bigint>>, blocks {_BLOCKS}, wrapped {_BLOCKS}")
    return out.withColumnRenamed("key", key)
