"""Quality of texts: a ridge fit on random Fourier features of text statistics, calibrated to a probability.

Each text becomes a short row of statistics, read once. Random Fourier features
of the standardised row approximate a Gaussian kernel; their normal equations
are summed by partition, apart for each fold, so the penalty and the scores
out of the fold need no further fit. The scores out of the fold are counted in
narrow bins with their labels, and pooling adjacent violators makes a rising
curve of them. The driver holds features x features numbers per fold and the bins.

Cases: null and empty texts have a row of their own kind and get the score of
such rows; very long texts are read whole, one at a time. Rows that repeat are
scored alike, and learned from as often as they stand. A null label isn't
learned from; a document of several labels has their mean. Without any label
every score is one half; with one class only it is that class. Empty tables
give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import arrays
from docketry.session import importable, materialize

#: Fourier features, folds, and how many bins a unit of the raw score has.
FEATURES, FOLDS, BINS = 192, 3, 1024
#: Penalties that are tried, as shares of the mean diagonal of the normal equations.
PENALTIES = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2)
#: Standardised statistics are cut at this many deviations, raw scores to this range.
CLIP, RANGE = 6.0, (-1.0, 2.0)
#: The share of the score that is the raw score's place in RANGE: texts that the curve puts at one level keep their order.
TILT = 1e-3

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _HIGH = (np.zeros(256, bool) for _ in range(6))
_LOWER[97:123] = _UPPER[65:91] = _DIGIT[48:58] = _HIGH[128:] = True
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LINE[0x0A] = True
_SYMBOL = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _HIGH)
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in ".,;:!?"]] = True
_KINDS = np.array([_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _HIGH, _SYMBOL, _SYMBOL & ~_CLOSING]).T.astype(np.float64)
_NOT_LINE = ~_LINE

STATISTICS = (
    "empty", "bytes", "words", "lines", "lower", "upper", "digits", "space", "line_ends", "high", "symbols", "odd_symbols", "byte_entropy", "word_length", "word_spread",
    "distinct_words", "top_word", "distinct_pairs", "capital_words", "shouted_words", "tailed_words", "lone_symbols", "word_entropy", "line_length", "repeated_lines",
)


def _entropy(count: np.ndarray, row: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Entropy of each row's counts, in bits."""
    p = count / total[row]
    return -np.bincount(row, p * np.log2(p), minlength=len(total))


def _distinct(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, count) of each row's distinct hashes."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return r[at], np.diff(np.append(at, len(h)))


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; counts are logarithms, the rest are shares, means and entropies."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    whole = np.maximum(size, 1)
    row_of = np.repeat(np.arange(n), size)
    counts = np.bincount(row_of * 256 + data, minlength=n * 256).reshape(n, 256)
    shares = counts @ _KINDS / whole[:, None]
    r, b = np.nonzero(counts)
    byte_entropy = _entropy(counts[r, b], r, whole)

    starts, ends, row = arrays.words(data, offsets, arrays.NOT_SPACE)
    words = np.bincount(row, minlength=n)
    each = np.maximum(words, 1)
    mean = lambda v: np.bincount(row, v, minlength=n) / each
    length = (ends - starts).astype(np.float64)
    word_length = mean(length)
    spread = np.sqrt(np.maximum(mean(length**2) - word_length**2, 0))
    hashes = arrays.word_hashes(arrays.lowered(data), starts, ends)
    kinds, uses = _distinct(hashes, row, n)
    top = np.zeros(n)
    np.maximum.at(top, kinds, uses)
    pair, pair_at = arrays.shingles(hashes, row, n, 2)
    pair_row = np.repeat(np.arange(n), np.diff(pair_at))
    pair_kinds = np.bincount(_distinct(pair, pair_row, n)[0], minlength=n) / np.maximum(np.diff(pair_at), 1)
    upper, symbol, lower = (np.concatenate([[0], np.cumsum(k[data])]) for k in (_UPPER, _SYMBOL, _LOWER | _HIGH))
    inside = lambda c: c[ends] - c[starts]
    first, last = (data[starts], data[ends - 1]) if len(starts) else (np.zeros(0, np.uint8),) * 2
    letters = inside(upper) + inside(lower)
    odd_tail = _SYMBOL[last] & ((inside(symbol) > 1) | ~_CLOSING[last]) & (letters > 0)

    l_starts, l_ends, l_row = arrays.words(data, offsets, _NOT_LINE)
    lines = np.bincount(l_row, minlength=n)
    l_kinds = np.bincount(_distinct(arrays.word_hashes(data, l_starts, l_ends), l_row, n)[0], minlength=n)
    l_each = np.maximum(lines, 1)
    return np.column_stack(
        [
            (words == 0).astype(float), np.log1p(size), np.log1p(words), np.log1p(lines), shares, byte_entropy, word_length, spread,
            np.bincount(kinds, minlength=n) / each, top / each, pair_kinds, mean(_UPPER[first].astype(float)), mean((letters > 1) * (inside(upper) == letters) * 1.0),
            mean(odd_tail.astype(float)), mean((letters == 0) * (inside(symbol) > 0) * 1.0), _entropy(uses, kinds, each), np.log1p(np.bincount(l_row, l_ends - l_starts, minlength=n) / l_each), 1 - l_kinds / l_each,
        ]
    )


def statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stats): STATISTICS of every whole text."""
    importable(docs.sparkSession)
    width = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in arrays.chunks(b.column(1)):
                rows = text_statistics(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows)), lists], ["key", "stats"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, stats array<double>").withColumnRenamed("key", key)


@dataclass
class Quality:
    """Mean and deviation of the statistics, frequencies and phases of the features, weights, and the calibration curve."""

    mean: np.ndarray
    deviation: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    value: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """cos(wx + b) of standardised rows, and a constant; their inner products approximate the kernel."""
        z = np.clip((stats - self.mean) / self.deviation, -CLIP, CLIP)
        f = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([f, np.ones((len(f), 1))])

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        place = (np.clip(raw, *RANGE) - RANGE[0]) / (RANGE[1] - RANGE[0])
        return np.clip((1 - TILT) * np.interp(raw, self.raw, self.value) + TILT * place, 0.0, 1.0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def frequencies(dims: int, features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases for the kernel exp(-|x - y|^2 / (2 dims))."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(dims, features)) / np.sqrt(dims), rng.uniform(0, 2 * np.pi, features)


def pooled(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to ``value`` in weighted squares: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for w, v in zip(weight.tolist(), value.tolist(), strict=True):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, k2 = blocks.pop()
            w1, v1, k1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), k1 + k2]
    return np.repeat([b[1] for b in blocks], [b[2] for b in blocks])


def _solved(a: np.ndarray, b: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights; the constant isn't penalised."""
    ridge = np.full(len(a), penalty * np.trace(a) / len(a))
    ridge[-1] = 1e-12 * ridge[0]
    return np.linalg.solve(a + np.diag(ridge), b)


def learn(stats: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "label", features: int = FEATURES, seed: int = 11) -> Quality:
    """A model of rows of (key, stats) and (key, label 0 or 1)."""
    importable(stats.sparkSession)
    given = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    # Equal texts have equal statistics, so a fold never holds a copy of what another fold learns from.
    rows = stats.select(F.col(key).alias("key"), "stats").join(given, "key").select("stats", "y", F.pmod(F.xxhash64(F.lit("fold"), "stats"), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = materialize(rows, "labelled-statistics")
    dims = len(STATISTICS)
    s = lambda k: F.get("stats", F.lit(k))
    moments = rows.agg(F.count("*").alias("n"), F.avg("y").alias("rate"), *(F.avg(s(k)).alias(f"m{k}") for k in range(dims)), *(F.stddev_pop(s(k)).alias(f"d{k}") for k in range(dims))).first()
    w, b = frequencies(dims, features, seed)
    if not moments["n"] or moments["rate"] in (0.0, 1.0):
        # One level for all: a raw score of zero stands a third up RANGE.
        rate = moments["rate"] if moments["n"] else 0.5
        level = (rate - TILT * (0 - RANGE[0]) / (RANGE[1] - RANGE[0])) / (1 - TILT)
        return Quality(np.zeros(dims), np.ones(dims), w, b, np.zeros(features + 1), np.array([0.0]), np.array([level]))
    mean, deviation = (np.array([moments[f"{c}{k}"] for k in range(dims)]) for c in "md")
    model = Quality(mean, np.where(deviation > 1e-9, deviation, 1.0), w, b, np.zeros(features + 1), np.zeros(1), np.zeros(1))
    upper = np.triu_indices(features + 2)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Z'Z of features, constant and label: one triangle a fold and partition."""
        total = np.zeros((FOLDS, features + 2, features + 2))
        for batch in batches:
            z = np.hstack([model.features(_matrix(batch.column(0))), batch.column(1).to_numpy()[:, None]])
            own = batch.column(2).to_numpy()
            for f in np.unique(own):
                total[f] += z[own == f].T @ z[own == f]
        for f in range(FOLDS):
            if total[f].any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), f, np.int32)), pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[f][upper])], ["fold", "i", "v"])

    sums = rows.mapInArrow(equations, "fold int, i int, v double").groupBy("fold", "i").agg(F.sum("v").alias("v")).toPandas()  # features^2 / 2 numbers a fold
    each = np.zeros((FOLDS, features + 2, features + 2))
    each[sums["fold"], upper[0][sums["i"]], upper[1][sums["i"]]] = sums["v"]
    each += np.triu(each, 1).transpose(0, 2, 1)
    whole = each.sum(0)
    z, y = slice(0, features + 1), features + 1

    def lost(penalty: float) -> float:
        """Squared error of each fold under the weights of the others, from the sums alone."""
        out = 0.0
        for e in each:
            v = _solved(whole[z, z] - e[z, z], whole[z, y] - e[z, y], penalty)
            out += e[y, y] - 2 * v @ e[z, y] + v @ e[z, z] @ v
        return out

    apart = all(e[features, features] < whole[features, features] for e in each)  # not all rows in one fold
    best = min(PENALTIES, key=lost) if apart else PENALTIES[-1]
    model.weights = _solved(whole[z, z], whole[z, y], best)
    outside = [_solved(whole[z, z] - e[z, z], whole[z, y] - e[z, y], best) if apart else model.weights for e in each]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, scores and labels by bin of the score that the other folds' weights give."""
        last = int((RANGE[1] - RANGE[0]) * BINS)
        total = np.zeros((3, last + 1))
        for batch in batches:
            raw = np.clip((model.features(_matrix(batch.column(0))) * np.array(outside)[batch.column(2).to_numpy()]).sum(1), *RANGE)
            at = ((raw - RANGE[0]) * BINS).astype(np.int64)
            total += [np.bincount(at, v, minlength=last + 1) for v in (np.ones(len(raw)), raw, batch.column(1).to_numpy())]
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(t[at]) for t in total)], ["bin", "n", "raw", "y"])

    curve = rows.mapInArrow(binned, "bin bigint, n double, raw double, y double").groupBy("bin").agg(*(F.sum(c).alias(c) for c in ("n", "raw", "y"))).orderBy("bin").toPandas()  # a row a bin
    model.raw, model.value = (curve["raw"] / curve["n"]).to_numpy(), pooled(curve["n"].to_numpy(), (curve["y"] / curve["n"]).to_numpy())
    return model


def score(stats: DataFrame, model: Quality, *, out: str = "score") -> DataFrame:
    """The columns of ``stats`` but ``stats`` itself, and the calibrated score."""
    kept = [c for c in stats.columns if c not in ("stats", out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                value = model.calibrated(model.features(_matrix(b.column(len(kept)))) @ model.weights)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(value)], [*kept, out])

    schema = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in kept) + f", `{out}` double"
    return stats.select(*kept, "stats").mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "label") -> DataFrame:
    """(key, score) of every document, learned from all labels given: texts are read once."""
    stats = materialize(statistics(docs, key=key, text=text), "text-statistics")
    return score(stats, learn(stats, labels, key=key, label=label))
