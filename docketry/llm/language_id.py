"""Language identification by language-bitmask n-gram filters (operator 3).

For each language the typical n-grams of letters go into a Bloom filter. The
filters of all languages are bit-sliced: slot s holds one bit per language,
so one lookup per hash function, and an AND of the slots read, gives the set
of all languages whose filter contains the n-gram. A document's popcount for
a language is the number of its n-grams with that language's bit; it is
corrected for the filter's false-positive rate,
``(hits - n * fpr) / (1 - fpr)``, and the largest corrected count decides.

An n-gram is typical of a language when its share of that language's n-grams
is at least ``typical`` times its largest share in any language.

Learning uses at most about ``rows_per_language`` labelled rows of each
language (a documented bound, chosen by a hash of the row's id), whole texts.
The n-gram counts are summed in Spark; what reaches the driver is the sliced
filter, at most ``2 ** log2_slots`` slots for each 64 languages.

Defined cases: a null text, or one without a letter, is ``und`` with score 0.
Without any learned language everything is ``und``. A text whose n-grams no
filter knows gets the most frequent learned language, with score 0. Ties go
to the language that is first by code point. Repeated rows are predicted
each; extra columns pass through ``identify``. Empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.llm.arrays import mix
from docketry.session import importable, materialize

UNKNOWN = "und"
ORDERS = (1, 2, 3)
#: Documented bound of the labelled sample.
ROWS_PER_LANGUAGE = 5_000
CHUNK_CHARS = 250_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, 0 for all but letters, a 0 before each text and at the end; where each text starts."""
    low = [x.lower() for x in texts]
    joined = "\n" + "\n".join(low) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[code], code, np.uint32(0)), np.cumsum([1, *(len(x) + 1 for x in low)])


def _grams(code: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the n-grams of one order; a 0 may stand at either end of an n-gram, for the word's edge."""
    n = len(code) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for k in range(order):
        value = value * np.uint64(0x110000) + code[k : k + n]
    good = code[:n] > 0 if order == 1 else np.ones(n, bool)
    for k in range(1, order - 1):
        good &= code[k : k + n] > 0
    if order == 2:
        good &= (code[:n] > 0) | (code[1 : 1 + n] > 0)
    at = np.flatnonzero(good)
    # An n-gram that begins with the edge before a text belongs to that text.
    text = np.searchsorted(starts, at + (code[at] == 0), "right") - 1
    return mix(value[at] + np.uint64(order * 0x9E3779B97F4A7C15 % 2**64)), np.minimum(text, len(starts) - 2)


def _text_chunks(column: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    texts, first, load = [x or "" for x in column], 0, 0
    for k, x in enumerate(texts):
        if load and load + len(x) > CHUNK_CHARS:
            yield first, texts[first:k]
            first, load = k, 0
        load += len(x)
    if first < len(texts):
        yield first, texts[first:]


def learn(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, min_count: int = 3, typical: float = 0.5, log2_slots: int = 18, n_hashes: int = 2) -> dict:
    """A model from rows with a language: languages, the bit-sliced filter, false-positive rates."""
    importable(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    have = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(have)
    if not languages:
        return {"languages": [], "prior": UNKNOWN}
    chosen = F.pmod(F.xxhash64(F.lit("language sample"), "id"), F.lit(1_000_000))
    sparse = [x for x in languages if have[x] > rows_per_language]
    bound: Column = F.lit(1_000_000)
    for x in sparse:
        bound = F.when(F.col("lang") == x, F.lit(int(1_000_000 * rows_per_language / have[x]))).otherwise(bound)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_pylist()
            for first, texts in _text_chunks(b.column(1).to_pylist()):
                code, starts = _stream(texts)
                number = {x: k for k, x in enumerate(dict.fromkeys(own[first : first + len(texts)]))}
                of = np.array([number[x] for x in own[first : first + len(texts)]])
                for order in ORDERS:
                    h, at = _grams(code, starts, order)
                    for x, k in number.items():
                        grams, n = np.unique(h[of[at] == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([x] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = rows.where(chosen < bound).select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
    counts = materialize(counts.groupBy("gram", "lang").agg(F.sum("n").alias("n")), "gram-counts")
    total = {r["lang"]: float(r["t"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    share, bit = F.lit(0.0), F.lit(0)
    for k, x in enumerate(languages):
        share = F.when(F.col("lang") == x, F.col("n") / F.lit(total.get(x, 1.0))).otherwise(share)
        bit = F.when(F.col("lang") == x, F.lit(k)).otherwise(bit)
    shares = counts.withColumns({"share": share, "bit": bit})
    kept = shares.withColumn("best", F.max("share").over(Window.partitionBy("gram"))).where((F.col("n") >= min_count) & (F.col("share") >= typical * F.col("best")))
    slots = 1 << log2_slots
    at = F.explode(F.array(*(F.shiftrightunsigned("gram", 64 - log2_slots - j * log2_slots if 64 - log2_slots - j * log2_slots > 0 else 0).bitwiseAND(F.lit(slots - 1)) for j in range(n_hashes))))
    filled = kept.select(at.alias("slot"), F.floor(F.col("bit") / 64).cast("int").alias("plane"), F.expr("shiftleft(1L, bit % 64)").alias("mask")).groupBy("plane", "slot").agg(F.bit_or("mask").alias("mask"))
    planes = np.zeros((-(-len(languages) // 64), slots), np.uint64)
    held = filled.toArrow()  # at most a row per slot and plane
    planes[held["plane"].to_numpy(), held["slot"].to_numpy()] = held["mask"].to_numpy().view(np.uint64)
    fill = np.array([np.mean((planes[k // 64] >> np.uint64(k % 64)) & np.uint64(1)) for k in range(len(languages))])
    return {"languages": languages, "prior": max(languages, key=lambda x: have[x]), "planes": planes, "log2_slots": log2_slots, "n_hashes": n_hashes, "fpr": np.minimum(fill**n_hashes, 0.999)}


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def votes(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Corrected popcounts (texts x languages), and whether each text has a letter."""
    code, starts = _stream(texts)
    n_lang, n = len(model["languages"]), len(texts)
    hits, seen = np.zeros((n, n_lang)), np.zeros(n)
    bits = model["log2_slots"]
    has_letter = np.zeros(n, bool)
    for order in ORDERS:
        h, at = _grams(code, starts, order)
        if order == 1:
            has_letter[at] = True
        seen += np.bincount(at, minlength=n)
        for p, plane in enumerate(model["planes"]):
            mask = None
            for j in range(model["n_hashes"]):
                slot = (h >> np.uint64(max(0, 64 - bits - j * bits))) & np.uint64((1 << bits) - 1)
                read = plane[slot.astype(np.int64)]
                mask = read if mask is None else mask & read
            for byte in range(8):
                low = p * 64 + byte * 8
                if low < n_lang:
                    part = ((mask >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
                    counted = np.bincount(at * 256 + part, minlength=n * 256).reshape(n, 256) @ _BITS
                    hits[:, low : low + 8] += counted[:, : n_lang - low]
    return np.maximum(0.0, (hits - seen[:, None] * model["fpr"]) / (1 - model["fpr"])), has_letter


def identify(docs: DataFrame, model: dict, *, text: str = "text", pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with ``pred`` and ``score`` (0 to 1: the winner's share of all corrected counts), in place of columns of these names."""
    spark = docs.sparkSession
    importable(spark)
    if not model["languages"]:
        return docs.withColumns({pred: F.lit(UNKNOWN), score: F.lit(0.0)})
    shared = spark.sparkContext.broadcast(model)  # its size is fixed by log2_slots

    @F.pandas_udf("lang_pred string, lang_score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in batches:
            pred, score = np.full(len(s), UNKNOWN, object), np.zeros(len(s))
            for first, texts in _text_chunks(s.tolist()):
                v, has = votes(m, texts)
                total, best = v.sum(1), v.argmax(1)
                here = slice(first, first + len(texts))
                pred[here] = np.where(has, np.where(total > 0, np.array(m["languages"], object)[best], m["prior"]), UNKNOWN)
                score[here] = np.where(has & (total > 0), v[np.arange(len(v)), best] / np.maximum(total, 1e-300), 0.0)
            yield pd.DataFrame({"lang_pred": pred, "lang_score": score})

    kept = [c for c in docs.columns if c not in (pred, score)]
    # Marked non-deterministic so that the optimiser never evaluates it twice.
    return docs.withColumn("__lang", predict.asNondeterministic()(F.col(text).cast("string"))).select(*kept, F.col("__lang.lang_pred").alias(pred), F.col("__lang.lang_score").alias(score))


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text has remainder 2 by 4. A null id isn't."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_known_language(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: documents without a language (``und``) go; ``lang`` of the others is the language found."""
    model = learn(docs.where(~held_out()))
    found = identify(docs, model, pred="__pred", score="__score").where(F.col("__pred") != UNKNOWN)
    return found.select(*(F.col("__pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns))
