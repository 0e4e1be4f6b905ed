"""Mixing sources to target weights (operator 5): capped water-filling, then seeded repetitions.

Targets: ``share`` times all words is dealt out by weight; a source that
would pass ``max_epochs`` times its size is clamped there and the excess goes
to the others by weight, until no source is above its clamp. Each round needs
three sums over the sources, so the driver sees three numbers a round and at
most as many rounds as sources get clamped one after another.

Weights follow the sources' order by code point (null last). The order is
made by a range sort, so the list of sources never meets in one task.

Repetitions: a source is taken ``epochs = target / size`` times. Each of its
documents is taken floor(epochs) times, and some once more: documents of a
source are dealt by a seeded hash to buckets of about ``bucket_rows`` (a hot
source has many), and in each bucket the fractional repetition is spread by
error diffusion from the largest to the smallest document, with a seeded
threshold for each; what is then still owed goes to the document that fits it
best. A bucket's error stays near its smallest documents' sizes, and reruns
agree.

Defined cases: a null or blank text has size 0 and is taken 0 words. Null is
a source of its own. Rows with the same id are separate rows. Sources of
size 0 have target 0. Extra columns pass through ``repeat_documents``. Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.llm.arrays import NOT_SPACE, chunks, words
from docketry.session import importable, materialize

#: Documented bound of a bucket in ``repetitions``.
BUCKET_ROWS = 2_000


def sizes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, text_hash, size): words of each whole text, counted on its bytes."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.zeros(len(b), np.int64)
            for first, data, offsets in chunks(b.column(3)):
                _, _, row = words(data, offsets, NOT_SPACE)
                n[first : first + len(offsets) - 1] = np.bincount(row, minlength=len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n)], ["id", "source", "text_hash", "size"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(source).cast("string").alias("source"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_hash"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, source string, text_hash bigint, size bigint")


def source_totals(sized: DataFrame) -> DataFrame:
    """(source, source_size, n_rows, place): place counts from 0 in code-point order, null last."""
    spark = sized.sparkSession
    total = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("size").alias("n_rows")), "source-totals")
    ordered = total.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("tagged", F.monotonically_increasing_id())
    ordered = materialize(ordered.withColumns({"part": F.shiftright("tagged", 33), "within": F.col("tagged").bitwiseAND(F.lit((1 << 33) - 1))}).drop("tagged"), "source-order")
    counts = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}  # one row per partition
    before, run = {}, 0
    for part in sorted(counts):
        before[part] = run
        run += counts[part]
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "part long, start long")
    return ordered.join(F.broadcast(starts), "part").select("source", "source_size", "n_rows", (F.col("start") + F.col("within")).alias("place"))


def targets(totals: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``totals`` with ``target`` (words, double). Weights repeat along ``place``."""
    w: Column = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = totals.withColumns({"weight": w, "cap": F.col("source_size") * F.lit(float(max_epochs))})
    whole = table.agg(F.sum("source_size")).first()[0] or 0
    level, asked = 0.0, share * whole
    while True:
        # A source is clamped when level * weight reaches its cap; at a higher level no clamp is ever undone.
        clamped = F.lit(level) * F.col("weight") >= F.col("cap")
        capped, free = table.agg(F.sum(F.when(clamped, F.col("cap"))), F.sum(F.when(~clamped, F.col("weight")))).first()
        if not free or asked <= (capped or 0.0):
            break
        higher = (asked - (capped or 0.0)) / free
        if higher <= level:
            break
        level = higher
    return table.withColumn("target", F.least(F.lit(float(level)) * F.col("weight"), F.col("cap"))).drop("cap")


def repetitions(sized: DataFrame, planned: DataFrame, *, seed: int = 11, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, source, text_hash, size, source_size, target, times): how often each row is taken."""
    importable(sized.sparkSession)
    plan = planned.select(F.col("source").alias("_s"), "source_size", "target", F.ceil(F.col("n_rows") / F.lit(float(bucket_rows))).alias("n_buckets"))
    # Rows that repeat id, source and text are told apart by a number, so they spread over buckets like all others.
    counted = sized.groupBy("id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("rows"))
    numbered = counted.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("rows")
    rows = numbered.withColumn("u", F.xxhash64(F.lit(seed), "id", "text_hash", "nth")).drop("nth")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "u"), F.col("n_buckets"))).drop("n_buckets")

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        epochs = pdf["target"].iloc[0] / pdf["source_size"].iloc[0] if pdf["source_size"].iloc[0] else 0.0
        whole = int(np.floor(epochs))
        part = epochs - whole
        pdf = pdf.sort_values(["size", "u", "id"], ascending=[False, True, True], kind="stable")
        size = pdf["size"].to_numpy()
        once, debt = np.zeros(len(pdf), np.int64), 0.0
        # A document is taken once more when what is owed passes its threshold, 0.4 to 0.6 of its size.
        threshold = 0.4 + 0.2 * ((pdf["u"].to_numpy().astype(np.uint64) >> np.uint64(11)) / 2.0**53)
        for k, (n, c) in enumerate(zip(size.tolist(), threshold.tolist(), strict=True)):
            debt += part * n
            if n and part and debt > c * n:
                once[k] = 1
                debt -= n
        for _ in range(8 if part else 0):  # what is still owed, or too much, goes to the document that fits it best
            after = np.abs(debt + np.where(once == 1, size, -size))
            best = int(after.argmin())
            if after[best] >= abs(debt):
                break
            debt += size[best] if once[best] else -size[best]
            once[best] ^= 1
        return pdf.assign(times=whole + once)[["id", "source", "text_hash", "size", "source_size", "target", "times"]]

    return rows.groupBy("source", "bucket").applyInPandas(spread, "id bigint, source string, text_hash bigint, size bigint, source_size bigint, target double, times bigint")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Each row's id, size, its source's size and target, and ``taken`` words."""
    sized = materialize(sizes(docs), "sizes")
    return repetitions(sized, targets(source_totals(sized), **options)).withColumn("taken", F.col("size") * F.col("times"))


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The pipeline's stage: each row of ``docs`` as often as the mix takes it; rows without a word as often as their source's whole epochs."""
    plan = materialize(mixed(docs, **options).groupBy("id", "source", "text_hash").agg(F.sum("times").alias("__mix_times"), F.count("times").alias("__mix_rows")), "mix-plan")
    taken = docs.withColumn("__mix_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    columns = [taken[c] for c in docs.columns]

    def planned(plan: DataFrame, how: str) -> DataFrame:
        return taken.join(plan, taken["doc_id"].cast("long").eqNullSafe(plan["id"]) & taken["source"].eqNullSafe(plan["source"]) & (taken["__mix_hash"] == plan["text_hash"]), how)

    share = F.floor(F.col("__mix_times") / F.col("__mix_rows"))
    out = planned(plan, "left").where(share >= 1).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), share)).alias("__mix_copy")).drop("__mix_copy")
    # Rows that agree in id, source and text share their takings; what that leaves over goes to the first of them.
    uneven = plan.where("__mix_times % __mix_rows > 0")
    if uneven.isEmpty():
        return out
    place = F.row_number().over(Window.partitionBy(plan["id"], plan["source"], plan["text_hash"]).orderBy(F.xxhash64(*columns)))
    return out.union(planned(uneven, "inner").withColumn("__mix_place", place).where("__mix_place <= __mix_times % __mix_rows").select(*columns))
