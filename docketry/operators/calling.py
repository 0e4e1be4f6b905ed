"""Calls of a caller's embedder for what a store lacks: retries with back-off, progress kept wave by wave, failures as rows."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.store import pending

SCHEMA = "uuid string, kind string, embedding array<double>, attempts int, error string, failed boolean"
#: Characters of an error's text that a failure's row keeps.
ERROR_CHARS = 2_000


def may_pass_later(error: Exception) -> bool:
    """Whether another attempt can help: a rate limit, a server's fault, or an error without a status (a lost connection). Other answers are the same every time."""
    status = getattr(error, "status_code", None)
    return status is None or status == 429 or status >= 500


def pause(key: str, attempt: int, base: float) -> float:
    """Seconds before the attempt after ``attempt`` (from 1): ``base`` doubled each time, and up to one ``base`` more that depends on the key, so callers part and reruns agree."""
    part = int.from_bytes(hashlib.blake2b(f"{key}/{attempt}".encode(), digest_size=4).digest(), "big") / 2**32
    return base * (2 ** (attempt - 1) + part)


def call(embed: Callable[[list[str]], list[list[float]]], keys: list[str], texts: list[str], attempts: int, base: float) -> list[tuple[list[float] | None, int, str | None]]:
    """(vector, attempts, error) of each text. A batch that can't pass is called text by text, so one bad text takes no other with it."""
    for n in range(1, attempts + 1):
        try:
            vectors = embed(texts)
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            return [(list(v), n, None) for v in vectors]
        except Exception as e:  # noqa: BLE001  the caller's errors of any kind become rows
            error, again = f"{type(e).__name__}: {e}"[:ERROR_CHARS], may_pass_later(e)
        if not again or n == attempts:
            break
        time.sleep(pause(keys[0], n, base))
    if len(texts) > 1 and not again:
        return [r for k, t in zip(keys, texts, strict=True) for r in call(embed, [k], [t], attempts, base)]
    return [(None, n, error)] * len(texts)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows that waves have left at ``path``; none where nothing was written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(uuid, kind, embedding) of what has passed."""
    return stored(spark, path).where("not failed").select("uuid", "kind", "embedding").dropDuplicates(["uuid"])


def failures(spark: SparkSession, path: str) -> DataFrame:
    """(uuid, kind, attempts, error) of texts that have failed and haven't passed since; the row with most attempts of each."""
    rows = stored(spark, path)
    worst = rows.where("failed").groupBy("uuid").agg(F.max(F.struct("attempts", "error", "kind")).alias("w"))
    return pending(worst, rows.where("not failed"), ["uuid"]).select("uuid", "w.kind", "w.attempts", "w.error")


def fill(parts: DataFrame, path: str, embed: Callable[[list[str]], list[list[float]]], kind: str = "", attempts: int = 3, base: float = 1.0, callers: int = 64, batch: int = 64, wave_rows: int = 1_000_000) -> DataFrame:
    """Embed what the store at ``path`` lacks of ``parts`` (uuid, segment) and return its ``embeddings``.

    Each text is sent once, in batches of at most ``batch``. Pending texts are
    dealt by their hash to waves of about ``wave_rows``; a wave is one append,
    so what has passed stays when a later wave's job dies, and the next run
    sends only the rest. At most ``callers`` tasks call at once. A text that
    fails ``attempts`` times, or whose error can't pass later, leaves a row of
    ``failures`` and is tried again by the next run. Null and empty segments
    and null keys are left out; an empty table calls nothing.
    """
    spark = parts.sparkSession
    wanted = parts.select("uuid", "segment").where("uuid is not null and segment <> ''").groupBy("uuid").agg(F.min("segment").alias("segment"))
    count = pending(wanted, embeddings(spark, path), ["uuid"]).count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch):
                some = b.iloc[k : k + batch]
                keys = some["uuid"].tolist()
                got = call(embed, keys, some["segment"].tolist(), attempts, base)
                yield pd.DataFrame([(u, kind, v, n, e, v is None) for u, (v, n, e) in zip(keys, got, strict=True)], columns=["uuid", "kind", "embedding", "attempts", "error", "failed"])

    waves = math.ceil(count / wave_rows)
    for w in range(waves):
        todo = pending(wanted.where(F.pmod(F.xxhash64("uuid"), F.lit(waves)) == w), embeddings(spark, path), ["uuid"])
        todo.repartition(callers, "uuid").mapInPandas(run, SCHEMA).write.mode("append").parquet(path)
    return embeddings(spark, path)
