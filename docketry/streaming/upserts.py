"""Micro-batches merged into a keyed store; the same batch again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from docketry.operators import store


def keep_upserted(stream: DataFrame, versions: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Run until the input is used up. Each batch writes ``versions/<batch>``: the version before with the batch's latest row of each key.

    A batch that is run again after a failure writes its version again from
    the same version before, so the result is exactly once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        latest = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
        new = latest if number == 0 else store.upsert(batch.sparkSession.read.parquet(f"{versions}/{number - 1}"), latest, keys)
        new.write.mode("overwrite").parquet(f"{versions}/{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
