"""Keyed stores: latest rows, what is pending, tags, upserts, patches, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """All rows with the largest ``at`` of their key; ties stay."""
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(at)))).where("_r = 1").drop("_r")


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that aren't done."""
    return rows.join(done.select(*keys), keys, "left_anti")


def merged_tags(rows: DataFrame, key: str, tags: Column) -> DataFrame:
    """(key, tags): all tags of a key, once each, sorted."""
    return rows.select(key, F.explode(tags).alias("t")).groupBy(key).agg(F.array_sort(F.collect_set("t")).alias("tags"))


def upsert(store: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """``store`` with the rows of ``new`` in place of those of the same key. The same upsert again changes nothing.

    order: which of several new rows of a key comes first; without it, the one with the smallest values, column by column.
    """
    both = store.withColumn("_p", F.lit(1)).unionByName(new.withColumn("_p", F.lit(0)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_p", *(order or [c for c in store.columns if c not in keys])))).where("_n = 1").drop("_n", "_p")


def insert_missing(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``store`` with those rows of ``new`` whose key it lacks."""
    return store.unionByName(new.join(store.select(*keys), keys, "left_anti"))


def patched(rows: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with the patch's columns where its key matches, even where the patch is empty."""
    p = patch.select(F.col(key), F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = rows.join(p, key, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_hit", *(f"_{c}" for c in columns))


def complete_groups(needed: DataFrame, have: DataFrame, group: str, key: str) -> DataFrame:
    """Groups all of whose keys are there."""
    hit = needed.join(have.select(key).distinct().withColumn("_h", F.lit(1)), key, "left")
    return hit.groupBy(group).agg(F.count("*").alias("n"), F.count("_h").alias("hits")).where("n = hits").select(group, "n")


def pages_joined(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, n_pages, text): pages 0 to the last in order, a missing one empty, each with a line end."""
    own = pages.groupBy(doc, page).agg(F.max(text).alias("t"))
    every = pages.groupBy(doc).agg(F.max(page).alias("last")).select(doc, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias(page))
    return every.join(own, [doc, page], "left").groupBy(doc).agg(F.count("*").alias("n_pages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce("t", F.lit("")).alias("t")))), lambda e: F.concat(e["t"], F.lit("\n"))), "").alias("text"))


def fingerprint(rows: DataFrame, fields: list[Column]) -> DataFrame:
    """(n, fingerprint): the same for any order of the same rows.

    Equal rows are counted first. Their hashes are then hashed up a tree by
    ever shorter beginnings (6, 4, 2, 0 digits): a group holds at most 256
    entries above the first level, and n / 16 million on it.
    """
    h = F.sha2(F.concat_ws("\x1f", *fields), 256)
    level = rows.select(h.alias("b")).groupBy("b").agg(F.count("*").alias("n")).select("b", F.col("n").cast("string").alias("h"), "n")
    for digits in (6, 4, 2, 0):
        level = level.groupBy(F.substring("b", 1, digits).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("b", F.lit(":"), "h"))), "\x1e"), 256).alias("h"), F.sum("n").alias("n"))
    return level.select("n", F.col("h").alias("fingerprint"))
