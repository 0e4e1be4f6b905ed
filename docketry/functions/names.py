"""Party names: splitting, aliases and their roll-up keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_parties(parties: Column) -> Column:
    """Each entry split at ``|``, trimmed and lower-cased, in order; repeats and empty names stay."""
    return F.flatten(F.transform(parties, lambda p: F.transform(F.split(p, r"\|"), lambda x: F.lower(F.trim(x)))))


def canonical(rows: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """``name`` replaced by its canonical spelling, lower case; aliases: (alias, country). Unknown names stay."""
    table = aliases.select(F.lower("alias").alias("_alias"), F.lower("country").alias("_country")).dropDuplicates(["_alias"])
    return rows.join(table, F.lower(F.col(name)) == F.col("_alias"), "left").withColumn(name, F.coalesce("_country", F.lower(F.col(name)))).drop("_alias", "_country")


def spellings(aliases: DataFrame) -> DataFrame:
    """(country, alias): every spelling under which a country may stand in a figure, its own name included."""
    own = aliases.select("country", F.lower("country").alias("alias"))
    return aliases.select("country", F.lower("alias").alias("alias")).union(own).distinct()


def checked_aliases(aliases: DataFrame) -> DataFrame:
    """``aliases``, or an error if two countries claim one folded spelling."""
    clash = aliases.groupBy(F.lower("alias").alias("alias")).agg(F.count_distinct(F.lower("country")).alias("n")).where("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"more than one country is named {clash[0]['alias']!r}")
    return aliases
