"""The ladder: a spine of countries with one column per figure, and what the figures' names miss."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.names import spellings


@dataclass(frozen=True)
class Figure:
    """A figure: long rows (country, value), its column's title, and the value of a country that it lacks."""

    title: str
    values: DataFrame
    missing: float | None = 0.0


def by_country(figures: list[Figure], spine: DataFrame, aliases: DataFrame) -> DataFrame:
    """(country, figure, value): per country the sum over all its spellings in a figure, the figure's missing value without one.

    The alias table is small next to the figures; Spark picks the join by its measured size.
    """
    bridge = spellings(aliases).join(spine.select("country"), "country")
    own = spine.select("country", F.lower("country").alias("alias")).union(bridge.select("country", "alias")).distinct()
    values = None
    for f in figures:
        rows = f.values.select(F.lit(f.title).alias("figure"), F.lower("country").alias("alias"), F.col("value").cast("double").alias("value"))
        values = rows if values is None else values.unionByName(rows)
    sums = values.join(own, "alias").groupBy("country", "figure").agg(F.sum("value").alias("value"))
    titles = F.explode(F.array(*(F.struct(F.lit(f.title).alias("figure"), F.lit(f.missing).cast("double").alias("missing")) for f in figures)))
    grid = spine.select("country", titles.alias("f")).select("country", "f.*")
    return grid.join(sums, ["country", "figure"], "left").select("country", "figure", F.coalesce("value", "missing").alias("value"))


def ladder(figures: list[Figure], spine: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per country, one column per figure."""
    return by_country(figures, spine, aliases).groupBy("country").pivot("figure", [f.title for f in figures]).agg(F.first("value"))


def unused_names(figure: DataFrame, spine: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names of a figure that are no country's spelling."""
    own = spine.select(F.lower("country").alias("alias")).union(spellings(aliases).join(spine, "country").select("alias"))
    return figure.select(F.lower("country").alias("alias")).distinct().join(own, "alias", "left_anti")


def countries_without(figure: DataFrame, spine: DataFrame, aliases: DataFrame) -> DataFrame:
    """Countries none of whose spellings the figure has."""
    own = spine.select("country", F.lower("country").alias("alias")).union(spellings(aliases).join(spine, "country").select("country", "alias"))
    there = own.join(figure.select(F.lower("country").alias("alias")).distinct(), "alias", "left_semi").select("country")
    return spine.select("country").join(there, "country", "left_anti")
