"""Country figures: authorship, weighted sums, cells, affiliations, mentions, delays, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions.dates import OPEN_END

#: Closed ranges of years.
PERIODS = [("2000s", 2000, 2009), ("2010s", 2010, 2019), ("2020s (incomplete)", 2020, 2025)]


def first_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def in_periods(rows: DataFrame, year: str, periods: list[tuple[str, int, int]] = PERIODS) -> DataFrame:
    """Each row once for every period that holds its year, with ``period``."""
    names = F.filter(F.array(*(F.when(F.col(year).between(a, b), F.lit(p)) for p, a, b in periods)), lambda x: x.isNotNull())
    return rows.withColumn("period", F.explode(names))


def yearly_counts(papers: DataFrame, year: str = "year", party: str = "party") -> DataFrame:
    """(year, country, value): rows per year and party."""
    return papers.groupBy(F.col(year).alias("year"), F.col(party).alias("country")).agg(F.count("*").alias("value"))


def totals(yearly: DataFrame) -> DataFrame:
    """(country, value) of a yearly figure."""
    return yearly.groupBy("country").agg(F.sum("value").alias("value"))


def split_weights(rows: DataFrame, first: str, second: str, amount: str, weight: Column, major: float = 0.75) -> DataFrame:
    """(country, value): an amount shared between two operators; without a second one (null, blank, ``nan``) the first has all."""
    alone = F.col(second).isNull() | (F.trim(F.col(second)) == "") | (F.col(second) == "nan")
    value = F.col(amount) * weight
    parts = F.when(alone, F.array(F.struct(F.col(first).alias("country"), value.alias("value")))).otherwise(F.array(F.struct(F.col(first).alias("country"), (value * major).alias("value")), F.struct(F.col(second).alias("country"), (value * (1 - major)).alias("value"))))
    value = rows.select(F.explode(parts).alias("p")).select("p.*").groupBy("country")
    # Sums of decimals don't depend on the order of rows; a weight that isn't a number still spoils its country's sum.
    exact = F.sum(F.nanvl("value", F.lit(0.0)).cast("decimal(38,8)")).cast("double")
    return value.agg(F.when(F.bool_or(F.isnan("value")), F.lit(float("nan"))).otherwise(exact).alias("value"))


def cell_counts(grid: DataFrame, year: str, cells: list[str]) -> DataFrame:
    """(year, country, value): how often a name stands in a year's cells; a cell may hold several joined by ``&``."""
    names = grid.select(F.col(year).alias("year"), F.explode(F.array(*cells)).alias("cell")).where(F.trim("cell") != "")
    return names.select("year", F.explode(F.split("cell", "&")).alias("c")).select("year", F.trim("c").alias("country")).where("country <> ''").groupBy("year", "country").agg(F.count("*").alias("value"))


def longest_key(rows: DataFrame, text: str, keys: list[tuple[str, str]], out: str = "country") -> DataFrame:
    """``rows`` with the value of the longest key that the text holds; null without one, or where the longest ones disagree.

    The keys are a fixed list, so they are a chain of conditions from long to
    short, and no join.
    """
    found: Column = F.lit(None).cast("string")
    for n in sorted({len(k) for k, _ in keys}):
        group = [(k, v) for k, v in keys if len(k) == n]
        hits = F.array_distinct(F.filter(F.array(*(F.when(F.contains(F.lower(text), F.lit(k.lower())), F.lit(v)) for k, v in group)), lambda x: x.isNotNull()))
        found = F.when(F.size(hits) == 1, F.get(hits, 0)).when(F.size(hits) > 1, F.lit(None)).otherwise(found)
    return rows.withColumn(out, found)


def dense_grid(counts: DataFrame, years: tuple[int, int], countries: DataFrame) -> DataFrame:
    """(year, country, value) for every year of a closed range and every country, 0 where nothing was counted."""
    grid = countries.select("country", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))).alias("year"))
    return grid.join(counts, ["year", "country"], "left").select("year", "country", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def approval_pairs(rows: DataFrame, key: str, approvals: str, keep: list[str] | None = None) -> DataFrame:
    """(key, country, year) and ``keep``: a line that starts with a digit dates the country in the line before it; others have no year."""
    keep = keep or []
    lines = F.filter(F.transform(F.split(approvals, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    # Each line meets the next in its own row, so nothing is shuffled.
    with_next = F.transform("_lines", lambda x, k: F.struct(x.alias("line"), F.get("_lines", k + 1).alias("following")))
    dated = rows.select(key, *keep, lines.alias("_lines")).select(key, *keep, F.explode(with_next).alias("_e")).select(key, *keep, "_e.*")
    dated = dated.where(~F.col("line").rlike("^[0-9]"))
    year = F.when(F.col("following").rlike("^[0-9]"), F.right("following", F.lit(4)).cast("int"))
    return dated.select(key, F.col("line").alias("country"), year.alias("year"), *keep)


def approval_delays(pairs: DataFrame, adopted: str = "adopted", ended: Column | None = None) -> DataFrame:
    """Starred countries with ``delay``: years from adoption to approval, or to the end of what is known."""
    starred = pairs.where(F.endswith("country", F.lit("*"))).withColumn("country", F.expr("substring(country, 1, length(country) - 2)"))
    return starred.withColumn("delay", F.coalesce("year", ended if ended is not None else F.lit(OPEN_END)) - F.col(adopted))


def earliest_per_topic(documents: DataFrame, order: str = "sort_string", tie: str = "paper_id") -> DataFrame:
    """The first document of each topic by its sort string (as text); -1 is no topic."""
    return first_rows(documents.where("topic <> -1"), ["topic"], [F.col(order), F.col(tie)])


def distinct_topics(documents: DataFrame, by: list[str]) -> DataFrame:
    """Distinct topics by country (and period); the outlier topic doesn't count."""
    return documents.where("topic <> -1").groupBy(*by).agg(F.count_distinct("topic").alias("value"))
