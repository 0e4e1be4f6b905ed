"""The corpus's tables as they stand in the driver's: papers, authors, instruments, pages, stores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.session import read

WINDOW = (1996, 2000)


def papers(spark: SparkSession, sf: str, window: tuple[int, int] | None = None) -> DataFrame:
    """(paper_id, year, kind, meeting, topic, customer, amount) of all years or of a closed range, given as dates so that the scan can skip by them."""
    o = read(spark, sf, "orders")
    if window:
        o = o.where((F.col("o_orderdate") >= F.lit(f"{window[0]}-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit(f"{window[1] + 1}-01-01").cast("timestamp")))
    return o.select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("meeting"), (F.col("o_custkey") % 20 - 1).cast("int").alias("topic"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("amount"))


def working_papers(spark: SparkSession, sf: str) -> DataFrame:
    return papers(spark, sf, WINDOW).where(F.col("kind") == "F")


#: Line items that one task holds when they are gathered by paper.
ITEMS = 1_000_000


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """(paper_id, l_suppkey) of the line items, dealt by paper to as many tasks as their number asks for, so that what a task holds doesn't grow with the table."""
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), "l_suppkey")
    n = math.ceil(rows.count() / ITEMS)
    return rows.repartition(n, "paper_id") if n > 1 else rows


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("party"))


def authored(spark: SparkSession, sf: str, of: DataFrame) -> DataFrame:
    """The columns of ``of`` (a few, with paper_id as key) and each of a paper's parties once. Line items meet the chosen papers before anything is made distinct."""
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(of, F.col("l_orderkey") == F.col("paper_id"))
    return items.join(_suppliers(spark, sf), F.col("l_suppkey") == F.col("s_suppkey")).select(*of.columns, "party").distinct()


def with_parties(spark: SparkSession, sf: str, of: DataFrame) -> DataFrame:
    """``of`` with ``parties``, in ascending order."""
    return authored(spark, sf, of).groupBy(*of.columns).agg(F.array_sort(F.collect_list("party")).alias("parties"))


def parties(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """(paper_id, parties): each paper's parties once, in ascending order, of all papers with a line item or of those in ``of`` (paper_id)."""
    items = _items(spark, sf)
    items = items if of is None else items.join(of.select("paper_id").distinct(), "paper_id", "left_semi")
    each = items.join(_suppliers(spark, sf), F.col("l_suppkey") == F.col("s_suppkey")).select("paper_id", "party").distinct()
    return each.groupBy("paper_id").agg(F.array_sort(F.collect_list("party")).alias("parties"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(id, year, label, vector)"""
    e = read(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.lit(1961) + F.col("vec_id") % 60).alias("year"), F.col("label").alias("topic"), F.col("embedding").alias("vector"))


def instruments(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).where("id % 5 = 0")


def prior_papers(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).where("id % 5 <> 0")


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Instruments and papers as (id, year, vector)."""
    return instruments(spark, sf).select("id", "year", "vector"), prior_papers(spark, sf).select("id", "year", "vector")


def approvals(spark: SparkSession, sf: str) -> DataFrame:
    """(paper_id, adopted, approvals): text lines of countries and dates, some starred, some undated."""
    s = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "n_nationkey")
    li = read(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "n_name", "n_nationkey").agg(F.min("l_shipdate").alias("d"))
    line = F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, F.lit(" *")).otherwise(F.lit("")), F.when(F.col("n_nationkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("\n"), F.date_format("d", "dd/MM/yyyy"))))
    text = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", line.alias("line")))), lambda e: e["line"]), "\n").alias("approvals"))
    return papers(spark, sf).select("paper_id", F.col("year").alias("adopted")).join(text, F.col("paper_id") == F.col("l_orderkey")).drop("l_orderkey")


def regions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The spine of countries (region names, and one that nothing names) and aliases (nation names)."""
    r = read(spark, sf, "region")
    spine = r.select(F.col("r_name").alias("country")).union(spark.createDataFrame([("ATLANTIS",)], "country string"))
    aliases = read(spark, sf, "nation").where("n_nationkey < 24").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("country"), F.col("n_name").alias("alias"))
    return spine, aliases
