"""Writers: CSV with and without an index, gzip, one folder per window, stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions.vectors import printed
from docketry.operators import store


def indexed_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """A small figure as one CSV whose first, unnamed column counts rows from 0 in ``order``."""
    numbered = rows.select((F.row_number().over(Window.orderBy(*order)) - 1).alias(" "), *rows.columns)
    numbered.coalesce(1).sortWithinPartitions(" ").write.mode("overwrite").csv(path, header=True)


def csv(rows: DataFrame, path: str, order: list[str] | None = None, gzip: bool = False) -> None:
    """CSV files in ``order`` over all files."""
    out = rows.orderBy(*order) if order else rows
    out.write.mode("overwrite").option("compression", "gzip" if gzip else "none").csv(path, header=True)


def vectors_csv(rows: DataFrame, path: str, vector: str, digits: int = 6, gzip: bool = True) -> None:
    """Vectors as text with so many significant digits."""
    csv(rows.withColumn(vector, printed(F.col(vector), digits)), path, gzip=gzip)


def by_window(rows: DataFrame, path: str, window: str) -> None:
    """A folder of CSV files for each value of ``window``."""
    rows.write.mode("overwrite").partitionBy(window).csv(path, header=True)


def replaced(rows: DataFrame, path: str) -> None:
    """Parquet in place of an older table that ``rows`` may read: written beside it first."""
    spark = rows.sparkSession
    beside = f"{path.rstrip('/')}.new"
    rows.write.mode("overwrite").parquet(beside)
    spark.read.parquet(beside).write.mode("overwrite").parquet(path)
    fs = spark._jvm.org.apache.hadoop.fs.Path(beside).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(beside), True)


def upserted(new: DataFrame, path: str, keys: list[str]) -> None:
    """The store at ``path`` with ``new`` merged in."""
    replaced(store.upsert(new.sparkSession.read.parquet(path), new, keys), path)


def report(rows: DataFrame, path: str, line: Column) -> None:
    """Lines of text."""
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def json_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON, nested columns included: checkpoints that other tools read."""
    rows.write.mode("overwrite").json(path)
