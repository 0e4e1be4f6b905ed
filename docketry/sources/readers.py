"""Readers: tables with explicit schemas, dictionaries, grids, text folders, stores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAPERS = "paper_url string, paper_id string, meeting_year int, meeting_type string, meeting_number int, meeting_name string, party_type string, paper_name string, paper_number int, paper_revision int, agendas array<string>, parties array<string>, paper_language string, payload_json string"
INSTRUMENTS = "Document_Number int, Subject string, Status string, Category string, Topics string, Title string, Content string, Approvals string"
CHUNKS = "document string, chunk_num int, chunk string, year int, mentioned string, intervening string"
# Cells that mean "missing" in a table of text.
MISSING_CELLS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "UTF-8", header: bool = True, separator: str = ",") -> DataFrame:
    """A CSV table; cells may hold line ends and doubled quotes."""
    reader = spark.read.options(header=header, multiLine=True, escape='"', encoding=encoding, sep=separator)
    return (reader.schema(schema) if schema else reader).csv(path)


def with_missing_cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Null for every cell that a data frame library would read as missing."""
    return rows.withColumns({c: F.when(F.col(c).isin(*MISSING_CELLS), None).otherwise(F.col(c)) for c in columns})


def grid(spark: SparkSession, path: str, width: int) -> DataFrame:
    """A headerless grid of ``width`` text columns; rows that don't begin with a year are headings and go."""
    rows = spark.read.schema(", ".join(f"_c{k} string" for k in range(width))).options(header=False, multiLine=True, escape='"').csv(path)
    return rows.where(F.col("_c0").rlike(r"^\s*\d+\s*$")).withColumn("year", F.trim("_c0").cast("int")).drop("_c0")


def keyed_rows(spark: SparkSession, path: str, key: str, lists: list[str], separator: str = ",") -> DataFrame:
    """Rows by URL: those whose key isn't one go, list cells become arrays of trimmed names."""
    rows = csv(spark, path).where(F.startswith(key, F.lit("http")))
    return rows.withColumns({c: F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "") for c in lists})


def lookup(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of ``key;value`` lines; the last line of a key wins."""
    lines = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id()).where(F.contains("value", F.lit(";")))
    rows = lines.select("_n", F.trim(F.split_part("value", F.lit(";"), F.lit(1))).alias("key"), F.trim(F.expr("substring(value, instr(value, ';') + 1)")).alias("value"))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("_n")))).where("_r = 1").select("key", "value")


def names(spark: SparkSession, path: str, aliases: DataFrame) -> DataFrame:
    """(name): the lines of a file and all aliases, once each."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").union(aliases.select(F.col("alias").alias("name"))).distinct()


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a file that holds one JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def texts(spark: SparkSession, folder: str, suffix: str = ".txt", cut: str = ".ocr") -> DataFrame:
    """(document, text) of the files of one folder; the name is cut where ``cut`` begins."""
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    name = F.col("_metadata.file_name")
    return files.select(F.when(F.contains(name, F.lit(cut)), F.split_part(name, F.lit(cut), F.lit(1))).otherwise(name).alias("document"), F.col("value").alias("text"))


def text_tree(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """(path, text) of all files below a folder; bytes that aren't UTF-8 are dropped, not replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)

    @F.pandas_udf("string")
    def decoded(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return files.select("path", decoded("content").alias("text"))


def file_heads(spark: SparkSession, folder: str, most: int = 500) -> DataFrame:
    """(path, head, sha256) of all files below a folder: the first bytes as Latin-1 text, and the hash of the whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.decode(F.substring("content", 1, most), "ISO-8859-1").alias("head"), F.sha2("content", 256).alias("sha256"))


def chunk_store(spark: SparkSession, path: str) -> DataFrame:
    """Report sentences with their lists as arrays instead of JSON text."""
    rows = spark.read.schema(CHUNKS).parquet(path)
    return rows.withColumns({c: F.from_json(c, "array<string>") for c in ("mentioned", "intervening")})


def fixed_report(spark: SparkSession, path: str, pattern: str, columns: list[str]) -> DataFrame:
    """The groups of a pattern from every line of a report that matches."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(*(F.regexp_extract("value", pattern, k + 1).alias(c) for k, c in enumerate(columns)))


def pages(spark: SparkSession, path: str, extract: Callable[[str], str]) -> DataFrame:
    """(path, text) of fetched pages or scans by a caller's extractor: the place of scraping and recognition, which need a network."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [extract(bytes(x).decode("utf-8", "ignore")) for x in b["content"]]})

    return files.mapInPandas(run, "path string, text string")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(n, fingerprint) of a folder's files by path, length and time: a cache made from it is stale once this changes."""
    from docketry.operators.store import fingerprint

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    return fingerprint(files, [F.col("path"), F.col("length").cast("string"), F.col("modificationTime").cast("string")])


def sqlite(spark: SparkSession, path: str, table: str, schema: str, rows_per_part: int = 100_000) -> DataFrame:
    """A table of a SQLite file, by ranges of its row numbers, so no task reads it whole. The file must be on a mount that all executors share.

    Meant to be run once and kept as Parquet.
    """
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{table}"').fetchone()
    columns = [f.name for f in spark.createDataFrame([], schema).schema]
    listed = ", ".join(f'"{c}"' for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as own:
            for b in batches:
                for start in b["start"]:
                    yield pd.DataFrame(own.execute(f'SELECT {listed} FROM "{table}" WHERE rowid >= ? AND rowid < ?', (int(start), int(start) + rows_per_part)).fetchall(), columns=columns)

    parts = spark.range(low, high + 1, rows_per_part).withColumnRenamed("id", "start")
    return parts.repartition(max(1, -(-(high + 1 - low) // rows_per_part))).mapInPandas(run, schema)


def directions(path: str, name: str) -> np.ndarray:
    """A small array of an NPZ file: one direction per country."""
    with np.load(path) as z:
        return np.asarray(z[name], np.float64)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at ``path``; it is built first if it isn't there or wasn't finished."""
    jvm = spark._jvm.org.apache.hadoop.fs
    done = jvm.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
