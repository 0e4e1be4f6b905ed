"""Line dedup across documents (operator 4), DataFrame functions only.

Lines are exploded, normalised and hashed; documents are counted per hash;
lines whose hash is in too many documents are dropped everywhere but in the
document with the largest id; what stays is reassembled by position.

Only hashes, ids and positions are shuffled for counting. The texts
meet the dropped positions in one join on the document's id and a hash of
its text, and each text is rebuilt from its own row, so no group collects
lines. Counting aggregates before each shuffle, so a line that is in a third
of all documents reaches its final task as one row per map task.

Defined cases: a null or empty text is one empty line. Rows with the same
id are the same document: its lines count once. A null id counts as one
document, below every other. Extra columns pass through ``dedup_lines``.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Space and \x09-\x0D.
BLANK = " \t\n\x0b\x0c\r"
_NO_ID = -(2**63)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def dropped_positions(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, text_hash, gone): for each document that loses lines, the positions it loses, as array<int>."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), _lines(F.translate(F.col(text), UPPER, LOWER)).alias("lines"))
    lines = rows.select("id", "text_hash", F.posexplode("lines").alias("pos", "line")).select("id", "text_hash", "pos", _key(F.col("line")).alias("k")).where(F.length("k") >= min_chars).select("id", "text_hash", "pos", F.unhex(F.md5("k")).alias("h"))
    hot = lines.groupBy("h", "id").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("one").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    # As a table of its own it meets the lines in a plain join, whose hot keys Spark splits at run time.
    gone = lines.join(materialize(hot.select("h", "keeper"), "repeated-lines"), "h").where(F.col("id") != F.col("keeper"))
    return gone.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of ``docs`` with ``kept_text``, ``n_lines`` (before) and ``n_dropped`` added."""
    gone = dropped_positions(docs, key=key, text=text, min_chars=min_chars, min_docs=min_docs)
    taken = docs.withColumns({"__line_id": F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)), "__line_hash": F.xxhash64(F.coalesce(text, F.lit("")))})
    joined = taken.join(gone, (F.col("__line_id") == gone["id"]) & (F.col("__line_hash") == gone["text_hash"]), "left").select(*(taken[c] for c in docs.columns), gone["gone"].alias("__line_gone"))
    lines = _lines(F.col(text))

    # Inside transform(array(x), f) the lines are split once and stay a value, whatever the optimiser inlines.
    def kept(x: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__line_gone"))
        return F.concat_ws("\n", F.transform(stay, lambda p: F.get(x, p)))

    whole = F.coalesce(F.col(text), F.lit(""))
    return joined.withColumns({
        "n_lines": (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_dropped": F.when(F.col("__line_gone").isNull(), 0).otherwise(F.size("__line_gone")).cast("long"),
        "kept_text": F.when(F.col("__line_gone").isNull(), whole).otherwise(F.element_at(F.transform(F.array(lines), kept), 1)),
    }).drop("__line_gone")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: columns as before, ``text`` (and ``n_chars``, if there) of what stays; every document stays."""
    aside = {c: f"__own_{c}" for c in ("n_lines", "n_dropped", "kept_text") if c in docs.columns}
    out = dedup_lines(docs.withColumnsRenamed(aside)).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))
