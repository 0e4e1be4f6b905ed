"""From raw documents to piece ids: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir) and gives back documents with their
columns; its result is written as Parquet in the shared folder and read again
by the next, so a lost executor never costs more than the running stage.
The last stage gives piece ids.

Cases, in every stage: a null or empty text has no letter, so language ID drops
it, with all texts of signs or digits only; handed to a later stage directly, it
is one empty line, near to nothing, of size 0 (so the mix takes nothing of it),
and has no pieces. A null doc_id, lang or source stays null; a row without an
id is near to nothing and keeps its lines unless another row holds them. Very
long texts are read whole. Rows that repeat id and text count as one document
from the near-copy stage on. Ties go to the smaller id (near copies), the
larger one (lines), or a seeded draw (mix). Empty tables give empty results.
Other columns pass through every stage but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import language_id, line_dedup, minhash, mixing, nbest
from docketry.llm.queries import tokenizer_path
from docketry.session import importable, materialize, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, whose language is ``und``, go; all others stay, and ``lang`` is from here on the language found."""
    return language_id.with_known_language(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters in at least 5 documents stay in the document with the largest id; every document stays."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8 or more)."""
    return minhash.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids, score and the next best segmentations of each text, and whether the ids decode to it."""
    encoded = nbest.encode_documents(docs, tokenizer_path(), n_best=4, check=True)
    p = F.col("pieces")
    return encoded.select("doc_id", "source", "lang", F.size(p["ids"]).cast("long").alias("n_pieces"), p["ids"].alias("piece_ids"), p["score"].alias("score"), p["alternatives"].alias("alternatives"), p["round_trip"].alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("nbest_pieces", encode_pieces),
]

#: Language ID, seeded repetitions and the piece lattice have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    importable(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
