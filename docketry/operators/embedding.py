"""Vectors for texts: dedupe, what the store lacks, a caller's embedder, segments."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators.store import insert_missing, pending

#: What an embedding model takes at most.
MOST_TOKENS, MOST_CHARS = 32_000, 131_072


_WORD = re.compile(r"\s*\S+(?:\s+\Z)?|\s+")


def segments(
    text: str,
    most_tokens: int = MOST_TOKENS,
    most_chars: int = MOST_CHARS,
    encode: Callable[[str], list] = _WORD.findall,
    decode: Callable[[list], str] = "".join,
) -> list[str]:
    """Parts of a text within both limits, of equally many tokens each; joined they are the text.

    A text of fewer than three characters for each allowed token is one part. Else there are as few parts as both
    limits need, and one more as long as any of them reaches the limit of characters; in the end every token stands alone.
    Without a tokenizer of the embedder's own a token is a word with the white space before it.
    """
    if len(text) < 3 * most_tokens:
        return [text] if text else []
    tokens = encode(text)
    for n in range(max(math.ceil(len(tokens) / most_tokens), math.ceil(len(text) / most_chars)), len(tokens)):
        size = math.ceil(len(tokens) / n)
        parts = [decode(tokens[k : k + size]) for k in range(0, len(tokens), size)]
        if all(len(p) < most_chars for p in parts):
            return parts
    return [decode([x]) for x in tokens]


def with_segments(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part, uuid, segment): each document's segments and their hashes; blank ones go."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: segments(x or ""))

    parts = documents.select(key, F.posexplode(cut(text)).alias("part", "segment")).where(F.trim("segment") != "")
    return parts.select(key, "part", F.sha2(F.col("segment").cast("binary"), 256).alias("uuid"), "segment")


def hashed_vector(text: str, width: int = 64) -> list[float]:
    """A repeatable unit vector of a text's words: a stand-in where no model can be called."""
    v = np.zeros(width)
    for w in text.lower().split():
        h = hashlib.blake2b(w.encode(), digest_size=8).digest()
        v[int.from_bytes(h[:4], "little") % width] += 1 if h[4] & 1 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed_missing(parts: DataFrame, store: DataFrame, embed: Callable[[list[str]], list[list[float]]] = lambda xs: [hashed_vector(x) for x in xs]) -> DataFrame:
    """``store`` (uuid, embedding) with every segment that it lacked, each text embedded once."""
    todo = pending(parts.select("uuid", "segment").dropDuplicates(["uuid"]), store, ["uuid"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"uuid": b["uuid"], "embedding": embed(b["segment"].tolist())})

    return insert_missing(store.select("uuid", "embedding"), todo.mapInPandas(run, "uuid string, embedding array<double>"), ["uuid"])
