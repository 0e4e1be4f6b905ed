"""Token counts of whole texts (operator 8).

Batches are encoded inside Arrow functions and only lengths leave them.
Batches hold about ``batch_bytes`` of text each. A text longer than
``piece_bytes`` is cut at safe boundaries, so no call sees an unbounded
string.

A cut is safe for a SentencePiece model when no piece holds a space after
another character, nothing is normalised, and the model adds a dummy space
in front: the cut falls before a single space between two characters that are
not white space, and that space is dropped, as the dummy space of the next
part takes its place. For a model without these properties, and for a
``tokenizers`` file, texts are encoded whole.

Defined cases: a null or empty text has 0 bytes and 0 tokens. Repeated rows
are counted each; extra columns are ignored unless named in ``keep``. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import importable

#: U+2581 is how the model writes a space, so a text's own one counts as white space.
_SAFE = re.compile(r"(?<=[^\s\u2581]) (?=[^\s\u2581])")


@lru_cache(maxsize=4)
def _encoder(path: str):
    """(counts of a list of texts, whether texts may be cut)."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        return lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)], False
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    cut = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not any("▁" in p.piece.lstrip("▁") for p in model.pieces)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)], cut


def split_safely(text: str, most: int) -> list[str]:
    """Parts of at most about ``most`` characters whose token counts add up to the text's."""
    parts, start = [], 0
    while len(text) - start > most:
        at = next((m.start() for m in _SAFE.finditer(text, start + most)), None)
        if at is None:
            break
        parts.append(text[start:at])
        start = at + 1
    return [*parts, text[start:]]


def _counts(texts: list[str], sizes: list[int], path: str, batch_bytes: int, piece_bytes: int) -> list[int]:
    count, cut = _encoder(path)
    out, owners, batch, load = [0] * len(texts), [], [], 0

    def flush() -> None:
        for k, n in zip(owners, count(batch), strict=True):
            out[k] += n
        owners.clear()
        batch.clear()

    for k, text in enumerate(texts):
        for part in split_safely(text, piece_bytes) if cut and sizes[k] > piece_bytes else [text]:
            owners.append(k)
            batch.append(part)
            load += sizes[k] if part is text else len(part.encode())
            if load >= batch_bytes:
                flush()
                load = 0
    flush()
    return out


def token_counts(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text", batch_bytes: int = 1 << 20, piece_bytes: int = 1 << 16) -> DataFrame:
    """``key``, n_bytes and n_tokens of each row. ``model_path`` must exist on every executor."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            sizes = [len(x.encode()) for x in texts]
            counts = _counts(texts, sizes, model_path, batch_bytes, piece_bytes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("key", key)
