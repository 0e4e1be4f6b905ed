import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import nbest
from docketry.llm.queries import op10_nbest_pieces, tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def lattice():
    return nbest.Lattice(PATH, 4)


def every(lattice, text):
    into = lattice.edges(nbest.SPACE + text.replace(nbest.SPACE, nbest._LITERAL).replace(" ", nbest.SPACE))

    def walk(j):
        if not j:
            yield 0.0, ()
        for i, ids, s in into[j]:
            for score, before in walk(i):
                yield score + s, before + ids

    return sorted(walk(len(into) - 1), key=lambda x: -x[0])


def applied(ids, edits):
    out = list(ids)
    for at, n, new in sorted(edits, reverse=True):
        out[at : at + n] = new
    return out


def test_equals_all_segmentations(lattice):
    rng = random.Random(4)
    texts = ["the cat", "a\nb  c", "é ▁x", "日本 ok", "  a", "a", "x "] + ["".join(rng.choice("the anio\n▁é") for _ in range(9)) for _ in range(40)]
    for text in texts:
        whole = every(lattice, text)
        score, ids, others = lattice.encode(text)
        assert [score, *(s for s, _ in others)] == [s for s, _ in whole[:4]]
        found = [tuple(ids.tolist()), *(tuple(applied(ids.tolist(), e)) for _, e in others)]
        assert len(set(found)) == len(found) and {(s, x) for s, x in zip([score, *(s for s, _ in others)], found, strict=True)} <= set(whole)


def test_together_equals_alone(lattice, docs):
    parts = {p for r in docs.limit(60).collect() for p in lattice.parts.findall(nbest.SPACE + r["text"].replace(" ", nbest.SPACE))}
    lattice.prepare(parts)
    assert all(lattice.best(p) == lattice._viterbi(p) for p in parts)


def test_small_cache_changes_nothing(docs, monkeypatch):
    texts = [r["text"] for r in docs.limit(40).collect()]
    first = [(s, i.tolist(), o) for s, i, o in nbest.Lattice(PATH, 3).encode_all(texts)]
    monkeypatch.setattr(nbest, "CACHE_PARTS", 50)
    monkeypatch.setattr(nbest, "CHUNK_CHARS", 500)
    assert first == [(s, i.tolist(), o) for s, i, o in nbest.Lattice(PATH, 3).encode_all(texts)]


def test_round_trip(docs, odd, none):
    for frame in (docs, odd):
        rows = nbest.encode_documents(frame, PATH).withColumn("back", nbest.decoded(F.col("pieces.ids"), PATH))
        assert rows.columns[: len(frame.columns)] == frame.columns
        assert all(r["back"] == (r["text"] or "") for r in rows.collect())
    assert nbest.encode_documents(none, PATH).count() == 0
    empty = nbest.encode_documents(odd.where("doc_id in (2, 3)"), PATH).collect()
    assert [(r["pieces"]["score"], r["pieces"]["ids"], r["pieces"]["alternatives"]) for r in empty] == [(0.0, [], [])] * 2


def test_ids_of_no_text_still_decode():
    d = nbest.Decoder(PATH)
    assert d.texts(np.array([3 + 0xC3, 3 + 0x41]), np.array([0, 1, 2, 2])).to_pylist() == ["", "", ""]


def test_query(spark, sf):
    rows = op10_nbest_pieces(spark, sf).collect()
    assert all(r["round_trip"] for r in rows)
    assert all(list(r["other_scores"]) == sorted(r["other_scores"], reverse=True) and (not r["other_scores"] or r["score"] >= r["other_scores"][0]) for r in rows)


def test_memory_of_a_long_part_without_a_break(lattice):
    rng = random.Random(5)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(30_000))
    lattice.encode("a")
    tracemalloc.start()
    _, ids, others = lattice.encode(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(text) and len(others) == 3
    assert nbest.pieces_of(PATH).texts(ids, np.array([0, len(ids)])).to_pylist() == [text]
    assert nbest.SPACE + text not in lattice.found


def test_bound_of_bytes_changes_nothing(docs, monkeypatch):
    texts = [r["text"] for r in docs.limit(40).collect()]
    first = [(s, i.tolist(), o) for s, i, o in nbest.Lattice(PATH, 3).encode_all(texts)]
    monkeypatch.setattr(nbest, "CACHE_BYTES", 5_000)
    monkeypatch.setattr(nbest, "CHUNK_CHARS", 500)
    monkeypatch.setattr(nbest, "KEPT_CHARS", 3)
    assert first == [(s, i.tolist(), o) for s, i, o in nbest.Lattice(PATH, 3).encode_all(texts)]


def test_checked_round_trip_and_name(odd):
    rows = nbest.encode_documents(odd, PATH, check=True, out="own").collect()
    assert all(r["own"]["round_trip"] is True and r["pieces"] == "pieces" for r in rows)
