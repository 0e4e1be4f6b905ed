import random
import re

import pytest

from docketry.operators import sentences
from docketry.operators.sentences import Splitter, chunk_spans, learn, sentence_spans


@pytest.fixture(scope="module")
def corpus(spark):
    """Reports whose abbreviations, initials and openers stand nowhere but in the text itself."""
    rng = random.Random(3)
    nouns = "delegation station glacier measure harbour survey krill vessel season report".split()
    rows = []
    for _ in range(400):
        a, b, c = rng.sample(nouns, 3)
        rows.append(
            f"The {a} met Dr. Olsen near the {b}. However the {c} closed. See Art. {rng.randint(1, 20)} of the {a} and No. {rng.randint(1, 9)} again. "
            f"A {b} from the U.S. vessel left. The {c} was late! Was the {a} seen? However no {b} came. J. Berg of the {a} wrote it. It closed and left again with a {c} that came late."
        )
    return spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "id int, text string")


@pytest.fixture(scope="module")
def splitter(corpus):
    return learn(corpus, "text")


def cut(text, splitter):
    return [text[a:b] for a, b in sentence_spans(text, splitter)]


def test_learns_abbreviations_without_a_list(splitter):
    assert {"dr", "art", "u.s"} <= splitter.abbreviations and {"art", "no"} <= splitter.leads
    assert not splitter.abbreviations & {"delegation", "station", "glacier", "closed", "came"}
    assert {"the", "however"} <= splitter.openers and "olsen" not in splitter.openers


def test_abbreviations_end_no_sentence(splitter):
    text = "Dr. Olsen cited Art. 3 and No. 3 there. J. Berg left the U.S. vessel. It closed."
    assert cut(text, splitter) == ["Dr. Olsen cited Art. 3 and No. 3 there.", "J. Berg left the U.S. vessel.", "It closed."]
    # Before a word that opens sentences an abbreviation may end one.
    assert cut("They went to the U.S. However it closed.", splitter) == ["They went to the U.S.", "However it closed."]
    assert cut("Dr. Olsen left.", Splitter()) == ["Dr.", "Olsen left."]


def test_plain_cases():
    none = Splitter()
    assert cut("One here. Two follows! Three?", none) == ["One here.", "Two follows!", "Three?"]
    assert cut("Wait... not yet. Then... Now", none) == ["Wait... not yet.", "Then...", "Now"]
    assert cut('He said "no." Then left.\n\nHEADING\n \nBody', none) == ['He said "no."', "Then left.", "HEADING", "Body"]
    assert cut("", none) == [] and cut(" \n\n ", none) == []
    assert cut("No terminator", none) == ["No terminator"]
    assert chunk_spans("A one. B two. C three.", none, 2) == [(0, 13), (14, 22)] and chunk_spans("", none, 3) == []


@pytest.mark.parametrize("seed", range(40))
def test_spans_rebuild_any_text(seed, splitter):
    rng = random.Random(seed)
    text = "".join(rng.choice(["Dr", "U.S", "x", "The", ".", ". ", "!", "?", "...", "\n", "\n\n", " ", '"', ")", "(", "é", "𝄞", "7", ", "]) for _ in range(200))
    spans = sentence_spans(text, splitter)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    gaps = [0, *(x for s in spans for x in s), len(text)]
    assert all(not text[gaps[k] : gaps[k + 1]].strip() for k in range(0, len(gaps), 2))


@pytest.mark.parametrize("unit", [".", "\n", ". ", "a.", ".\"", "\n ", "''", "Dr. "])
def test_long_runs_are_linear(unit, splitter):
    import time

    start = time.perf_counter()
    sentence_spans(unit * 300_000 + "x", splitter)
    assert time.perf_counter() - start < 10


def test_counts_equal_a_plain_version(corpus):
    dotted, plain = {}, {}
    for (text,) in corpus.select("text").collect():
        for w in re.split(sentences.SPACE, text):
            core = w.strip(sentences.AROUND)
            stop = core.endswith(".") and not core.endswith("..")
            word = (core[:-1] if stop else core.rstrip(sentences.MARKS)).lower()
            if any(map(str.isalpha, word)):
                into = dotted if stop else plain
                into[word] = into.get(word, 0) + 1
    got = {r["word"]: (r["dotted"], r["plain"]) for r in sentences.word_counts(corpus, "text").collect()}
    assert got == {w: (dotted.get(w, 0), plain.get(w, 0)) for w in dotted.keys() | plain.keys()}


def test_empty_and_odd_corpora(spark):
    none = spark.createDataFrame([], "text string")
    assert learn(none, "text") == Splitter()
    odd = spark.createDataFrame([(None,), ("",), (" \n",), ("...",), ("all. dots. here.",), ("x" * 200_000,)], "text string")
    learned = learn(odd, "text")
    chunks = sentences.with_chunks(odd, "text", learned, 2).collect()
    assert [[c["chunk"] for c in r["chunks"]] for r in chunks[:4]] == [[], [], [], ["..."]]
    assert all(r["text"][c["start"] : c["end"]] == c["chunk"] for r in chunks if r["text"] for c in r["chunks"])
