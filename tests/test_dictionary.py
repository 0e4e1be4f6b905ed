import random
import re
import time

import pytest

from docketry.operators import dictionary
from docketry.operators.dictionary import censor, longest_key, marked, phrase_automaton, phrase_spans


def plain_longest(text, keys):
    low = (text or "").lower()
    hits = [(len(k), v) for k, v in keys if k and v is not None and k.lower() in low]
    best = {v for n, v in hits if n == max(hits)[0]}
    return best.pop() if len(best) == 1 else None


@pytest.mark.parametrize("pass_bytes", [1 << 20, 700])
def test_longest_key_equals_a_plain_search(spark, pass_bytes):
    rng = random.Random(1)
    keys = [("".join(rng.choice("abcé ") for _ in range(rng.randint(1, 5))), rng.choice(["x", "y", "z"])) for _ in range(40)]
    keys += [("India", "x"), ("Indian River", "y"), ("", "z"), (None, "z"), ("AB", None), keys[0]]
    texts = ["".join(rng.choice("abcé dF") for _ in range(rng.randint(0, 14))) for _ in range(200)] + [None, "", "INDIAN RIVER college", "india"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    got = longest_key(rows, "text", spark.createDataFrame(keys, "key string, value string"), "found", pass_bytes).orderBy("id").collect()
    assert [r["found"] for r in got] == [plain_longest(t, [k for k in keys if k[0]]) for t in texts]
    assert got[-1]["found"] == "x" and got[-2]["found"] == "y"


def test_no_keys_and_no_rows(spark):
    keys, rows = spark.createDataFrame([], "key string, value string"), spark.createDataFrame([("a",)], "text string")
    assert [r["country"] for r in longest_key(rows, "text", keys).collect()] == [None]
    assert longest_key(rows.where("false"), "text", keys).collect() == []
    none = spark.createDataFrame([], "phrase string, cased boolean")
    assert [tuple(r["censored"]) for r in censor(rows, "text", none).collect()] == [("a", 0)]


def plain_spans(text, phrases):
    """Leftmost and then longest by trying every phrase at every place."""
    forms = [(len(" ".join(p.split())), re.compile(r"\s+".join(map(re.escape, p.split())), 0 if cased else re.I)) for p, cased in phrases if p.strip()]
    out, at = [], 0
    while at < len(text):
        best = None
        if at == 0 or not re.match(r"\w", text[at - 1]):
            for n, form in forms:
                m = form.match(text, at)
                if m and not re.match(r"\w", text[m.end() : m.end() + 1]) and (best is None or n > best[0]):
                    best = (n, m.end())
        if best:
            out.append((at, best[1]))
        at = best[1] if best else at + 1
    return out


@pytest.mark.parametrize("seed", range(30))
def test_phrase_spans_equal_a_plain_search(seed):
    rng = random.Random(seed)
    words = ["us", "US", "U.S.", "the", "united", "states", "Chilé", "(x)", "_", "norway"]
    phrases = [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))), rng.random() < 0.3) for _ in range(12)] + [(" ", False)]
    text = "".join(rng.choice([*words, *map(str.upper, words), *map(str.title, words)]) + rng.choice([" ", "  ", "\n", "  ", ",", ""]) for _ in range(80))
    assert phrase_spans(phrase_automaton(phrases), text) == plain_spans(text, phrases)


def test_marks(spark):
    auto = phrase_automaton([("United States", False), ("States", False), ("US", True)])
    assert marked(auto, "The united\n states and us, US; statesman İ US\n", "X") == ("The X and us, X; statesman İ X\n", 3)
    assert marked(auto, None, "X") == (None, 0) and marked(auto, "", "X") == ("", 0)
    rows = spark.createDataFrame([("the US.",), (None,), ("",)], "text string")
    phrases = spark.createDataFrame([("US", True), ("US", True), (None, False)], "phrase string, cased boolean")
    assert [tuple(r["censored"]) for r in censor(rows, "text", phrases, "$1").collect()] == [("the $1.", 1), (None, 0), ("", 0)]
    with pytest.raises(ValueError, match="bytes of phrases"):
        censor(rows, "text", phrases, most_bytes=50)


def test_fifty_thousand_keys_in_one_pass():
    rng = random.Random(5)
    keys = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(6, 12))) for _ in range(50_000)})
    text = " ".join(rng.choice(keys) if rng.random() < 0.2 else "other" for _ in range(20_000))
    start = time.perf_counter()
    spans = phrase_spans(phrase_automaton([(k, False) for k in keys]), text)
    assert time.perf_counter() - start < 20
    known = set(keys)
    assert [text[a:b] for a, b in spans] == [w for w in text.split() if w in known]


def test_passes_hold_every_phrase_once(spark):
    keys = spark.createDataFrame([(f"key {k}",) for k in range(500)], "key string")
    parts = dictionary._passes(keys, "key", 5000)
    assert len(parts) > 5 and sorted(r["key"] for p in parts for r in p.collect()) == sorted(f"key {k}" for k in range(500))
