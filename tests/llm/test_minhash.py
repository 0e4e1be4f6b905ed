import random
import re

import numpy as np

from docketry.llm import components, minhash
from docketry.llm.components import connected

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(table, width):
    out = []
    for i, text in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out.append((i, frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()))
    return out


def brute(table, width, percent):
    sets = sets_of(table, width)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for j in range(i):
            b, r = sets[j]
            if a is None or b is None or not s or not r:
                continue
            common = len(s & r)
            if 100 * common >= percent * (len(s) + len(r) - common):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((str(i), len(s), str(least.get(root(k)))) for k, (i, s) in enumerate(sets))


def check(spark, table, width, percent):
    frame = spark.createDataFrame(table, "doc_id long, text string")
    rows = minhash.near_duplicates(frame, width=width, percent=percent).collect()
    assert sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == brute(table, width, percent)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in rows if r["id"] is not None)


def table(seed=0, groups=12, most=25):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzuvw") + str(rng.randrange(30))
    passage, rows, k = [word() for _ in range(30)], [], 0
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, most)):
            text = [word() if rng.random() < 0.02 * rng.random() else w for w in base]
            if rng.random() < 0.3:
                text += passage
            rows.append((k, " ".join(text)))
            k += 1
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    check(spark, table(), 3, 85)
    check(spark, table(1), 5, 80)


def test_blocks_of_lists_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LIST_BLOCK", 8)
    monkeypatch.setattr(minhash, "CLUSTER_BLOCK", 8)
    check(spark, table(2, groups=4, most=60), 3, 85)


def test_few_hubs_and_edge_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LIST_BLOCK", 5)
    monkeypatch.setattr(minhash, "CLUSTER_BLOCK", 6)
    monkeypatch.setattr(minhash, "HUBS", 1)
    monkeypatch.setattr(components, "EDGE_BLOCK", 7)
    check(spark, table(3, groups=6, most=40), 3, 85)


def test_repeated_ids_with_other_texts(spark):
    base = [f"word{k}" for k in range(60)]
    near, other = " ".join([*base, "more"]), " ".join(f"other{k}" for k in range(50))
    rows = [(7, " ".join(base)), (7, other), (3, near), (7, near), (9, other + " more"), (9, None), (7, " ".join(base))]
    check(spark, rows, 3, 85)


def test_work_on_one_hot_group_grows_with_its_length():
    rng = np.random.default_rng(0)
    counted = []
    for m in (1000, 2000, 4000):
        sig = np.tile(rng.integers(0, 2**32, 32, dtype=np.uint32), (m, 1))
        sig[rng.random(sig.shape) < 0.1] = rng.integers(0, 2**32)
        near, calls = minhash._near_signatures(sig, np.full(m, 100), 15, 85), [0]

        def counting(some, others, near=near, calls=calls):
            calls[0] += len(some) * len(others)
            return near(some, others)

        root = minhash.spanning(m, counting)
        assert (root == 0).all()
        counted.append(calls[0])
    assert counted[1] <= 2.2 * counted[0] and counted[2] <= 2.2 * counted[1]


def test_odd_rows(spark, odd, none):
    check(spark, [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()], 3, 85)
    assert minhash.near_duplicates(odd).count() == odd.count() and minhash.near_duplicates(none).count() == 0


def test_matches_needed():
    assert minhash.least_matches(85) < 32 * 0.85 and minhash.least_matches(80) < minhash.least_matches(85)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(300, 299), (7, 7)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{100 + k: 100 for k in range(1, 50)}, 300: 299}


def test_components_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGE_BLOCK", 5)
    test_components_of_chains_and_stars(spark)


def test_stage_keeps_one_of_each_group(spark):
    base = " ".join(f"word{k}" for k in range(100))
    rows = [(3, base, "x"), (1, base, "x"), (2, base + " more", "x"), (5, "alone", "x"), (5, "alone", "x"), (6, None, "x"), (None, base, "x"), (1, "another text of the same id", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id string")
    out = minhash.one_of_each_group(frame)
    assert out.columns == frame.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:7]) for r in out.collect()) == sorted([("1", "word0 w"), ("5", "alone"), ("6", ""), ("None", "word0 w"), ("1", "another")])
