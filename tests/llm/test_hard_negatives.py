import numpy as np
import pytest
from oracle import connect, rows
from pyspark.sql import functions as F

from docketry.llm import hard_negatives as hn
from docketry.llm.queries import OP12_SQL, op12_hard_negatives

SCHEMA = "id long, label int, x array<long>"
OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (64, 64, 64), (65, 63, 130), (1, 200, 33), (100, 0, 5), (0, 9, 9)])
def test_strassen_equals_plain_product(shape):
    m, k, n = shape
    rng = np.random.default_rng(m + k + n)
    for most in (300, 2**26, 2**40):
        a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (k, n))
        # int64 wraps at 2^64; so does the plain product.
        assert (hn.strassen(a, b, 4) == a @ b).all()


def test_leaf_is_exact_above_2_to_53():
    a, b = np.full((2, 3), 2**30 + 1), np.full((3, 2), 2**29 + 1)
    assert hn._leaf(a, b).tolist() == [[3 * (2**30 + 1) * (2**29 + 1)] * 2] * 2


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    slot, score, ids = rng.integers(0, 9, 400), rng.integers(0, 12, 400), rng.integers(0, 50, 400)
    want = sorted(r for s in range(9) for r in sorted(((s, -v, i, k) for k, (t, v, i) in enumerate(zip(slot.tolist(), score.tolist(), ids.tolist())) if t == s), key=lambda r: r[1:])[:3])
    for parts in (1, 7, 400):
        heaps = hn.Heaps(3)
        for p in rng.permutation(400).reshape(-1, 400 // parts) if 400 % parts == 0 else np.array_split(rng.permutation(400), parts):
            heaps.merge(slot[p], score[p], ids[p], p)
        assert sorted(zip(heaps.slot.tolist(), (-heaps.score).tolist(), heaps.id.tolist(), heaps.key.tolist())) == want


def brute(data, positives=5, negatives=3, low=50, high=95):
    good = [(k, i, y, x) for k, (i, y, x) in enumerate(data) if None not in (i, y, x) and None not in x]
    out = []
    for k, i, y, x in good:
        if i % 50:
            continue
        near = sorted((-sum(a * b for a, b in zip(x, v)), j, r, z) for r, j, z, v in good if r != k and len(v) == len(x))
        for p, j, _, _ in [n for n in near if n[3] == y][:positives]:
            inside = [n for n in near if n[3] != y and -low * p <= -100 * n[0] <= -high * p]
            out += [(i, j, rank, n[1], -p, -n[0]) for rank, n in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(spark, data):
    found = hn.mine(spark.createDataFrame(data, SCHEMA), F.col("id") % 50 == 0)
    assert found.columns == OUT
    return sorted(tuple(r) for r in found.collect())


def test_equals_brute_force_with_ties_repeats_and_a_hot_label(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(k, int(rng.integers(0, 4)) if k % 3 else 9, rng.integers(-9, 30, 12).tolist()) for k in range(400)]
    data += [(1000 + k, 9 if k % 2 else 1, data[50][2]) for k in range(60)] + [data[50], data[50], data[100], (50, 2, data[7][2])]
    data += [(None, 1, [1] * 12), (150, None, [1] * 12), (250, 1, None), (350, 1, [None] * 12), (450, 1, [4, 5]), (500, 1, []), (550, 2, []), (600, 1, [3, 4]), (601, 1, [3, 3]), (603, 2, [2, 3]), (650, 1, [0] * 12)]
    want = brute(data)
    assert len(want) > 50
    assert mined(spark, data) == want
    for name, value in (("BLOCK", 40), ("TILE_ROWS", 3), ("TILE_COLUMNS", 16), ("LEAF", 4), ("MOST_SENT", 0)):
        monkeypatch.setattr(hn, name, value)
    assert mined(spark, data) == want


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1, 2])]) == []
    assert mined(spark, [(0, 1, [1, 2]), (1, 1, [2, 2]), (2, 0, [1, 2])]) == [(0, 1, 1, 2, 6, 5)]


def test_scores_beyond_a_long_are_refused(spark):
    with pytest.raises(Exception, match="don't fit a long"):
        mined(spark, [(0, 1, [2**40]), (1, 1, [2**40])])


def test_query_equals_sql(spark, sf):
    assert rows(op12_hard_negatives(spark, sf).toPandas()) == rows(connect(sf).execute(OP12_SQL).df())
