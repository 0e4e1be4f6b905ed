"""Hard negatives: for each anchor and positive, the rows of other labels whose score lies in a window below the positive's.

Anchors and rows are dealt to blocks of bounded size, and each pair of blocks
meets in one task, where integer tiles are multiplied by Strassen's recursion.
Two rounds: an anchor's positives come from the blocks of its own label, then
its windows are filled from the blocks of all rows. What leaves a task is an
anchor's best few of that block, in a heap that merges with those of others.

Cases: rows without an id, label or vector, or with a null or non-finite
component, take no part. Vectors of different lengths don't meet. Equal scores
go to the smaller id. A repeated row is a row of its own: it may be a positive
of its copy, and each copy of an anchor gives its own results. Empty tables
give an empty result. A score that doesn't fit a long raises an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.session import importable, materialize

#: Rows of a side that meet in one task, and rows and columns of a tile inside it.
BLOCK, TILE_ROWS, TILE_COLUMNS = 8192, 512, 4096
#: Strassen's recursion ends at this length of a side.
LEAF = 16
#: Labels of more than a block that are sent to all tasks; with more of them their table is joined by shuffling.
MOST_SENT = 100_000


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A plain product. Doubles hold all its integers where none passes 2^53; else it is multiplied as int64."""
    if a.size and b.size and a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max()) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices by seven half-size products a level; odd sides get a row or column of zeros.

    Additions wrap at 2^64 as int64 does, so every product that fits a long is exact whatever its parts were.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _leaf(a, b)
    a, b = np.pad(a, ((0, m & 1), (0, k & 1))), np.pad(b, ((0, k & 1), (0, n & 1)))
    r, s, t = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    c = np.zeros((2 * r, 2 * t), np.int64)
    c11, c12, c21, c22 = c[:r, :t], c[:r, t:], c[r:, :t], c[r:, t:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11 += p
    c22 += p
    p = strassen(a21 + a22, b11, leaf)
    c21 += p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12 += p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return c[:m, :n]


class Heaps:
    """The best ``k`` (score, id, key) of each slot: higher scores first, then smaller ids. Merging is associative."""

    def __init__(self, k: int):
        self.k = k
        self.slot, self.score, self.id, self.key = (np.zeros(0, np.int64) for _ in range(4))

    def merge(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, key: np.ndarray) -> None:
        slot, score, ids, key = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids), (self.key, key)))
        order = np.lexsort((key, ids, -score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, slot)
        best = np.arange(len(slot)) - first < self.k
        order = order[best]
        self.slot, self.score, self.id, self.key = slot[best], score[order], ids[order], key[order]


def _best(heaps: Heaps, slots: np.ndarray, scores: np.ndarray, ok: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
    """Merge each row's best allowed entries of a tile into its slot. Columns come in ascending order of (id, key)."""
    k = min(heaps.k, scores.shape[1])
    low = np.iinfo(np.int64).min
    value = np.where(ok, scores, low)
    least = np.partition(value, value.shape[1] - k, axis=1)[:, -k, None]
    hit = ok & (value >= least)
    row, column = np.nonzero(hit)
    # Of those that equal the k-th, only the first ones can count: columns ascend by id.
    tie = value[row, column] == least[row, 0]
    nth = np.cumsum(tie) - tie
    start = np.searchsorted(row, row)
    keep = ~tie | (nth - nth[start] < heaps.k)
    row, column = row[keep], column[keep]
    heaps.merge(slots[row], value[row, column], ids[column], keys[column])


def _matrices(table: pa.Table, vector: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, int64 matrix) for each length of vector."""
    column = table.column(vector).combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        out.append((rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(rows), d)))
    return out


def _check(x: np.ndarray) -> None:
    if x.size and x.shape[1] * max(int(x.max()), -int(x.min())) ** 2 >= 2**63:
        raise ValueError("scores of these vectors don't fit a long")


def _ints(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy().astype(np.int64, copy=False) for n in names]


def _positives(table: pa.Table, k: int) -> pa.Table:
    """A block's best rows of an anchor's own label."""
    ids, keys, label = _ints(table, "id", "r", "label")
    side = table.column("side").to_numpy(zero_copy_only=False)
    heaps = Heaps(k)
    for rows, x in _matrices(table, "x"):
        _check(x)
        order = np.lexsort((keys[rows], ids[rows], label[rows]))
        rows, x = rows[order], x[order]
        cuts = [0, *(np.flatnonzero(np.diff(label[rows])) + 1).tolist(), len(rows)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own = side[rows[lo:hi]]
            a, c = lo + np.flatnonzero(own), lo + np.flatnonzero(~own)
            for i in range(0, len(a), TILE_ROWS):
                some = a[i : i + TILE_ROWS]
                for j in range(0, len(c), TILE_COLUMNS):
                    near = c[j : j + TILE_COLUMNS]
                    other = keys[rows[some]][:, None] != keys[rows[near]][None, :]
                    _best(heaps, keys[rows[some]], strassen(x[some], np.ascontiguousarray(x[near].T)), other, ids[rows[near]], keys[rows[near]])
    return pa.table({"a": heaps.slot, "id": heaps.id, "r": heaps.key, "score": heaps.score})


def _windows(table: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """A block's best rows of other labels in the windows of each anchor's positives; ``n`` numbers an anchor's positives."""
    ids, keys, label = _ints(table, "id", "r", "label")
    side = table.column("side").to_numpy(zero_copy_only=False)
    scores = table.column("scores").to_pylist()
    most = max((len(s) for s in scores if s), default=0)
    heaps = Heaps(k)
    for rows, x in _matrices(table, "x"):
        _check(x)
        order = np.lexsort((keys[rows], ids[rows]))
        rows, x = rows[order], x[order]
        own = side[rows]
        a, c = np.flatnonzero(own), np.flatnonzero(~own)
        for i in range(0, len(a), TILE_ROWS):
            some = a[i : i + TILE_ROWS]
            # Whole scores s with low * p <= 100 * s <= high * p, in Python's integers; an anchor with fewer positives has empty windows.
            ends = np.full((2, most, len(some)), 0, np.int64)
            ends[0] = 1
            for at, row in enumerate(rows[some].tolist()):
                for n, p in enumerate(scores[row]):
                    ends[:, n, at] = -(-low * p // 100), high * p // 100
            for j in range(0, len(c), TILE_COLUMNS):
                near = c[j : j + TILE_COLUMNS]
                product = strassen(x[some], np.ascontiguousarray(x[near].T))
                other = label[rows[some]][:, None] != label[rows[near]][None, :]
                for n in range(most):
                    ok = other & (product >= ends[0, n][:, None]) & (product <= ends[1, n][:, None])
                    with_any = np.flatnonzero(ok.any(1))
                    if len(with_any):
                        _best(heaps, keys[rows[some]][with_any] * most + n, product[with_any], ok[with_any], ids[rows[near]], keys[rows[near]])
    most = max(most, 1)
    return pa.table({"a": heaps.slot // most, "n": heaps.slot % most, "id": heaps.id, "r": heaps.key, "score": heaps.score})


def _dealt(anchors: DataFrame, rows: DataFrame, home: list[str]) -> DataFrame:
    """Both sides in pairs of blocks (*home, ab, cb). Each side has its numbers of blocks in ``ka`` (anchors) and ``kc`` (rows)."""
    draw = F.xxhash64(F.lit("block"), "r")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    a = anchors.withColumns({"ab": F.pmod(draw, "ka"), "cb": every("kc"), "side": F.lit(True)})
    c = rows.withColumns({"cb": F.pmod(draw, "kc"), "ab": every("ka"), "side": F.lit(False)})
    return a.unionByName(c, allowMissingColumns=True).drop("ka", "kc").repartition(*home, "ab", "cb")


def mine(rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id: str = "id", label: str = "label", vector: str = "x") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vector`` is an array of longs; a score is an inner product. An anchor's positives are the best other rows of its
    label; a positive's negatives are the best rows of other labels with low % to high % of its score.
    """
    spark = rows.sparkSession
    importable(spark)
    ready = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    ready = ready.where("id is not null and label is not null and x is not null and not exists(x, e -> e is null)")
    # A row's number stands in a table: a task that is run again gives the same one.
    base = materialize(ready.withColumn("r", F.monotonically_increasing_id()), "mining-rows")
    n, n_anchors = base.agg(F.count("*"), F.count_if("anchor")).first()
    blocks = lambda c: F.ceil(c / F.lit(BLOCK))
    big = materialize(base.groupBy("label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("na")).where(F.col("n") > BLOCK).select("label", blocks(F.col("n")).alias("kc"), blocks(F.greatest("na", F.lit(1))).alias("ka")), "mining-labels")
    sent = F.broadcast(big) if big.count() <= MOST_SENT else big
    # A label of less than a block shares the block of its hash with others; a larger one is its own home of several blocks.
    bucket = F.pmod(F.xxhash64("label"), F.lit(max(1, math.ceil(n / BLOCK))))
    placed = base.join(sent, "label", "left").select(
        "r", "id", "label", "x", "anchor", F.when(F.col("kc").isNull(), bucket).alias("bucket"), F.when(F.col("kc").isNotNull(), F.col("label")).alias("big"), F.coalesce("kc", F.lit(1)).alias("kc"), F.coalesce("ka", F.lit(1)).alias("ka")
    )
    found = _dealt(placed.where("anchor"), placed, ["bucket", "big"]).groupBy("bucket", "big", "ab", "cb").applyInArrow(lambda t: _positives(t, positives), "a bigint, id bigint, r bigint, score bigint")
    place = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id", "r"))
    best = found.withColumn("place", place(["a"])).where(F.col("place") <= positives)
    best = best.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("p"))  # at most ``positives``
    asking = base.where("anchor").join(best, F.col("r") == F.col("a")).select("r", "id", "label", "x", F.col("p")["id"].alias("positives"), F.col("p")["score"].alias("scores"))
    asking = materialize(asking, "mining-anchors")
    sizes = {"ka": F.lit(max(1, math.ceil(n_anchors / BLOCK))), "kc": F.lit(max(1, math.ceil(n / BLOCK)))}
    dealt = _dealt(asking.drop("positives").withColumns(sizes), base.drop("anchor").withColumns(sizes), [])
    below = dealt.groupBy("ab", "cb").applyInArrow(lambda t: _windows(t, negatives, low, high), "a bigint, n bigint, id bigint, r bigint, score bigint")
    ranked = below.withColumn("rank", place(["a", "n"])).where(F.col("rank") <= negatives).select("a", "n", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = asking.select(F.col("r").alias("a"), F.col("id").alias("anchor_id"), F.posexplode(F.arrays_zip("positives", "scores")).alias("n", "p"))
    return ranked.join(names, ["a", "n"]).select("anchor_id", F.col("p.positives").alias("positive_id"), "rank", "negative_id", F.col("p.scores").alias("positive_score"), "negative_score")
