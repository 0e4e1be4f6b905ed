"""Approximate nearest neighbours (operator 6): a forest of random-projection trees.

Each tree splits the vectors at the median of a random projection, level by
level. Directions come from a seed and medians from a bounded sample
(``SAMPLE_ROWS``); every row is then indexed, once: its leaf in each tree beside its vector.
The depth follows from the number of rows and ``LEAF_ROWS``, up to ``DEPTH`` levels.

A query walks all trees through one shared priority queue: the cheapest open
node of any tree is opened next, where a node costs the squared distances of
the query to the planes that it had to cross on the way. Leaves are taken
until they hold ``share`` times all rows, and more than k of one tree. What a
query has opened is a set of bits, one per tree and leaf; a row is its candidate if the bit of one
of the row's leaves is set, so a row of several opened leaves is scored once, and a query
never scores more than all rows.

Rows lie in parts, the upper levels of the first tree. A query goes to the parts that
hold a row of an opened leaf, and each part gives back its best candidates by the exact inner
product on the original vectors. Parts with more rows or queries than a block are
searched block by block on separate tasks.

``share`` is a part of all rows because nothing less keeps the recall at
every size on vectors without structure; on vectors that do cluster it can be
far smaller.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite
components takes no part, as query or candidate; vectors of different length
don't meet; a row with a null id takes no part. A query never finds rows of
its own id. An id that repeats is found once, with its best score. Rows that repeat a query's id
ask together: a candidate's score is its best with any of them. Ties go
to the smaller id. Fewer candidates than k give fewer rows. Extra columns
are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.vectors import by_dimension, count_by_dimension, matrix, sample_by_dimension, usable
from docketry.session import importable, materialize

TREES = 4
#: Most levels of a tree, and the rows of a leaf at which it grows no further.
DEPTH, LEAF_ROWS = 8, 8
#: Levels of the first tree that make the parts.
PART_LEVELS = 5
#: Rows of the leaves that a query opens, as a part of all rows. A row counts in each tree here; it is scored once.
SHARE = 1.3
#: Documented bound of the sample that the trees are fitted on, per vector length.
SAMPLE_ROWS = 20_000
BLOCK = 4096
#: Queries that are scored at once.
STEP = 256


class Forest:
    """Directions and medians of all trees for one vector length. A tree's nodes are numbered level by level."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        self.depth = depth
        rng = np.random.default_rng([seed, sample.shape[1]])
        w = rng.normal(size=(trees, (1 << depth) - 1, sample.shape[1]))
        self.w = w / np.linalg.norm(w, axis=2, keepdims=True)
        self.median = np.zeros((trees, (1 << depth) - 1))
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                first = (1 << level) - 1
                own = np.einsum("nd,nd->n", sample, self.w[t, first + node])
                for k in range(first + 1):
                    if (node == k).any():
                        self.median[t, first + k] = np.median(own[node == k])
                node = node * 2 + (own > self.median[t, first + node])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows x trees) leaf numbers."""
        out = np.zeros((len(x), len(self.w)), np.int64)
        for t in range(len(self.w)):
            side = x @ self.w[t].T > self.median[t]
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = node * 2 + side[np.arange(len(x)), (1 << level) - 1 + node]
            out[:, t] = node
        return out

    def walk(self, margin: np.ndarray, filled: np.ndarray, need: float, least: int) -> np.ndarray:
        """Which leaves (trees x leaves) a query opens, in the order of the shared queue, until ``need`` rows are reached, ``least`` of them in one tree, so different ones. margin: trees x nodes."""
        inner = (1 << self.depth) - 1
        queue = [(0.0, t, 0) for t in range(len(margin))]
        opened, have, by_tree = np.zeros(filled.shape, bool), 0, [0] * len(margin)
        margin, counts = margin.tolist(), filled.tolist()
        while queue and (have < need or max(by_tree) < least):
            cost, t, node = heapq.heappop(queue)
            while node < inner:
                m = margin[t][node]
                heapq.heappush(queue, (cost + m * m, t, 2 * node + 1 + (m <= 0)))
                node = 2 * node + 1 + (m > 0)
            opened[t, node - inner] = True
            have += counts[t][node - inner]
            by_tree[t] += counts[t][node - inner]
        return opened


def _indexed(rows: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """(d, part, id, leaves, vector): each row with its leaf in every tree (two bytes each)."""
    kind = rows.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_dimension(b, "vector"):
                leaf = forests[d].leaves(x)
                part = leaf[:, 0] >> max(0, forests[d].depth - PART_LEVELS)
                took = b.take(pa.array(at))
                packed = pa.array([r.tobytes() for r in leaf.astype(np.uint16)], pa.binary())
                columns = [pa.array(np.full(len(at), d, np.int32)), pa.array(part.astype(np.int32)), took.column("id"), packed, took.column("vector")]
                yield pa.RecordBatch.from_arrays(columns, ["d", "part", "id", "leaves", "vector"])

    return rows.select("id", "vector").mapInArrow(run, f"d int, part int, id bigint, leaves binary, vector {kind}")


def _leaves(column: pa.Array | pa.ChunkedArray, trees: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, trees).astype(np.int64)


def _filled(index: DataFrame, forests: dict[int, Forest], trees: int) -> dict[int, np.ndarray]:
    """Rows by vector length: parts x trees x leaves, numbers of a size fixed by the forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                d, part, leaf = np.repeat(b.column(0).to_numpy(), trees), np.repeat(b.column(1).to_numpy(), trees), _leaves(b.column(2), trees).ravel()
                tree = np.tile(np.arange(trees), len(b))
                rows, n = np.unique(np.stack([d, part, tree, leaf], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in rows.T), pa.array(n.astype(np.int64))], ["d", "part", "tree", "leaf", "n"])

    counted = index.select("d", "part", "leaves").mapInArrow(run, "d int, part int, tree int, leaf int, n bigint")
    counted = counted.groupBy("d", "part", "tree", "leaf").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    out = {d: np.zeros((1 << min(f.depth, PART_LEVELS), trees, 1 << f.depth), np.int64) for d, f in forests.items()}
    for d, part, tree, leaf, n in zip(*counted.values(), strict=True):
        out[d][part, tree, leaf] = n
    return out


def _visits(queries: DataFrame, forests: dict[int, Forest], filled: dict[int, np.ndarray], share: float, k: int) -> DataFrame:
    """(d, part, id, leaves, vector): each query in the parts that it visits; leaves are the bits of what it has opened."""
    kind = queries.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_dimension(b, "vector"):
                f, held = forests[d], filled[d]
                counts = held.sum(0)
                rows = int(counts[0].sum())
                row, part, bits = [], [], []
                for first in range(0, len(at), STEP):
                    for q, m in zip(at[first : first + STEP].tolist(), np.einsum("qd,tnd->qtn", x[first : first + STEP], f.w, optimize=True) - f.median, strict=True):
                        opened = f.walk(m, counts, share * rows, min(rows, k + 1))
                        goes = np.flatnonzero((held * opened).any((1, 2)))
                        row += [q] * len(goes)
                        part.append(goes)
                        bits += [np.packbits(opened).tobytes()] * len(goes)
                took = b.take(pa.array(row, pa.int64()))
                columns = [pa.array(np.full(len(row), d, np.int32)), pa.array(np.concatenate(part).astype(np.int32)), took.column("id"), pa.array(bits, pa.binary()), took.column("vector")]
                yield pa.RecordBatch.from_arrays(columns, ["d", "part", "id", "leaves", "vector"])

    return queries.select("id", "vector").mapInArrow(run, f"d int, part int, id bigint, leaves binary, vector {kind}")


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, each id once with its best score, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], scores[first]


def _best_of(q: np.ndarray, rough: np.ndarray, rows: np.ndarray, ids: np.ndarray, slack: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A query's k best of candidate rows. The exact score is a sum over each row alone, so equal vectors score equally wherever they are."""
    m = min(k, len(rough))
    if m:
        near = rough >= np.partition(rough, len(rough) - m)[len(rough) - m] - slack
        i, s = _top(ids[near], (rows[near] * q).sum(1), k)
        if len(i) == m:
            return i, s
    return _top(ids, (rows * q).sum(1), k)  # ids that repeat took places


def nearest(
    rows: DataFrame, is_query: Column, *, k: int = 20, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, depth: int = DEPTH, share: float = SHARE, seed: int = 5
) -> DataFrame:
    """(query_id, rank, id, score): for each row that ``is_query`` its k nearest found."""
    importable(rows.sparkSession)
    table = rows.where(is_query.isNotNull() & usable(vector) & F.col(key).isNotNull())
    base = table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    asked = table.where(is_query).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    have = count_by_dimension(base, "vector")
    levels = {d: min(depth, max(1, int(math.log2(max(2, n / LEAF_ROWS))))) for d, n in have.items()}
    forests = {d: Forest(x, trees, levels[d], seed) for d, x in sample_by_dimension(base, "id", "vector", SAMPLE_ROWS, "forest", have).items()}
    index = materialize(_indexed(base, forests), "leaf-rows")
    filled = _filled(index, forests, trees)
    visits = materialize(_visits(asked, forests, filled, share, k), "visits")
    held = [(d, p, int(-(-n // BLOCK))) for d, x in filled.items() for p, n in enumerate(x[:, 0].sum(1).tolist()) if n]
    blocks = rows.sparkSession.createDataFrame(held, "d int, part int, blocks int")
    per_part = visits.groupBy("d", "part").agg(F.ceil(F.count("id") / F.lit(float(BLOCK))).cast("int").alias("query_blocks"))
    # Both tables have a row per part: a size fixed by the forest.
    sized = F.broadcast(blocks.join(per_part, ["d", "part"]))
    draw = F.xxhash64(F.lit("block"), "id")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    own = index.join(sized, ["d", "part"])
    own = own.select("d", "part", F.pmod(draw, "blocks").cast("int").alias("rb"), every("query_blocks").alias("qb"), F.lit(False).alias("asks"), "id", "leaves", "vector")
    asks = visits.join(sized, ["d", "part"])
    asks = asks.select("d", "part", every("blocks").alias("rb"), F.pmod(draw, "query_blocks").cast("int").alias("qb"), F.lit(True).alias("asks"), "id", "leaves", "vector")

    def rerank(part: pa.Table) -> pa.Table:
        asking = part.column("asks").to_numpy(zero_copy_only=False)
        ids, x, said = part.column("id").to_numpy(), matrix(part.column("vector")), part.column("leaves").combine_chunks()
        qid, q, cid, cand = ids[asking], x[asking], ids[~asking], x[~asking]
        leaf = _leaves(said.filter(pa.array(~asking)), trees)
        bits = np.frombuffer(b"".join(said.filter(pa.array(asking)).to_pylist()), np.uint8).reshape(len(qid), -1) if len(qid) else np.zeros((0, 1), np.uint8)
        far = np.sqrt((cand * cand).sum(1)).max(initial=0.0)
        out_i, out_s = [], []
        for first in range(0, len(q), STEP):
            some = slice(first, first + STEP)
            opened = np.unpackbits(bits[some], axis=1)[:, : trees << levels[q.shape[1]]].reshape(len(qid[some]), trees, -1).astype(bool)
            candidate = np.zeros((len(qid[some]), len(cid)), bool)
            for t in range(trees):
                candidate |= opened[:, t][:, leaf[:, t]]
            candidate &= qid[some][:, None] != cid[None, :]
            for v, r, c in zip(q[some], q[some] @ cand.T, candidate, strict=True):
                # What the product of matrices may differ by is far below this.
                i, s = _best_of(v, r[c], cand[c], cid[c], 1e-12 * float(np.sqrt((v * v).sum())) * far, k)
                out_i.append(i)
                out_s.append(s)
        return pa.table({"query_id": pa.array(qid, pa.int64()), "ids": pa.array(out_i, pa.list_(pa.int64())), "scores": pa.array(out_s, pa.list_(pa.float64()))})

    def best(part: pa.Table) -> pa.Table:
        ids = part.column("ids").combine_chunks().flatten().to_numpy()
        scores = part.column("scores").combine_chunks().flatten().to_numpy()
        i, s = _top(ids, scores, k)
        return pa.table({"query_id": pa.array([part.column("query_id")[0].as_py()] * len(i), pa.int64()), "rank": pa.array(np.arange(1, len(i) + 1, dtype=np.int32)), "id": pa.array(i), "score": pa.array(s)})

    found = own.unionByName(asks).groupBy("d", "part", "rb", "qb").applyInArrow(rerank, "query_id bigint, ids array<bigint>, scores array<double>")
    return found.groupBy("query_id").applyInArrow(best, "query_id bigint, rank int, id bigint, score double")
