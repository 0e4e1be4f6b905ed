"""MinHash near-duplicates (operator 9): signature-coordinate inverted join, confirmed on full sets.

1. Every text becomes its set of word shingles and a signature of ``k``
   minima. Equal sets are one class with a number of its own; classes go on.
2. A class is posted under its (coordinate, value) pairs, ordered
   from rare to frequent. Two signatures that agree in at least ``t`` of k
   places must share one of their first ``k - t + 1`` pairs in any common
   order, so only those are posted (prefix), and a pair of the whole corpus's
   passages, being frequent, comes last. The order uses counts in a
   fixed number of buckets, summed over all classes.
3. A posting list counts the collisions of its members' whole signatures.
   It starts at one member and takes in all that reach t with it (and whose set
   sizes allow the threshold), then all that reach t with those, and so on: who is in
   is skipped from then on, so a list of near copies of one text costs about its
   length, and only members that are still apart are counted with everybody.
   A list sends out one edge a member at most, never its pairs.
4. The edges make candidate clusters. In each, full sets are compared
   in the same way with exact intersections; true links leave as spanning edges.
5. Components of the links give the classes.

``t`` is the largest count that a linked pair misses with a chance below
1e-7 at the threshold itself; above the threshold it is far less.

No task holds an unbounded group: lists and clusters longer than a block are
dealt to blocks by a hash, with a few members (``HUBS``) in every block
to tie the blocks together. What is in different components after that is
compared block by block: all but the group's largest component with
everybody. So a pair of different blocks is left out only if its ends are linked already.

Defined cases: a null text, or one without words, has an empty set and is
linked with nothing. Fewer words than the shingle's width give one shingle.
Rows with the same id are rows of their own, each with its own text's links; a row with a
null id is linked with nothing. Ties need no rule: links depend on sets only, and the smallest
id names a class. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.arrays import NOT_SPACE, chunks, lowered, mix, shingles, word_hashes, words
from docketry.llm.components import connected
from docketry.session import importable, materialize

COORDINATES = 32
LOG2_BUCKETS = 16
LIST_BLOCK = 4096
#: Members of a cluster that meet in one task, and shingles of their sets.
CLUSTER_BLOCK = 2048
CLUSTER_SHINGLES = 4_000_000
#: About how many members of a group of several blocks stand in each of them.
HUBS = 16
#: Members that are counted with the rest of a block at once.
STEP = 32
MISS = 1e-7

_rng = np.random.default_rng(9)
_A = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, 256, dtype=np.uint64)


def least_matches(percent: int, k: int = COORDINATES, miss: float = MISS) -> int:
    """The largest t so that a pair of the threshold's similarity agrees in fewer than t of k places with a chance of at most ``miss``."""
    p, below = percent / 100, 0.0
    for t in range(k + 1):
        below += comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > miss:
            return max(1, t)
    return k


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted distinct shingle hashes of each row) by chunks."""
    for first, data, offsets in chunks(column):
        low = lowered(data)
        starts, ends, row = words(low, offsets, NOT_SPACE)
        made, at = shingles(word_hashes(low, starts, ends), row, len(offsets) - 1, width)
        yield first, [np.unique(made[at[k] : at[k + 1]]) for k in range(len(offsets) - 1)]


def signatures(docs: DataFrame, width: int, *, key: str = "doc_id", text: str = "text", k: int = COORDINATES) -> DataFrame:
    """(id, text_hash, n, set_hash, sig): size of each text's set, a 128-bit hash of it, and its k minima (empty for an empty set)."""
    import hashlib

    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, set_hash, sig = np.zeros(len(b), np.int64), [b""] * len(b), [b""] * len(b)
            for first, sets in _sets(b.column(2), width):
                size = np.array([len(x) for x in sets])
                n[first : first + len(sets)] = size
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                flat = np.concatenate([sets[r] for r in full])
                at = np.concatenate([[0], np.cumsum(size[full])])[:-1]
                rows = np.stack([(np.minimum.reduceat(flat * _A[j] + _B[j], at) >> np.uint64(32)).astype(np.uint32) for j in range(k)], 1)
                for r, s in zip(full.tolist(), rows, strict=True):
                    sig[first + r] = s.tobytes()
                    set_hash[first + r] = hashlib.blake2b(sets[r].tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(set_hash, pa.binary()), pa.array(sig, pa.binary())], ["id", "text_hash", "n", "set_hash", "sig"])

    rows = docs.select(F.col(key).cast("long").alias("id"), _text_hash(text), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, text_hash bigint, n bigint, set_hash binary, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """A binary column of equal lengths as rows of uint32."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint32).reshape(len(values), -1) if values else np.zeros((0, 1), np.uint32)


def _pairs(sig: np.ndarray) -> np.ndarray:
    """64-bit hashes of the (coordinate, value) pairs."""
    return mix(sig.astype(np.uint64) | (np.arange(1, sig.shape[1] + 1, dtype=np.uint64) << np.uint64(32)))


def _bucket_counts(reps: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << LOG2_BUCKETS, np.int64)
        for b in batches:
            if len(b):
                bucket = (_pairs(_matrix(b.column(0))) >> np.uint64(64 - LOG2_BUCKETS)).astype(np.int64)
                total += np.bincount(bucket.ravel(), minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])

    counts = np.zeros(1 << LOG2_BUCKETS, np.int64)
    summed = reps.select("sig").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2**16 rows
    counts[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return counts


def postings(reps: DataFrame, counts: np.ndarray, prefix: int) -> DataFrame:
    """(pair, node): each class under its ``prefix`` rarest pairs."""
    shared = reps.sparkSession.sparkContext.broadcast(counts)  # 2**16 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            p = _pairs(_matrix(b.column(1)))
            rank = shared.value[(p >> np.uint64(64 - LOG2_BUCKETS)).astype(np.int64)]
            chosen = np.take_along_axis(p, np.lexsort((p, rank), axis=1)[:, :prefix], 1)
            node = np.repeat(b.column(0).to_numpy(), chosen.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(chosen.ravel().view(np.int64)), pa.array(node)], ["pair", "node"])

    return reps.select("node", "sig").mapInArrow(run, "pair bigint, node bigint")


Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def spanning(m: int, near: Near) -> np.ndarray:
    """The first of its component for each of ``m`` members; near(some, others) says which of the others are near any of the some."""
    root, left = np.arange(m), np.arange(m)
    while len(left) > 1:
        first, left = left[:1], left[1:]
        at, step = first, 1  # the first alone: near copies of one text are all near to it
        while len(at) and len(left):
            hit = near(at[:step], left)
            found = left[hit]
            root[found] = first[0]
            at, left, step = np.concatenate([at[step:], found]), left[~hit], STEP
    return root


def _near_signatures(sig: np.ndarray, n: np.ndarray, t: int, percent: int) -> Near:
    columns = np.ascontiguousarray(sig.T)

    def near(some: np.ndarray, others: np.ndarray) -> np.ndarray:
        same = np.zeros((len(some), len(others)), np.uint8)
        for c in columns:
            same += c[some][:, None] == c[others][None, :]
        x, y = n[some][:, None], n[others][None, :]
        return ((same >= t) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))).any(0)

    return near


def _near_sets(sets: list[np.ndarray], percent: int) -> Near:
    size = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(flat.max()) + 1, bool)
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3  # members, their shingles one after another, where each one's begin

    def near(some: np.ndarray, others: np.ndarray) -> np.ndarray:
        if not len(held[0]) or len(others) < len(held[0]) // 2 or not np.isin(others, held[0], assume_unique=True).all():
            held[0], held[1] = others, np.concatenate([flat[start[k] : start[k + 1]] for k in others.tolist()])
            held[2] = np.concatenate([[0], np.cumsum(size[others])])[:-1]
        here = np.searchsorted(held[0], others)
        hit = np.zeros(len(others), bool)
        for k in some.tolist():
            n = size[others]
            fits = 100 * np.minimum(n, size[k]) >= percent * np.maximum(n, size[k])
            if not (fits & ~hit).any():
                continue
            mark[flat[start[k] : start[k + 1]]] = True
            common = np.add.reduceat(mark[held[1]], held[2], dtype=np.int64)[here]
            mark[flat[start[k] : start[k + 1]]] = False
            hit |= 100 * common >= percent * (n + size[k] - common)
        return hit

    return near


def _runs(rows: DataFrame, group: list[str], schema: str, compare: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """``compare`` of each run of whole groups; most groups are of a few rows, so many go at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            table = pa.Table.from_batches([b])
            table = table if rest is None else pa.concat_tables([rest, table])
            if table.num_rows:
                at = int(_starts(table, group)[-2])  # the last group may go on in the next batch
                yield compare(table.slice(0, at))
                rest = table.slice(at)
        if rest is not None:
            yield compare(rest)

    return rows.repartition(*group).sortWithinPartitions(*group, "node").mapInArrow(run, schema)


def _starts(table: pa.Table, group: list[str]) -> np.ndarray:
    """Where each run of equal ``group`` begins, and the end."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in group:
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none)) for x in (a, b)], ["a", "b"])


def _spanning_edges(node: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    root = spanning(len(node), near)
    far = np.flatnonzero(root != np.arange(len(root)))
    return node[far], node[root[far]]


def _meeting_edges(asks: np.ndarray, root: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the components (``root``) of the rows that ask and of the others that they are near to."""
    root, others, a, b = root.copy(), np.flatnonzero(~asks), [], []
    for k in np.flatnonzero(asks):
        apart = others[root[others] != root[k]]
        if len(apart):
            for r in np.unique(root[apart[near(np.array([k]), apart)]]).tolist():
                a.append(root[k])
                b.append(r)
                root[root == r] = root[k]
    return np.array(a, np.int64), np.array(b, np.int64)


def _own_block(rows: DataFrame) -> DataFrame:
    """Rows of groups of ``m`` members in ``blocks`` blocks, each with its ``block``; a few stand in all blocks of their group."""
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit("hub"), "node"), "m") < HUBS)
    own = F.pmod(F.xxhash64(F.lit("block"), "node"), "blocks")
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    return rows.withColumn("block", F.explode(F.when(hub, everywhere).otherwise(F.array(own))))


def _apart(rows: DataFrame, group: str, found: DataFrame, block: int) -> DataFrame:
    """(group, ask_block, block, asks, node, root): what is still in different components of a group, to meet.

    All but the group's largest component ask, and meet every member.
    """
    reached = rows.join(found, "node", "left").select(group, "node", "blocks", F.coalesce("root", "node").alias("root"))
    parts = reached.groupBy(group, "root").agg(F.count("node").alias("size")).groupBy(group)
    parts = parts.agg(F.max_by("root", "size").alias("largest"), (F.sum("size") - F.max("size")).alias("others"))
    parts = parts.where("others > 0").withColumn("ask_blocks", F.ceil(F.col("others") / F.lit(float(block))))
    parts = materialize(parts, "parts")
    dealt = reached.join(parts, group).withColumn("draw", F.xxhash64(F.lit("block"), "node"))

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    ask = dealt.where("root <> largest").select(
        group, F.pmod("draw", "ask_blocks").alias("ask_block"), each("blocks").alias("block"), F.lit(True).alias("asks"), "node", "root"
    )
    every = dealt.select(group, each("ask_blocks").alias("ask_block"), F.pmod("draw", "blocks").alias("block"), F.lit(False).alias("asks"), "node", "root")
    return ask.unionByName(every)


def candidate_clusters(reps: DataFrame, percent: int) -> DataFrame:
    """(node, root): components of what agrees in at least t coordinates."""
    t = least_matches(percent)
    posts = postings(reps, _bucket_counts(reps), COORDINATES - t + 1)
    # Counts are tables of their own, so they meet the rows in plain joins, whose hot keys Spark splits at run time.
    many = materialize(posts.groupBy("pair").agg(F.count("node").alias("m")).where("m > 1"), "list-lengths")
    lists = posts.join(many, "pair").withColumn("blocks", F.ceil(F.col("m") / F.lit(float(LIST_BLOCK))))
    lists = materialize(lists.select("pair", "node", "m", "blocks"), "lists")
    signed = reps.select("node", "n", "sig")

    def columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return table.column("node").to_numpy(), table.column("n").to_numpy(), _matrix(table.column("sig").combine_chunks())

    def span(table: pa.Table) -> pa.RecordBatch:
        node, n, sig = columns(table)
        cuts, out_a, out_b = _starts(table, ["pair", "block"]), [], []
        pairs = cuts[:-1][np.diff(cuts) == 2]
        enough = ((sig[pairs] == sig[pairs + 1]).sum(1) >= t) if len(pairs) else np.zeros(0, bool)
        for k in pairs[enough].tolist():
            if 100 * min(n[k], n[k + 1]) >= percent * max(n[k], n[k + 1]):
                out_a.append(node[k + 1 : k + 2])
                out_b.append(node[k : k + 1])
        long = np.flatnonzero(np.diff(cuts) > 2)
        for s, e in zip(cuts[long].tolist(), cuts[long + 1].tolist(), strict=True):
            a, b = _spanning_edges(node[s:e], _near_signatures(sig[s:e], n[s:e], t, percent))
            out_a.append(a)
            out_b.append(b)
        return _edges(out_a, out_b)

    own = _own_block(lists).join(signed, "node").select("pair", "block", "node", "n", "sig")
    found = connected(_runs(own, ["pair", "block"], "a bigint, b bigint", span))
    long = lists.where("blocks > 1")
    if long.isEmpty():
        return found

    def meet(table: pa.Table) -> pa.Table:
        node, n, sig = columns(table)
        asks, root = table.column("asks").to_numpy(zero_copy_only=False), table.column("root").to_numpy()
        return pa.table(_meeting_edges(asks, root, _near_signatures(sig, n, t, percent)), names=["a", "b"])

    again = _apart(long, "pair", found, LIST_BLOCK).join(signed, "node").groupBy("pair", "ask_block", "block")
    return connected(found.select("node", "root").union(again.applyInArrow(meet, "a bigint, b bigint")), "node", "root")


def _cluster_sets(docs: DataFrame, reps: DataFrame, candidates: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(node, cluster, m, blocks, shingles) of all classes in clusters of two or more."""
    import hashlib

    members = reps.join(candidates, "node", "left").withColumn("cluster", F.coalesce("root", "node"))
    sized = members.groupBy("cluster").agg(F.count("node").alias("m"), F.sum("n").alias("all")).where("m > 1")
    blocks = F.ceil(F.greatest(F.col("m") / F.lit(float(CLUSTER_BLOCK)), F.col("all") / F.lit(float(CLUSTER_SHINGLES))))
    members = members.join(materialize(sized.select("cluster", "m", blocks.alias("blocks")), "cluster-sizes"), "cluster")
    members = members.select("node", "cluster", "m", "blocks", "id", "text_hash", "set_hash")
    rows = docs.select(F.col(key).cast("long").alias("id"), _text_hash(text), F.col(text).cast("string").alias("text"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat id and text give their class once a task
        for b in batches:
            want, node = b.column("set_hash").to_pylist(), b.column("node").to_pylist()
            for first, sets in _sets(b.column("text"), width):
                keep, kept = [], []
                for k, x in enumerate(sets, first):
                    if node[k] not in seen and hashlib.blake2b(x.tobytes(), digest_size=16).digest() == want[k]:
                        seen.add(node[k])
                        keep.append(k)
                        kept.append(x.tobytes())
                if keep:
                    took = b.select(["node", "cluster", "m", "blocks"]).take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([*took.columns, pa.array(kept, pa.binary())], [*took.schema.names, "shingles"])

    met = members.join(rows, ["id", "text_hash"]).select("node", "cluster", "m", "blocks", "set_hash", "text")
    return met.mapInArrow(shingled, "node bigint, cluster bigint, m bigint, blocks bigint, shingles binary")


def links(docs: DataFrame, reps: DataFrame, candidates: DataFrame, width: int, percent: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, root): components of the true links inside the candidate clusters."""
    sets = materialize(_cluster_sets(docs, reps, candidates, width, key, text), "sets")

    def columns(table: pa.Table) -> tuple[np.ndarray, pa.Table, list[np.ndarray]]:
        node, first = np.unique(table.column("node").to_numpy(), return_index=True)
        table = table.take(pa.array(first)) if "asks" not in table.column_names else table
        return node, table, [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]

    def span(table: pa.Table) -> pa.Table:
        node, _, shingle = columns(table)
        return pa.Table.from_batches([_edges(*([x] for x in _spanning_edges(node, _near_sets(shingle, percent))))])

    def meet(table: pa.Table) -> pa.Table:
        _, table, shingle = columns(table)
        asks, root = table.column("asks").to_numpy(zero_copy_only=False), table.column("root").to_numpy()
        return pa.table(_meeting_edges(asks, root, _near_sets(shingle, percent)), names=["a", "b"])

    own = _own_block(sets).select("cluster", "block", "node", "shingles")
    found = connected(own.groupBy("cluster", "block").applyInArrow(span, "a bigint, b bigint"))
    long = sets.where("blocks > 1").select("cluster", "node", "blocks")
    if long.isEmpty():
        return found
    again = _apart(long, "cluster", found, CLUSTER_BLOCK).join(sets.select("node", "shingles"), "node")
    met = again.groupBy("cluster", "ask_block", "block").applyInArrow(meet, "a bigint, b bigint")
    return connected(found.select("node", "root").union(met), "node", "root")


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_hash")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, component_id, kept) per row of ``docs``; text_hash is xxhash64 of the text."""
    signed = materialize(signatures(docs, width, key=key, text=text), "signatures")
    whole = (F.col("n") > 0) & F.col("id").isNotNull()
    full = signed.where(whole)
    one = full.groupBy("set_hash").agg(F.min(F.struct("id", "text_hash")).alias("one"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # The table is written once, so the numbers stay.
    reps = materialize(one.select(F.monotonically_increasing_id().alias("node"), "one.id", "one.text_hash", "set_hash", "n", "sig"), "classes")
    found = links(docs, reps.drop("sig"), candidate_clusters(reps, percent), width, percent, key=key, text=text)
    named = reps.select("node", "id", "set_hash")
    least = named.join(found, "node").groupBy("root").agg(F.min("id").alias("low"))
    least = least.join(named.select(F.col("node").alias("root"), "id"), "root").select("root", F.least("low", "id").alias("low"))
    linked = named.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = linked.join(materialize(least, "least-ids"), "root", "left").select("set_hash", F.coalesce("low", "id").alias("component_id"))
    joined = full.select("id", "text_hash", "n", "set_hash").join(classes, "set_hash").select("id", "text_hash", "n", "component_id")
    alone = signed.where(~whole).select("id", "text_hash", "n", F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    return joined.union(alone).select("id", "text_hash", F.col("n").alias("n_shingles"), "component_id", kept)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: of each group of near copies the document with the smallest id stays; of rows that repeat id and text, one."""
    found = near_duplicates(docs.select("doc_id", "text"))
    plan = found.groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__text_hash")).agg(F.max("kept").alias("__kept"), F.count("kept").alias("__rows")).where(~F.col("__kept") | (F.col("__rows") > 1))
    hashed = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = hashed.join(plan, (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__hash") == F.col("__text_hash")), "left").where(F.coalesce("__kept", F.lit(True)))
    repeated = joined.where(F.col("__rows") > 1).dropDuplicates(["doc_id", "__hash"])
    return joined.where(F.col("__rows").isNull()).select(*docs.columns).union(repeated.select(*docs.columns))
