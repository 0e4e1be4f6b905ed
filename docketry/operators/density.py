"""Density clustering: mutual reachability, a minimum spanning tree by Boruvka rounds, the condensed tree by stability.

1. Equal vectors are one node with a count. A node's core distance reaches as many rows as ``min_samples``, itself included;
   two nodes are as far apart as the largest of their distance and both core distances.
2. Every round joins each fragment by its lightest outgoing edge. The graph of nearest neighbours gives it, unless a node's
   list ends before that edge's weight; such nodes look it up among the cells of pivots that come near enough. So the tree
   is that of all pairs, and edges are ordered by (weight, smaller id, larger id), which leaves no cycles.
3. The tree's edges are merged from light to heavy in bands. In a band the fragments that its edges form are independent, and
   each is merged in one task, which holds that band's edges of one fragment and, of what was merged before, one row a
   fragment: its size, its cluster, and the sums from which stability follows. A fragment becomes a cluster at
   ``min_size`` rows; smaller ones that meet a cluster fall to it; two clusters that meet are children of a new one.
4. A cluster is flagged if it is more stable than the flagged ones below it together. A row's label is the topmost flagged
   cluster above the one that it fell to, named by its smallest id; rows without one are noise.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.neighbours import TILE, WIDE, Cells, distances, matrix, met, pair_distances, squares, with_visits
from docketry.session import forget, materialize

#: Edges of a band of the tree: what one task merges.
BAND = 500_000
#: Distances below it count as it: copies are dense, but not infinitely.
LEAST = 1e-9
NOISE = -1


def nodes_of(rows: DataFrame) -> DataFrame:
    """(id, x, n): each distinct vector of ``rows`` (id, x), under its smallest id."""
    return rows.where("id is not null and x is not null and size(x) > 0 and not exists(x, e -> e is null or isnan(e))").groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "x", "n")


def _core(near: DataFrame, nodes: DataFrame, min_samples: int) -> DataFrame:
    """(id, core, far): core distance, and the distance of the last listed neighbour (nothing unlisted is nearer)."""
    listed = near.join(nodes.select(F.col("id").alias("other"), F.col("n").alias("m")), "other").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "m"))).alias("l"))  # as many as the list is long
    step = lambda s, e: F.struct((s["rows"] + e["m"]).alias("rows"), F.when(s["rows"] < min_samples, e["distance"]).otherwise(s["core"]).alias("core"))
    reached = F.aggregate("l", F.struct(F.col("n").alias("rows"), F.lit(0.0).alias("core")), step)
    found = nodes.select("id", "n").join(listed, "id", "left").withColumn("l", F.coalesce("l", F.array().cast("array<struct<distance:double,m:bigint>>")))
    return found.select("id", reached["core"].alias("core"), F.coalesce(F.array_max("l")["distance"], F.lit(0.0)).alias("far"))


def _weight(core_a: str, core_b: str, distance: str) -> Column:
    return F.greatest(F.col(core_a), F.col(core_b), F.col(distance), F.lit(LEAST))


def _roots(hooks: DataFrame) -> DataFrame:
    """(c, root) from (c, to): each fragment points to another one; the only circles are two that chose one edge, of which the smaller is the root."""
    back = hooks.select(F.col("c").alias("to"), F.col("to").alias("c"), F.lit(True).alias("mutual"))
    now = materialize(hooks.join(back, ["c", "to"], "left").select("c", F.when(F.col("mutual") & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root")), "hooks")
    while True:
        way = now.select(F.col("c").alias("root"), F.col("root").alias("up"))
        twice = now.join(way, "root").select("c", F.col("root").alias("first"), F.col("up").alias("root")).join(way, "root")
        next_ = materialize(twice.select("c", F.col("up").alias("root"), (F.col("up") != F.col("first")).alias("moved")), "hooks")
        forget(now)
        if not next_.where("moved").limit(1).count():
            return next_.select("c", "root")
        now = next_.select("c", "root")
        now.written_to = next_.written_to


def spanning_tree(nodes: DataFrame, min_samples: int, neighbours: int) -> DataFrame:
    """(a, b, w): the minimum spanning tree of mutual reachability of ``nodes`` (id, x, n)."""
    cells = Cells(nodes)
    near = materialize(cells.nearest(neighbours), "near")
    core = materialize(_core(near, nodes, min_samples), "core")
    of = lambda name: core.select(F.col("id").alias(name), F.col("core").alias(f"core_{name}"))
    pairs = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "distance").distinct()
    graph = materialize(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", _weight("core_a", "core_b", "distance").alias("w")), "graph")
    holds = materialize(cells.table.join(core, "id").select("id", "x", "cell", "core", "far"), "cores")
    frag = materialize(nodes.select("id", F.col("id").alias("c")), "fragments")
    tree, left = [], cells.n
    while left > 1:
        label = lambda name: frag.select(F.col("id").alias(name), F.col("c").alias(f"c_{name}"))  # noqa: B023, E731
        graph = materialize(graph.join(label("a"), "a").join(label("b"), "b").where("c_a <> c_b").select("a", "b", "w", "c_a", "c_b"), "graph")
        edge = F.struct("w", "a", "b")
        sides = graph.select(F.col("c_a").alias("c"), F.col("c_b").alias("to"), edge.alias("e")).union(graph.select(F.col("c_b").alias("c"), F.col("c_a").alias("to"), edge.alias("e")))
        listed = materialize(sides.groupBy("c").agg(F.min(F.struct("e", "to")).alias("best")), "listed")
        # What no list holds is at least as far as the list's end, and as the core distance: only below the best one listed is it of use.
        most = F.coalesce(F.col("best.e.w"), F.lit(float("inf")))
        asks = holds.join(frag, "id").join(listed, "c", "left").where(F.greatest("core", "far") <= most).select("id", "x", "core", "c", most.alias("most"))
        visits = materialize(with_visits(asks, cells.centres, cells.radius, cells.group, "most"), "asks")
        looked = met(visits, holds.join(frag, "id").select("id", "x", "cell", "core", "c"), cells.counts).groupBy("visit", "ask_block", "block").applyInArrow(_lightest, "c bigint, to bigint, w double, a bigint, b bigint")
        both = listed.select("c", "best").union(looked.select("c", F.struct(F.struct("w", "a", "b").alias("e"), F.col("to")).alias("best")))
        chosen = materialize(both.groupBy("c").agg(F.min("best").alias("best")).select("c", "best.to", "best.e.*"), "chosen")
        tree.append(chosen.select("a", "b", "w").distinct())
        roots = _roots(chosen.select("c", "to"))
        frag = materialize(frag.join(roots, "c").select("id", F.col("root").alias("c")), "fragments")
        graph = graph.select("a", "b", "w")
        forget(visits)
        left = frag.select("c").distinct().count()
    out = tree[0] if tree else nodes.sparkSession.createDataFrame([], "a long, b long, w double")
    for t in tree[1:]:
        out = out.union(t)
    return out


def _weights_of_few(x: np.ndarray, y: np.ndarray, least: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Weights of all rows of two matrices, at least ``least``: of wide ones only those that may be a row's lightest but for ``same``, the rest is infinite."""
    rough, slack = squares(x, y)
    np.maximum(rough, least * least, out=rough)
    rough[same] = np.inf
    low = rough.min(1, keepdims=True)
    row, column = np.nonzero((rough <= low * (1 + 1e-12) + 2 * slack) & ~same)
    out = np.full(rough.shape, np.inf)
    out[row, column] = np.maximum(pair_distances(x, y, row, column), least[row, column])
    return out


def _lightest(table: pa.Table) -> pa.Table:
    """A block's lightest edge from each asking fragment to another one."""
    side = table.column("side").to_numpy(zero_copy_only=False)
    ids, frag, core, x = table.column("id").to_numpy(), table.column("c").to_numpy(), table.column("core").to_numpy(), matrix(table.column("x"))
    ask, hold = np.flatnonzero(side), np.flatnonzero(~side)
    hold = hold[np.argsort(ids[hold], kind="stable")]
    best: dict[int, tuple[float, int, int, int]] = {}
    held, wide = x[hold], x.shape[1] >= WIDE
    for s in range(0, len(ask) if len(hold) else 0, TILE):
        some = ask[s : s + TILE]
        least = np.maximum(np.maximum(core[some][:, None], core[hold][None, :]), LEAST)
        same = frag[some][:, None] == frag[hold][None, :]
        w = _weights_of_few(x[some], held, least, same) if wide else np.maximum(distances(x[some], held), least)
        w[same] = np.inf
        low = w.min(1)
        for k in np.flatnonzero(np.isfinite(low)).tolist():
            at = np.flatnonzero(w[k] == low[k])
            lo, hi = np.minimum(ids[some[k]], ids[hold[at]]), np.maximum(ids[some[k]], ids[hold[at]])
            j = np.lexsort((hi, lo))[0]
            found = (float(low[k]), int(lo[j]), int(hi[j]), int(frag[hold[at[j]]]))
            c = int(frag[some[k]])
            if c not in best or found < best[c]:
                best[c] = found
    values = list(best.items())
    return pa.table({"c": pa.array([c for c, _ in values], pa.int64()), "to": pa.array([v[3] for _, v in values], pa.int64()), "w": pa.array([v[0] for _, v in values], pa.float64()), "a": pa.array([v[1] for _, v in values], pa.int64()), "b": pa.array([v[2] for _, v in values], pa.int64())})


#: kind m: fragment f is now part of fragment ``to``; s: the state of fragment f; f: the rows of fragment f fall to cluster ``to`` at w; c: cluster f ends in ``to`` at w.
_EVENTS = {"kind": pa.string(), "f": pa.int64(), "to": pa.int64(), "w": pa.float64(), "size": pa.int64(), "inside": pa.float64(), "below": pa.float64(), "flagged": pa.bool_()}
_STATE = ["size", "cluster", "inside", "below"]


def merge_band(edges: dict[str, np.ndarray], state: dict[str, np.ndarray], min_size: int) -> pa.Table:
    """Merge fragments by edges (w, a, b, number e, fragments fa and fb) in the order of (w, a, b): events as in _EVENTS.

    ``state``: (f, size, cluster, has, inside, below), a row a fragment; has: whether it is in a cluster; inside: the sum over a
    cluster's rows of the density at which each leaves it; below: the stability of what is flagged below. A cluster has the
    number of the edge that made it. Everything stands in arrays, about 300 bytes an edge.
    """
    names, first = np.unique(state["f"], return_index=True)
    typed = lambda kind, values: array(kind, np.ascontiguousarray(values).tobytes())
    size, cluster, has = typed("q", state["size"][first].astype(np.int64)), typed("q", state["cluster"][first].astype(np.int64)), typed("b", state["has"][first].astype(np.int8))
    inside, below = typed("d", state["inside"][first].astype(np.float64)), typed("d", state["below"][first].astype(np.float64))
    up = typed("q", np.arange(len(names)))
    # Fragments of the band's start in one that is no cluster yet, as a chain from its root.
    after, last = typed("q", np.full(len(names), -1)), typed("q", np.arange(len(names)))
    order = np.lexsort((edges["b"], edges["a"], edges["w"]))
    ends = [typed("q", np.searchsorted(names, edges[c][order])) for c in ("fa", "fb")]
    fell, ended = [array(k) for k in "qqd"], [array(k) for k in "qqdb"]

    def root(f: int) -> int:
        while up[f] != f:
            up[f] = up[up[f]]
            f = up[f]
        return f

    def falls(f: int, to: int, w: float) -> None:
        while f >= 0:
            for column, v in zip(fell, (f, to, w), strict=True):
                column.append(v)
            f = after[f]

    # ``names`` has an end's fragment, and an edge's two ends are in different ones.
    for w, number, fa, fb in zip(typed("d", edges["w"][order]), typed("q", edges["e"][order]), *ends, strict=True):
        a, b = root(fa), root(fb)
        na, nb, density = size[a], size[b], 1 / w
        n = na + nb
        if not has[a] and not has[b]:
            after[last[a]], last[a] = b, last[b]
            if n >= min_size:
                cluster[a], has[a], inside[a], below[a] = number, 1, n * density, 0.0
                falls(a, number, w)
        elif not has[a] or not has[b]:
            small, less, c = (a, na, cluster[b]) if not has[a] else (b, nb, cluster[a])
            falls(small, c, w)
            cluster[a], has[a], inside[a], below[a] = c, 1, inside[a] + inside[b] + less * density, below[a] + below[b]
        else:
            flagged = 0.0
            for x, rows in ((a, na), (b, nb)):
                stability = inside[x] - rows * density
                flagged += max(stability, below[x])
                for column, v in zip(ended, (cluster[x], number, w, stability >= below[x]), strict=True):
                    column.append(v)
            cluster[a], inside[a], below[a] = number, n * density, flagged
        size[a], up[b] = n, a
    roots = np.array([root(f) for f in range(len(names))], np.int64)
    moved, stay = np.flatnonzero(roots != np.arange(len(names))), np.flatnonzero(roots == np.arange(len(names)))
    of = lambda column, kind: np.frombuffer(column, kind)[stay] if len(column) else np.zeros(0, kind)
    seen = lambda column, kind: np.frombuffer(column, kind) if len(column) else np.zeros(0, kind)
    parts = [
        {"kind": "f", "f": names[seen(fell[0], np.int64)], "to": seen(fell[1], np.int64), "w": seen(fell[2], np.float64)},
        {"kind": "c", "f": seen(ended[0], np.int64), "to": seen(ended[1], np.int64), "w": seen(ended[2], np.float64), "flagged": seen(ended[3], np.int8).astype(bool)},
        {"kind": "m", "f": names[moved], "to": names[roots[moved]]},
        {"kind": "s", "f": names[stay], "to": pa.array(of(cluster, np.int64), mask=of(has, np.int8) == 0), "size": of(size, np.int64), "inside": of(inside, np.float64), "below": of(below, np.float64)},
    ]
    column = lambda p, c, kind: pa.array([p["kind"]]).take(pa.array(np.zeros(len(p["f"]), np.int8))) if c == "kind" else pa.array(p[c], kind) if c in p else pa.nulls(len(p["f"]), kind)
    return pa.concat_tables([pa.table({c: column(p, c, kind) for c, kind in _EVENTS.items()}) for p in parts])


def components(edges: DataFrame) -> DataFrame:
    """(f, root) of the ends of edges (a, b): every end's neighbours go to the smallest of them, larger ones first, then smaller ones, until nothing changes."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while True:
        two = now.union(now.select("b", "a"))
        least = two.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = two.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        next_ = materialize(small, "stars")
        same = now.exceptAll(next_).limit(1).count() == 0 and next_.exceptAll(now).limit(1).count() == 0
        forget(now)
        now = next_
        if same:
            return now.select(F.col("a").alias("f"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def condensed(tree: DataFrame, nodes: DataFrame, min_size: int, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """((id, cluster, w): the cluster that each node falls to, (cluster, parent, flagged)) of a spanning tree (a, b, w) of ``nodes`` (id, x, n)."""
    spark = tree.sparkSession
    numbered = materialize(nodes.select("id", "n", F.when(F.col("n") >= min_size, -1 - F.monotonically_increasing_id()).alias("cluster")), "tree-nodes")
    heavy = F.col("cluster").isNotNull()
    state = numbered.select(F.col("id").alias("f"), F.col("n").alias("size"), "cluster", F.when(heavy, F.col("n") / F.lit(LEAST)).otherwise(0.0).alias("inside"), F.lit(0.0).alias("below"))
    fallen = [numbered.where(heavy).select("id", "cluster", F.lit(LEAST).alias("w"))]
    loose = numbered.where(~heavy).select("id", F.col("id").alias("f"))
    edges = materialize(tree.withColumn("e", F.monotonically_increasing_id()).withColumns({"fa": F.col("a"), "fb": F.col("b")}), "tree")
    total = edges.count()
    cuts = edges.stat.approxQuantile("w", [k / math.ceil(total / band) for k in range(1, math.ceil(total / band))], 0.1 * band / total) if total > band else []
    ended, lows = [], [-1.0, *sorted(set(cuts)), float("inf")]
    schema = ", ".join(f"{k} {'string' if v == pa.string() else 'bigint' if v == pa.int64() else 'double' if v == pa.float64() else 'boolean'}" for k, v in _EVENTS.items())

    def merge(table: pa.Table) -> pa.Table:
        of = lambda c: table.column(c).to_numpy()
        both = lambda c, sides="ab": np.concatenate([of(f"{c}_{side}") for side in sides])
        cluster = pa.concat_arrays([x for side in "ab" for x in table.column(f"cluster_{side}").chunks])
        state = {"f": np.concatenate([of("fa"), of("fb")]), "cluster": cluster.fill_null(0).to_numpy(), "has": cluster.is_valid().to_numpy(zero_copy_only=False), **{c: both(c) for c in ("size", "inside", "below")}}
        return merge_band({c: of(c) for c in ("w", "a", "b", "e", "fa", "fb")}, state, min_size)

    for low, high in zip(lows, lows[1:], strict=False):
        here = edges.where((F.col("w") > low) & (F.col("w") <= high))
        # All edges of one tree are one fragment.
        own = here.withColumn("root", F.lit(0)) if len(lows) == 2 else here.join(components(here.select(F.col("fa").alias("a"), F.col("fb").alias("b"))).select(F.col("f").alias("fa"), "root"), "fa")
        for side in "ab":
            own = own.join(state.select(F.col("f").alias(f"f{side}"), *(F.col(c).alias(f"{c}_{side}") for c in _STATE)), f"f{side}")
        events = materialize(own.groupBy("root").applyInArrow(merge, schema), "events")
        moved = events.where("kind = 'm'").select("f", "to")
        fell = events.where("kind = 'f'").select("f", F.col("to").alias("cluster"), "w")
        fallen.append(loose.join(fell, "f").select("id", "cluster", "w"))
        ended.append(events.where("kind = 'c'").select(F.col("f").alias("cluster"), F.col("to").alias("parent"), "flagged"))
        now = lambda rows, f: rows.join(moved.select(F.col("f").alias(f), F.col("to").alias("_to")), f, "left").withColumn(f, F.coalesce("_to", f)).drop("_to")  # noqa: B023, E731
        last = high == lows[-1]
        loose = materialize(now(loose.join(fell.select("f"), "f", "left_anti"), "f"), "loose")
        if not last:
            edges = materialize(now(now(edges.where(F.col("w") > high), "fa"), "fb").select("a", "b", "w", "e", "fa", "fb"), "tree")
        fresh = events.where("kind = 's'").select("f", "size", F.col("to").alias("cluster"), "inside", "below")
        state = materialize(state.join(events.where("kind in ('m', 's')").select("f").distinct(), "f", "left_anti").unionByName(fresh), "states")
    ended.append(state.where("cluster is not null").select("cluster", F.lit(None).cast("long").alias("parent"), F.lit(False).alias("flagged")))
    every = lambda parts: parts[0] if len(parts) == 1 else every([parts[0].unionByName(parts[1]), *parts[2:]])
    return materialize(every(fallen), "fallen"), materialize(every(ended), "clusters")


def selected(clusters: DataFrame) -> DataFrame:
    """(cluster, label): the topmost flagged cluster on the way up from each, itself included; null where none is."""
    now = materialize(clusters.select("cluster", F.coalesce("parent", "cluster").alias("up"), F.when(F.col("flagged"), F.col("cluster")).alias("label")), "ways")
    while True:
        above = now.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("label").alias("higher"))
        next_ = materialize(now.join(above, "up").select("cluster", F.col("next").alias("up"), F.coalesce("higher", "label").alias("label"), (F.col("next") != F.col("up")).alias("moved")), "ways")
        forget(now)
        now = next_
        if not now.where("moved").limit(1).count():
            return now.select("cluster", "label")


def clustered(rows: DataFrame, *, min_size: int = 5, min_samples: int = 5, neighbours: int = 15, key: str = "id", vector: str = "x") -> DataFrame:
    """(key, topic) of all rows: the smallest id of the row's cluster, or NOISE. ``key`` is a long.

    Euclidean distances; unit vectors give the order of cosines. ``neighbours`` only says how long the lists of the first
    rounds are, not what comes out. Rows without an id or a vector, or with a null or missing entry, are noise.
    """
    ready = rows.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda e: e.cast("double")).alias("x"))
    nodes = materialize(nodes_of(ready), "nodes")
    if not nodes.limit(1).count():
        return rows.select(key, F.lit(NOISE).cast("long").alias("topic"))
    tree = spanning_tree(nodes, min_samples, max(neighbours, min_samples))
    fallen, clusters = condensed(tree, nodes, min_size)
    labels = fallen.join(selected(clusters).where("label is not null"), "cluster").select("id", "label")
    names = labels.groupBy("label").agg(F.min("id").alias("topic"))
    found = nodes.join(labels.join(names, "label"), "id").select("x", "topic")
    return ready.join(found, "x", "left").select(F.col("id").alias(key), F.coalesce("topic", F.lit(NOISE)).alias("topic"))
