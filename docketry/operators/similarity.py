"""Vector matching between two sets of documents: thresholds, nearest ones, and years.

Both sides are dealt to blocks and each pair of blocks meets in one task as a
matrix product; no pair of rows is made that doesn't pass. Shuffled rows grow
with the number of blocks, not with the number of pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.session import importable

#: Rows of a side that meet in one task.
BLOCK = 4096
#: Where a task only gives sums or counts of its pairs: rows of the left and of the right side, and the blocks of a side below which it is cut further for the sake of the cores.
LEFT, RIGHT, LEAST_ROWS = 16384, 65536, 1024
#: Rows and columns of a tile inside such a task, and the neighbouring values whose counts travel as one row.
TILE, WIDTH, CHUNK = 256, 8192, 4096


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _blocks(left: DataFrame, right: DataFrame, backward: bool = False, cut: tuple[int, int] | None = None) -> DataFrame:
    """(lb, rb, left, id, year, vector) of both sides; a row goes to each block of the other side.

    backward: only pairs with the right side not later than the left are of use. Blocks then follow the years, and a row
    goes to those blocks of the other side that hold a year of use to it; rows without a year go nowhere.
    cut: how many blocks each side has, else they follow BLOCK.
    """
    cols = ["lb", "rb", "side", "id", "year", "vector"]
    draw = F.xxhash64(F.lit("block"), "id")
    if not backward:
        nl, nr = cut or (max(1, math.ceil(x.count() / BLOCK)) for x in (left, right))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        a = left.withColumns({"lb": F.pmod(draw, F.lit(nl)).cast("int"), "rb": every(nr), "side": F.lit(True)}).select(*cols)
        b = right.withColumns({"rb": F.pmod(draw, F.lit(nr)).cast("int"), "lb": every(nl), "side": F.lit(False)}).select(*cols)
        return a.union(b)
    # A row per calendar year.
    counts = [{r["year"]: r["count"] for r in x.where("year is not null").groupBy("year").count().collect()} for x in (left, right)]
    years = sorted({*counts[0], *counts[1]})
    plan, before = [], [0, 0]
    for y in years:
        n = [c.get(y, 0) for c in counts]
        # The first left block that reaches this year, and the last right block that begins by it.
        plan.append((y, before[0], n[0], before[1], n[1], before[0] // BLOCK, max(0, before[1] + n[1] - 1) // BLOCK))
        before = [p + k for p, k in zip(before, n, strict=True)]
    last = max(0, before[0] - 1) // BLOCK
    schema = "year long, l_before long, l_n long, r_before long, r_n long, l_first int, r_last int"
    table = F.broadcast(left.sparkSession.createDataFrame(plan, schema))

    def own(side: str) -> Column:
        return F.floor((F.col(f"{side}_before") + F.pmod(draw, F.col(f"{side}_n"))) / F.lit(BLOCK)).cast("int")

    a = left.join(table, "year").withColumns({"lb": own("l"), "rb": F.explode(F.sequence(F.lit(0), "r_last")), "side": F.lit(True)}).select(*cols)
    b = right.join(table, "year").where(F.col("l_first") <= last)
    b = b.withColumns({"rb": own("r"), "lb": F.explode(F.sequence("l_first", F.lit(last))), "side": F.lit(False)}).select(*cols)
    return a.union(b)


def pairs_above(left: DataFrame, right: DataFrame, threshold: float, backward: bool = False) -> DataFrame:
    """(left_id, right_id, left_year, right_year, sim) of all pairs with a dot product of at least ``threshold``; backward: right not later than left.

    Both sides are (id, year, vector).
    """
    importable(left.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy(zero_copy_only=False)
        ids, year, x = table.column("id").to_numpy(), table.column("year").to_numpy(), _matrix(table.column("vector"))
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        out = {"left_id": [], "right_id": [], "left_year": [], "right_year": [], "sim": []}
        for k in range(0, len(a), 512):
            some = a[k : k + 512]
            sim = x[some] @ x[b].T
            ok = sim >= threshold
            if backward:
                ok &= year[b][None, :] <= year[some][:, None]
            i, j = np.nonzero(ok)
            for name, v in (("left_id", ids[some][i]), ("right_id", ids[b][j]), ("left_year", year[some][i]), ("right_year", year[b][j]), ("sim", sim[i, j])):
                out[name].append(v)
        return pa.table({k: np.concatenate(v) if v else np.zeros(0, np.float64 if k == "sim" else np.int64) for k, v in out.items()})

    return _blocks(left, right, backward).groupBy("lb", "rb").applyInArrow(run, "left_id bigint, right_id bigint, left_year bigint, right_year bigint, sim double")


def matches_by_threshold(left: DataFrame, right: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, left_id, left_year, n, first, nearest): what each of ``left`` finds among ``right`` not later than itself, per threshold.

    n: matches; first: the earliest one, then the more similar, then the smaller id; nearest: the most similar, then the smaller id;
    both (id, year, sim). Each pair of blocks is reduced in its own task, so what is shuffled doesn't grow with the number of pairs.
    """
    importable(left.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy(zero_copy_only=False)
        ids, year, x = table.column("id").to_numpy(), table.column("year").to_numpy(), _matrix(table.column("vector"))
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        b = b[np.argsort(ids[b], kind="stable")]
        out: dict[str, list[np.ndarray]] = {c: [] for c in _REDUCED}
        for k in range(0, len(a) if len(b) else 0, 512):
            some = a[k : k + 512]
            sim = x[some] @ x[b].T
            place = np.round(sim, 9)
            fits = year[b][None, :] <= year[some][:, None]
            for t in thresholds:
                hit = fits & (sim >= t)
                n = hit.sum(1)
                row = np.flatnonzero(n)
                if not len(row):
                    continue
                hit, low = hit[row], place[row]
                near = np.where(hit, low, -np.inf).argmax(1)
                first_year = np.where(hit, year[b][None, :], np.iinfo(np.int64).max).min(1)
                first = np.where(hit & (year[b][None, :] == first_year[:, None]), low, -np.inf).argmax(1)
                at = np.arange(len(row))
                values = (np.full(len(row), t), ids[some][row], year[some][row], n[row], *(v for j in (first, near) for v in (ids[b][j], year[b][j], sim[row][at, j])))
                for c, v in zip(_REDUCED, values, strict=True):
                    out[c].append(v)
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.float64 if kind == "double" else np.int64) for (c, kind), v in zip(_REDUCED.items(), out.values(), strict=True)})

    each = _blocks(left, right, backward=True).groupBy("lb", "rb").applyInArrow(run, ", ".join(f"{c} {kind}" for c, kind in _REDUCED.items()))
    found = lambda p: F.struct(F.col(f"{p}_id").alias("id"), F.col(f"{p}_year").alias("year"), F.col(f"{p}_sim").alias("sim"))
    less = lambda p: -F.round(F.col(f"{p}_sim"), 9)
    return each.groupBy("threshold", "left_id", "left_year").agg(
        F.sum("n").alias("n"),
        F.min_by(found("first"), F.struct(F.col("first_year"), less("first").alias("s"), F.col("first_id"))).alias("first"),
        F.min_by(found("near"), F.struct(less("near").alias("s"), F.col("near_id"))).alias("nearest"),
    )


_REDUCED = {
    "threshold": "double", "left_id": "bigint", "left_year": "bigint", "n": "bigint",
    "first_id": "bigint", "first_year": "bigint", "first_sim": "double", "near_id": "bigint", "near_year": "bigint", "near_sim": "double",
}


def _cut(n: int, block: int, least: int) -> int:
    """How many blocks: as many as ``block`` rows ask for, or ``least`` if none gets too small."""
    return max(1, math.ceil(n / block), min(least, math.ceil(n / LEAST_ROWS)))


def _places(x: np.ndarray, y: np.ndarray, scale: int) -> np.ndarray:
    """Cosine distances of all rows of two matrices in whole steps of 1 / scale, as doubles."""
    out = x @ y.T
    np.subtract(1, out, out=out)
    out *= scale
    return np.rint(out, out=out)


def distance_counts(left: DataFrame, right: DataFrame, decimals: int, once: bool = False) -> DataFrame:
    """(part, distance, n): how many pairs have a cosine distance, rounded to ``decimals`` places, by the left side's ``part``.

    once: for a set that meets itself; only pairs whose left id is the smaller one count.

    Both sides are (id, year, vector), unit vectors; left has ``part`` too. A task counts the pairs of two large blocks, up to a
    thousand million, and gives rows of CHUNK counts; so what it holds and gives is bounded by the number of
    rounded values of a part, whatever the number of pairs.
    """
    importable(left.sparkSession)
    scale = 10**decimals

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy(zero_copy_only=False)
        ids, part, vectors = table.column("id").to_numpy(), table.column("year").to_numpy(), table.column("vector").combine_chunks()
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        out = []
        for p in np.unique(part[a]):
            own = a[part[a] == p]
            counts: dict[int, np.ndarray] = {}
            for j in range(0, len(b), WIDTH):
                there = b[j : j + WIDTH]
                y = _matrix(vectors.take(pa.array(there)))
                for k in range(0, len(own), TILE):
                    here = own[k : k + TILE]
                    place = _places(_matrix(vectors.take(pa.array(here))), y, scale).astype(np.int64)
                    place = place[ids[here][:, None] < ids[there]] if once else place.ravel()
                    if len(place):
                        _count(place, counts)
            out.append(pa.table({"part": np.full(len(counts), p, np.int64), "chunk": np.array(list(counts), np.int64), "counts": _lists(counts)}))
        return pa.concat_tables(out) if out else pa.table({"part": np.zeros(0, np.int64), "chunk": np.zeros(0, np.int64), "counts": _lists({})})

    def added(table: pa.Table) -> pa.Table:
        each = table.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, CHUNK).sum(0)
        full = np.flatnonzero(each)
        place = table.column("chunk")[0].as_py() * CHUNK + full
        return pa.table({"part": np.full(len(full), table.column("part")[0].as_py(), np.int64), "distance": place / scale, "n": each[full]})

    marked = left.select("id", F.col("part").cast("long").alias("year"), "vector")
    other = right.select("id", F.col("year").cast("long").alias("year"), "vector")
    blocks = _blocks(marked, other, cut=(_cut(marked.count(), LEFT, 4), _cut(other.count(), RIGHT, 4)))
    found = blocks.groupBy("lb", "rb").applyInArrow(run, "part bigint, chunk bigint, counts array<bigint>")
    return found.groupBy("part", "chunk").applyInArrow(added, "part bigint, distance double, n bigint")


def _count(place: np.ndarray, counts: dict[int, np.ndarray]) -> None:
    """Add the counts of whole numbers to rows of CHUNK counts."""
    low, high = int(place.min()) // CHUNK, int(place.max()) // CHUNK
    if (high - low) * CHUNK <= 4 * len(place) + 4_000_000:
        found = np.bincount(place - low * CHUNK, minlength=(high - low + 1) * CHUNK).reshape(-1, CHUNK)
        each = ((low + int(i), found[i]) for i in np.flatnonzero(found.any(1)))
    else:  # far from unit vectors
        values, n = np.unique(place, return_counts=True)
        cuts = np.unique(values // CHUNK)
        each = ((int(c), np.bincount(values[values // CHUNK == c] - c * CHUNK, n[values // CHUNK == c], CHUNK).astype(np.int64)) for c in cuts)
    for c, row in each:
        if c in counts:
            counts[c] += row
        else:
            counts[c] = row.copy()


def _lists(counts: dict[int, np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(list(counts.values())) if counts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, CHUNK, dtype=np.int32), pa.array(flat, pa.int64()))


def own_distances(rows: DataFrame, decimals: int) -> DataFrame:
    """(part, n, mean, min, max) of the cosine distances, rounded to ``decimals`` places, of all pairs of a set, by the ``part`` of the smaller id.

    ``rows`` are (id, part, vector), unit vectors. Blocks follow the ids and each two of them meet once, in a task that gives
    one row a part, with an exact sum.
    """
    importable(rows.sparkSession)
    scale = 10**decimals
    n = _cut(rows.count(), LEFT, 12)
    cuts = sorted(set(rows.select(F.col("id").cast("double").alias("id")).approxQuantile("id", [k / n for k in range(1, n)], 0.05 / n))) if n > 1 else []
    block = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    own = rows.select("id", F.col("part").cast("long").alias("part"), "vector", block.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("other"))
    own = own.withColumns({"lb": F.least("own", "other"), "rb": F.greatest("own", "other")})

    def run(table: pa.Table) -> pa.Table:
        ids, part, vectors = table.column("id").to_numpy(), table.column("part").to_numpy(), table.column("vector").combine_chunks()
        block, lb, rb = table.column("own").to_numpy(), table.column("lb")[0].as_py(), table.column("rb")[0].as_py()
        a, b = np.flatnonzero(block == lb), np.flatnonzero(block == rb)
        out = []
        for p in np.unique(part[a]):
            mine = a[part[a] == p]
            pairs, total, low, high = 0, 0, math.inf, -math.inf
            for j in range(0, len(b), WIDTH):
                there = b[j : j + WIDTH]
                y = _matrix(vectors.take(pa.array(there)))
                for k in range(0, len(mine), TILE):
                    here = mine[k : k + TILE]
                    place = _places(_matrix(vectors.take(pa.array(here))), y, scale)
                    if lb == rb:
                        place = place[ids[here][:, None] < ids[there]]
                    if place.size:
                        pairs, total = pairs + place.size, total + int(place.sum())
                        low, high = min(low, place.min()), max(high, place.max())
            if pairs:
                out.append((p, pairs, total, low / scale, high / scale))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({c: pa.array(v, k) for c, v, k in zip(("part", "n", "total", "min", "max"), cols, kinds, strict=True)})

    each = own.groupBy("lb", "rb").applyInArrow(run, "part bigint, n bigint, total bigint, min double, max double")
    total = F.sum(F.col("total").cast("decimal(20,0)")).cast("double")
    return each.groupBy("part").agg(F.sum("n").alias("n"), (total / F.sum("n") / F.lit(float(scale))).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"))


def nearest(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(left_id, rank, right_id, left_year, right_year, sim): the k nearest of ``right`` for each of ``left``, ties to the smaller id."""
    importable(left.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy(zero_copy_only=False)
        ids, year, x = table.column("id").to_numpy(), table.column("year").to_numpy(), _matrix(table.column("vector"))
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        b = b[np.argsort(ids[b], kind="stable")]
        y, most = x[b], min(k, len(b))
        far = np.sqrt((y * y).sum(1)).max(initial=0.0)
        parts = []
        for first in range(0, len(a), 256):
            for i, rough in zip(a[first : first + 256], x[a[first : first + 256]] @ y.T, strict=True):
                if not most:
                    continue
                # What ties after rounding, or what the product of matrices may have moved, is kept and scored row by row.
                slack = 2e-12 * max(1.0, far * float(np.sqrt((x[i] * x[i]).sum())))
                near = np.flatnonzero(rough >= np.partition(rough, len(rough) - most)[len(rough) - most] - slack)
                sim = np.round((y[near] * x[i]).sum(1), 12)
                top = np.argsort(-sim, kind="stable")[:k]
                parts.append((np.full(len(top), ids[i]), ids[b][near[top]], np.full(len(top), year[i]), year[b][near[top]], sim[top]))
        cols = list(zip(*parts, strict=True)) or [[np.zeros(0, np.int64)]] * 4 + [[np.zeros(0)]]
        return pa.table({n: np.concatenate(v) for n, v in zip(("left_id", "right_id", "left_year", "right_year", "sim"), cols, strict=True)})

    best = _blocks(left, right).groupBy("lb", "rb").applyInArrow(run, "left_id bigint, right_id bigint, left_year bigint, right_year bigint, sim double")
    order = Window.partitionBy("left_id").orderBy(F.desc("sim"), "right_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def real_parties(rows: DataFrame, parties: str, bodies: list[str]) -> DataFrame:
    """``rows`` with ``parties`` without the bodies that aren't parties; order and repeats stay."""
    return rows.withColumn(parties, F.filter(parties, lambda p: ~p.isin(bodies)))


def introduction_credit(candidates: DataFrame, kept: int = 3) -> DataFrame:
    """(left_id, year, party, weight): credit for what an instrument is nearest to.

    candidates: (left_id, left_year, rank, sim, right_year, parties). Of those with a party and a year not later
    than the instrument's, the first ``kept`` count; each weighs its inverse distance by the sum of theirs, and every party of it gets the
    whole weight. A party's weights for an instrument are added up and rounded to 10 places. A distance of 0 gives a null weight.
    """
    fit = candidates.where((F.size("parties") > 0) & (F.col("right_year") <= F.col("left_year")))
    top = fit.withColumn("_n", F.row_number().over(Window.partitionBy("left_id").orderBy("rank"))).where(F.col("_n") <= kept)
    inverse = F.try_divide(F.lit(1.0), 1 - F.col("sim"))
    top = top.withColumn("_i", inverse).withColumn("weight", F.try_divide("_i", F.sum("_i").over(Window.partitionBy("left_id"))))
    each = top.select("left_id", F.col("left_year").alias("year"), F.explode("parties").alias("party"), "weight")
    return each.groupBy("left_id", "year", "party").agg(F.round(F.sum("weight"), 10).alias("weight"))


def earliest_match(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Every row of ``left`` with its earliest match of at least ``threshold`` among ``right`` not later than itself; ties: more similar, then the smaller id."""
    first = matches_by_threshold(left, right, [threshold]).select("left_id", F.col("first.id").alias("right_id"), F.col("first.year").alias("right_year"), F.col("first.sim").alias("sim"))
    return left.select(F.col("id").alias("instrument"), F.col("year").alias("instrument_year")).join(first, F.col("instrument") == F.col("left_id"), "left").drop("left_id")


def available_history(left: DataFrame, right: DataFrame) -> DataFrame:
    """(instrument, available): years back to the first of ``right`` that isn't later. ``right`` is counted by year first, so years meet years."""
    years = right.select(F.col("year").alias("_y")).distinct()
    first = left.select("year").distinct().join(years, F.col("_y") <= F.col("year")).groupBy("year").agg(F.min("_y").alias("first"))
    return left.join(first, "year", "left").select(F.col("id").alias("instrument"), (F.col("year") - F.col("first")).alias("available"))


def inverse_distance_credit(candidates: DataFrame, kept: int = 3) -> DataFrame:
    """(left_id, right_id, weight): each of the first ``kept`` survivors weighs 1 / distance, the weights of an instrument add up to 1.

    candidates: survivors (left_id, right_id, rank, sim). A distance of 0 gives a null weight.
    """
    order = Window.partitionBy("left_id").orderBy("rank")
    top = candidates.withColumn("n", F.row_number().over(order)).where(F.col("n") <= kept)
    inverse = F.try_divide(F.lit(1.0), 1 - F.col("sim"))
    return top.withColumn("inverse", inverse).withColumn("weight", F.try_divide("inverse", F.sum("inverse").over(Window.partitionBy("left_id")))).drop("n", "inverse")


def chance_latency(instruments: DataFrame, papers: DataFrame) -> DataFrame:
    """(topic, chance): per topic the median over its instruments of the median years back to all papers not later.

    Papers are counted by year first, so quantiles are over (year, count).
    """
    counts = papers.groupBy(F.col("year").alias("_y")).agg(F.count("*").alias("c"))
    per_year = instruments.select("year").distinct().join(counts, F.col("_y") <= F.col("year")).groupBy("year").agg(F.percentile(F.col("year") - F.col("_y"), F.lit(0.5), F.col("c")).alias("m"))
    return instruments.where("topic <> -1").join(per_year, "year").groupBy("topic").agg(F.percentile("m", F.lit(0.5)).alias("chance"))


def threshold_sweep(left: DataFrame, right: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold: coverage, matches, lags to the earliest and to the most similar paper, history and candidates."""
    many = left.agg(F.count("*").alias("total"))
    history = available_history(left, right).withColumnRenamed("instrument", "left_id")
    per = matches_by_threshold(left, right, thresholds).join(history, "left_id")
    per = per.select("threshold", "n", "available", (F.col("left_year") - F.col("first.year")).alias("earliest"), (F.col("left_year") - F.col("nearest.year")).alias("nearest"))
    half = lambda c: F.percentile(c, F.lit(0.5))
    out = per.groupBy("threshold").agg(
        F.count("*").alias("n_covered"),
        half("earliest").alias("median_lag_earliest"),
        F.avg("earliest").alias("mean_lag_earliest"),
        half("nearest").alias("median_lag_nearest"),
        half("available").alias("median_available_history"),
        half(F.try_divide("earliest", F.nullif("available", F.lit(0)))).alias("degeneracy_ratio"),
        half("n").alias("median_candidates"),
    )
    return out.join(F.broadcast(many)).withColumn("coverage", F.col("n_covered") / F.col("total")).drop("total")  # one row
