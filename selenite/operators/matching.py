"""Joins by nearness: range-binned neighbours, boxes, descriptors, candidates.

A range condition becomes an equality on bins plus a check, so the work is dealt
out by bin and never compares all with all.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenite.operators import raster


def argmin(rows: DataFrame, keys: Sequence[str], error: str, order: Sequence[str], keep: Sequence[str], positive: bool = False) -> DataFrame:
    """The row of least error for each key; ties go to the first in ``order``. With ``positive`` errors of 0 or less lose."""
    some = rows.where(F.col(error) > 0) if positive else rows
    best = F.min(F.struct(F.col(error), *order, *(c for c in keep if c not in order))).alias("_b")
    return some.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_b.{c}").alias(c) for c in dict.fromkeys([error, *order, *keep])))


def least_sum(rows: DataFrame, key: str, gaps: Sequence[tuple[Sequence[Column], Sequence[Column]]], places: int) -> DataFrame:
    """(key, cand, err): the least of all sums of two gaps, one of either list of a pair of lists, rounded; ties go to the smallest number.

    Sums are numbered by pair of lists, then first gap, then second. Adding and rounding keep the order, so the least sum holds the least gaps and
    each number is found by its own list: a row costs as many steps as there are gaps, not sums. Where gaps are null, the sum is null under number 0.
    """
    wide = len(gaps[0][0]), len(gaps[0][1])
    total = lambda a, b: F.round(a + b, places)
    found = rows.select(key, F.array(*(F.struct(F.array(*a).alias("a"), F.array(*b).alias("b")) for a, b in gaps)).alias("g"))
    found = found.select(key, "g", F.transform("g", lambda g: total(F.array_min(g["a"]), F.array_min(g["b"]))).alias("least"))
    found = found.select(key, "g", "least", F.array_min("least").alias("err"))
    first = lambda values: F.coalesce(F.array_position(values, F.col("err")) - 1, F.lit(0))
    found = found.select(key, "g", "err", first(F.col("least")).alias("i"))
    found = found.select(key, "err", "i", F.get("g", F.col("i").cast("int")).alias("g"))
    found = found.select(key, "err", "i", "g", first(F.transform("g.a", lambda a: total(a, F.array_min("g.b")))).alias("j"))
    found = found.select(key, "err", "i", "g", "j", F.get("g.a", F.col("j").cast("int")).alias("own"))
    found = found.select(key, "err", "i", "j", first(F.transform("g.b", lambda b: total(F.col("own"), b))).alias("k"))
    found = found.select(key, "err", ((F.col("i") * wide[0] + F.col("j")) * wide[1] + F.col("k")).cast("long").alias("cand"))
    return argmin(found, [key], "err", ["cand"], []).select(key, "cand", "err")


def window_nearest(features: DataFrame, candidates: DataFrame, ident: Sequence[str], half: int) -> DataFrame:
    """For each feature (px, py, fx, fy, fz) the nearest candidate (x, y, cx, cy, cz) at most ``half`` pixels away.

    Distance in three dimensions; ties go to the first row, then column. Features
    visit the bins that their window touches (at most four, as bins are as wide as a window).
    """
    bin_size = 2 * half + 1
    to_bin = lambda c: F.floor(c / bin_size)
    spread = lambda c: F.sequence(to_bin(F.col(c) - half), to_bin(F.col(c) + half))
    left = features.withColumn("_bx", F.explode(spread("px"))).withColumn("_by", F.explode(spread("py")))
    right = candidates.withColumn("_bx", to_bin(F.col("x"))).withColumn("_by", to_bin(F.col("y")))
    near = left.join(raster.dealt(right), ["_bx", "_by"]).where((F.abs(F.col("x") - F.col("px")) <= half) & (F.abs(F.col("y") - F.col("py")) <= half))
    gap = sum(((F.col(f"f{c}") - F.col(f"c{c}")) * (F.col(f"f{c}") - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0))
    best = argmin(near.withColumn("dist", F.sqrt(gap)), ident, "dist", ["y", "x"], ["cx", "cy", "cz"])
    return features.select(*ident).join(best, list(ident), "left")


def shift_errors(points: DataFrame, rows: DataFrame, thetas: Sequence[float], shifts: Sequence[float], width: int, scale: float) -> DataFrame:
    """(cand, err): the mean squared gap between points and the pixels that they meet, for every turn and pair of shifts.

    ``points``: px, py, value. ``rows``: y, v (an array along x). A candidate turns by one of ``thetas``, then moves along x and along y by
    one of ``shifts`` (at most 30, whole numbers, rising); they are numbered in that order. Pixels are multiplied by ``scale``. Points of a turn that meet
    the same pixels under all shifts are summed up before any row is met, so the work behind that grows with the image.
    """
    n = len(shifts)
    turn = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.cos(F.lit(t)).alias("c"), F.sin(F.lit(t)).alias("s")) for i, t in enumerate(thetas)))).alias("t")
    place = points.where("value is not null").select("px", "py", "value", turn)
    place = place.select("value", "t.i", (F.col("t.c") * F.col("px") - F.col("t.s") * F.col("py")).alias("u"), (F.col("t.s") * F.col("px") + F.col("t.c") * F.col("py")).alias("w"))
    base = lambda a: F.floor(a).cast("long")
    cut = lambda a, k: (F.col(a) + float(shifts[k])).cast("long")
    # cut towards 0, a place lies at its floor plus the shift, or one above: where it is below 0 or the sum rounds up
    above = lambda a: sum(((cut(a, k) - base(a) - int(shifts[k])) * (1 << k) for k in range(n)), F.lit(0)).cast("int")
    near = F.col("u").between(-1.0 - shifts[-1], width - float(shifts[0])) & (F.col("w") >= -1.0 - shifts[-1])
    key = [base("u").alias("bu"), above("u").alias("au"), base("w").alias("bw"), above("w").alias("aw")]
    sums = place.where(near).select("i", *key, "value").groupBy("i", "bu", "au", "bw", "aw")
    sums = sums.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    at = lambda b, a: F.array(*(F.struct(F.lit(k).alias("k"), (F.col(b) + int(shifts[k]) + F.shiftright(a, k).bitwiseAND(F.lit(1))).alias("at")) for k in range(n)))
    down = sums.select("*", F.explode(at("bw", "aw")).alias("d")).select("i", "bu", "au", "n", "mean", "var", F.col("d.k").alias("k"), F.col("d.at").alias("y"))
    met = down.where("y >= 0").join(rows.select(F.col("y").cast("long").alias("y"), "v"), "y")
    met = met.select("*", F.explode(at("bu", "au")).alias("a")).where(F.col("a.at").between(0, width - 1))
    pixel = F.get("v", F.col("a.at").cast("int")).cast("double")
    seen = met.select(((F.col("i") * n + F.col("a.k")) * n + F.col("k")).cast("long").alias("cand"), "n", "mean", "var", pixel.alias("pixel")).where("pixel is not null")
    gap = F.col("n") * (F.col("var") + F.pow(F.col("mean") - F.col("pixel") * scale, 2))
    return seen.groupBy("cand").agg((F.sum(gap) / F.sum("n")).alias("err"))


def overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Boxes (low x, high x, low y, high y) that share a point, borders included."""
    return (a[0] <= b[1]) & (b[0] <= a[1]) & (a[2] <= b[3]) & (b[2] <= a[3])


SHAPE = ("x0", "x1", "y0", "y1")


def shape_pairs(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """(l_x0 .. l_y1, r_x0 .. r_y1): the distinct boxes of either side that overlap, each pair once: equality on grid cells, then the check.

    A pair is reported by the cell of the lower corner of its intersection only. Boxes of one shape are one here, so a cell holds no more rows than there are shapes.
    """
    to_cell = lambda c: F.floor(c / cell).cast("long")
    cells = lambda a, b: F.sequence(to_cell(F.col(a)), to_cell(F.col(b)))

    def dealt(boxes: DataFrame, name: str) -> DataFrame:
        rows = boxes.select(*(F.col(c).alias(f"{name}_{c}") for c in SHAPE)).distinct()
        rows = rows.withColumn("_cx", F.explode(cells(f"{name}_x0", f"{name}_x1")))
        return rows.withColumn("_cy", F.explode(cells(f"{name}_y0", f"{name}_y1")))

    rows = raster.dealt(dealt(left, "l")).join(dealt(right, "r"), ["_cx", "_cy"])
    box = lambda n: [F.col(f"{n}_{c}") for c in SHAPE]
    own = (F.col("_cx") == to_cell(F.greatest("l_x0", "r_x0"))) & (F.col("_cy") == to_cell(F.greatest("l_y0", "r_y0")))
    return rows.where(overlap(box("l"), box("r")) & own).select(*box("l"), *box("r"))


def box_join(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes (l_id / r_id, x0, x1, y0, y1) that overlap, each once: shapes that overlap, then the boxes of either shape.

    What a task gives out is dealt by the right box's shape, not by cell.
    """
    named = lambda boxes, n: boxes.select(F.col("id").alias(f"{n}_id"), *(F.col(c).alias(f"{n}_{c}") for c in SHAPE))
    rows = raster.dealt(shape_pairs(left, right, cell))
    for n, boxes in (("l", left), ("r", right)):
        rows = raster.dealt(rows.join(named(boxes, n), [f"{n}_{c}" for c in SHAPE]))
    return rows.select("l_id", "r_id")


def overlap_flags(boxes: DataFrame, others: DataFrame, cell: float) -> DataFrame:
    """(id, overlaps): 1 for boxes that overlap any of the others, else 0; boxes of one id are one. No pair of boxes is listed, only of shapes."""
    shape = list(SHAPE)
    hit = shape_pairs(others, boxes, cell).select(*(F.col(f"r_{c}").alias(c) for c in SHAPE), F.lit(1).alias("overlaps")).distinct()
    return boxes.join(hit, shape, "left").groupBy("id").agg(F.max(F.coalesce("overlaps", F.lit(0))).alias("overlaps"))


def dense(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def k_nearest(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, step: int = 512):
    """(rows of a, rows of b, squared distance): the k rows of ``b`` nearest each of ``a``, ties to the lower id, exactly.

    A product of matrices finds all that can be among them; their distances are then worked out as they stand.
    """
    lengths = (b * b).sum(1)
    for at in range(0, len(a), step):
        part = a[at : at + step]
        own = (part * part).sum(1)
        d = own[:, None] - 2 * (part @ b.T) + lengths
        least = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(part), np.inf)
        slack = 1e-10 * (own + lengths.max())
        u, v = np.nonzero(d <= (least + slack)[:, None])
        exact = ((b[v] - part[u]) ** 2).sum(1)
        order = np.lexsort((ids[v], exact, u))
        u, v, exact = u[order], v[order], exact[order]
        kept = np.arange(len(u)) - np.searchsorted(u, u) < k  # u is sorted
        yield at + u[kept], v[kept], exact[kept]


def nearest_descriptors(queries: DataFrame, table: DataFrame, k: int = 2, block: int = 8192) -> DataFrame:
    """(q_id, t_id, rank, dist2): the k nearest descriptors of each query, exactly; ties to the lower id.

    Queries and table are dealt into blocks, every pair of blocks is one group for
    dense arithmetic in doubles, and only k rows of each query leave a group. Descriptors
    travel as they are given, once for each block of the other side.
    """

    def blocks(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        n = max(1, rows.count() // block)
        return rows.select(F.col("id").alias("id"), "desc", F.pmod(F.xxhash64("id"), F.lit(n)).alias(name)), n

    (q, nq), (t, nt) = blocks(queries, "qb"), blocks(table, "tb")
    q = q.withColumn("tb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nt - 1).cast("long"))))
    t = t.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q_id": pa.array([], pa.int64()), "t_id": pa.array([], pa.int64()), "dist2": pa.array([], pa.float64())})
        a, b = (dense(x.column("desc")) for x in (left, right))
        own, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        parts = [(own[u], ids[v], d) for u, v, d in k_nearest(a, b, ids, k)]
        return pa.table(dict(zip(("q_id", "t_id", "dist2"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    pairs = q.groupBy("qb", "tb").cogroup(t.groupBy("qb", "tb")).applyInArrow(compare, "q_id long, t_id long, dist2 double")
    best = pairs.groupBy("q_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("dist2", "t_id"))), 1, k).alias("b"))
    rows = best.select("q_id", F.posexplode("b").alias("rank", "b"))
    return rows.select("q_id", "b.t_id", (F.col("rank") + 1).alias("rank"), "b.dist2")


def ratio_test(nearest: DataFrame, ratio: float) -> DataFrame:
    """Queries whose nearest distance is at most ``ratio`` times the second."""
    two = nearest.groupBy("q_id").agg(
        F.min_by("t_id", "rank").alias("t_id"), F.min(F.when(F.col("rank") == 1, F.col("dist2"))).alias("d1"), F.min(F.when(F.col("rank") == 2, F.col("dist2"))).alias("d2")
    )
    return two.where(F.sqrt("d1") <= ratio * F.sqrt("d2")).select("q_id", "t_id", "d1", "d2")


def mutual(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest."""
    a = forward.where("rank = 1").select("q_id", "t_id", "dist2")
    b = backward.where("rank = 1").select(F.col("q_id").alias("t_id"), F.col("t_id").alias("q_id"))
    return a.join(b, ["q_id", "t_id"])


def remove_duplicates(points: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The first point on each whole pixel."""
    first = F.min(F.struct(*order, *keep)).alias("_f")
    return points.groupBy(*keys, F.col("x").cast("int").alias("px"), F.col("y").cast("int").alias("py")).agg(first).select(
        *keys, "px", "py", *(F.col(f"_f.{c}").alias(c) for c in dict.fromkeys([*order, *keep]))
    )
