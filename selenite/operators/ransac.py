"""Outlier masks of matched pixels: seeded hypotheses, all scored in one aggregate, the best fitted again.

``pairs``: keys, id, x, y (one image), u, v (the other). A hypothesis is a row: its pairs are
drawn by places in a hashed order, so every run draws the same, and its model comes from batched
small matrices. Models meet all pairs of their key in one join whose rows are counted before they
are shuffled; the number of hypotheses bounds them.

Defined results: pairs with nulls are outliers; a key with fewer pairs than a model needs, or without any
model, has outliers only and no model; equal counts go to the lesser error, then to the earlier hypothesis.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs that a model needs.
SIZES = {"homography": 4, "fundamental": 8}


def design(kind: str, x, y, u, v) -> list:
    """The rows of the linear system whose null vector is the model; works on arrays and on columns alike."""
    one, zero = x * 0 + 1, x * 0
    if kind == "fundamental":
        return [[u * x, u * y, u, v * x, v * y, v, x, y, one]]
    return [[x, y, one, zero, zero, zero, -u * x, -u * y, -u], [zero, zero, zero, x, y, one, -v * x, -v * y, -v]]


def conditioned(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (..., n, 2) moved and scaled to a mean distance of sqrt 2, with the matrices that do it."""
    mean = p.mean(-2, keepdims=True)
    reach = np.sqrt(((p - mean) ** 2).sum(-1)).mean(-1)
    scale = np.sqrt(2) / np.where(reach > 0, reach, 1)
    t = np.zeros((*p.shape[:-2], 3, 3))
    t[..., 0, 0] = t[..., 1, 1] = scale
    t[..., :2, 2] = -scale[..., None] * mean[..., 0, :]
    t[..., 2, 2] = 1
    return (p - mean) * scale[..., None, None], t


def unconditioned(kind: str, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Models of conditioned pixels as models of the pixels themselves, of length 1; a fundamental matrix gets rank 2."""
    if kind == "fundamental":
        u, s, w = np.linalg.svd(m)
        s[..., 2] = 0
        m = np.swapaxes(b, -1, -2) @ (u * s[..., None, :] @ w) @ a
    else:
        m = np.linalg.inv(b) @ m @ a
    return m / np.sqrt((m * m).sum((-1, -2), keepdims=True))


def fit(kind: str, samples: np.ndarray) -> np.ndarray:
    """Models (n, 9) of samples (n, pairs, 4); rows that are not finite have none."""
    p, a = conditioned(samples[..., :2])
    q, b = conditioned(samples[..., 2:])
    rows = design(kind, p[..., 0], p[..., 1], q[..., 0], q[..., 1])
    system = np.concatenate([np.stack(r, -1) for r in rows], -2)
    _, s, w = np.linalg.svd(system)
    with np.errstate(all="ignore"):
        m = unconditioned(kind, w[:, -1].reshape(-1, 3, 3), a, b).reshape(-1, 9)
    m[s[:, 7] < 1e-9 * s[:, 0]] = np.nan  # more than one solution
    return m


def error(kind: str, m: list[Column]) -> Column:
    """Squared distance of a pair from a model: to the place where it belongs, or the larger one to the epipolar lines."""
    x, y, u, v = (F.col(c) for c in "xyuv")
    line = lambda i, a, b: a * m[i] + b * m[i + 1] + m[i + 2]
    if kind == "homography":
        w = line(6, x, y)
        return F.when(w != 0, (line(0, x, y) / w - u) ** 2 + (line(3, x, y) / w - v) ** 2)
    there = [line(0, x, y), line(3, x, y), line(6, x, y)]
    back = [u * m[k] + v * m[3 + k] + m[6 + k] for k in range(3)]
    off = (u * there[0] + v * there[1] + there[2]) ** 2
    lengths = [a[0] ** 2 + a[1] ** 2 for a in (there, back)]
    return F.greatest(*(F.when(n > 0, off / n) for n in lengths))


def drawn(pairs: DataFrame, keys: Sequence[str], size: int, count: int, seed: int) -> DataFrame:
    """(keys, h, sample): ``count`` samples of ``size`` different pairs for each key, at evenly spaced places of a hashed order."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), "id"), "id", "x", "y", "u", "v")
    placed = pairs.withColumn("place", F.row_number().over(order) - 1)
    rows = pairs.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= size)
    rows = rows.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    draw = lambda k, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "h", *keys), n)
    step = 1 + draw(1, F.floor((F.col("n") - 1) / (size - 1)))
    places = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.pmod(draw(0, F.col("n")) + j * step, F.col("n")).cast("int"))
    rows = rows.select(*keys, "h", F.explode(places).alias("place")).join(placed, [*keys, "place"])
    return rows.groupBy(*keys, "h").agg(F.array_sort(F.collect_list(F.array("x", "y", "u", "v"))).alias("sample"))


def modelled(samples: DataFrame, kind: str) -> DataFrame:
    """``samples`` with ``model``, without those that have none."""
    schema = samples.drop("sample").withColumn("model", F.array(F.lit(0.0))).schema
    size = SIZES[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = fit(kind, batch.column("sample").flatten().flatten().to_numpy().reshape(-1, size, 4))
                found = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), 9).cast(pa.list_(pa.float64()))
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), found], schema.names)
                yield out.filter(pa.array(np.isfinite(m).all(1)))

    return samples.mapInArrow(run, schema)


def refitted(pairs: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """(keys, model): least squares over all ``pairs``, from sums of products of conditioned pixels."""
    stats = pairs.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in "xyuv" for n, f in (("mean", F.avg), ("dev", F.stddev_pop))))
    rows = pairs.join(stats, list(keys))
    scale = {c: F.lit(1.0) / F.when(F.col(f"dev_{c}") > 0, F.col(f"dev_{c}")).otherwise(F.lit(1.0)) for c in "xyuv"}
    at = [(F.col(c) - F.col(f"mean_{c}")) * scale[c] for c in "xyuv"]
    system = F.explode(F.array(*(F.array(*r) for r in design(kind, *at))))
    upper = [(i, j) for i in range(9) for j in range(i, 9)]
    place = [f"{n}_{c}" for c in "xyuv" for n in ("mean", "dev")]
    rows = rows.select(*keys, *place, system.alias("a"))
    sums = rows.groupBy(*keys).agg(F.array(*(F.sum(F.col("a")[i] * F.col("a")[j]) for i, j in upper)).alias("sums"), F.array(*(F.first(c) for c in place)).alias("place"))
    schema = sums.drop("sums", "place").withColumn("model", F.array(F.lit(0.0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("sums").flatten().to_numpy().reshape(-1, len(upper))
            g = np.zeros((len(flat), 9, 9))
            for k, (i, j) in enumerate(upper):
                g[:, i, j] = g[:, j, i] = flat[:, k]
            p = batch.column("place").flatten().to_numpy().reshape(-1, 4, 2)
            t = np.zeros((len(flat), 2, 3, 3))
            for side in (0, 1):
                for axis in (0, 1):
                    mean, dev = p[:, 2 * side + axis, 0], p[:, 2 * side + axis, 1]
                    dev = np.where(dev > 0, dev, 1)
                    t[:, side, axis, axis], t[:, side, axis, 2] = 1 / dev, -mean / dev
                t[:, side, 2, 2] = 1
            m = unconditioned(kind, np.linalg.eigh(g)[1][:, :, 0].reshape(-1, 3, 3), t[:, 0], t[:, 1]).reshape(-1, 9)
            found = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), 9).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), found], schema.names)

    return sums.mapInArrow(run, schema)


def consensus(
    pairs: DataFrame, keys: Sequence[str], kind: str = "homography", method: str = "ransac", threshold: float = 3.0, hypotheses: int = 256, seed: int = 7
) -> DataFrame:
    """(keys, model, limit): for each key the model that most pairs lie within ``threshold`` of (ransac), or whose median error is
    least (lmeds, with the limit that follows from it), or that fits all pairs (all)."""
    whole = pairs.select(*keys, "id", *(F.col(c).cast("double").alias(c) for c in "xyuv")).dropna(subset=list("xyuv"))
    size = SIZES[kind]
    if method == "all":
        enough = whole.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= size).select(*keys)
        return refitted(whole.join(enough, list(keys), "left_semi"), keys, kind).withColumn("limit", F.lit(float("inf")))
    models = modelled(drawn(whole, keys, size, hypotheses, seed), kind)
    e = error(kind, [F.col("model")[i] for i in range(9)])
    scored = whole.join(models, list(keys)).select(*keys, "h", "model", F.coalesce(e, F.lit(float("inf"))).alias("e"))
    if method == "ransac":
        near = F.col("e") <= threshold**2
        counts = scored.groupBy(*keys, "h").agg(F.count(F.when(near, 1)).alias("n"), F.sum(F.when(near, F.col("e"))).alias("s"))
        rank, limit = F.struct(-F.col("n"), F.col("s"), "h"), F.lit(float(threshold) ** 2)
    else:
        counts = scored.groupBy(*keys, "h").agg(F.median("e").alias("s"), F.count("*").alias("n"))
        room = 2.5 * 1.4826 * (1 + 5.0 / F.greatest(F.lit(1), F.col("n") - size)) * F.sqrt("s")
        rank, limit = F.struct(F.col("s"), "h"), F.greatest(room, F.lit(1e-3)) ** 2
    best = counts.groupBy(*keys).agg(F.min_by(F.struct("h", limit.alias("limit")), rank).alias("b")).select(*keys, "b.*")
    return best.join(models, [*keys, "h"]).select(*keys, "model", "limit")


def outlier_mask(pairs: DataFrame, keys: Sequence[str], kind: str = "homography", method: str = "ransac", **options) -> DataFrame:
    """The rows of ``pairs`` with ``inlier``."""
    models = consensus(pairs, keys, kind, method, **options)
    e = error(kind, [F.col("model")[i] for i in range(9)])
    rows = pairs.join(models, list(keys), "left").withColumn("inlier", F.coalesce(e <= F.col("limit"), F.lit(False)))
    return rows.select(*pairs.columns, "inlier")


def robust_models(masked: DataFrame, keys: Sequence[str], kind: str = "homography") -> DataFrame:
    """(keys, model): least squares over the inliers of ``outlier_mask``, for keys with enough of them."""
    rows = masked.where("inlier").select(*keys, *(F.col(c).cast("double").alias(c) for c in "xyuv"))
    enough = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= SIZES[kind]).select(*keys)
    return refitted(rows.join(enough, list(keys), "left_semi"), keys, kind)
