"""Registration: distributed sums, solved as small matrices on the driver.

Everything that grows with the data stays in Spark; what comes back is a fixed
number of sums (at most 45), a 3 x 3 matrix or a vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenite.functions import geo
from selenite.operators import matching, raster


def centroid(points: DataFrame, columns: Sequence[str]) -> DataFrame:
    return points.agg(*(F.avg(c).alias(c) for c in columns))


def mean_translation(pairs: DataFrame, rotation: np.ndarray | None = None) -> DataFrame:
    """Mean of reference minus (rotated) match over pairs with a reference (r_x, m_x, ...)."""
    m = [F.col(f"m_{c}") for c in "xyz"]
    if rotation is not None:
        m = geo.apply_matrix(rotation.tolist(), m)
    some = pairs.where("r_x is not null")
    return some.agg(*(F.avg(F.col(f"r_{c}") - v).alias(f"t_{c}") for c, v in zip("xyz", m, strict=True)))


def matching_errors(pairs: DataFrame) -> DataFrame:
    """``err``: the distance of each pair."""
    return pairs.withColumn("err", geo.norm([F.col(f"r_{c}") - F.col(f"m_{c}") for c in "xyz"]))


def cross_covariance(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The nine centred sums of reference x match, in one pass, with the number of pairs and both centres."""
    r, m = [F.col(f"r_{c}") for c in "xyz"], [F.col(f"m_{c}") for c in "xyz"]
    n = F.count("r_x")
    sums = [
        (F.sum(a * b) - F.sum(a) * F.sum(b) / n).alias(f"s_{i}{j}") for i, a in zip("xyz", r, strict=True) for j, b in zip("xyz", m, strict=True)
    ]
    return pairs.where("r_x is not null").groupBy(*keys).agg(
        n.alias("n"), *sums, *(F.avg(f"{p}_{c}").alias(f"c{p}_{c}") for p in "rm" for c in "xyz")
    )


def kabsch(covariance: np.ndarray) -> np.ndarray:
    """The rotation that carries matches onto references; never a reflection."""
    u, _, vt = np.linalg.svd(covariance)
    fix = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    return u @ fix @ vt


def solve_rigid(pairs: DataFrame, rotate: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """(R, t, pairs) with r = R m + t; the identity and no motion without pairs."""
    row = cross_covariance(pairs).first()
    if row is None or not row["n"]:
        return np.eye(3), np.zeros(3), 0
    h = np.array([[row[f"s_{i}{j}"] for j in "xyz"] for i in "xyz"])
    r = kabsch(h) if rotate and row["n"] >= 3 else np.eye(3)
    cr, cm = (np.array([row[f"c{p}_{c}"] for c in "xyz"]) for p in "rm")
    return r, cr - r @ cm, row["n"]


def iterate_closest(
    features: DataFrame, match: Callable[[DataFrame], DataFrame], most: int = 10, threshold: float = 0.01, rotate: bool = True
) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Iterative closest point over features (id, fx, fy, fz): (R, t, mean errors).

    ``match`` gives (id, r_x, r_y, r_z) for moved features. The total motion is kept as
    numbers and applied to the features as read, so the plan does not grow with the rounds.
    """
    total_r, total_t, errors = np.eye(3), np.zeros(3), []
    for _ in range(most):
        p = [F.col(f"f{c}") for c in "xyz"]
        moved = geo.rigid(p, total_r.tolist(), total_t.tolist())
        rows = features.select("id", *(v.alias(f"f{c}") for c, v in zip("xyz", moved, strict=True)))
        pairs = rows.select("id", *(F.col(f"f{c}").alias(f"m_{c}") for c in "xyz")).join(match(rows), "id")
        pairs = pairs.where("r_x is not null")
        error = matching_errors(pairs).agg(F.avg("err")).first()[0]
        if error is None:
            break
        errors.append(error)
        if error <= threshold:
            break
        r, t, _ = solve_rigid(pairs, rotate)
        total_r, total_t = r @ total_r, r @ total_t + t
    return total_r, total_t, errors


def normal_sums(rows: DataFrame, terms: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """All sums of products of two terms (a_b, a not after b): what normal equations need."""
    names = list(terms)
    sums = [F.sum(terms[a] * terms[b]).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)


def solve_affine(rows: DataFrame) -> np.ndarray:
    """The 2 x 3 affine map from (x, y) to (u, v) by least squares."""
    s = normal_sums(rows, {"x": F.col("x"), "y": F.col("y"), "e": F.lit(1.0), "u": F.col("u"), "v": F.col("v")}).first()
    a = np.array([[s["x_x"], s["x_y"], s["x_e"]], [s["x_y"], s["y_y"], s["y_e"]], [s["x_e"], s["y_e"], s["e_e"]]])
    b = np.array([[s["x_u"], s["y_u"], s["e_u"]], [s["x_v"], s["y_v"], s["e_v"]]])
    return np.stack([np.linalg.lstsq(a, v, rcond=None)[0] for v in b])


def solve_homography(rows: DataFrame) -> np.ndarray:
    """The 3 x 3 map from (x, y) to (u, v) by the direct linear transform: 45 sums and an eigenvector."""
    x, y, u, v, z, e = F.col("x"), F.col("y"), F.col("u"), F.col("v"), F.lit(0.0), F.lit(1.0)
    first = [x, y, e, z, z, z, -u * x, -u * y, -u]
    second = [z, z, z, x, y, e, -v * x, -v * y, -v]
    sums = [F.sum(first[i] * first[j] + second[i] * second[j]).alias(f"s{i}_{j}") for i in range(9) for j in range(i, 9)]
    row = rows.agg(*sums).first()
    a = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(9)] for i in range(9)])
    h = np.linalg.eigh(a)[1][:, 0].reshape(3, 3)
    return h / h[2, 2]


def moved_candidates(dem: DataFrame, rotation: np.ndarray, translation: np.ndarray, center: Sequence[float]) -> DataFrame:
    """DEM points (x, y, cx, cy, cz) turned about ``center`` and shifted; they keep their pixels."""
    p = geo.sub([F.col(f"c{c}") for c in "xyz"], [F.lit(float(v)) for v in center])
    moved = geo.rigid(p, rotation.tolist(), (np.asarray(translation, float) + np.asarray(center, float)).tolist())
    return dem.select("x", "y", *(v.alias(f"c{c}") for c, v in zip("xyz", moved, strict=True)))


def lidar_to_dem(
    features: DataFrame, dem: DataFrame, half: int, center: Sequence[float], most: int = 10, threshold: float = 0.01
) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The motion of a DEM onto lidar points (id, px, py, fx, fy, fz): (R, t, mean errors).

    Each round matches every point to the nearest DEM point of its window, under the motion so
    far, and fits a shift and a rotation to the matches; rotations are multiplied and shifts added
    up. Stops at ``threshold``, after ``most`` rounds or without a match.
    """
    rotation, translation, errors = np.eye(3), np.zeros(3), []
    while len(errors) < most and (not errors or errors[-1] > threshold):
        found = matching.window_nearest(features, moved_candidates(dem, rotation, translation, center), ["id"], half).where("cx is not null")
        pairs = features.select("id", *(F.col(f"f{c}").alias(f"r_{c}") for c in "xyz")).join(
            found.select("id", *(F.col(f"c{c}").alias(f"m_{c}") for c in "xyz")), "id"
        )
        row = cross_covariance(pairs).join(matching_errors(pairs).agg(F.avg("err").alias("err"))).first()  # one row each
        if not row or not row["n"]:
            break
        errors.append(row["err"])
        rotation = rotation @ (kabsch(np.array([[row[f"s_{i}{j}"] for j in "xyz"] for i in "xyz"])) if row["n"] >= 3 else np.eye(3))
        translation = translation + np.array([row[f"cr_{c}"] - row[f"cm_{c}"] for c in "xyz"])
    return rotation, translation, errors


def multi_start(
    features: DataFrame, candidates: DataFrame, half: int, starts: Sequence[tuple[np.ndarray, np.ndarray]], rounds: int = 10
) -> tuple[int, list[tuple[np.ndarray, np.ndarray, float]]]:
    """Closest-point iteration from several motions at once: (number of the best, (R, t, mean error) of each).

    The start is a column, so every round is one job over all of them; what comes back is one
    row a start. A start without matches keeps its motion and an infinite error; ties go to the first.
    """
    spark = features.sparkSession
    state = [(np.asarray(r, float), np.asarray(t, float), float("inf")) for r, t in starts]
    names = [f"r{i}{j}" for i in range(3) for j in range(3)] + [f"t{i}" for i in range(3)]
    schema = "start int, " + ", ".join(f"{n} double" for n in names)
    for _ in range(rounds + 1):  # the last only measures
        motions = spark.createDataFrame([(k, *map(float, r.ravel()), *map(float, t)) for k, (r, t, _) in enumerate(state)], schema)
        rows = features.join(F.broadcast(motions))  # a row for each start
        p = [F.col(f"f{c}") for c in "xyz"]
        moved = [geo.dot([F.col(f"r{i}{j}") for j in range(3)], p) + F.col(f"t{i}") for i in range(3)]
        rows = rows.select("start", "id", *(v.alias(f"f{c}") for c, v in zip("xyz", moved, strict=True)))
        rows = rows.withColumn("px", F.round("fx").cast("int")).withColumn("py", F.round("fy").cast("int"))
        found = matching.window_nearest(rows, candidates, ["start", "id"], half).where("cx is not null")
        found = found.select("start", "id", *(F.col(f"c{c}").alias(f"r_{c}") for c in "xyz"))
        pairs = found.join(rows.select("start", "id", *(F.col(f"f{c}").alias(f"m_{c}") for c in "xyz")), ["start", "id"])
        errors = {r["start"]: r["err"] for r in matching_errors(pairs).groupBy("start").agg(F.avg("err").alias("err")).collect()}
        state = [(r, t, errors.get(k, float("inf"))) for k, (r, t, _) in enumerate(state)]
        if _ == rounds:
            break
        for row in cross_covariance(pairs, ["start"]).collect():
            r, t, error = state[row["start"]]
            step = kabsch(np.array([[row[f"s_{i}{j}"] for j in "xyz"] for i in "xyz"])) if row["n"] >= 3 else np.eye(3)
            shift = np.array([row[f"cr_{c}"] for c in "xyz"]) - step @ np.array([row[f"cm_{c}"] for c in "xyz"])
            state[row["start"]] = (step @ r, step @ t + shift, error)
    return int(np.argmin([e for _, _, e in state])), state


def gauss_newton(rows: Callable[[np.ndarray], DataFrame], start: np.ndarray, steps: int = 200) -> tuple[np.ndarray, list[float]]:
    """As many parameters as ``start`` has by Gauss-Newton: 6 of an affine map, 9 of a homography.

    ``rows(m)`` gives j0 .. and the residual r; stops and reverts when the error does not fall.
    """
    now, errors, n = np.array(start, float).ravel(), [], np.size(start)
    before = now
    for _ in range(steps):
        terms = {f"j{i}": F.col(f"j{i}") for i in range(n)} | {"r": F.col("r")}
        s = normal_sums(rows(now), terms).first()
        if not s["n"]:
            now = before
            break
        error = s["r_r"] / s["n"]
        if errors and error >= errors[-1]:
            now = before
            break
        errors.append(error)
        a = np.array([[s[f"j{min(i, j)}_j{max(i, j)}"] for j in range(n)] for i in range(n)])
        b = np.array([s[f"j{i}_r"] for i in range(n)])
        before = now
        now = now + np.linalg.pinv(a, rcond=1e-14) @ b
    return now, errors


gauss_newton_affine = gauss_newton


def image_gradients(image: DataFrame) -> DataFrame:
    """(x, y, v, gx, gy): an image with its central differences."""
    gx = raster.derivative(image, "x").withColumnRenamed("d", "gx")
    return raster.derivative(gx, "y").withColumnRenamed("d", "gy")


def alignment_rows(points: DataFrame, image: DataFrame, m: np.ndarray) -> DataFrame:
    """Derivatives j0 .. and residuals r of points (px, py, value) on an image with gradients under a map of 6 or 9 parameters.

    A point takes the pixel that it falls on; points outside the image or where a map's denominator vanishes are left out.
    """
    x, y, h = F.col("px"), F.col("py"), [float(v) for v in m]
    w = x * h[6] + y * h[7] + h[8] if len(h) == 9 else F.lit(1.0)
    u, v = (x * h[0] + y * h[1] + h[2]) / w, (x * h[3] + y * h[4] + h[5]) / w
    at = points.where(w != 0).select("px", "py", "value", w.alias("w"), u.alias("u"), v.alias("t"), F.round(u).cast("int").alias("x"), F.round(v).cast("int").alias("y"))
    seen = at.join(image, ["x", "y"])
    gx, gy, w = F.col("gx"), F.col("gy"), F.col("w")
    parts = [g * c / w for g in (gx, gy) for c in (x, y, F.lit(1.0))]
    if len(h) == 9:
        pull = -(gx * F.col("u") + gy * F.col("t")) / w
        parts += [pull * x, pull * y, pull]
    return seen.select(*(c.alias(f"j{i}") for i, c in enumerate(parts)), (F.col("value") - F.col("v")).alias("r"))


def coarse_to_fine(points: DataFrame, image: DataFrame, start: np.ndarray, zooms: Sequence[int] = (8, 4, 2, 1), steps: int = 20) -> tuple[np.ndarray, list[float]]:
    """An affine map of points (px, py, value) onto an image, level by level: (2 x 3 map, the last errors).

    A level pools the image by its zoom; the map goes there and back between pixels of both sizes,
    whose centres lie at (z - 1) / 2 of the level above.
    """
    now, errors = np.vstack([np.asarray(start, float).reshape(2, 3), [0, 0, 1]]), []
    for z in zooms:
        small = image_gradients(raster.pool(image, z) if z > 1 else image.select("x", "y", "v"))
        down = np.array([[1 / z, 0, -(z - 1) / 2 / z], [0, 1 / z, -(z - 1) / 2 / z], [0, 0, 1]])
        near = points.select((F.col("px") * down[0, 0] + float(down[0, 2])).alias("px"), (F.col("py") * down[1, 1] + float(down[1, 2])).alias("py"), "value")
        level = (down @ now @ np.linalg.inv(down))[:2].ravel()
        found, errors = gauss_newton(lambda m, p=near, i=small: alignment_rows(p, i, m), level, steps)
        now = np.linalg.inv(down) @ np.vstack([found.reshape(2, 3), [0, 0, 1]]) @ down
    return now[:2], errors


def displacement_statistics(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of reference minus match, per axis."""
    d = {c: F.col(f"r_{c}") - F.col(f"m_{c}") for c in "xyz"}
    return pairs.groupBy(*keys).agg(*(f(v).alias(f"{n}_{c}") for c, v in d.items() for n, f in (("mean", F.avg), ("dev", F.stddev_pop))))


def remove_outliers(pairs: DataFrame) -> DataFrame:
    """Pairs strictly within one deviation of the mean displacement on every axis."""
    rows = pairs.join(F.broadcast(displacement_statistics(pairs)))  # one row
    ok = None
    for c in "xyz":
        near = F.abs(F.col(f"r_{c}") - F.col(f"m_{c}") - F.col(f"mean_{c}")) < F.col(f"dev_{c}")
        ok = near if ok is None else ok & near
    return rows.where(ok).select(*pairs.columns)


def weighted_translation(pairs: DataFrame, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    w = F.col(weight)
    return pairs.groupBy(*keys).agg(*((F.sum(w * (F.col(f"r_{c}") - F.col(f"m_{c}"))) / F.sum(w)).alias(f"t_{c}") for c in "xyz"))


#: Poses that are multiplied together at once.
BLOCK = 4096


def running_products(group: np.ndarray, motions: np.ndarray) -> np.ndarray:
    """Products of 4 x 4 motions from the start of each run of equal ``group`` on, by doubling the reach."""
    out = motions.copy()
    starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
    first = np.repeat(starts, np.diff([*starts, len(group)]))
    reach = 1
    while reach < len(out):
        rows = np.arange(reach, len(out))
        rows = rows[rows - reach >= first[rows]]
        if not len(rows):
            break
        out[rows] = out[rows - reach] @ out[rows]
        reach *= 2
    return out


def motions(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """4 x 4 motions of rotations and translations, in rows or flat."""
    r, t = np.reshape(r, (-1, 3, 3)), np.reshape(t, (-1, 3))
    out = np.zeros((len(r), 4, 4))
    out[:, :3, :3], out[:, :3, 3], out[:, 3, 3] = r, t, 1
    return out


def global_poses(poses: DataFrame, keys: Sequence[str], order: str, rotation: str, translation: str, folder: str) -> DataFrame:
    """(keys, order, n, r, t): Rg = Rp Rr, Tg = Rp Tr + Tp down each sequence; ``n`` counts the poses so far.

    Poses are dealt out by ranges of (keys, order), so that a long sequence spreads over many tasks. Each
    task multiplies its stretch, a block at a time; the stretches' products, one row a task and
    sequence end, are multiplied in turn and go in front. Poses with nulls are passed over; equal orders are taken in
    the order of their values. ``folder`` (new, shared): the stretches are written there, so that the ranges stay as they are if an executor is lost.
    """
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    rows = poses.where(F.col(rotation).isNotNull() & F.col(translation).isNotNull())
    rows = rows.select(*named, F.col(order).alias("o"), F.col(rotation).alias("r"), F.col(translation).alias("t"))
    own = [f"k{i}" for i in range(len(keys))]
    sequence = F.xxhash64(F.lit(0), *own)
    rows = rows.withColumn("sequence", sequence).repartitionByRange("sequence", *own, "o").sortWithinPartitions("sequence", *own, "o", "r", "t")
    rows = rows.withColumn("part", F.spark_partition_id())
    schema = T.StructType([*rows.schema, T.StructField("n", T.LongType())])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried, n = None, np.eye(4), 0
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                of = [batch.column(c).to_pylist() for c in own]
                of = list(zip(*of, strict=True)) if own else [()] * batch.num_rows
                changed = np.array([a != b for a, b in zip(of, [last, *of[:-1]], strict=True)])
                group = np.cumsum(changed)
                flat = lambda c: batch.column(c).flatten().to_numpy().astype(float)
                m = motions(flat("r"), flat("t"))
                if not changed[0]:
                    m[0] = carried @ m[0]
                m = running_products(group, m)
                place = np.arange(len(m))
                count = place + 1 - np.maximum.accumulate(np.where(changed, place, -n))
                last, carried, n = of[-1], m[-1], int(count[-1])
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), k).cast(pa.list_(pa.float64())) for v, k in ((m[:, :3, :3], 9), (m[:, :3, 3], 3))]
                columns = [batch.column(c) if c not in "rt" else lists["rt".index(c)] for c in schema.names[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(count.astype(np.int64))], schema.names)

    held = rows.mapInArrow(along, schema)
    held.write.parquet(folder)
    held = poses.sparkSession.read.schema(schema).parquet(folder)
    ends = held.groupBy("part", "sequence", *own).agg(F.max(F.struct("n", "r", "t")).alias("x"))
    spread = F.count("*").over(Window.partitionBy("sequence", *own))
    ends = ends.withColumn("parts", spread).where("parts > 1").select("sequence", *own, "part", "x.n", "x.r", "x.t")

    def fronts(stretches: pa.Table) -> pa.Table:  # of one sequence, a row for each task that it spreads over
        stretches = stretches.sort_by("part")
        flat = lambda c: stretches.column(c).combine_chunks().flatten().to_numpy().astype(float)
        m = running_products(np.zeros(stretches.num_rows), motions(flat("r"), flat("t")))
        m = np.concatenate([np.eye(4)[None], m[:-1]])
        n = np.concatenate([[0], np.cumsum(stretches.column("n").to_numpy())[:-1]])
        new = {"n": pa.array(n), "r": pa.array(m[:, :3, :3].reshape(-1, 9).tolist(), pa.list_(pa.float64())), "t": pa.array(m[:, :3, 3].tolist(), pa.list_(pa.float64()))}
        return pa.table({c: new.get(c, stretches.column(c)) for c in stretches.column_names})

    front = ends.groupBy("sequence", *own).applyInArrow(fronts, ends.schema)
    front = front.select(F.col("part").alias("fpart"), *(F.col(k).alias(f"f{k}") for k in own), F.struct("n", "r", "t").alias("p"))
    same = [F.col(k).eqNullSafe(F.col(f"f{k}")) for k in own]
    out = held.join(front, [F.col("part") == F.col("fpart"), *same], "left")
    whole = F.when(F.col("p").isNull(), F.struct("n", "r", "t")).otherwise(next_pose(F.col("p"), F.struct("n", "r", "t")))
    names = [F.col(k).alias(c) for k, c in zip(own, keys, strict=True)]
    return out.select(*names, F.col("o").alias(order), whole.alias("w")).select(*keys, order, "w.n", "w.r", "w.t")


def next_pose(s: Column, p: Column) -> Column:
    """The pose (n, r, t) behind another."""
    row = lambda i: [s["r"][3 * i + k] for k in range(3)]
    r = [geo.dot(row(i), [p["r"][3 * k + j] for k in range(3)]) for i in range(3) for j in range(3)]
    t = [geo.dot(row(i), [p["t"][k] for k in range(3)]) + s["t"][i] for i in range(3)]
    return F.struct((s["n"] + p["n"]).alias("n"), F.array(*r).alias("r"), F.array(*t).alias("t"))


def compose_poses(poses: DataFrame, keys: Sequence[str], order: str, rotation: str, translation: str, folder: str) -> DataFrame:
    """(keys, n, r, t): the last global pose of each sequence."""
    every = global_poses(poses, keys, order, rotation, translation, folder)
    return every.groupBy(*keys).agg(F.max(F.struct("n", "r", "t")).alias("w")).select(*keys, "w.n", "w.r", "w.t")
