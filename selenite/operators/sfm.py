"""Frames and control points: chains of matches, ordinal joins, rotations, patch matches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenite.operators import graphs, matching, raster
from selenite.operators.registration import kabsch

GRID = 1e-3
NO_MATCH = 1e7


class Chains:
    """Chains of one sequence of matches, added in order; last pixels are held by cell, so a match looks at nine."""

    def __init__(self) -> None:
        self.cells: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
        self.where: list[tuple[int, int]] = []

    def add(self, x: float, y: float, u: float, v: float, first_frame: bool) -> int:
        """The chain of a match from (x, y) to (u, v)."""
        cx, cy = int(x // GRID), int(y // GRID)
        found = None
        if not first_frame:
            near = (self.cells.get((cx + a, cy + b), {}) for a in (-1, 0, 1) for b in (-1, 0, 1))
            found = min((k for c in near for k, (p, q) in c.items() if abs(p - x) + abs(q - y) < GRID), default=None)
        if found is None:
            found = len(self.where)
            self.where.append((0, 0))
        else:
            del self.cells[self.where[found]][found]
        self.where[found] = (int(u // GRID), int(v // GRID))
        self.cells.setdefault(self.where[found], {})[found] = (u, v)
        return found


def link_chains(prev: np.ndarray, now: np.ndarray, first_frame: np.ndarray) -> np.ndarray:
    """The chain of each match of a sequence, in order.

    A match continues the first chain (by number) whose last pixel is nearer than ``GRID``
    (sum of both distances) to where it starts, and moves that pixel; others open a chain,
    as all of the first frame do.
    """
    chains = Chains()
    return np.array([chains.add(*p, *q, f) for p, q, f in zip(prev.tolist(), now.tolist(), first_frame, strict=True)], np.int64)


def chain_matches(matches: DataFrame, sequence: Sequence[str], frame: str, order: Sequence[str], folder: str) -> DataFrame:
    """``matches`` (px, py to qx, qy) with ``chain``, numbered from 0 in each sequence as the chains open.

    Chains that can ever meet share cells of ``GRID``: a match joins the cell where it ends to those around its start
    where others end. Each component of cells is searched on its own, in order, so a film spreads over as many groups
    as it has families of chains. Numbers come from counts of openings in ranges of the film. ``folder``: new and shared.
    """
    spark = matches.sparkSession
    cell = lambda x, y, i=0, j=0: F.xxhash64(*sequence, F.floor(F.col(x) / GRID) + i, F.floor(F.col(y) / GRID) + j)
    first = matches.groupBy(*sequence).agg(F.min(frame).alias("_frame"))
    rows = matches.select("*", F.monotonically_increasing_id().alias("_id"), cell("qx", "qy").alias("_end")).join(first, list(sequence))
    rows = rows.withColumn("_first", F.col(frame) == F.col("_frame")).drop("_frame")
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/rows")

    around = F.array(*(cell("px", "py", i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    edges = rows.where(~F.col("_first")).select(F.col("_end").alias("u"), F.explode(around).alias("v")).distinct()
    ends = rows.select(F.col("_end").alias("v")).distinct()
    family = graphs.components(edges.join(ends, "v", "left_semi"), f"{folder}/cells")
    rows = rows.join(family.select(F.col("node").alias("_end"), "root"), "_end", "left").withColumn("_family", F.coalesce("root", "_end")).drop("root", "_end")

    schema = T.StructType([*(f for f in rows.schema if f.name not in ("_first", "_family")), T.StructField("_opener", T.LongType())])

    family = [*sequence, "_family"]
    kept = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Family after family in sorted order; only the chains of the last one are held."""
        at, chains, openers = None, Chains(), []
        for batch in batches:
            here = zip(*(batch.column(c).to_pylist() for c in family), strict=True)
            pixels = zip(*(batch.column(c).to_numpy(zero_copy_only=False).astype(float).tolist() for c in ("px", "py", "qx", "qy")), strict=True)
            out = []
            for key, pixel, first, own in zip(here, pixels, batch.column("_first").to_pylist(), batch.column("_id").to_pylist(), strict=True):
                if key != at:
                    at, chains, openers = key, Chains(), []
                chain = chains.add(*pixel, first)
                if chain == len(openers):
                    openers.append(own)
                out.append(openers[chain])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.int64())], [*kept, "_opener"])

    dealt = rows.repartition(*family).sortWithinPartitions(*family, *(F.col(c).asc_nulls_last() for c in (frame, *order, "_id")))
    linked = dealt.mapInArrow(run, schema)
    linked.write.parquet(f"{folder}/linked")
    linked = spark.read.schema(schema).parquet(f"{folder}/linked")
    opened = linked.where("_id = _opener").select(*sequence, frame, *order, "_id")
    opened = opened.repartitionByRange(*sequence, frame, *order, "_id").withColumn("_part", F.spark_partition_id())
    opened.write.parquet(f"{folder}/opened")
    opened = spark.read.schema(opened.schema).parquet(f"{folder}/opened")
    counts = opened.groupBy(*sequence, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*sequence).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*sequence, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*sequence, "_part").orderBy(frame, *order, "_id"))
    numbers = opened.withColumn("_place", inside).join(counts, [*sequence, "_part"])
    numbers = numbers.select(F.col("_id").alias("_opener"), (F.col("_before") + F.col("_place") - 1).cast("long").alias("chain"))
    return linked.join(numbers, "_opener").select(*matches.columns, "chain")


def ordinals(rows: DataFrame, keys: Sequence[str], track: str, shot: str) -> DataFrame:
    """``rows`` with ``ordinal`` from 0 in the order of track and shot: within tracks, then tracks by their counts."""
    inside = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys, track).orderBy(shot)))
    counts = inside.groupBy(*keys, track).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(W.partitionBy(*keys).orderBy(track).rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(*keys, track, F.coalesce(before, F.lit(0)).alias("_b"))
    return inside.join(counts, [*keys, track]).withColumn("ordinal", F.col("_b") + F.col("_n") - 1).drop("_n", "_b")


def update_control_points(points: DataFrame, shots: DataFrame) -> DataFrame:
    """Observations of control points: each camera's feature shots meet the points by their running number.

    ``points``: ordinal. ``shots``: camera, track_id, shot_idx, feature, valid, refl, x, y,
    x_before, y_before. A shot that is invalid or without reflectance gives -1 throughout.
    """
    seen = ordinals(shots.where("feature"), ["camera"], "track_id", "shot_idx")
    usable = F.col("valid") & (F.col("refl") != 0) & (F.col("refl") != -1)
    values = [F.when(usable, F.col(c)).otherwise(F.lit(-1.0)).alias(c) for c in ("x", "y", "x_before", "y_before")]
    return points.join(seen.select("ordinal", "camera", *values), "ordinal")


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two lists (line_no, name) side by side: (line_no, left, right), as long as the shorter."""
    return left.select("line_no", F.col("name").alias("left")).join(right.select("line_no", F.col("name").alias("right")), "line_no")


def control_point_lines(points: DataFrame, observations: DataFrame) -> DataFrame:
    """(file, line_no, value): a file for each observed point: its place and sigmas, then a line for each camera.

    ``points``: ordinal, track_id, shot_idx, lon, lat, rad and their sigmas; six decimals.
    """
    fixed = lambda *names: F.concat_ws(" ", *(F.format_string("%.6f", F.col(c).cast("double")) for c in names))
    lines = F.array_sort(F.collect_list(F.struct("camera", fixed("x", "y").alias("p"))))
    seen = observations.groupBy("ordinal").agg(F.transform(lines, lambda o: F.concat_ws(" ", o["camera"], o["p"])).alias("seen"))
    head = F.concat(fixed("lon", "lat", "rad", "sigma_lon", "sigma_lat", "sigma_rad"), F.lit(" "))
    rows = points.join(seen, "ordinal").select(
        F.concat(F.lit("gcp/"), F.concat_ws("_", F.lit("points"), F.col("track_id"), F.col("shot_idx")), F.lit(".gcp")).alias("file"),
        F.posexplode(F.concat(F.array(head), "seen")).alias("line_no", "value"),
    )
    return rows


def matching_report(candidates: DataFrame, shots: DataFrame) -> DataFrame:
    """(section, n, value): the candidates (cand, d0 .. d5, err), the best one (least error above 0), features by track."""
    number = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    listed = candidates.select(
        F.lit(0).alias("section"), F.col("cand").cast("long").alias("n"),
        F.concat(F.lit("index="), F.col("cand").cast("string"), *(F.concat(F.lit(f" d[{k}]= "), number(f"d{k}")) for k in range(6)), F.lit(" e="), number("err")).alias("value"),
    )
    best = matching.argmin(candidates.select("cand", "err"), [], "err", ["cand"], [], positive=True)
    best = best.select(F.lit(1).alias("section"), F.lit(0).cast("long").alias("n"), F.concat(F.lit("bestTransformIndex = "), F.col("cand").cast("string"), F.lit(", smallest error = "), number("err")).alias("value"))
    features = F.count(F.when(F.col("feature") & F.col("valid") & (F.col("refl") != 0), 1))
    tracks = shots.groupBy("track_id").agg(F.count("*").alias("shots"), features.alias("features"))
    total = tracks.agg(F.concat(F.lit("numTotalTracks = "), F.count("*").cast("string")).alias("value")).select(F.lit(2).alias("section"), F.lit(0).cast("long").alias("n"), "value")
    by_track = tracks.select(
        F.lit(3).alias("section"), F.col("track_id").cast("long").alias("n"),
        F.format_string("trackID: %d numShots: %d numFeatures: %d", F.col("track_id").cast("long"), "shots", "features").alias("value"),
    )
    return listed.unionByName(best).unionByName(total).unionByName(by_track)


def cross_products(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The nine sums of reference x match about the origin, their number and determinant."""
    s = {i + j: F.sum(F.col(f"r_{i}") * F.col(f"m_{j}")).alias(f"s_{i}{j}") for i in "xyz" for j in "xyz"}
    rows = pairs.where("r_x is not null").groupBy(*keys).agg(F.count("*").alias("n"), *s.values())
    c = lambda k: F.col(f"s_{k}")
    minor = lambda a, b, d, e: c(a) * c(b) - c(d) * c(e)
    det = c("xx") * minor("yy", "zz", "yz", "zy") - c("xy") * minor("yx", "zz", "yz", "zx") + c("xz") * minor("yx", "zy", "yy", "zx")
    return rows.withColumn("det", det)


def relative_rotation(pairs: DataFrame, min_matches: int, det_threshold: float) -> np.ndarray | None:
    """The rotation of matches onto references about the origin; none with too few pairs or a flat determinant."""
    row = cross_products(pairs).first()
    if row is None or row["n"] < min_matches or abs(row["det"]) < det_threshold:
        return None
    return kabsch(np.array([[row[f"s_{i}{j}"] for j in "xyz"] for i in "xyz"]))


def patch_match(shots: DataFrame, image: DataFrame, half_x: int, half_y: int, samples: int, nodata: float) -> DataFrame:
    """(track_id, shot_idx, dx, dy, err): the offset at which the shots around each feature fit the image best.

    ``shots``: track_id, shot_idx (from 0), px, py, refl, feature, gain, bias. The neighbourhood is
    ``samples`` // 2 shots before and after, the last left out, cut at the track's ends. An
    offset counts with more than half of ``samples`` valid; the first in rows, then columns, wins ties;
    without any the offset is 0 and the error 1e7. Gains and biases of 0 fit nothing.
    """
    last = shots.groupBy("track_id").agg(F.max("shot_idx").alias("_last"))
    wanted = shots.where(F.col("feature") & (F.col("refl") != 0) & (F.col("refl") != -1)).select("track_id", "shot_idx").join(last, "track_id")
    low, high = F.greatest(F.lit(0), F.col("shot_idx") - samples // 2), F.least(F.col("_last"), F.col("shot_idx") + samples // 2) - 1
    around = wanted.where(low <= high).select("track_id", F.col("shot_idx").alias("at"), F.explode(F.sequence(low, high)).alias("shot_idx"))
    sides = lambda half: F.explode(F.sequence(F.lit(-half), F.lit(half)))
    rows = around.join(shots.select("track_id", "shot_idx", "px", "py", "refl", "gain", "bias"), ["track_id", "shot_idx"])
    rows = rows.where("gain <> 0 and bias <> 0").withColumn("dy", sides(half_y)).withColumn("dx", sides(half_x))
    rows = rows.withColumn("x", (F.floor("px") + F.col("dx")).cast("int")).withColumn("y", (F.floor("py") + F.col("dy")).cast("int"))
    seen = rows.where("x > 0 and y > 0").join(raster.dealt(image.where(F.col("v") != nodata).select("x", "y", "v")), ["x", "y"])
    gap = F.abs(F.col("v") - F.col("bias") - F.col("gain") * F.col("refl"))
    errors = seen.groupBy("track_id", "at", "dy", "dx").agg(F.avg(gap).alias("err"), F.count("*").alias("n")).where(F.col("n") > samples // 2)
    best = matching.argmin(errors, ["track_id", "at"], "err", ["dy", "dx"], []).withColumnRenamed("at", "shot_idx")
    out = wanted.select("track_id", "shot_idx").join(best, ["track_id", "shot_idx"], "left")
    return out.select("track_id", "shot_idx", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("dx", "dy")), F.coalesce("err", F.lit(NO_MATCH)).alias("err"))


def projection_lines(chains: DataFrame, chain: str, frame: str) -> DataFrame:
    """(chain, value): a point's mean place, its number of frames, then frame and pixel of each, for bundle adjustment."""
    number = lambda c: F.format_string("%.6f", c)
    seen = F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), F.col("px").alias("px"), F.col("py").alias("py"))))
    rows = chains.groupBy(chain).agg(*(F.avg(c).alias(c) for c in "xyz"), seen.alias("s"))
    each = F.transform("s", lambda p: F.concat_ws(" ", p["f"].cast("string"), number(p["px"]), number(p["py"])))
    return rows.select(chain, F.concat_ws(" ", *(number(F.col(c)) for c in "xyz"), F.size("s").cast("string"), F.array_join(each, " ")).alias("value"))


def paired_rows(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x, y, u, v): shots valid in both images, paired by track and shot, as the rows of a homography."""
    a = left.where("valid").select(*keys, "x", "y")
    return a.join(right.where("valid").select(*keys, F.col("x").alias("u"), F.col("y").alias("v")), list(keys))
