"""Stereo: block matching, clean-up of disparities, tiles that cover them, reprojection.

Images are long tables (x, y, v). A disparity is a join on a shifted column, sums over
windows are two one-dimensional windows, so no pixel's neighbourhood is ever gathered.
Semi-global matching follows the scan lines in order, with one pixel of a line in memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from selenite.operators import raster


def cost_volume(left: DataFrame, right: DataFrame, disparities: int, least: int = 0, half: int = 2) -> DataFrame:
    """(x, y, d, sad): sums of absolute differences over square windows that lie whole in both images."""
    shifted = left.select("x", "y", "v", F.explode(F.sequence(F.lit(least), F.lit(least + disparities - 1))).alias("d"))
    other = right.select(F.col("x").alias("xr"), "y", F.col("v").alias("u"))
    both = shifted.withColumn("xr", F.col("x") - F.col("d")).join(raster.dealt(other), ["xr", "y"])
    along = W.partitionBy("d", "y").orderBy("x").rangeBetween(-half, half)
    down = W.partitionBy("d", "x").orderBy("y").rangeBetween(-half, half)
    rows = both.select("x", "y", "d", F.abs(F.col("v") - F.col("u")).alias("ad"))
    rows = rows.select("x", "y", "d", F.sum("ad").over(along).alias("ad"), F.count("*").over(along).alias("n"))
    rows = rows.select("x", "y", "d", F.sum("ad").over(down).alias("sad"), F.sum("n").over(down).alias("n"))
    return rows.where(F.col("n") == (2 * half + 1) ** 2).drop("n")


def block_match(left: DataFrame, right: DataFrame, disparities: int, least: int = 0, half: int = 2) -> DataFrame:
    """(x, y, d, sad): the disparity of least absolute difference over a square window; ties go to the smaller.

    Only windows that lie whole in both images count; pixels without any are left out.
    """
    best = cost_volume(left, right, disparities, least, half).groupBy("x", "y").agg(F.min(F.struct("sad", "d")).alias("b"))
    return best.select("x", "y", F.col("b.d").alias("d"), F.col("b.sad").alias("sad"))


#: Steps of the scan lines that end in a pixel; the first four, or all.
DIRECTIONS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1))
#: What a disparity without a whole window costs.
NO_WINDOW = 1_000_000
#: Scan lines that are followed together in one task.
LINES = 8


def follow(before: np.ndarray | None, costs: np.ndarray, p1: int, p2: int) -> np.ndarray:
    """Path costs (lines x disparities) of pixels whose lines come from ``before``: a step of one costs p1, any other p2."""
    if before is None:
        return costs
    least = before.min(1, keepdims=True)
    edge = np.full((len(costs), 1), np.iinfo(np.int64).max // 2)
    down, up = np.hstack([edge, before[:, :-1]]), np.hstack([before[:, 1:], edge])
    return costs + np.minimum(np.minimum(before, np.minimum(down, up) + p1), least + p2) - least


def path_costs(volume: DataFrame, p1: int, p2: int, directions: int) -> DataFrame:
    """(x, y, path): the costs of the best paths to each pixel (x, y, costs), a row for each direction.

    Lines are dealt out in bundles; a task goes along its bundles pixel by pixel in sorted order and holds
    one pixel of each line. A line starts anew behind a missing pixel.
    """
    steps = DIRECTIONS[:directions]
    line = [F.col("y") if dy == 0 else F.col("x") if dx == 0 else F.col("x") - dx * dy * F.col("y") for dx, dy in steps]
    place = [dx * F.col("x") if dx else dy * F.col("y") for dx, dy in steps]
    ways = F.array(*(F.struct(F.lit(k).alias("k"), ln.cast("long").alias("line"), at.cast("long").alias("at")) for k, (ln, at) in enumerate(zip(line, place, strict=True))))
    rows = volume.select("x", "y", "costs", F.explode(ways).alias("w")).select("x", "y", "costs", "w.*")
    rows = rows.withColumn("bundle", F.floor(F.col("line") / LINES))
    keys = ["k", "bundle", "at", "line"]
    rows = rows.repartition("k", "bundle").sortWithinPartitions(*keys).select("x", "y", *keys, "costs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, held, now = None, None, {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            k, bundle, places, lines = (batch.column(c).to_numpy() for c in keys)
            costs = batch.column("costs").flatten().to_numpy().reshape(batch.num_rows, -1)
            edges = np.flatnonzero(np.diff(k) | np.diff(bundle) | np.diff(places)) + 1
            out = np.empty_like(costs)
            for i, j in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                here = (k[i], bundle[i]), places[i]
                if here[0] != group:
                    group, at, held, now = here[0], here[1], {}, {}
                elif here[1] != at:  # a step on; lines without a pixel just before start anew
                    held, now = (now if here[1] == at + 1 else {}), {}
                    at = here[1]
                known = np.array([n in held for n in lines[i:j].tolist()])
                out[i:j] = costs[i:j]
                if known.any():
                    before = np.stack([held[n] for n in lines[i:j][known].tolist()])
                    out[i:j][known] = follow(before, costs[i:j][known], p1, p2)
                now.update(zip(lines[i:j].tolist(), out[i:j], strict=True))
            path = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), path], ["x", "y", "path"])

    kinds = ", ".join(f"{c} {volume.schema[c].dataType.simpleString()}" for c in "xy")
    return rows.mapInArrow(run, f"{kinds}, path array<long>")


def semi_global_match(
    left: DataFrame, right: DataFrame, disparities: int, least: int = 0, half: int = 1, p1: int = 8, p2: int = 32, directions: int = 8,
    unique: int = 0, check: int | None = None,
) -> DataFrame:
    """(x, y, d, cost): the disparity of the least sum of path costs over ``directions`` (4 or 8) scan lines; ties go to the smaller.

    Values are whole numbers. Pixels without any whole window are left out. ``unique``: a pixel counts only if no disparity but the
    best and its neighbours costs less than (100 + unique) / 100 of the best sum. ``check``: only if
    the right pixel's own best disparity differs by no more.
    """
    volume = cost_volume(left, right, disparities, least, half)
    each = [F.coalesce(F.max(F.when(F.col("d") == least + k, F.col("sad"))), F.lit(NO_WINDOW)).cast("long") for k in range(disparities)]
    rows = path_costs(volume.groupBy("x", "y").agg(F.array(*each).alias("costs")), p1, p2, directions)
    sums = rows.groupBy("x", "y").agg(F.array(*(F.sum(F.col("path")[k]) for k in range(disparities))).alias("s"))
    sums = sums.withColumn("cost", F.array_min("s")).withColumn("i", (F.array_position("s", F.array_min("s")) - 1).cast("int"))
    if unique > 0:
        rival = F.exists(F.transform("s", lambda c, k: (F.abs(k - F.col("i")) > 1) & (c * 100 < F.col("cost") * (100 + unique))), lambda b: b)
        sums = sums.where(~rival)
    found = sums.select("x", "y", (F.col("i") + least).alias("d"), "cost")
    if check is None:
        return found
    seen = sums.select("x", "y", F.posexplode("s").alias("k", "c")).select((F.col("x") - F.col("k") - least).alias("xr"), "y", "c", (F.col("k") + least).alias("dr"))
    theirs = seen.groupBy("xr", "y").agg(F.min(F.struct("c", "dr")).alias("b")).select("xr", "y", F.col("b.dr").alias("dr"))
    both = found.withColumn("xr", F.col("x") - F.col("d")).join(theirs, ["xr", "y"])
    return both.where(F.abs(F.col("d") - F.col("dr")) <= check).select("x", "y", "d", "cost")


def opened(disparity: DataFrame, passes: int = 2) -> DataFrame:
    """Erode, then dilate, ``passes`` times each by 3 x 3."""
    for largest in (False, True):
        for _ in range(passes):
            disparity = raster.dilate(disparity, largest)
    return disparity


def tile_layout(parameters: DataFrame) -> DataFrame:
    """Tile sizes that hold the disparities of (image, width, height, tile_w, tile_h, least, disparities, window).

    Sizes are even; without a size the tile is the image; a tile no larger than its overlap becomes twice that.
    """
    far = F.greatest(F.abs("least"), F.abs(F.col("least") + F.col("disparities")))
    none = (F.col("tile_w") <= 0) | (F.col("tile_h") <= 0)
    even = lambda c: c + F.pmod(c, F.lit(2))
    over = {"x_overlap": far * 2 + F.col("window") + 1, "y_overlap": F.col("window") + 1}
    size = {
        "w": even(F.when(none, F.col("width")).otherwise(F.col("tile_w"))),
        "h": even(F.when(none, F.col("height")).otherwise(F.col("tile_h"))),
    }
    grown = lambda c, o: F.when(c <= o, 2 * o).otherwise(c)
    return parameters.select(
        "image", grown(size["w"], over["x_overlap"]).alias("tile_w"), grown(size["h"], over["y_overlap"]).alias("tile_h"), *(v.alias(k) for k, v in over.items())
    )


def tile_core(tile: Sequence[Column], x_overlap: Column, y_overlap: Column) -> list[Column]:
    """A tile (x, y, w, h) without the half of its overlap that the tile before holds."""
    x, y, w, h = tile
    cut = lambda at, o: F.when(at == 0, F.lit(0)).otherwise(F.floor(o / 2).cast("int"))
    cx, cy = cut(x, x_overlap), cut(y, y_overlap)
    return [x + cx, y + cy, w - cx, h - cy]


def change_coordinates(q: np.ndarray, rotation: np.ndarray, translation: np.ndarray) -> np.ndarray:
    """The 4 x 4 reprojection matrix behind a rigid motion: [R, t] Q."""
    motion = np.eye(4)
    motion[:3, :3], motion[:3, 3] = rotation, translation
    return motion @ q


def reproject(x: Column, y: Column, d: Column, q: np.ndarray) -> list[Column]:
    """A pixel with its disparity as a point in space; null where it lies at infinity."""
    row = lambda i: x * float(q[i, 0]) + y * float(q[i, 1]) + d * float(q[i, 2]) + float(q[i, 3])
    w = row(3)
    return [F.when(w != 0, row(i) / w) for i in range(3)]


def stereo_points(disparity: DataFrame, image: DataFrame, q: np.ndarray, most: float = 1e4) -> DataFrame:
    """(x, y, px, py, pz, v): pixels with a disparity as points in front of the camera and nearer than ``most``, with their values."""
    p = [c.alias(n) for c, n in zip(reproject(F.col("x"), F.col("y"), F.col("d"), q), ("px", "py", "pz"), strict=True)]
    rows = disparity.select("x", "y", *p).where((F.col("pz") > 0) & (F.col("pz") < most))
    return rows.join(raster.dealt(image.select("x", "y", "v")), ["x", "y"])


def normalized_disparity(disparity: DataFrame) -> DataFrame:
    """(x, y, v): disparities scaled to 0 .. 255 by the least and largest of all."""
    return raster.normalize(disparity.select("x", "y", F.col("d").cast("double").alias("v"))).withColumn("v", F.floor(F.col("v") * 255).cast("int"))
