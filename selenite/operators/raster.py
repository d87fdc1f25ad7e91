"""Rasters as long tables (raster keys, x, y, v): sampling, statistics, tiles, pyramids.

Lookups are equality joins on integer pixels, so a raster of any size is dealt
out by pixel; nothing is broadcast except one-row parameters. What comes out of an explode is many times larger than
Spark takes it for, so such joins ask for a merge (``dealt``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from selenite.functions import geo


def valid_pixel(v: Column, nodata: float) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (v != nodata)


def value_range(raster: DataFrame, nodata: float, keys: Sequence[str] = ()) -> DataFrame:
    """Least and largest valid value."""
    return raster.where(valid_pixel(F.col("v"), nodata)).groupBy(*keys).agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows that joins deal out by key and never send whole to every executor."""
    return rows.hint("merge")


def bilinear(points: DataFrame, raster: DataFrame, ident: Sequence[str], width: int, height: int) -> DataFrame:
    """``value`` at the points (px, py), from the four pixels around, edges extended; null if one is missing.

    Each point becomes four rows that meet their pixel in one equality join.
    """
    x0, y0 = F.floor("px").cast("int"), F.floor("py").cast("int")
    fx, fy = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c))
    corners = F.array(
        *(
            F.struct(clamp(x0 + i, width).alias("x"), clamp(y0 + j, height).alias("y"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
            for i in (0, 1)
            for j in (0, 1)
        )
    )
    inside = points.where((F.col("px") >= 0) & (F.col("px") <= width - 1) & (F.col("py") >= 0) & (F.col("py") <= height - 1))
    rows = inside.select(*ident, F.inline(corners)).join(dealt(raster.select("x", "y", "v")), ["x", "y"])
    found = rows.groupBy(*ident).agg(F.sum(F.col("w") * F.col("v")).alias("_v"), F.count("v").alias("_n"))
    return found.select(*ident, F.when(F.col("_n") == 4, F.col("_v")).alias("value"))


def nearest(points: DataFrame, raster: DataFrame, ident: Sequence[str]) -> DataFrame:
    """The pixel that the coordinates are cut to; -1 where there is none."""
    keyed = points.select(*ident, F.col("px").cast("int").alias("x"), F.col("py").cast("int").alias("y"))
    joined = keyed.join(dealt(raster.select("x", "y", "v")), ["x", "y"], "left")
    return joined.select(*ident, F.coalesce("v", F.lit(-1.0)).alias("value"))


def gate_by_range(samples: DataFrame, limits: DataFrame, precision: str | None = None, most: float = 25.0) -> DataFrame:
    """``valid``: strictly inside the raster's least and largest value, and precise where a precision is given."""
    rows = samples.join(F.broadcast(limits))  # one row
    ok = F.col("value").isNotNull() & (F.col("value") > F.col("v_min")) & (F.col("value") < F.col("v_max"))
    if precision:
        ok = ok & (F.col(precision) >= 0) & (F.col(precision) < most)
    return rows.withColumn("valid", F.coalesce(ok, F.lit(False))).drop("v_min", "v_max")


def subsample(raster: DataFrame, step_x: int, step_y: int, nodata: float) -> DataFrame:
    return raster.where((F.col("x") % step_x == 0) & (F.col("y") % step_y == 0) & valid_pixel(F.col("v"), nodata))


def normalize(raster: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """To 0 .. 1 by the least and largest value."""
    if not keys:
        limits = F.broadcast(raster.agg(F.min("v").alias("_a"), F.max("v").alias("_b")))  # one row
        rows = raster.join(limits)
    else:
        rows = raster.join(raster.groupBy(*keys).agg(F.min("v").alias("_a"), F.max("v").alias("_b")), list(keys))
    return rows.withColumn("v", (F.col("v") - F.col("_a")) / (F.col("_b") - F.col("_a"))).drop("_a", "_b")


def pool(raster: DataFrame, factor: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of factor x factor pixels: a level of the pyramid."""
    cell = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("x", "y")]
    return raster.groupBy(*keys, *cell).agg(F.avg("v").alias("v"))


def pyramid(raster: DataFrame, zooms: Sequence[int] = (8, 4, 2, 1), keys: Sequence[str] = ()) -> DataFrame:
    """(keys, zoom, x, y, v): the means of all levels from one pass; sums and counts are added up before they are shuffled."""
    level = [F.struct(F.lit(z).alias("zoom"), *(F.floor(F.col(c) / z).cast("int").alias(c) for c in ("x", "y"))) for z in zooms]
    rows = raster.select(*keys, "v", F.explode(F.array(*level)).alias("_l")).select(*keys, "_l.*", "v")
    return rows.groupBy(*keys, "zoom", "x", "y").agg(F.avg("v").alias("v"))


def origin_cloud(raster: DataFrame, place: Sequence[float], semi_major: float, step: int = 20, nodata: float = -37687.0) -> DataFrame:
    """(x, y, px, py, pz): every ``step``-th valid pixel as a point in space, counted from the point of the first pixel.

    ``place``: (lon of the first pixel, its lat, degrees a column, degrees a row). Without a first pixel there are no points.
    """
    lon0, lat0, dx, dy = map(float, place)
    lon, lat = F.lit(lon0) + F.col("x") * dx, F.lit(lat0) + F.col("y") * dy
    at = [p.alias(c) for p, c in zip(geo.geodetic_to_xyz(lon, lat, F.col("v"), semi_major), ("px", "py", "pz"), strict=True)]
    first = raster.where("x = 0 and y = 0").select(*at).limit(1).select(*(F.col(c).alias(f"_{c}") for c in ("px", "py", "pz")))
    rows = subsample(raster, step, step, nodata).where(~F.isnan("v")).select("x", "y", *at)
    return rows.join(F.broadcast(first)).select("x", "y", *((F.col(c) - F.col(f"_{c}")).alias(c) for c in ("px", "py", "pz")))  # one row


def rasterize(points: DataFrame, x: Column, y: Column, value: str, order: Sequence[str]) -> DataFrame:
    """A grid of the last value that falls on each pixel."""
    cell = [F.floor(x).cast("int").alias("x"), F.floor(y).cast("int").alias("y")]
    return points.groupBy(*cell).agg(F.max_by(F.col(value), F.struct(*order)).alias("v"))


def derivative(raster: DataFrame, along: str = "x") -> DataFrame:
    """``d``: the seven-tap central difference along an axis; 0 near the border."""
    other = "y" if along == "x" else "x"
    w = W.partitionBy(other).orderBy(along)
    taps = ((1, 3 / 4), (2, -3 / 20), (3, 1 / 60))
    total = sum(((F.lead("v", k).over(w) - F.lag("v", k).over(w)) * t for k, t in taps), F.lit(0.0))
    return raster.withColumn("d", F.coalesce(total, F.lit(0.0)))


def dilate(raster: DataFrame, largest: bool = True) -> DataFrame:
    """3 x 3 maximum (or minimum), by one window along each axis."""
    f = F.max if largest else F.min
    across = W.partitionBy("y").orderBy("x").rangeBetween(-1, 1)
    down = W.partitionBy("x").orderBy("y").rangeBetween(-1, 1)
    return raster.withColumn("v", f("v").over(across)).withColumn("v", f("v").over(down))


def tile_grid(images: DataFrame, tile_w: int, tile_h: int, overlap: int) -> DataFrame:
    """Overlapping tiles of images (image, width, height); the last is shifted back inside, larger ones cover all."""

    def starts(size: Column, tile: int) -> Column:
        step = max(1, tile - overlap)
        n = F.greatest(F.lit(1), F.ceil((size - overlap) / step).cast("int"))
        whole = (size <= tile) | (F.lit(tile) <= 0)
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(i * step, size - tile))
        return F.when(whole, F.array(F.lit(0))).otherwise(at)

    side = lambda size, tile: F.when((size <= tile) | (F.lit(tile) <= 0), size).otherwise(F.lit(tile))
    rows = images.withColumn("x", F.explode(starts(F.col("width"), tile_w)))
    rows = rows.withColumn("y", F.explode(starts(F.col("height"), tile_h)))
    return rows.select("image", "x", "y", side(F.col("width"), tile_w).alias("w"), side(F.col("height"), tile_h).alias("h"))


def pyramid_parameters(images: DataFrame, tile: int) -> DataFrame:
    """Levels, padded side (a power of two of tiles) and the offset that centres the image."""
    large = F.greatest("width", "height")
    levels = F.greatest(F.lit(0), F.ceil(F.log2(large / tile))).cast("int")
    side = (F.lit(tile) * F.pow(F.lit(2.0), levels)).cast("long")
    return images.select(
        "image", levels.alias("levels"), side.alias("side"),
        F.floor((side - F.col("width")) / 2).cast("long").alias("offset_x"), F.floor((side - F.col("height")) / 2).cast("long").alias("offset_y"),
    )


def pyramid_tiles(parameters: DataFrame) -> DataFrame:
    """Every tile of every level with its quad-tree path, most significant digit first."""
    rows = parameters.select("image", F.explode(F.sequence(F.lit(0), F.col("levels"))).alias("level"))
    last = (F.pow(F.lit(2.0), F.col("level")) - 1).cast("int")
    rows = rows.withColumn("h", F.explode(F.sequence(F.lit(0), last))).withColumn("v", F.explode(F.sequence(F.lit(0), last)))
    path = F.expr("array_join(transform(reverse(sequence(0, greatest(level, 1) - 1)), k -> cast((shiftright(h, k) & 1) + 2 * (shiftright(v, k) & 1) as string)), '/')")
    return rows.withColumn("path", F.when(F.col("level") > 0, path).otherwise(F.lit("")))


def mosaic(pixels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean over overlapping images of the values that are not 0."""
    n = F.count(F.when(F.col(value) != 0, 1))
    return pixels.groupBy(*keys).agg((F.sum(value) / F.when(n > 0, n)).alias("v"), n.alias("n"))


def assemble(background: DataFrame, foreground: DataFrame, keys: Sequence[str], weighted: bool = False) -> DataFrame:
    """Foreground over background (columns v, acc): the foreground where there is one, or both blended by accuracy."""
    fore = foreground.select(*keys, F.col("v").alias("fv"), F.col("acc").alias("fa"))
    rows = background.join(dealt(fore), list(keys), "left")
    if not weighted:
        return rows.select(*keys, F.coalesce("fv", "v").alias("v"), F.coalesce("fa", "acc").alias("acc"))
    w = F.col("acc") / (F.col("fa") + F.col("acc"))
    return rows.select(
        *keys,
        F.coalesce(w * F.col("fv") + (1 - w) * F.col("v"), F.col("v")).alias("v"),
        F.coalesce(1 / (w / F.col("fa") + (1 - w) / F.col("acc")), F.col("acc")).alias("acc"),
    )


#: Fixed value: what pixels outside a resampled image hold.
FILL = -3.4028226550889e38


def padded_pyramid(raster: DataFrame, width: int, height: int, tile: int, pad: int, levels: int, factor: int = 2, fill: float = FILL) -> DataFrame:
    """(level, tx, ty, i, j, v): tiles with a border of ``pad`` pixels, each level ``factor`` times smaller than the one before.

    A pixel takes the bilinear value at its place in the image; ``fill`` outside.
    """
    spark = raster.sparkSession
    scales = [factor**k for k in range(levels)]
    tiles = spark.createDataFrame([(k, s, -(-(-(-width // s)) // tile), -(-(-(-height // s)) // tile)) for k, s in enumerate(scales)], "level int, scale int, nx int, ny int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = F.explode(F.sequence(F.lit(-pad), F.lit(tile + pad - 1)))
    rows = tiles.withColumn("tx", upto("nx")).withColumn("ty", upto("ny")).repartition("level", "tx", "ty").withColumn("i", side).withColumn("j", side)
    place = [((F.col(t) * tile + F.col(o)) * F.col("scale")).cast("double").alias(p) for t, o, p in (("tx", "i", "px"), ("ty", "j", "py"))]
    key = ["level", "tx", "ty", "i", "j"]
    found = bilinear(rows.select(*key, *place), raster, key, width, height)
    return rows.select(*key).join(dealt(found), key, "left").select(*key, F.coalesce("value", F.lit(fill)).alias("v"))


def tiles_in_box(parameters: DataFrame, tile: int, box: Sequence[float]) -> DataFrame:
    """(image, level, h, v): tiles of every level that touch a box (left, top, right, bottom) in pixels of the image.

    Level 0 is one tile of the padded side; each level halves the ground that a tile covers.
    """
    rows = parameters.select("*", F.explode(F.sequence(F.lit(0), F.col("levels"))).alias("level"))
    ground = F.col("side") / F.pow(F.lit(2.0), F.col("level"))
    last = (F.pow(F.lit(2.0), F.col("level")) - 1).cast("int")
    clamp = lambda c: F.greatest(F.lit(0), F.least(last, F.floor(c / ground).cast("int")))
    span = lambda a, b, o: F.explode(F.sequence(clamp(F.lit(float(a)) + F.col(o)), clamp(F.lit(float(b)) + F.col(o))))
    inside = (F.lit(float(box[2])) + F.col("offset_x") >= 0) & (F.lit(float(box[0])) + F.col("offset_x") <= F.col("side"))
    inside = inside & (F.lit(float(box[3])) + F.col("offset_y") >= 0) & (F.lit(float(box[1])) + F.col("offset_y") <= F.col("side"))
    rows = rows.where(inside).withColumn("h", span(box[0], box[2], "offset_x"))
    return rows.withColumn("v", span(box[1], box[3], "offset_y")).select("image", "level", "h", "v")


#: The finest ground resolution of a foreground that counts.
FINEST = 1 / 32


def sub_pyramid_tiles(boxes: DataFrame, tile: int, padding: Sequence[int] = (0, 0, 0, 0), elevation: bool = True) -> DataFrame:
    """The background's tiles under each foreground's box, with their names and how much either is enlarged.

    ``boxes``: image, left, top, right, bottom (pixels of the background), offset_x, offset_y (of its pyramid), back_res, fore_res
    (ground units a pixel). The box is widened to breaks between tiles; ``padding`` (left, top, right,
    bottom) is added around each. The background is enlarged by the power of two that reaches the foreground's resolution.
    """
    start = lambda c, o: F.floor((F.col(c) + F.col(o)) / tile).cast("long")
    stop = lambda c, o: F.ceil((F.col(c) + F.col(o)) / tile).cast("long") - 1
    span = lambda a, b, o: F.explode(F.when(start(a, o) <= stop(b, o), F.sequence(start(a, o), stop(b, o))))
    back, fore = F.abs("back_res"), F.abs(F.when(F.col("fore_res") < FINEST, F.lit(FINEST)).otherwise(F.col("fore_res")))
    enlarged = F.pow(F.lit(2.0), F.ceil(F.log2(back / fore)))
    rows = boxes.withColumn("back_up", enlarged).withColumn("fore_up", F.col("back_up") / (back / F.abs("fore_res")))
    rows = rows.withColumn("h", span("left", "right", "offset_x")).withColumn("v", span("top", "bottom", "offset_y"))
    x, y = F.col("h") * tile - F.col("offset_x"), F.col("v") * tile - F.col("offset_y")
    name = lambda kind: F.concat(F.lit("assembled_"), F.col("h").cast("string"), F.lit("_"), F.col("v").cast("string"), F.lit(kind))
    names = {"name": "_dem.tif", "acc_name": "_acc.tif", "pc_name": "_pc.txt"} if elevation else {"name": "_drg.tif"}
    return rows.select(
        "image", "h", "v", (x - padding[0]).alias("xl"), (x + tile + padding[2]).alias("xr"), (y - padding[1]).alias("yt"), (y + tile + padding[3]).alias("yb"),
        *(name(k).alias(c) for c, k in names.items()), "back_up", "fore_up",
    )


def crop(raster: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The pixels of a window, counted from its corner."""
    inside = raster.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    return inside.withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def assemble_at(background: DataFrame, foreground: DataFrame, keys: Sequence[str], fx: Column, fy: Column, weighted: bool = False) -> DataFrame:
    """Background pixels (keys, v, acc ...) under the foreground pixel at (fx, fy), the inverse of the foreground's motion.

    ``fx`` and ``fy`` may use any column of the background, such as the height that carries an image's pixel back.
    """
    at = background.withColumn("_x", F.floor(fx + 0.5).cast("int")).withColumn("_y", F.floor(fy + 0.5).cast("int"))
    fore = foreground.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("v").alias("fv"), F.col("acc").alias("fa"))
    rows = at.join(dealt(fore), ["_x", "_y"], "left")
    if not weighted:
        return rows.select(*keys, F.coalesce("fv", "v").alias("v"), F.coalesce("fa", "acc").alias("acc"))
    w = F.col("acc") / (F.col("fa") + F.col("acc"))
    blended, accuracy = w * F.col("fv") + (1 - w) * F.col("v"), 1 / (w / F.col("fa") + (1 - w) / F.col("acc"))
    return rows.select(*keys, F.coalesce(blended, "v").alias("v"), F.coalesce(accuracy, "acc").alias("acc"))
