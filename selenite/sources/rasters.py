"""Georeferenced rasters (TIFF) and planetary images (PDS) as long tables, and back.

Files are read by ranges of bytes (``ranged``), so their size has no bound and a window costs only its
rows; of headers only the pages that hold them are read. Files written are tiles of a raster, each
encoded where its pixels meet; they appear when all are written, or none does.

Defined results: a file that is neither raises ``ValueError`` with its path; pixels that equal
the file's no-data value are kept and can be told by the header's ``nodata``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenite.sources import ranged
from selenite.sources.formats import HEADER, encode_cube, encode_pds, encode_tiff, tiff_header


def read_rasters(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, band, x, y, v): the pixels of all TIFF files of a path or pattern, or of a window (x, y, width, height)."""
    return ranged.read_images(spark, ranged.TiffSource, path, **options)


def raster_headers(spark: SparkSession, path: str) -> DataFrame:
    """Sizes, no-data values and places of the TIFF files; no content is read but the headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, *tiff_header(ranged.RangedFile(p))) for p in map(ranged.address, batch.column("path").to_pylist())]
            names = [c.split()[0] for c in HEADER.split(", ")]
            kinds = [pa.string(), *[pa.int32()] * 3, *[pa.float64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, HEADER)


def tiles_of(raster: DataFrame, tile: int, keys: Sequence[str], encode, nodata: float, whole: bool = False) -> DataFrame:
    """(keys, tx, ty, content): (keys, x, y, v) as tiles, each encoded from its pixels; missing pixels hold ``nodata``.

    ``encode(pixels, tx, ty)`` gives the file. A tile ends at its last pixel, or is ``tile`` wide and high if ``whole``.
    Columns of ``raster`` beside keys, x, y and v are not read.
    """
    tx, ty = (F.floor(F.col(c) / tile).cast("long") for c in "xy")
    rows = raster.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)), tx.alias("tx"), ty.alias("ty"), "x", "y", F.col("v").cast("double").alias("v"))
    group = [*(f"k{i}" for i in range(len(keys))), "tx", "ty"]
    schema = T.StructType([*(rows.schema[c] for c in group), T.StructField("content", T.BinaryType())])

    def run(rows: pa.Table) -> pa.Table:
        tx, ty = (rows.column(c)[0].as_py() for c in ("tx", "ty"))
        x, y = (rows.column(c).to_numpy() - t * tile for c, t in (("x", tx), ("y", ty)))
        shape = (tile, tile) if whole else (int(y.max()) + 1, int(x.max()) + 1)
        pixels = np.full(shape, nodata, np.float64)
        v = rows.column("v").to_numpy(zero_copy_only=False).astype(float)
        pixels[y, x] = np.where(np.isnan(v), nodata, v)
        content = pa.array([encode(pixels, tx, ty)], pa.binary())
        return pa.table([*(rows.column(c).slice(0, 1) for c in group), content], names=schema.names)

    return rows.groupBy(*group).applyInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keys)})


def write_rasters(raster: DataFrame, folder: str, tile: int, place: tuple[float, float, float, float], nodata: float, keys: Sequence[str] = ()) -> None:
    """Write (keys, x, y, v) as TIFF tiles of ``tile`` x ``tile`` pixels.

    ``place``: (x0, y0, dx, dy) of the whole raster. Names are ``keys_tilex_tiley.tif``.
    """
    x0, y0, dx, dy = place
    encode = lambda p, tx, ty: encode_tiff(p, x0 + tx * tile * dx, y0 + ty * tile * dy, dx, dy, nodata)
    found = tiles_of(raster, tile, keys, encode, nodata)
    name = F.concat(F.concat_ws("_", *(F.col(c).cast("string") for c in (*keys, "tx", "ty"))), F.lit(".tif"))
    ranged.save_files(found.select(name.alias("name"), "content"), folder)


def quad_path(level: Column, tx: Column, ty: Column) -> Column:
    """Folders of a tile in its level's quad tree: of each pair of bits, from the highest, 1 + x bit + 2 y bit."""
    bits = F.transform(F.reverse(F.sequence(F.lit(0), level - 1)), lambda k: (F.call_function("shiftright", tx, k).bitwiseAND(1) + 2 * F.call_function("shiftright", ty, k).bitwiseAND(1) + 1).cast("string"))
    return F.when(level > 0, F.array_join(bits, "/")).otherwise(F.lit(""))


def write_quad_tiles(pyramid: DataFrame, folder: str, tile: int, fill: float, elevation: bool = True) -> None:
    """Write (level, x, y, v) as raw tiles of ``tile`` x ``tile`` pixels, ``level/quad folders/0``.

    Elevations are big-endian 32-bit reals, images unsigned bytes (cut off, held to 0 .. 255). A level's
    tiles are numbered from its corner, so that level k has at most 2 ** k of them on a side.
    """

    def encode(p: np.ndarray, tx: int, ty: int) -> bytes:
        return (p.astype(">f4") if elevation else np.clip(np.trunc(p), 0, 255).astype("u1")).tobytes()

    found = tiles_of(pyramid, tile, ["level"], encode, fill, whole=True)
    path = quad_path(F.col("level").cast("int"), F.col("tx").cast("int"), F.col("ty").cast("int"))
    name = F.concat_ws("/", F.col("level").cast("string"), F.when(path != "", path), F.lit("0"))
    ranged.save_files(found.select(name.alias("name"), "content"), folder)


def read_quad_tiles(spark: SparkSession, folder: str, tile: int, elevation: bool = True) -> DataFrame:
    """(level, x, y, v) of the tiles that ``write_quad_tiles`` wrote."""
    at = F.split(F.regexp_extract("path", r"/(\d+(?:/[1-4])*)/0$", 1), "/")
    digits = F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0)))
    step = lambda bit: F.aggregate(digits, F.lit(0), lambda s, d: 2 * s + (((d.cast("int") - 1) / bit).cast("int") % 2))
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = rows.select(at[0].cast("int").alias("level"), step(1).alias("tx"), step(2).alias("ty"), "content")
    kind = ">f4" if elevation else "u1"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                level, tx, ty = (batch.column(c)[r].as_py() for c in ("level", "tx", "ty"))
                v = np.frombuffer(batch.column("content")[r].as_buffer(), kind).astype(np.float64)
                ys, xs = np.divmod(np.arange(v.size, dtype=np.int32), np.int32(tile))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(v.size, level, np.int32)), pa.array(xs + np.int32(tx * tile)), pa.array(ys + np.int32(ty * tile)), pa.array(v)], ["level", "x", "y", "v"]
                )

    return rows.mapInArrow(run, "level int, x int, y int, v double")


def write_pds(pixels: DataFrame, folder: str, keys: Sequence[str]) -> None:
    """Write (keys, x, y, v) as planetary images of unsigned 16-bit samples, ``keys.img``; each is whole, from (0, 0) on."""
    found = tiles_of(pixels, 1 << 20, keys, lambda p, tx, ty: encode_pds(p), 0.0)
    name = F.concat(F.concat_ws("_", *(F.col(c).cast("string") for c in keys)), F.lit(".img"))
    ranged.save_files(found.select(name.alias("name"), "content"), folder)


def write_mosaic_tiles(pixels: DataFrame, folder: str, tile: int) -> None:
    """Write (x, y, v, px, py, pz) as an eight-bit image and a cloud for each tile with points.

    ``tile_i_j.tif`` holds the values (0: none), ``tile_i_j_point_cloud.txt`` a line
    ``x y z value value value`` for each point, in rows, with six decimals.
    """
    encode = lambda p, tx, ty: encode_tiff(np.clip(np.trunc(p), 0, 255), tx * tile, ty * tile, 1.0, 1.0, 0.0)
    tx, ty = (F.floor(F.col(c) / tile).cast("long").cast("string") for c in "xy")
    name = F.concat(F.lit("tile_"), F.col("tx").cast("string"), F.lit("_"), F.col("ty").cast("string"))
    images = tiles_of(pixels, tile, [], encode, 0.0, whole=True).select(F.concat(name, F.lit(".tif")).alias("name"), "content")
    grey = F.greatest(F.lit(0), F.least(F.lit(255), F.col("v").cast("int"))).cast("string")
    line = F.concat_ws(" ", *(F.format_string("%.6f", F.col(c).cast("double")) for c in ("px", "py", "pz")), grey, grey, grey)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", line.alias("line")))), lambda s: s["line"])
    clouds = pixels.where("px is not null").groupBy(tx.alias("tx"), ty.alias("ty")).agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))
    clouds = clouds.select(F.concat(name, F.lit("_point_cloud.txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    ranged.save_files(images.unionByName(clouds), folder)


def read_pds(spark: SparkSession, path: str, tile: tuple[int, int, int, int] | None = None, **options) -> DataFrame:
    """(path, band, x, y, v): raw samples of planetary images, or of a tile (x, y, width, height) of each.

    A tile outside an image, or of one with neither one nor three bands, raises.
    """
    window = dict(zip(("x", "y", "width", "height"), tile, strict=True)) if tile else {}
    return ranged.read_images(spark, ranged.PdsSource, path, **window, **options)


def read_cubes(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, band, x, y, v): the pixels of camera cubes with base and multiplier applied; special pixels are null."""
    return ranged.read_images(spark, ranged.CubeSource, path, **options)


def write_cubes(pixels: DataFrame, folder: str, keys: Sequence[str], tile: tuple[int, int]) -> None:
    """Write (keys, x, y, v) as cubes of one band of reals, ``keys.cub``; missing pixels and nulls become the null pixel."""
    nan = float("nan")
    found = tiles_of(pixels, 1 << 20, keys, lambda p, tx, ty: encode_cube(p[None], tile), nan)
    name = F.concat(F.concat_ws("_", *(F.col(c).cast("string") for c in keys)), F.lit(".cub"))
    ranged.save_files(found.select(name.alias("name"), "content"), folder)


def eight_bits(pixels: DataFrame, bits: int) -> DataFrame:
    """Samples as 8 bits: 16-bit ones by 256 over the file's largest, 32-bit ones by 256; three bands in reversed order."""
    limits = pixels.groupBy("path").agg(F.max("v").alias("_most"), F.max("band").alias("_last"))
    scale = {8: F.lit(1.0), 16: F.lit(256.0) / F.col("_most"), 32: F.lit(256.0)}[bits]
    value = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("v") * scale).cast("int")))
    band = F.when(F.col("_last") == 2, 2 - F.col("band")).otherwise(F.col("band"))
    return pixels.join(limits, "path").select("path", band.alias("band"), "x", "y", value.alias("v"))
