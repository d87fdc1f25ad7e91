"""Queries of the registrations, on motions that are known, and of raster files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from selenite.functions import geo
from selenite.operators import matching, raster, registration
from selenite.plans import match_queries as M
from selenite.plans import proxies as P
from selenite.plans.catalog import query
from selenite.sources import rasters

SHIFT = (0.3, -0.2, 0.1)


def lidar(spark, d, shift):
    """Every eighth DEM point, moved, around the pixel it came from."""
    rows = M.candidates(spark, d).where("x % 8 = 0 and y % 8 = 0")
    return rows.select(
        (F.col("x").cast("long") + F.col("y") * 64).alias("id"), F.col("x").alias("px"), F.col("y").alias("py"),
        *((F.col(f"c{c}") + v).alias(f"f{c}") for c, v in zip("xyz", shift, strict=True)),
    )


@query(f"select cast(2 as integer) as rounds, {', '.join(f'cast({v} as double) as t{c}' for c, v in zip('xyz', SHIFT, strict=True))}, cast(1 as double) as turn, cast(0 as double) as err")
def i02_j05_lidar_to_dem(spark, d):
    """A DEM onto lidar points moved by a known shift, less than half a pixel, so the motion is known."""
    r, t, errors = registration.lidar_to_dem(lidar(spark, d, SHIFT), M.candidates(spark, d), 2, (32.0, 0.0, 0.0))
    return spark.createDataFrame(
        [(len(errors), *(round(float(v), 4) for v in t), round(float(np.trace(r)) / 3, 6), round(errors[-1], 4) + 0.0)], "rounds int, tx double, ty double, tz double, turn double, err double"
    )


PLACES = f"""select cast(x + y * 64 as bigint) as id, x, y, 0.0::double as err from v_raster where x % 8 = 0 and y % 8 = 0 and v > -0.05"""


@query(P.with_views(PLACES, "v_raster"))
def i02_lidar_matches(spark, d):
    """The DEM's pixel that each lidar point meets under the motion found, and how far off it is: its own pixel, nothing."""
    dem, features, center = M.candidates(spark, d), lidar(spark, d, SHIFT), (32.0, 0.0, 0.0)
    r, t, _ = registration.lidar_to_dem(features, dem, 2, center)
    found = matching.window_nearest(features, registration.moved_candidates(dem, r, t, center), ["id"], 2)
    return found.select("id", "x", "y", (F.round("dist", 4) + 0.0).alias("err"))


@query(
    P.with_views(
        """select cast(x + y * 64 as bigint) as id, x, y, cast(1 as integer) as start, 0.0::double as err from v_raster where x % 8 = 0 and y % 8 = 0 and v > -0.05""",
        "v_raster",
    )
)
def i05_start_matches(spark, d):
    """The best start of several, and what each point meets under its motion: the pixel that it came from."""
    starts = [(np.eye(3), np.array([30.0, 30.0, 0.0])), (np.eye(3), np.array([-2.1, 1.1, -0.4])), (np.eye(3), np.array([1e6, 0.0, 0.0]))]
    features, dem = lidar(spark, d, (2.0, -1.0, 0.5)), M.candidates(spark, d)
    best, found = registration.multi_start(features, dem, 2, starts, 2)
    r, t, _ = found[best]
    moved = [geo.dot([F.lit(float(v)) for v in r[i]], [F.col(f"f{c}") for c in "xyz"]) + float(t[i]) for i in range(3)]
    rows = features.select("id", *(m.alias(f"f{c}") for c, m in zip("xyz", moved, strict=True)))
    rows = rows.withColumn("px", F.round("fx").cast("int")).withColumn("py", F.round("fy").cast("int"))
    near = matching.window_nearest(rows, dem, ["id"], 2)
    return near.select("id", "x", "y", F.lit(best).alias("start"), (F.round("dist", 4) + 0.0).alias("err"))


@query("select cast(1 as integer) as best, cast(-2 as double) as tx, cast(1 as double) as ty, cast(-0.5 as double) as tz, cast(0 as double) as err")
def i05_multi_start(spark, d):
    """The start beside the known motion wins."""
    starts = [(np.eye(3), np.array([30.0, 30.0, 0.0])), (np.eye(3), np.array([-2.1, 1.1, -0.4])), (np.eye(3), np.array([1e6, 0.0, 0.0]))]
    best, found = registration.multi_start(lidar(spark, d, (2.0, -1.0, 0.5)), M.candidates(spark, d), 2, starts, 2)
    _, t, err = found[best]
    return spark.createDataFrame([(best, *(round(float(v), 4) + 0.0 for v in t), round(err, 4) + 0.0)], "best int, tx double, ty double, tz double, err double")


def surface(x, y):
    return 10 * F.sin(x / 9) + 8 * F.cos(y / 7) + 3 * F.sin((x + y) / 5)


def smooth(spark, d):
    """An image as large as the raster whose values follow a smooth surface, and points that see it moved by (4, 3)."""
    image = P.raster(spark, d).select("x", "y", surface(F.col("x"), F.col("y")).alias("v"))
    some = image.where("x between 8 and 52 and x % 2 = 0 and y >= 8 and y % 2 = 0").join(image.agg(F.max("y").alias("last"))).where("y < last - 12")  # one row
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return image, some.select(x.alias("px"), y.alias("py"), surface(x + 4, y + 3).alias("value"))


@query("select cast(1 as integer) as fits, cast(4 as double) as tx, cast(3 as double) as ty")
def i03_i04_coarse_to_fine(spark, d):
    """Level by level to the known shift, to a pixel; then a homography from beside it."""
    image, points = smooth(spark, d)
    m, _ = registration.coarse_to_fine(points, image, np.array([1.0, 0, 0, 0, 1, 0]), (4, 2, 1), 8)
    grid = registration.image_gradients(image)
    h, errors = registration.gauss_newton(lambda p: registration.alignment_rows(points, grid, p), np.array([1.0, 0, 3, 0, 1, 2, 0, 0, 1]), 8)
    u, v, w = h.reshape(3, 3) @ (30, 30, 1)
    near = m @ (30, 30, 1) - 30
    fits = abs(u / w - 34) < 0.7 and abs(v / w - 33) < 0.7 and errors[-1] <= errors[0]
    return spark.createDataFrame([(int(fits), float(round(near[0])), float(round(near[1])))], "fits int, tx double, ty double")


@query(P.with_views("select cast(x // 32 as bigint) as tx, cast(y // 32 as bigint) as ty, x, y, v from v_raster", "v_raster"))
def sc09_sk10_raster_files(spark, d):
    """The raster written as tiles of georeferenced files and read back; its values are 32-bit reals."""
    folder = P.scratch(spark)
    rasters.write_rasters(P.raster(spark, d), folder, 32, (0.0, 0.0, 1.0, -1.0), -9999.0)
    heads = rasters.raster_headers(spark, folder).select("path", "nodata", F.col("x0").cast("int").alias("x0"), (-F.col("y0")).cast("int").alias("y0"))
    rows = rasters.read_rasters(spark, folder).join(heads, "path").where(raster.valid_pixel(F.col("v"), -9999.0))
    x, y = F.col("x") + F.col("x0"), F.col("y") + F.col("y0")
    return rows.select(F.floor(x / 32).cast("long").alias("tx"), F.floor(y / 32).cast("long").alias("ty"), x.alias("x"), y.alias("y"), "v")
