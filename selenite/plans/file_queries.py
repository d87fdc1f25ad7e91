"""Queries that write files of rasters and read them back by ranges of bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenite.plans import proxies as P
from selenite.plans.catalog import query
from selenite.sources import appended, labels, rasters


@query(
    P.with_views(
        """select cast(y // 128 as bigint) as image, cast(0 as integer) as band, x, cast(y % 128 as integer) as y, cast(floor(abs(v) * 10000) as double) as v
        from v_raster where x between 5 and 24 and y % 128 between 10 and 59 and y // 128 < (select max(y) + 1 from v_raster) // 128""",
        "v_raster",
    )
)
def sc13_planetary_windows(spark, d):
    """The raster as planetary images of 128 rows, and of each whole one a window of 20 x 50 pixels."""
    folder = P.scratch(spark)
    image = F.floor(F.col("y") / 128).cast("long")
    pixels = P.raster(spark, d).select(image.alias("image"), "x", (F.col("y") % 128).cast("int").alias("y"), F.floor(F.abs("v") * 10000).alias("v"))
    rasters.write_pds(pixels.where(image_whole(P.height(spark, d))), folder, ["image"])
    rows = rasters.read_pds(spark, f"{folder}/*.img", (5, 10, 20, 50))
    return rows.select(F.regexp_extract("path", r"(\d+)\.img$", 1).cast("long").alias("image"), "band", "x", "y", "v")


def image_whole(height: int) -> F.Column:
    return F.col("image") < height // 128


LEVELS = "(select cast(greatest(1, ceil(log2(greatest(64, max(y) + 1) / 32.0))) as integer) as n from v_raster)"


@query(
    P.with_views(
        f"""select level, x, y, v from (select cast(level as integer) as level, cast(x // power(2, n - level) as integer) as x, cast(y // power(2, n - level) as integer) as y, v
        from (select *, unnest(range(0, n + 1)) as level from v_raster, {LEVELS})
        where x % cast(power(2, n - level) as integer) = 0 and y % cast(power(2, n - level) as integer) = 0)""",
        "v_raster",
    )
)
def sk11_quad_tiles(spark, d):
    """Every 2 ** k-th pixel of the raster as levels of raw tiles in quad-tree folders, read back without the fill."""
    folder, height = P.scratch(spark), P.height(spark, d)
    levels = (-(-max(64, height) // 32) - 1).bit_length()
    step = F.pow(F.lit(2), F.lit(levels) - F.col("level")).cast("int")
    rows = P.raster(spark, d).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    rasters.write_quad_tiles(rows.select("level", (F.col("x") / step).cast("int").alias("x"), (F.col("y") / step).cast("int").alias("y"), "v"), folder, 32, -9999.0)
    return rasters.read_quad_tiles(spark, folder, 32).where("v <> -9999")


@query(
    P.with_views(
        """select tile, cast(px as double) as px, cast(py as double) as py, pz, grey from (select 'tile_' || (x // 32) || '_' || (y // 32) as tile, x / 2.0 as px, y / 4.0 as py, floor(v * 10000) / 10000.0 as pz,
        cast(least(255, floor(abs(v) * 1000)) as integer) as grey from v_raster where x % 3 = 0)""",
        "v_raster",
    )
)
def sk13_mosaic_clouds(spark, d):
    """A mosaic's tiles with their points, of which the clouds are read back."""
    folder, v = P.scratch(spark), F.col("v")
    place = [F.when(F.col("x") % 3 == 0, c.cast("double")).alias(n) for c, n in ((F.col("x") / 2, "px"), (F.col("y") / 4, "py"), (F.floor(v * 10000) / 10000.0, "pz"))]
    rasters.write_mosaic_tiles(P.raster(spark, d).select("x", "y", F.floor(F.abs(v) * 1000).cast("double").alias("v"), *place), folder, 32)
    lines = spark.read.text(f"{folder}/*_point_cloud.txt").select(F.split("value", " ").alias("p"), F.col("_metadata.file_path").alias("path"))
    number = lambda i, n: F.col("p")[i].cast("double").alias(n)
    tile = F.regexp_extract("path", r"(tile_\d+_\d+)_point", 1).alias("tile")
    return lines.select(tile, number(0, "px"), number(1, "py"), number(2, "pz"), F.col("p")[3].cast("int").alias("grey"))


@query(
    P.with_views(
        "select tile, x, y, v from (select 'tile_' || (x // 32) || '_' || (y // 32) as tile, cast(x % 32 as integer) as x, cast(y % 32 as integer) as y, cast(least(255, floor(abs(v) * 1000)) as double) as v from v_raster) where v > 0",
        "v_raster",
    )
)
def sk13_mosaic_images(spark, d):
    """A mosaic's tiles, of which the images are read back."""
    folder = P.scratch(spark)
    pixels = P.raster(spark, d).select("x", "y", F.floor(F.abs("v") * 1000).cast("double").alias("v"), *(F.lit(None).cast("double").alias(c) for c in ("px", "py", "pz")))
    rasters.write_mosaic_tiles(pixels, folder, 32)
    tile = F.regexp_extract("path", r"(tile_\d+_\d+)\.tif$", 1).alias("tile")
    return rasters.read_rasters(spark, f"{folder}/*.tif").select(tile, "x", "y", "v").where("v > 0")


@query(
    P.with_views(
        """select cast(y // 96 as bigint) as cube, x, cast(y % 96 as integer) as y, case when (x + y) % 7 <> 0 then v end as v from v_raster
        where x between 20 and 50 and y % 96 between 3 and 60""",
        "v_raster",
    )
)
def sc10_camera_cubes(spark, d):
    """The raster as tiled camera cubes of 96 rows with missing pixels, read back in a window; what was missing is null."""
    folder, y = P.scratch(spark), F.col("y")
    pixels = P.raster(spark, d).select(F.floor(y / 96).cast("long").alias("cube"), "x", (y % 96).cast("int").alias("y"), F.when((F.col("x") + y) % 7 != 0, F.col("v")).alias("v"))
    rasters.write_cubes(pixels, folder, ["cube"], (32, 16))
    rows = rasters.read_cubes(spark, f"{folder}/*.cub", x=20, y=3, width=31, height=58)
    return rows.select(F.regexp_extract("path", r"(\d+)\.cub$", 1).cast("long").alias("cube"), "x", "y", "v")


def label(spark, d):
    """(id, t): a label for each supplier, whose numbers come from its key and nation."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    part = lambda c: c.cast("string") if isinstance(c, F.Column) else F.lit(c)
    axes = [["  MODEL_COMPONENT_", str(i), " = (", k + i, ", ", n, ".5, -", i + k * 0, ")\n"] for i in range(1, 7)]
    pieces = [
        "PDS_VERSION_ID = PDS3 /* of ", k, " */\nROVER_MOTION_COUNTER = (1, 2,\n   3, ", n, ", 5)\nFRAME_ID = \"", F.element_at(F.array(F.lit("LEFT"), F.lit("RIGHT"), F.lit("MONO")), (k % 3 + 1).cast("int")),
        "\"\nSPACECRAFT_CLOCK_START_COUNT = \"", k * 1000, ".25\"\nLOCAL_TRUE_SOLAR_TIME = \"", 10 + k % 10, ":30:15\"\nOBJECT = IMAGE\n  LINES = ", 512 + k,
        "\n  LINE_SAMPLES = 256 <pixel>\n  GROUP = BANDS\n    NAMES = (\"RED, ", n, "\", BLUE)\n  END_GROUP = BANDS\nEND_OBJECT = IMAGE\nGROUP = GEOMETRIC_CAMERA_MODEL_PARMS\n",
        *(x for i, row in enumerate(axes) for x in (row if i < 4 else [F.when(n % 2 == 0, F.concat(*map(part, row))).otherwise(F.lit(""))])),
        "END_GROUP\n/* COORDINATE SYSTEM STATE: ROVER */\nORIGIN_OFFSET_VECTOR = (", k, ",", n, ",0.5)\nORIGIN_ROTATION_QUATERNION = (1,0,", n, ",0)\nGROUP = SITE_DERIVED_GEOMETRY_PARMS\n  SOLAR_AZIMUTH = ", n,
        ".5 <deg>\n  SOLAR_ELEVATION = -", n, "\nEND_GROUP\nGROUP = DERIVED_IMAGE_PARMS\n  RADIANCE_OFFSET = ", F.when(k % 5 == 0, F.lit('"NULL"')).otherwise((k / 4.0).cast("string")),
        "\n  RADIANCE_SCALING_FACTOR = 2.0e-3 <x>\nEND_GROUP\nEND\nBEHIND = 1\n",
    ]
    return P.table(spark, d, "supplier").select(k.alias("id"), F.concat(*map(part, pieces)).alias("t"))


def scanned(spark, d, columns):
    found = columns(F.col("t"))
    return label(spark, d).select("id", *(c.alias(n) for n, c in found.items()))


AXIS = ", ".join(f"case when {i} <= 4 or s_nationkey % 2 = 0 then [s_suppkey + {i}, s_nationkey + 0.5, -{i}]::double[] end as {c}" for i, c in enumerate("cahvor", 1))


@query(f"select s_suppkey as id, {AXIS}, s_nationkey % 2 = 0 as got_or from supplier")
def sc14_camera_axes(spark, d):
    return scanned(spark, d, labels.camera_axes)


@query("select s_suppkey as id, s_nationkey + 0.5::double as azimuth, -s_nationkey::double as elevation, ((10 + s_suppkey % 10) * 3600 + 30 * 60 + 15)::double as solar_seconds from supplier")
def sc14_site_geometry(spark, d):
    return scanned(spark, d, labels.site_geometry)


@query("select s_suppkey as id, s_suppkey * 1000 + 0.25::double as clock, cast(case s_suppkey % 3 when 0 then 1 when 1 then 2 else 0 end as integer) as eye, cast(s_nationkey as integer) as mast from supplier")
def sc14_frame_identity(spark, d):
    return scanned(spark, d, labels.frame_identity)


@query("select s_suppkey as id, [s_suppkey, s_nationkey, 0.5]::double[] as \"offset\", [1, 0, s_nationkey, 0]::double[] as rotation from supplier")
def sc14_rover_origin(spark, d):
    return scanned(spark, d, labels.rover_origin)


@query("select s_suppkey as id, cast(512 + s_suppkey as integer) as rows, cast(256 as integer) as columns from supplier")
def sc14_image_size(spark, d):
    return scanned(spark, d, labels.image_size)


@query("select s_suppkey as id, case when s_suppkey % 5 <> 0 then 0.002::double end as scale, case when s_suppkey % 5 <> 0 then s_suppkey / 4.0::double end as bias from supplier")
def sc15_radiance(spark, d):
    return scanned(spark, d, labels.radiance)


@query(
    """select s_suppkey as id, within, keyword, case i when 0 then 'PDS3' when 1 then cast(512 + s_suppkey as varchar) when 2 then '256' else 'RED, ' || s_nationkey || '|BLUE' end as value from supplier,
    (values (0, '', 'PDS_VERSION_ID'), (1, 'IMAGE', 'LINES'), (2, 'IMAGE', 'LINE_SAMPLES'), (3, 'IMAGE/BANDS', 'NAMES')) t(i, within, keyword)"""
)
def sc14_label_statements(spark, d):
    """Some of the statements of nested labels, lists with their entries."""
    rows = labels.statements(label(spark, d), "t", ["id"])
    some = rows.where("keyword = 'PDS_VERSION_ID' or keyword = 'BEHIND' or within like 'IMAGE%'")
    return some.select("id", "within", "keyword", F.array_join(labels.listed(F.col("value")), "|").alias("value"))


@query("select event_id, user_id, round(value, 6) as x, cast(event_id % 256 as integer) as grey from events")
def sk15_appended_clouds(spark, d):
    """Points appended frame after frame, one frame twice as after a failure."""
    folder, e = P.scratch(spark), F.col("event_id")
    rows = P.table(spark, d, "events").select("event_id", "user_id", F.round("value", 6).alias("x"), (e % 256).cast("int").alias("grey"))
    for batch in (0, 1, 1, 2, 0):
        appended.append_batch(rows.where(e % 3 == batch), folder, batch)
    return appended.read_appended(spark, folder, rows.schema)


@query(
    """select s_suppkey as id, s_suppkey + 0.5::double as sample, s_nationkey + 0.25::double as line, -s_nationkey::double as min_lon, s_nationkey + 1::double as max_lon, -5.5::double as min_lat,
    s_suppkey % 80::double as max_lat, cast(1000 + s_suppkey as integer) as columns, cast(512 as integer) as rows, cast(s_suppkey as integer) as x, cast(s_nationkey as integer) as y from supplier"""
)
def sc24_tool_reports(spark, d):
    """What camera tools report of places and images, read from their texts."""
    k, n = (F.col(c).cast("string") for c in ("s_suppkey", "s_nationkey"))
    t = lambda *parts: F.concat(*(x if isinstance(x, F.Column) else F.lit(x) for x in parts))
    high = (F.col("s_suppkey") % 80).cast("string")
    place = t("Group = GroundPoint\n  Sample  = ", k, ".5 <pixels>\n  Line = ", n, ".25\nEnd_Group\n")
    reach = t(
        "Group = Target\n  MaximumLatitude = 1\nEnd_Group\nGroup = UniversalGroundRange\n  MinimumLatitude = -5.5 <degrees>\n  MaximumLatitude = ", high,
        "\n  MaximumLongitude = 400\nEnd_Group\nGroup = PositiveEast180\n  MinimumLongitude = -", n, "\n  MaximumLongitude = ", (F.col("s_nationkey") + 1).cast("string"), "\nEnd_Group\n",
    )
    rows = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), place.alias("p"), reach.alias("r"), t("a,b,c,d,e,f\n1,2,3,4,", F.col("s_suppkey") + 1000, ",512,9\n").alias("s"), t("name,", k, ".75,", n, ".1\n").alias("f"))
    found = labels.reported_pixel(F.col("p")) | labels.reported_range(F.col("r")) | labels.reported_size(F.col("s")) | labels.reported_projection(F.col("f"))
    return rows.select("id", *(c.alias(name) for name, c in found.items()))
