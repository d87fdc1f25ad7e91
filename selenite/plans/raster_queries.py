"""Queries of the raster, tile and mosaic operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenite.functions import photometry
from selenite.operators import raster
from selenite.plans import proxies as P
from selenite.plans.catalog import query

BILINEAR = """select p.event_id, sum(w * v) as value from (
    select event_id, greatest(0, least(63, cast(floor(px) as integer) + i)) as x, greatest(0, least(h, cast(floor(py) as integer) + j)) as y,
    (case when i = 1 then px - floor(px) else 1 - (px - floor(px)) end) * (case when j = 1 then py - floor(py) else 1 - (py - floor(py)) end) as w
    from v_pix, (select cast(max(vec_id) as integer) as h from embeddings), range(0, 2) a(i), range(0, 2) b(j) where px <= 63 and py <= h) p join v_raster r on r.x = p.x and r.y = p.y group by p.event_id"""


@query(P.with_views(f"select event_id, round(value, 8) as value from ({BILINEAR})", "v_pix", "v_raster"))
def j01_bilinear_sample(spark, d):
    return P.rounded(raster.bilinear(P.pixels(spark, d), P.raster(spark, d), ["event_id"], 64, P.height(spark, d)), 8)


@query(
    P.with_views(
        f"""select event_id, round(value, 8) as value, value > (select min(v) from v_raster) * 0.3 and value < (select max(v) from v_raster) * 0.3
        and event_id % 40 >= 0 and event_id % 40 < 25 as valid from ({BILINEAR})""",
        "v_pix",
        "v_raster",
    )
)
def j02_f03_f04_gated_sample(spark, d):
    dem = P.raster(spark, d)
    found = raster.bilinear(P.pixels(spark, d), dem, ["event_id"], 64, P.height(spark, d)).withColumn("prec", (F.col("event_id") % 40).cast("double"))
    limits = raster.value_range(dem, -9999.0).select((F.col("v_min") * 0.3).alias("v_min"), (F.col("v_max") * 0.3).alias("v_max"))
    return P.rounded(raster.gate_by_range(found, limits, "prec").select("event_id", "value", "valid"), 8)


@query(
    P.with_views(
        """select event_id, coalesce(v, -1.0) as value from v_pix left join v_raster r on r.x = cast(trunc(px) as integer) and r.y = cast(trunc(py) as integer)""",
        "v_pix",
        "v_raster",
    )
)
def j03_nearest_sample(spark, d):
    return raster.nearest(P.pixels(spark, d), P.raster(spark, d), ["event_id"])


@query(P.with_views("select min(v) as v_min, max(v) as v_max, count(*) as n from v_raster where not isnan(v) and v <> 0", "v_raster"))
def a05_f02_raster_range(spark, d):
    rows = P.raster(spark, d).where(raster.valid_pixel(F.col("v"), 0.0))
    return rows.agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.count("*").alias("n"))


@query(P.with_views("select x, y, v from v_raster where x % 5 = 0 and y % 5 = 0 and v <> 0 and not isnan(v)", "v_raster"))
def f10_sk12_subsample(spark, d):
    return raster.subsample(P.raster(spark, d), 5, 5, 0.0)


@query(P.with_views("select x, y, round((v - a) / (b - a), 8) as v from v_raster, (select min(v) as a, max(v) as b from v_raster)", "v_raster"))
def p25_normalize(spark, d):
    return P.rounded(raster.normalize(P.raster(spark, d)), 8)


@query(
    P.with_views(
        """select x, y, cast(least(255, greatest(0, trunc((v + 1) * 255 / (select max(v + 1) from v_raster)))) as integer) as b from v_raster""", "v_raster"
    )
)
def p24_sc12_eight_bits(spark, d):
    rows = P.raster(spark, d).withColumn("u", F.col("v") + 1)
    rows = rows.join(F.broadcast(rows.agg(F.max("u").alias("largest"))))  # one row
    return rows.select("x", "y", photometry.to_eight_bits(F.col("u"), F.col("largest")).alias("b"))


@query(P.with_views("select x // 4 as x, y // 4 as y, round(avg(v), 8) as v from v_raster group by 1, 2", "v_raster"))
def o17_o18_pool(spark, d):
    return P.rounded(raster.pool(P.raster(spark, d), 4), 8)


@query(
    P.with_views(
        """select cast(floor(px / 10) as integer) as x, cast(floor(py / 10) as integer) as y, max_by(value, event_id) as v from v_pix group by 1, 2""", "v_pix"
    )
)
def o11_rasterize(spark, d):
    return raster.rasterize(P.pixels(spark, d), F.col("px") / 10, F.col("py") / 10, "value", ["event_id"])


@query(
    P.with_views(
        """select x, y, round(coalesce(0.75 * (lead(v, 1) over w - lag(v, 1) over w) - 0.15 * (lead(v, 2) over w - lag(v, 2) over w)
        + (lead(v, 3) over w - lag(v, 3) over w) / 60, 0.0), 8) as d from v_raster window w as (partition by y order by x)""",
        "v_raster",
    )
)
def w10_central_difference(spark, d):
    return P.rounded(raster.derivative(P.raster(spark, d)).select("x", "y", "d"), 8)


@query(
    P.with_views(
        """select x, y, max(v) over (partition by x order by y range between 1 preceding and 1 following) as v from (
        select x, y, max(v) over (partition by y order by x range between 1 preceding and 1 following) as v from v_raster)""",
        "v_raster",
    )
)
def w12_dilate(spark, d):
    return raster.dilate(P.raster(spark, d))


IMAGES = "(select s_suppkey as image, cast(100 + s_suppkey * 37 % 900 as integer) as width, cast(80 + s_suppkey * 53 % 700 as integer) as height from supplier)"


def images(spark, d):
    key = F.col("s_suppkey")
    rows = P.table(spark, d, "supplier")
    return rows.select(key.alias("image"), (100 + key * 37 % 900).cast("int").alias("width"), (80 + key * 53 % 700).cast("int").alias("height"))


def _axis(size: str, tile: int) -> str:
    step = tile - 16
    return f"case when {size} <= {tile} then [0] else [least(i * {step}, {size} - {tile}) for i in range(0, cast(greatest(1, ceil(({size} - 16) / {step}::double)) as bigint))] end"


@query(
    f"""select image, cast(x as integer) as x, cast(y as integer) as y, least(width, 256) as w, least(height, 192) as h from (
    select *, unnest({_axis("height", 192)}) as y from (select *, unnest({_axis("width", 256)}) as x from {IMAGES}))"""
)
def o06_tile_grid(spark, d):
    return raster.tile_grid(images(spark, d), 256, 192, 16)


PARAMETERS = f"""(select image, levels, cast(128 * power(2, levels) as bigint) as side, width, height from (
    select *, cast(greatest(0, ceil(log2(greatest(width, height) / 128.0))) as integer) as levels from {IMAGES}))"""


@query(f"select image, levels, side, (side - width) // 2 as offset_x, (side - height) // 2 as offset_y from {PARAMETERS}")
def o08_pyramid_parameters(spark, d):
    return raster.pyramid_parameters(images(spark, d), 128)


@query(
    f"""select image, level, h, v, case when level > 0 then array_to_string([cast(((h >> (level - 1 - k)) & 1) + 2 * ((v >> (level - 1 - k)) & 1) as varchar)
    for k in range(0, level)], '/') else '' end as path from (select image, cast(level as integer) as level, cast(h as integer) as h,
    cast(unnest(range(0, cast(power(2, level) as bigint))) as integer) as v
    from (select image, level, unnest(range(0, cast(power(2, level) as bigint))) as h from (select image, unnest(range(0, levels + 1)) as level from {PARAMETERS})))"""
)
def o09_p29_sk11_pyramid_tiles(spark, d):
    return raster.pyramid_tiles(raster.pyramid_parameters(images(spark, d), 128))


OVERLAY = "select cast(event_id % 50 as integer) as x, cast(event_id % 31 as integer) as y, case when event_id % 6 = 0 then 0.0 else round(value, 2) end as value from events"


@query(f"select x, y, round(sum(value) / nullif(count(case when value <> 0 then 1 end), 0), 6) as v, count(case when value <> 0 then 1 end) as n from ({OVERLAY}) group by x, y")
def a21_f19_mosaic(spark, d):
    key = F.col("event_id")
    value = F.when(key % 6 == 0, F.lit(0.0)).otherwise(F.round("value", 2)).alias("value")
    rows = P.table(spark, d, "events").select((key % 50).cast("int").alias("x"), (key % 31).cast("int").alias("y"), value)
    return P.rounded(raster.mosaic(rows, ["x", "y"], "value"))


LAYERS = "v_raster b left join (select x + 3 as x, y + 2 as y, v * 1.1 as v, (x + 5.0) * (x + 5.0) / 300 as acc from v_raster where v > 0.05) f on f.x = b.x and f.y = b.y"


def layers(spark, d):
    back = P.raster(spark, d)
    moved = back.where("v > 0.05").select(
        (F.col("x") + 3).alias("x"), (F.col("y") + 2).alias("y"), (F.col("v") * 1.1).alias("v"), ((F.col("x") + 5.0) * (F.col("x") + 5.0) / 300).alias("acc")
    )
    return back.withColumn("acc", F.lit(2.0)), moved


@query(P.with_views(f"select b.x, b.y, round(coalesce(f.v, b.v), 8) as v, round(coalesce(f.acc, 2.0), 8) as acc from {LAYERS}", "v_raster"))
def j10_j11_assemble(spark, d):
    return P.rounded(raster.assemble(*layers(spark, d), ["x", "y"]), 8)


@query(
    P.with_views(
        f"""select b.x, b.y, round(coalesce(w * f.v + (1 - w) * b.v, b.v), 8) as v, round(coalesce(1 / (w / f.acc + (1 - w) / 2.0), 2.0), 8) as acc from {LAYERS},
        lateral (select 2.0 / (f.acc + 2.0) as w)""",
        "v_raster",
    )
)
def j10_p15_p16_weighted_assemble(spark, d):
    return P.rounded(raster.assemble(*layers(spark, d), ["x", "y"], weighted=True), 8)


@query(
    P.with_views(
        """select round(avg(a.v - b.v), 8) as mean_diff, min(a.v - b.v) as min_diff, max(a.v - b.v) as max_diff, count(*) as n
        from v_raster a join v_raster b on b.x = a.x + 1 and b.y = a.y where a.x % 8 = 0 and a.y % 8 = 0""",
        "v_raster",
    )
)
def a14_i06_average_difference(spark, d):
    rows = P.raster(spark, d)
    other = rows.select((F.col("x") - 1).alias("x"), "y", F.col("v").alias("u"))
    both = raster.subsample(rows, 8, 8, -9999.0).join(raster.dealt(other), ["x", "y"])
    diff = F.col("v") - F.col("u")
    return both.agg(F.round(F.avg(diff), 8).alias("mean_diff"), F.min(diff).alias("min_diff"), F.max(diff).alias("max_diff"), F.count("*").alias("n"))


@query(
    P.with_views(
        "select x + 2 as x, y - 1 as y, max_by(v, y * 64 + x) as v from v_raster where v <> 0 group by 1, 2", "v_raster"
    )
)
def j12_scatter(spark, d):
    moved = P.raster(spark, d).where("v <> 0").withColumn("ord", F.col("y") * 64 + F.col("x"))
    out = raster.rasterize(moved, F.col("x") + 2, F.col("y") - 1, "v", ["ord"])
    return out


@query(P.with_views("select cast(z as integer) as zoom, cast(x // z as integer) as x, cast(y // z as integer) as y, round(avg(v), 8) as v from v_raster, (values (8), (4), (2), (1)) t(z) group by 1, 2, 3", "v_raster"))
def o17_pyramid(spark, d):
    return P.rounded(raster.pyramid(P.raster(spark, d)), 8)


@query(
    P.with_views(
        """select x, y, round(px - first(px) over w, 3) as px, round(py - first(py) over w, 3) as py, round(pz - first(pz) over w, 3) as pz from (
        select x, y, r * cos(lat) * cos(lon) as px, r * cos(lat) * sin(lon) as py, r * sin(lat) as pz from (
        select x, y, 1737400 + v * 1000 as r, radians(30 + x * 0.01) as lon, radians(20 + y * -0.001) as lat from v_raster where x % 20 = 0 and y % 20 = 0))
        window w as (order by y, x rows between unbounded preceding and unbounded following)""",
        "v_raster",
    )
)
def sk12_origin_cloud(spark, d):
    heights = P.raster(spark, d).select("x", "y", (F.col("v") * 1000).alias("v"))
    return P.rounded(raster.origin_cloud(heights, (30, 20, 0.01, -0.001), 1737400.0), 3)


BOXES = """(select s_suppkey as image, (s_suppkey * 37 % 900)::double as l, (s_suppkey * 53 % 700)::double as t, (s_suppkey * 37 % 900 + 130 + s_nationkey)::double as r, (s_suppkey * 53 % 700 + 200.5)::double as b,
    (s_suppkey % 64)::bigint as ox, (s_suppkey % 50)::bigint as oy, 1 + s_nationkey / 4.0::double as back_res, case when s_suppkey % 3 = 0 then 0.01 else 0.3 end::double as fore_res from supplier)"""


@query(
    f"""select image, h, v, h * 128 - ox - 4 as xl, h * 128 - ox + 128 + 6 as xr, v * 128 - oy - 5 as yt, v * 128 - oy + 128 + 7 as yb, 'assembled_' || h || '_' || v || '_dem.tif' as name,
    'assembled_' || h || '_' || v || '_acc.tif' as acc_name, 'assembled_' || h || '_' || v || '_pc.txt' as pc_name, up as back_up, round(up / (back_res / fore_res), 6) as fore_up from (
    select *, pow(2.0, ceil(log2(back_res / greatest(fore_res, 0.03125)))) as up, unnest(range(cast(floor((t + oy) / 128) as bigint), cast(ceil((b + oy) / 128) as bigint))) as v from (
    select *, unnest(range(cast(floor((l + ox) / 128) as bigint), cast(ceil((r + ox) / 128) as bigint))) as h from {BOXES}))"""
)
def o09_sub_pyramid_tiles(spark, d):
    """The tiles under a box of each supplier, snapped to tile breaks and padded, with their files' names."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    left, top = (k * 37 % 900).cast("double"), (k * 53 % 700).cast("double")
    boxes = P.table(spark, d, "supplier").select(
        k.alias("image"), left.alias("left"), top.alias("top"), (left + 130 + n).alias("right"), (top + 200.5).alias("bottom"), (k % 64).alias("offset_x"), (k % 50).alias("offset_y"),
        (1 + n / 4.0).alias("back_res"), F.when(k % 3 == 0, 0.01).otherwise(0.3).alias("fore_res"),
    )
    return P.rounded(raster.sub_pyramid_tiles(boxes, 128, (4, 5, 6, 7)))
