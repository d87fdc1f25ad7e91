"""Queries of pyramids, boxes, crops, assembled layers, profiles, and of text files written and read."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenite.functions import geo
from selenite.operators import raster, sfm, tracks
from selenite.plans import proxies as P
from selenite.plans import stereo_queries as S
from selenite.plans import text_queries as T
from selenite.plans.catalog import query
from selenite.plans.raster_queries import BILINEAR
from selenite.sources import text

ROWS = "(select cast(max(vec_id) + 1 as integer) as h from embeddings)"
PLACES = f"""(select row_number() over () as event_id, * from (select level, tx, ty, i as ti, j as tj, (tx * 32 + i) * scale * 1.0 as px, (ty * 32 + j) * scale * 1.0 as py from (
    select level, cast(power(2, level) as integer) as scale from range(0, 3) t(level)), {ROWS}, lateral (select unnest(range(0, cast(ceil(ceil(64.0 / scale) / 32) as bigint))) as tx),
    lateral (select unnest(range(0, cast(ceil(ceil(h * 1.0 / scale) / 32) as bigint))) as ty), range(-2, 34) a(i), range(-2, 34) b(j)))"""


@query(
    P.with_views(
        f"""select cast(level as integer) as level, cast(tx as integer) as tx, cast(ty as integer) as ty, cast(ti as integer) as i, cast(tj as integer) as j,
        round(coalesce(value, {raster.FILL}), 8) as v from places left join ({BILINEAR.replace("v_pix", "places").replace("where px <=", "where px >= 0 and py >= 0 and px <=")}) b
        using (event_id)""",
        "v_raster",
    ).replace("with v_raster", f"with places as materialized ({PLACES[1:-1]}), v_raster")
)
def o10_padded_pyramid(spark, d):
    return P.rounded(raster.padded_pyramid(P.raster(spark, d), 64, P.height(spark, d), 32, 2, 3), 8)


SIDES = """(select s_suppkey as image, s_suppkey * 37 % 4000 + 100 as width, s_suppkey * 53 % 3000 + 100 as height from supplier)"""


@query(
    f"""select image, cast(level as integer) as level, cast(h as integer) as h, cast(v as integer) as v from (select *, unnest(range(greatest(0, least(last, fy0)), greatest(0, least(last, fy1)) + 1)) as v from (
    select *, unnest(range(greatest(0, least(last, fx0)), greatest(0, least(last, fx1)) + 1)) as h from (select *, cast(power(2, level) - 1 as bigint) as last,
    cast(floor((300 + ox) / (side / power(2, level))) as bigint) as fx0, cast(floor((900 + ox) / (side / power(2, level))) as bigint) as fx1,
    cast(floor((200 + oy) / (side / power(2, level))) as bigint) as fy0, cast(floor((700 + oy) / (side / power(2, level))) as bigint) as fy1 from (
    select *, unnest(range(0, levels + 1)) as level, cast(floor((side - width) / 2) as bigint) as ox, cast(floor((side - height) / 2) as bigint) as oy from (
    select *, 256 * power(2, levels) as side from (select *, cast(greatest(0, ceil(log2(greatest(width, height) / 256.0))) as bigint) as levels from {SIDES})))
    where 900 + ox >= 0 and 300 + ox <= side and 700 + oy >= 0 and 200 + oy <= side)))"""
)
def o09_tiles_in_box(spark, d):
    k = F.col("s_suppkey")
    images = P.table(spark, d, "supplier").select(k.alias("image"), (k * 37 % 4000 + 100).alias("width"), (k * 53 % 3000 + 100).alias("height"))
    return raster.tiles_in_box(raster.pyramid_parameters(images, 256), 256, (300, 200, 900, 700))


@query(
    P.with_views(
        "select x, y, round(avg(v), 8) as v from (select (x - 5) // 2 as x, (y - 7) // 2 as y, v from v_raster where x between 5 and 34 and y between 7 and 66) group by 1, 2", "v_raster"
    )
)
def o18_crop_and_reduce(spark, d):
    return P.rounded(raster.pool(raster.crop(P.raster(spark, d), 5, 7, 30, 60), 2), 8)


#: A turn by a right angle with a stretch, and a shift: the foreground's motion on the background.
FORWARD = ((0.0, -0.5, 40.0), (4.0, 0.0, 3.0))
FORE = "(select x, y, v * 1.1 as v, (x + 5.0) * (x + 5.0) / 300 as acc from v_raster where v > 0.05)"


def fore(spark, d):
    x = F.col("x") + 5.0
    return P.raster(spark, d).where("v > 0.05").select("x", "y", (F.col("v") * 1.1).alias("v"), (x * x / 300).alias("acc"))


@query(
    P.with_views(
        f"""select b.x, b.y, round(coalesce(f.v, b.v), 8) as v, round(coalesce(f.acc, 2.0), 8) as acc from (select *, cast(floor((y - 3.0) / 4 + 0.5) as integer) as fx,
        cast(floor((40.0 - x) * 2 + 0.5) as integer) as fy from v_raster) b left join {FORE} f on f.x = b.fx and f.y = b.fy""",
        "v_raster",
    )
)
def j10_assemble_by_inverse(spark, d):
    """Background pixels take the foreground that the inverse of its motion finds for them."""
    (_, b, c), (a, _, f) = FORWARD
    back = P.raster(spark, d).withColumn("acc", F.lit(2.0))
    return P.rounded(raster.assemble_at(back, fore(spark, d), ["x", "y"], (F.col("y") - f) / a, (F.col("x") - c) / b), 8)


@query(
    P.with_views(
        f"""select b.x, b.y, round(coalesce(w * f.v + (1 - w) * b.g, b.g), 8) as v, round(coalesce(1 / (w / f.acc + (1 - w) / 2.0), 2.0), 8) as acc from (
        select x, y, (x * 7 + y) % 50 * 1.0 as g, cast(floor(x - 3 + v * 4 + 0.5) as integer) as fx, cast(floor(y + v * 2 + 0.5) as integer) as fy from v_raster) b
        left join {FORE} f on f.x = b.fx and f.y = b.fy, lateral (select 2.0 / (f.acc + 2.0) as w)""",
        "v_raster",
    )
)
def j11_image_over_heights(spark, d):
    """An image's pixels meet the foreground where the height under them carries them back, blended by accuracy."""
    dem = P.raster(spark, d)
    back = dem.select("x", "y", ((F.col("x") * 7 + F.col("y")) % 50 * 1.0).cast("double").alias("v"), F.col("v").alias("height"), F.lit(2.0).alias("acc"))
    return P.rounded(raster.assemble_at(back, fore(spark, d), ["x", "y"], F.col("x") - 3 + F.col("height") * 4, F.col("y") + F.col("height") * 2, weighted=True), 8)


@query(
    """select event_id, round(x / s, 6) as ax, round(y / s, 6) as ay, round(z / s, 6) as az, round(atan2(s, t), 6) as angle from (select *, sqrt(x * x + y * y + z * z) as s from (
    select event_id, cos(a) * sin(b) + sin(b) as x, sin(a) * cos(b) + sin(a) as y, -sin(a) * sin(b) as z, cos(a) + cos(b) + cos(a) * cos(b) - 1 as t
    from (select event_id, radians(event_id % 80 + 1) as a, radians(event_id % 70 + 1) as b from events)))"""
)
def p12_axis_angle(spark, d):
    """A turn about x, then about y, as one turn."""
    k = F.col("event_id")
    a, b = F.radians(k % 80 + 1), F.radians(k % 70 + 1)
    zero = F.lit(0.0)
    r = [[F.cos(a), F.sin(a) * F.sin(b), F.sin(a) * F.cos(b)], [zero, F.cos(b), -F.sin(b)], [-F.sin(a), F.cos(a) * F.sin(b), F.cos(a) * F.cos(b)]]
    found = geo.axis_angle(r)
    return P.rounded(P.table(spark, d, "events").select("event_id", *(c.alias(n) for n, c in zip(("ax", "ay", "az", "angle"), found, strict=True))))


@query(
    P.with_views(
        """select track_id, cast(l as integer) as line_no, string_agg(printf('%.6f', case l when 0 then z when 1 then x when 2 then refl * 1.000000001 else image end), ' ' order by shot_idx) as value
        from (select *, count(*) over (partition by track_id) as n_valid from v_shot where refl >= 0 and image >= 0), range(0, 4) t(l) where n_valid >= 8 group by 1, 2""",
        "v_shot",
    )
)
def sk07_profile_lines(spark, d):
    """Four lines a track; tracks with too few valid points have none."""
    profile = tracks.track_profile(P.shots(spark, d), ["track_id"], "shot_idx", "refl", "image", 8)
    profile = profile.withColumn("refl", F.col("refl") * 1.000000001)  # no value lies between two of six decimals
    return tracks.profile_lines(profile, ["track_id"], "shot_idx", ["z", "x", "refl", "image"])


@query(
    """select user_id, printf('%.6f %.6f %.6f %d ', avg(x), avg(y), avg(z), count(*)) || string_agg(event_id || printf(' %.6f %.6f', px, py), ' ' order by event_id) as value from (
    select user_id, event_id, cast(event_id % 50 as double) as x, cast(event_id % 20 as double) as y, cast(event_id % 10 as double) as z, cast(event_id % 64 as double) as px,
    cast(event_id % 48 as double) as py from events) group by user_id"""
)
def sk14_projection_lines(spark, d):
    k = F.col("event_id")
    part = lambda n, c: (k % n).cast("double").alias(c)
    rows = P.table(spark, d, "events").select("user_id", "event_id", part(50, "x"), part(20, "y"), part(10, "z"), part(64, "px"), part(48, "py"))
    return sfm.projection_lines(rows, "user_id", "event_id")


@query(
    P.with_views(
        f"""select a.track_id, a.shot_idx, a.x, a.y, b.x as u, b.y as v from {S.ALIGNED} a join {S.ALIGNED} b on a.track_id = b.track_id and a.shot_idx = b.shot_idx
        where a.camera = 0 and b.camera = 1 and a.valid and b.valid""",
        "v_shot",
    )
)
def j18_paired_tracks(spark, d):
    shots = S.aligned(spark, d)
    return sfm.paired_rows(shots.where("camera = 0"), shots.where("camera = 1"), ["track_id", "shot_idx"])


@query(
    """select date_trunc('second', ts) as ts, cast(event_id % 360 as double) as lon, cast(event_id % 90 as double) as lat, cast(1737 + event_id % 5 as double) as rad_km,
    cast(event_id % 5 + 1 as integer) as s from events where event_id % 360 <= 300"""
)
def sc02_f01_lidar_files(spark, d):
    """Lines written to a file and read back as returns; of these the ones in range."""
    folder = P.scratch(spark)
    text.write_lines(T.csv_lines(spark, d), folder, "line")
    rows = text.lidar_returns(text.lines(spark, folder)).where(tracks.in_range(F.col("lon"), F.col("lat"), F.col("rad_km")) & (F.col("lon") <= 300))
    return rows.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "lon", "lat", "rad_km", "s")


@query("select try_cast(token as double) as token, count(*) as n from (select unnest([event_type, cast(user_id as varchar)]) as token from events) group by 1")
def sc05_sc19_number_tokens(spark, d):
    """Tokens of files as numbers; words are none."""
    folder = P.scratch(spark)
    text.write_lines(P.table(spark, d, "events").select(F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("value")), folder)
    return text.tokens(text.lines(spark, folder), "double").groupBy("token").agg(F.count("*").alias("n"))
