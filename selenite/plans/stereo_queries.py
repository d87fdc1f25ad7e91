"""Queries of the stereo and frame operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from selenite.operators import frames, ransac, sfm, stereo
from selenite.plans import match_queries as M
from selenite.plans import proxies as P
from selenite.plans.catalog import query

LEFT = "(select x, y, cast(round(v * 1000) as bigint) as v from v_raster)"
RIGHT = "(select x - 2 - (y // 50) % 3 as x, y, cast(round(v * 1000) as bigint) + (x * y) % 3 as v from v_raster)"


def images(spark, d):
    """The raster as a left image and, moved by two to four columns in bands and with a little noise, as a right one."""
    x, y = F.col("x"), F.col("y")
    left = P.raster(spark, d).select("x", "y", F.round(F.col("v") * 1000).cast("long").alias("v"))
    right = left.select((x - 2 - F.floor(y / 50) % 3).cast("int").alias("x"), "y", (F.col("v") + (x * y) % 3).alias("v"))
    return left, right


VOLUME = f"""(select x, y, d, cast(sad as bigint) as sad from (select x, y, d, sum(ad) over w as sad, sum(n) over w as n from (
    select x, y, d, sum(ad) over w as ad, count(*) over w as n from (
        select l.x, l.y, d, abs(l.v - r.v) as ad from (select *, x - d as xr from {LEFT}, range(0, 6) t(d)) l join {RIGHT} r on r.x = l.xr and r.y = l.y)
    window w as (partition by d, y order by x range between 1 preceding and 1 following))
    window w as (partition by d, x order by y range between 1 preceding and 1 following)) where n = 9)"""

MATCHED = f"""(select x, y, d, sad from (select *, row_number() over (partition by x, y order by sad, d) as k from (
    select x, y, d, sum(ad) over w as sad, sum(n) over w as n from (
        select x, y, d, sum(ad) over w as ad, count(*) over w as n from (
            select l.x, l.y, d, abs(l.v - r.v) as ad from (select *, x - d as xr from {LEFT}, range(0, 6) t(d)) l join {RIGHT} r on r.x = l.xr and r.y = l.y)
        window w as (partition by d, y order by x range between 2 preceding and 2 following))
    window w as (partition by d, x order by y range between 2 preceding and 2 following))
    where n = 25) where k = 1)"""


@query(P.with_views(f"select x, y, cast(d as integer) as d, cast(sad as bigint) as sad from {MATCHED}", "v_raster"))
def j21_block_matching(spark, d):
    return stereo.block_match(*images(spark, d), 6)


COSTS = f"""(select p.x, p.y, list(coalesce(c.sad, 1000000) order by t.d) as c from (select distinct x, y from {VOLUME}) p cross join range(0, 6) t(d)
    left join {VOLUME} c on c.x = p.x and c.y = p.y and c.d = t.d group by p.x, p.y)"""


def _paths(name: str, dx: int, dy: int) -> str:
    """Path costs along one direction, pixel after pixel."""
    near = "list_transform(range(1, 7), lambda i: c[i] + least(w.l[i], coalesce(w.l[i - 1], 1000000000) + 8, coalesce(w.l[i + 1], 1000000000) + 8, list_min(w.l) + 32) - list_min(w.l))"
    return f"""{name} as (select x, y, c as l from costs a where not exists (select 1 from costs b where b.x = a.x - {dx} and b.y = a.y - {dy})
        union all select a.x, a.y, {near.replace("c[i]", "a.c[i]")} from {name} w join costs a on a.x = w.x + {dx} and a.y = w.y + {dy})"""


SEMI_GLOBAL = f"""select x, y, cast(list_position(s, list_min(s)) - 1 as integer) as d, cast(list_min(s) as bigint) as cost from (
    select x, y, list_transform(range(1, 7), lambda i: list_sum(list_transform(list(l), lambda e: e[i]))) as s from (
    select * from w0 union all select * from w1 union all select * from w2 union all select * from w3) group by x, y)"""


@query(
    P.with_views(SEMI_GLOBAL, "v_raster").replace("with ", "with recursive ", 1).replace(
        SEMI_GLOBAL, f", costs as materialized {COSTS}, " + ", ".join(_paths(f"w{k}", *way) for k, way in enumerate(stereo.DIRECTIONS[:4])) + " " + SEMI_GLOBAL
    )
)
def j21_semi_global(spark, d):
    return stereo.semi_global_match(*images(spark, d), 6, directions=4)


def _window(f: str, axis: str, inner: str) -> str:
    other = "y" if axis == "x" else "x"
    return f"(select x, y, {f}(v) over (partition by {other} order by {axis} range between 2 preceding and 2 following) as v from {inner})"


@query(P.with_views("select x, y, v from " + _window("max", "y", _window("max", "x", _window("min", "y", _window("min", "x", "v_raster")))), "v_raster"))
def w12_erode_dilate_twice(spark, d):
    return stereo.opened(P.raster(spark, d))


@query(
    P.with_views(
        f"""select x, y, cast(floor((d - a) / (b - a) * 255) as integer) as v from (select x, y, cast(d as double) as d from {MATCHED}),
        (select cast(min(d) as double) as a, cast(max(d) as double) as b from {MATCHED})""",
        "v_raster",
    )
)
def sk16_normalized_disparity(spark, d):
    return stereo.normalized_disparity(stereo.block_match(*images(spark, d), 6))


PARAMETERS = """select s_suppkey as image, cast(s_suppkey * 37 % 4000 + 100 as integer) as width, cast(s_suppkey * 53 % 3000 + 100 as integer) as height,
    cast(s_suppkey % 9 * 15 as integer) as tile_w, cast(s_suppkey % 8 * 15 as integer) as tile_h, cast(s_suppkey % 21 - 10 as integer) as least,
    cast(16 * (s_suppkey % 4 + 1) as integer) as disparities, cast(5 + 2 * (s_suppkey % 3) as integer) as window_size from supplier"""
TILES = f"""(select image, case when w <= xo then 2 * xo else w end as tile_w, case when h <= yo then 2 * yo else h end as tile_h, xo, yo from (
    select image, greatest(abs(least), abs(least + disparities)) * 2 + window_size + 1 as xo, window_size + 1 as yo,
    case when tile_w <= 0 or tile_h <= 0 then width else tile_w end as w0, case when tile_w <= 0 or tile_h <= 0 then height else tile_h end as h0,
    w0 + w0 % 2 as w, h0 + h0 % 2 as h from ({PARAMETERS})))"""


@query(
    f"""select image, tile_w, tile_h, xo as x_overlap, yo as y_overlap, cast(tile_w + xo // 2 as integer) as core_x, cast(0 as integer) as core_y,
    cast(tile_w - xo // 2 as integer) as core_w, tile_h as core_h from {TILES}"""
)
def o07_disparity_tiles(spark, d):
    k = F.col("s_suppkey")
    rows = P.table(spark, d, "supplier").select(
        k.alias("image"), *(c.cast("int").alias(n) for n, c in {
            "width": k * 37 % 4000 + 100, "height": k * 53 % 3000 + 100, "tile_w": k % 9 * 15, "tile_h": k % 8 * 15, "least": k % 21 - 10,
            "disparities": 16 * (k % 4 + 1), "window": 5 + 2 * (k % 3),
        }.items())
    )
    tiles = stereo.tile_layout(rows)
    second = [F.col("tile_w"), F.lit(0), F.col("tile_w"), F.col("tile_h")]  # the tile beside the first
    core = stereo.tile_core(second, F.col("x_overlap"), F.col("y_overlap"))
    return tiles.select("*", *(c.alias(f"core_{n}") for n, c in zip("xywh", core, strict=True)))


Q = stereo.change_coordinates(
    np.array([[1.0, 0, 0, -31.5], [0, 1, 0, -250.0], [0, 0, 0, 700.0], [0, 0, 0.25, 0.0]]), np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]]), np.array([10.0, 20.0, 30.0])
)


def _product(row: int, x: str, y: str, z: str) -> str:
    return f"({x} * {Q[row, 0]} + {y} * {Q[row, 1]} + {z} * {Q[row, 2]} + {Q[row, 3]})"


@query(
    "select event_id, " + ", ".join(f"case when dd <> 0 then round({_product(i, 'xx', 'yy', 'dd')} / {_product(3, 'xx', 'yy', 'dd')}, 6) end as {c}" for i, c in enumerate("xyz"))
    + " from (select event_id, cast(event_id % 64 as double) as xx, cast(event_id % 500 as double) as yy, cast(event_id % 7 as double) as dd from events)"
)
def i13_p32_reproject(spark, d):
    """Pixels with disparities into space, by a matrix that a rigid motion has changed."""
    k = F.col("event_id")
    point = stereo.reproject(*((k % n).cast("double") for n in (64, 500, 7)), Q)
    return P.rounded(P.table(spark, d, "events").select("event_id", *(c.alias(n) for n, c in zip("xyz", point, strict=True))))


ALIGNED = """(select c as camera, track_id, shot_idx, shot_idx % 4 = 0 as feature, image > 0 as valid, refl, cast(x + c as double) as x, cast(y + c as double) as y,
    cast(x as double) as x_before, cast(y as double) as y_before from v_shot, range(0, 2) t(c))"""


def aligned(spark, d):
    """Shots as two cameras see them; every fourth is a feature."""
    c = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    rows = P.shots(spark, d).withColumn("camera", c)
    number = lambda a: a.cast("double")
    return rows.select(
        "camera", "track_id", F.col("shot_idx").cast("long").alias("shot_idx"), (F.col("shot_idx") % 4 == 0).alias("feature"), (F.col("image") > 0).alias("valid"), "refl",
        number(F.col("x") + F.col("camera")).alias("x"), number(F.col("y") + F.col("camera")).alias("y"), number(F.col("x")).alias("x_before"), number(F.col("y")).alias("y_before"),
    )


def points(spark, d):
    """A control point for each feature shot, numbered."""
    rows = sfm.ordinals(aligned(spark, d).where("camera = 0 and feature"), [], "track_id", "shot_idx")
    return rows.select("ordinal", "track_id", "shot_idx")


OBSERVED = "(select *, row_number() over (partition by camera order by track_id, shot_idx) - 1 as ordinal, valid and refl <> 0 and refl <> -1 as ok from {0} where feature)".format(ALIGNED)


@query(
    P.with_views(
        "select ordinal, track_id, shot_idx, camera, " + ", ".join(f"round(case when ok then {c} else -1 end, 6) as {c}" for c in ("x", "y", "x_before", "y_before")) + f" from {OBSERVED}",
        "v_shot",
    )
)
def j19_control_points(spark, d):
    """Control points meet each camera's feature shots by their running number."""
    return P.rounded(sfm.update_control_points(points(spark, d), aligned(spark, d)))


@query(
    P.with_views(
        f"""select 'gcp/points_' || track_id || '_' || shot_idx || '.gcp' as file, cast(0 as integer) as line_no, printf('%.6f %.6f %.6f %.6f %.6f %.6f ', track_id * 1.0, shot_idx * 1.0,
        0.0, 1.0, 1.0, 1.0) as value from {OBSERVED} where camera = 0 union all select 'gcp/points_' || track_id || '_' || shot_idx || '.gcp', cast(camera + 1 as integer),
        printf('camera%d %.6f %.6f', camera, case when ok then x else -1.0 end, case when ok then y else -1.0 end) from {OBSERVED}""",
        "v_shot",
    )
)
def sk06_control_point_files(spark, d):
    seen = sfm.update_control_points(points(spark, d), aligned(spark, d)).withColumn("camera", F.concat(F.lit("camera"), F.col("camera").cast("string")))
    place = points(spark, d).select(
        "ordinal", "track_id", "shot_idx", F.col("track_id").alias("lon"), F.col("shot_idx").alias("lat"), F.lit(0).alias("rad"),
        *(F.lit(1).alias(f"sigma_{c}") for c in ("lon", "lat", "rad")),
    )
    return sfm.control_point_lines(place, seen)


@query(
    """select a.n as line_no, c_name as "left", s_name as "right" from (select c_name, row_number() over (order by c_custkey) as n from customer) a
    join (select s_name, row_number() over (order by s_suppkey) as n from supplier) b on a.n = b.n"""
)
def j20_zipped_lists(spark, d):
    """Two lists of names, paired by line."""
    listed = lambda t, k, n: sfm.ordinals(P.table(spark, d, t).withColumn("_t", F.floor(F.col(k) / 1000)), [], "_t", k).select((F.col("ordinal") + 1).alias("line_no"), F.col(n).alias("name"))
    return sfm.zipped(listed("customer", "c_custkey", "c_name"), listed("supplier", "s_suppkey", "s_name"))


@query()
def j16_chain_links(spark, d):
    """Matches of each user's frames, linked by the pixels they share; tested against a plain search."""
    k = F.col("event_id")
    rows = P.table(spark, d, "events").select(
        "user_id", F.floor(k / 400).cast("long").alias("frame"), "event_id", (k % 17).cast("double").alias("px"), (k % 5).cast("double").alias("py"),
        (k * 3 % 17).cast("double").alias("qx"), (k * 2 % 5).cast("double").alias("qy"),
    )
    return sfm.chain_matches(rows, ["user_id"], "frame", ["event_id"], P.scratch(spark))


SUMS = ", ".join(f"sum(cast(r_{i} * m_{j} as double)) as s_{i}{j}" for i in "xyz" for j in "xyz")


@query(
    P.with_views(
        f"""select side, n, {", ".join(f"round(s_{i}{j}, 3) as s_{i}{j}" for i in "xyz" for j in "xyz")}, n >= 100 and abs(s_xx * (s_yy * s_zz - s_yz * s_zy)
        - s_xy * (s_yx * s_zz - s_yz * s_zx) + s_xz * (s_yx * s_zy - s_yy * s_zx)) >= 1e-6 as usable from (select id % 3 as side, count(*) as n, {SUMS} from {M.PAIRS} group by 1)""",
        "v_raster",
    )
)
def a20_cross_products(spark, d):
    rows = sfm.cross_products(M.pairs(spark, d).withColumn("side", F.col("id") % 3), ["side"])
    usable = (F.col("n") >= 100) & (F.abs("det") >= 1e-6)
    return P.rounded(rows.withColumn("usable", usable).drop("det"), 3)


FITTED = """(select track_id, shot_idx, (shot_id * 37 % 6300) / 100.0 as px, (shot_id * 91 % (select greatest(1, max(vec_id) * 100) from embeddings)) / 100.0 as py, refl,
    shot_idx % 3 = 0 as feature, cast(track_id % 5 as double) * 0.1 as gain, 0.01 as bias from v_shot)"""


@query(
    P.with_views(
        f"""select f.track_id, cast(f.shot_idx as bigint) as shot_idx, cast(coalesce(dx, 0) as integer) as dx, cast(coalesce(dy, 0) as integer) as dy, round(coalesce(err, 1e7), 8) as err
        from {FITTED} f left join (select * from (select *, row_number() over (partition by track_id, mid order by err, dy, dx) as k from (
            select s.track_id, mid, dy, dx, avg(abs(v - bias - gain * refl)) as err, count(*) as n from (
                select a.track_id, a.shot_idx as mid, b.gain, b.bias, b.refl, dx, dy, cast(floor(b.px) as integer) + dx as x, cast(floor(b.py) as integer) + dy as y
                from (select *, max(shot_idx) over (partition by track_id) as last from {FITTED}) a
                join {FITTED} b on a.track_id = b.track_id and b.shot_idx >= a.shot_idx - 3 and b.shot_idx < least(a.last, a.shot_idx + 3),
                range(-1, 2) i(dx), range(-1, 2) j(dy) where a.feature and a.refl not in (0, -1) and b.gain <> 0 and b.bias <> 0) s
            join v_raster r on r.x = s.x and r.y = s.y where s.x > 0 and s.y > 0 group by 1, 2, 3, 4) where n > 3) where k = 1) m on m.track_id = f.track_id and m.mid = f.shot_idx
        where f.feature and f.refl not in (0, -1)""",
        "v_shot",
        "v_raster",
    )
)
def j06_w11_patch_match(spark, d):
    k, span = F.col("shot_id"), max(1, (P.height(spark, d) - 1) * 100)
    shots = P.shots(spark, d).select(
        "track_id", F.col("shot_idx").cast("long").alias("shot_idx"), (k * 37 % 6300 / 100.0).alias("px"), (k * 91 % span / 100.0).alias("py"), "refl",
        (F.col("shot_idx") % 3 == 0).alias("feature"), (F.col("track_id") % 5 * 0.1).alias("gain"), F.lit(0.01).alias("bias"),
    )
    return P.rounded(sfm.patch_match(shots, P.raster(spark, d), 1, 1, 6, -9999.0), 8)


REPORTED = "(select s_suppkey as cand, " + ", ".join(f"cast(s_suppkey * {k + 1} % 10 as double) as d{k}" for k in range(6)) + ", cast(s_suppkey * 7 % 11 as double) as err from supplier)"


@query(
    P.with_views(
        f"""select 0 as section, cast(cand as bigint) as n, 'index=' || cand || {" || ".join(f"printf(' d[{k}]= %.6f', d{k})" for k in range(6))} || printf(' e=%.6f', err) as value from {REPORTED}
        union all select 1, 0, (select printf('bestTransformIndex = %d, smallest error = %.6f', cand, err) from {REPORTED} where err > 0 order by err, cand limit 1)
        union all select 2, 0, 'numTotalTracks = ' || count(distinct track_id) from v_shot
        union all select 3, track_id, printf('trackID: %d numShots: %d numFeatures: %d', track_id, count(*), count(case when shot_idx % 4 = 0 and image > 0 and refl <> 0 then 1 end))
        from v_shot group by track_id""",
        "v_shot",
    )
)
def sk09_matching_report(spark, d):
    k = F.col("s_suppkey")
    candidates = P.table(spark, d, "supplier").select(k.alias("cand"), *((k * (i + 1) % 10).cast("double").alias(f"d{i}") for i in range(6)), (k * 7 % 11).cast("double").alias("err"))
    return sfm.matching_report(candidates, aligned(spark, d).where("camera = 0"))


SEEN = """(select event_id % 7 as film, event_id as id, cast(event_id * 37 % 640 as double) as x, cast(event_id * 91 % 480 as double) as y,
    event_id % 5 = 0 as moved from events)"""


@query(
    f"""select film, id, pow(case when moved then id * 53 % 640 else hx / w end - hx / w, 2) + pow(case when moved then id * 29 % 480 else hy / w end - hy / w, 2) <= 9 as inlier
    from (select *, 1.1 * x + 0.05 * y + 12 as hx, -0.04 * x + 0.95 * y - 7 as hy, 0.0001 * x - 0.00005 * y + 1 as w from {SEEN})"""
)
def i10_outlier_mask(spark, d):
    """Pixels of seven films under a homography, every fifth moved elsewhere: which of them lie where the film's own model puts them."""
    e, x, y = F.col("event_id"), F.col("x"), F.col("y")
    seen = P.table(spark, d, "events").select((e % 7).alias("film"), e.alias("id"), (e * 37 % 640).cast("double").alias("x"), (e * 91 % 480).cast("double").alias("y"))
    w = 0.0001 * x - 0.00005 * y + 1
    there = {"u": ((1.1 * x + 0.05 * y + 12) / w, F.col("id") * 53 % 640), "v": ((-0.04 * x + 0.95 * y - 7) / w, F.col("id") * 29 % 480)}
    pairs = seen.select("*", *(F.when(F.col("id") % 5 == 0, other.cast("double")).otherwise(own).alias(c) for c, (own, other) in there.items()))
    return ransac.outlier_mask(pairs, ["film"], "homography").select("film", "id", "inlier")


FRAMES = 5


@query(
    f"""select film, frame, cast(case when frame = 0 then 0 else n end as bigint) as matches, frame > 0 as moved, round(cos(frame * a), 6) as c, round(sin(frame * a), 6) as s,
    round(cast(frame * (film + 1) as double), 4) as tx from (select vec_id // 128 as film, count(*) as n, (vec_id // 128 % 9 + 1) / 20.0 as a from embeddings group by vec_id // 128),
    (select cast(unnest(range(0, {FRAMES})) as bigint) as frame) where n >= 12"""
)
def i07_frame_loop(spark, d):
    """Films of 128 vectors, seen in five frames as key points of a scene that turns and moves; the pose of every frame."""
    film = F.floor(F.col("vec_id") / 128).cast("long")
    v = F.col("embedding")
    rows = P.table(spark, d, "embeddings").select(film.alias("film"), F.slice(v, 1, 16).alias("desc"), *((v[16 + k].cast("double") * 50).alias(c) for k, c in enumerate(("wx", "wy", "wz"))))
    whole = rows.groupBy("film").agg(F.count("*").alias("n")).where("n >= 12").select("film")
    rows = rows.join(whole, "film").withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1)).cast("array<long>")))
    angle = F.col("frame") * (F.col("film") % 9 + 1) / 20.0
    moved = F.col("wx") - (F.col("film") + 1) * F.col("frame")  # the pose of frame k: a turn of k steps about z, k steps along x
    place = {"x": F.cos(angle) * moved + F.sin(angle) * F.col("wy"), "y": -F.sin(angle) * moved + F.cos(angle) * F.col("wy"), "z": F.col("wz")}
    poses = frames.frame_poses(rows.select("film", "frame", "desc", *(c.alias(n) for n, c in place.items())), P.scratch(spark))
    near = lambda c, n: F.round(c, n) + 0.0
    return poses.select("film", "frame", "matches", "moved", near(F.col("r")[0], 6).alias("c"), near(F.col("r")[3], 6).alias("s"), near(F.col("t")[0], 4).alias("tx"))


@query(
    P.with_views(
        f"""select m.x, m.y, round((m.x - 32) / (d * 0.5), 6) as px, round((m.y - 20) / (d * 0.5), 6) as py, round(100 / (d * 0.5), 6) as pz, cast(floor(abs(v) * 255) as integer) as grey
        from {MATCHED} m join v_raster r on r.x = m.x and r.y = m.y where d > 0""",
        "v_raster",
    )
)
def sk16_stereo_points(spark, d):
    """Points of the disparities, with the image's values."""
    q = np.array([[1, 0, 0, -32], [0, 1, 0, -20], [0, 0, 0, 100], [0, 0, 0.5, 0]])
    grey = P.raster(spark, d).select("x", "y", F.floor(F.abs("v") * 255).cast("int").alias("v"))
    return P.rounded(stereo.stereo_points(stereo.block_match(*images(spark, d), 6), grey, q).withColumnRenamed("v", "grey"))
