"""Queries of the coordinate, camera and depth expressions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from selenite.functions import geo, photometry
from selenite.plans import proxies as P
from selenite.plans.catalog import query

PTS = "(select event_id, cast(event_id * 13 % 360 as double) - 180 as lon, cast(event_id * 7 % 179 as double) - 89 as lat, 1737.4 + value / 100 as rad from events)"


def points(spark, d):
    k = F.col("event_id")
    rows = P.table(spark, d, "events")
    return rows.select(
        "event_id", ((k * 13 % 360).cast("double") - 180).alias("lon"), ((k * 7 % 179).cast("double") - 89).alias("lat"), (1737.4 + F.col("value") / 100).alias("rad")
    )


XYZ = f"""(select event_id, rad * cos(radians(lat)) * cos(radians(lon)) as x, rad * cos(radians(lat)) * sin(radians(lon)) as y, rad * sin(radians(lat)) as z from {PTS})"""


def xyz(spark, d):
    p = geo.lon_lat_radius_to_xyz(F.col("lon"), F.col("lat"), F.col("rad"))
    return points(spark, d).select("event_id", *(c.alias(n) for c, n in zip(p, "xyz", strict=True)))


@query(f"select event_id, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from {XYZ}")
def p01_lon_lat_radius_to_xyz(spark, d):
    return P.rounded(xyz(spark, d))


@query(f"select event_id, round(degrees(atan2(y, x)), 6) as lon, round(degrees(asin(z / sqrt(x*x+y*y+z*z))), 6) as lat, round(sqrt(x*x+y*y+z*z) - 1737.4, 6) as height from {XYZ}")
def p02_xyz_to_geodetic(spark, d):
    p = geo.xyz_to_geodetic([F.col(c) for c in "xyz"], 1737.4)
    return P.rounded(xyz(spark, d).select("event_id", *(c.alias(n) for c, n in zip(p, ("lon", "lat", "height"), strict=True))))


@query(f"select event_id, round((lon - 3.5) / 0.01, 6) as px, round((lat - 20.0) / -0.02, 6) as py from {PTS}")
def p03_lon_lat_to_pixel(spark, d):
    g = [F.lit(v) for v in (0.01, 3.5, -0.02, 20.0)]
    p = geo.lon_lat_to_pixel(F.col("lon"), F.col("lat"), *g)
    return P.rounded(points(spark, d).select("event_id", p[0].alias("px"), p[1].alias("py")))


@query(f"select event_id, case when lon * 2 < -180 then lon * 2 + 360 when lon * 2 > 180 then lon * 2 - 360 else lon * 2 end as lon from {PTS}")
def p04_wrap_longitude(spark, d):
    return points(spark, d).select("event_id", geo.wrap_longitude(F.col("lon") * 2).alias("lon"))


@query("select track_id, shot_id, " + ", ".join(f"round(-n{c} / n, 8) + 0.0 as n{c}" for c in "xyz") + """ from (select *, sqrt(nx*nx+ny*ny+nz*nz) as n from (
    select track_id, shot_id, uy*vz-uz*vy as nx, uz*vx-ux*vz as ny, ux*vy-uy*vx as nz from (select track_id, shot_id, x2-x1 as ux, y2-y1 as uy, z2-z1 as uz, x3-x1 as vx, y3-y1 as vy, z3-z1 as vz from ({0}))))
    where n > 0""".replace("{0}", P.with_views("select track_id, shot_id, " + ", ".join(f"max(case when pt_idx = {k} then {c} end) as {c}{k}" for k in (1, 2, 3) for c in "xyz") + " from v_return group by 1, 2 having count(*) >= 3", "v_return")))
def p05_face_normals(spark, d):
    cols = [F.max(F.when(F.col("pt_idx") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2, 3) for c in "xyz"]
    rows = P.returns(spark, d).groupBy("track_id", "shot_id").agg(F.count("*").alias("n"), *cols).where("n >= 3")
    p = [[F.col(f"{c}{k}") for c in "xyz"] for k in (1, 2, 3)]
    n = geo.cross(geo.sub(p[1], p[0]), geo.sub(p[2], p[0]))
    unit = photometry.face_normal(*p)
    out = rows.where(geo.norm(n) > 0).select("track_id", "shot_id", *((F.round(c, 8) + 0.0).alias(f"n{x}") for c, x in zip(unit, "xyz", strict=True)))
    return out


@query(
    f"""select event_id, round(case when mu0 < 0 or mu0 + greatest(mu, 0) = 0 then 0 else greatest(0, 2 * l * mu0 / (mu0 + greatest(mu, 0)) + (1 - l) * mu0) end, 6) as refl from (
    select *, 1 - 0.019 * a + 2.42e-4 * a * a - 1.46e-6 * a * a * a as l from (select event_id, sin(radians(lon)) as mu0, cos(radians(lat)) - 0.2 as mu, lat + 89 as a from {PTS}))"""
)
def p06_lunar_lambertian(spark, d):
    refl = photometry.lunar_lambertian(F.sin(F.radians("lon")), F.cos(F.radians("lat")) - 0.2, F.col("lat") + 89)
    return P.rounded(points(spark, d).select("event_id", refl.alias("refl")))


@query(f"select event_id, round(0.5 * lon + 0.1 * lat + 3, 6) as x, round(-0.2 * lon + 0.9 * lat - 1, 6) as y from {PTS}")
def p09_affine_rebase(spark, d):
    p = geo.affine([[0.5, 0.1, 3.0], [-0.2, 0.9, -1.0], [0.0, 0.0, 1.0]], F.col("lon"), F.col("lat"))
    return P.rounded(points(spark, d).select("event_id", p[0].alias("x"), p[1].alias("y")))


C30, S30 = math.cos(math.pi / 6), math.sin(math.pi / 6)
TURN = [[C30, -S30, 0.0], [S30, C30, 0.0], [0.0, 0.0, 1.0]]


@query(f"select event_id, round({C30!r} * (x - 10) - {S30!r} * (y - 20) + 10 + 1, 6) as x, round({S30!r} * (x - 10) + {C30!r} * (y - 20) + 20 + 2, 6) as y, round(z + 3, 6) as z from {XYZ}")
def p10_rigid_transform(spark, d):
    p = geo.rigid([F.col(c) for c in "xyz"], TURN, (1, 2, 3), (10, 20, 0))
    return P.rounded(xyz(spark, d).select("event_id", *(c.alias(n) for c, n in zip(p, "xyz", strict=True))))


@query(f"select event_id, round({C30!r} * (x - 1) + {S30!r} * (y - 2), 6) as x, round(-{S30!r} * (x - 1) + {C30!r} * (y - 2), 6) as y, round(z - 3, 6) as z from {XYZ} where z > 0")
def p11_i09_inverse_rigid(spark, d):
    p = geo.inverse_rigid([F.col(c) for c in "xyz"], TURN, (1, 2, 3))
    return P.rounded(xyz(spark, d).where("z > 0").select("event_id", *(c.alias(n) for c, n in zip(p, "xyz", strict=True))))


@query(f"select event_id, round(degrees(atan2(cos(a) * sin(b), cos(a) * cos(b))), 6) as ex, round(degrees(asin(sin(a))), 6) as ey, round(degrees(atan2(0, cos(a))), 6) as ez from (select event_id, radians(lat) as a, radians(lon / 2) as b from {PTS})")
def p12_euler_angles(spark, d):
    a, b = F.radians("lat"), F.radians(F.col("lon") / 2)
    zero = F.lit(0.0)
    r = [[F.cos(a), zero, zero], [zero, F.cos(b), -F.sin(b)], [-F.sin(a), F.cos(a) * F.sin(b), F.cos(a) * F.cos(b)]]
    e = geo.euler_xyz(r)
    return P.rounded(points(spark, d).select("event_id", *(c.alias(n) for c, n in zip(e, ("ex", "ey", "ez"), strict=True))))


@query(f"select event_id, round(1737400 * tan(radians(0.001 * lat)), 6) as mx, round(1737400 * tan(radians(0.002 * lat)), 6) as my from {PTS}")
def p13_translation_in_metres(spark, d):
    lat = F.col("lat")
    m = geo.translation_in_metres(0.001 * lat, 0.002 * lat, F.lit(0.0), F.lit(0.0), 1737400.0)
    return P.rounded(points(spark, d).select("event_id", m[0].alias("mx"), m[1].alias("my")))


@query("select s_suppkey as id, round((100 + s_suppkey) / abs(s_suppkey * 0.5 - 90.25), 6) as ppd from supplier")
def p17_pixels_per_degree(spark, d):
    k = F.col("s_suppkey")
    return P.rounded(P.table(spark, d, "supplier").select(k.alias("id"), geo.pixels_per_degree(100 + k, k * 0.5, F.lit(90.25)).alias("ppd")))


@query(f"select event_id, round((1 - 2 * q * q) * x - 2 * q * w * y, 6) as x, round(2 * q * w * x + (1 - 2 * q * q) * y, 6) as y, round(z, 6) as z from (select *, sin(radians(event_id % 90)) as q, cos(radians(event_id % 90)) as w from {XYZ})")
def p18_quaternion_rotation(spark, d):
    a = F.radians(F.col("event_id") % 90)
    r = geo.quaternion_to_rotation(F.cos(a), F.lit(0.0), F.lit(0.0), F.sin(a))
    p = geo.rotate(r, [F.col(c) for c in "xyz"])
    return P.rounded(xyz(spark, d).select("event_id", *(c.alias(n) for c, n in zip(p, "xyz", strict=True))))


@query(f"select event_id, round((500 * (x - 1) + 320 * (z + 2000)) / (z + 2000), 6) as px, round((500 * (y - 2) + 240 * (z + 2000)) / (z + 2000), 6) as py from {XYZ}")
def p19_cahv_projection(spark, d):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    p = geo.cahv_project([F.col(c) for c in "xyz"], lit(1, 2, -2000), lit(0, 0, 1), lit(500, 0, 320), lit(0, 500, 240))
    return P.rounded(xyz(spark, d).select("event_id", p[0].alias("px"), p[1].alias("py")))


@query("select s_suppkey as id, 320.0::double as hc, round(400.0 + s_suppkey, 6) as hs, round(2 * atan2(640.0, 2 * (400.0 + s_suppkey)), 8) as fov_x from supplier")
def p20_cahv_to_pinhole(spark, d):
    f = (400 + F.col("s_suppkey")).cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    m = geo.cahv_to_pinhole([zero, zero, one], [f, zero, F.lit(320.0)], [zero, f, F.lit(240.0)], F.lit(640.0), F.lit(480.0))
    return P.rounded(P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), m["hc"].alias("hc"), m["hs"].alias("hs"), m["fov_x"].alias("fov_x")), 8)


@query(f"select event_id, round(atan2(x, y), 8) as pan, round(atan2(-z, sqrt(x*x+y*y)), 8) as tilt from {XYZ}")
def p21_pan_tilt(spark, d):
    a = geo.pan_tilt([F.col(c) for c in "xyz"])
    return P.rounded(xyz(spark, d).select("event_id", a[0].alias("pan"), a[1].alias("tilt")), 8)


@query(f"select event_id, round(cos(radians(lat)) * sin(radians(lon)), 8) as x, round(cos(radians(lat)) * cos(radians(lon)), 8) as y, round(-sin(radians(lat)), 8) as z from {PTS}")
def p22_pan_tilt_vector(spark, d):
    v = geo.pan_tilt_to_vector(F.radians("lon"), F.radians("lat"))
    return P.rounded(points(spark, d).select("event_id", *(c.alias(n) for c, n in zip(v, "xyz", strict=True))), 8)


@query("select event_id, round(0.1236 * tan((event_id % 1000) / 2842.5 + 1.1863), 8) as depth from events where event_id % 1000 < 1000 and 0.1236 * tan((event_id % 1000) / 2842.5 + 1.1863) between 0 and 10000")
def p23_f17_depth(spark, d):
    depth = photometry.depth_to_metres(F.col("event_id") % 1000)
    return P.rounded(P.table(spark, d, "events").select("event_id", depth.alias("depth")).where(F.col("depth").between(0, 10000)), 8)


@query(f"select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from (select round({C30!r} * x - {S30!r} * y, 6) as x, round({S30!r} * x + {C30!r} * y, 6) as y from {XYZ})")
def a15_p33_transformed_extent(spark, d):
    p = geo.rigid([F.col(c) for c in "xyz"], TURN, (0, 0, 0))
    rows = P.rounded(xyz(spark, d).select(p[0].alias("x"), p[1].alias("y")))
    return rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query("""select s_suppkey as id, round(cast(greatest(0, x0 - 0.2 * (x1 - x0)) as double), 6) as x0, round(cast(least(100, x1 + 0.2 * (x1 - x0)) as double), 6) as x1 from (
    select s_suppkey, greatest(s_suppkey % 97, 20) * 1.0 as x0, least(s_suppkey % 97 + 15, 90) * 1.0 as x1 from supplier) where x0 < x1""")
def p34_expanded_box(spark, d):
    k = F.col("s_suppkey")
    rows = P.table(spark, d, "supplier").select(
        k.alias("id"), (F.greatest(k % 97, F.lit(20)) * 1.0).alias("a"), (F.least(k % 97 + 15, F.lit(90)) * 1.0).alias("b")
    )
    grow = 0.2 * (F.col("b") - F.col("a"))
    out = rows.where("a < b").select("id", F.greatest(F.lit(0.0), F.col("a") - grow).alias("x0"), F.least(F.lit(100.0), F.col("b") + grow).alias("x1"))
    return P.rounded(out)


@query(f"""select round(greatest(-pi(), min(pan) - 0.1), 6) as p0, round(least(pi(), max(pan) + 0.1), 6) as p1, round(greatest(-pi() / 2, min(tilt) - 0.1), 6) as t0, round(least(pi() / 2, max(tilt) + 0.1), 6) as t1
    from (select atan2(x, y) as pan, atan2(-z, sqrt(x*x+y*y)) as tilt from {XYZ})""")
def a22_mosaic_bounds(spark, d):
    pan, tilt = geo.pan_tilt([F.col(c) for c in "xyz"])
    rows = xyz(spark, d).select(pan.alias("pan"), tilt.alias("tilt"))
    out = rows.agg(
        F.greatest(F.lit(-math.pi), F.min("pan") - 0.1).alias("p0"), F.least(F.lit(math.pi), F.max("pan") + 0.1).alias("p1"),
        F.greatest(F.lit(-math.pi / 2), F.min("tilt") - 0.1).alias("t0"), F.least(F.lit(math.pi / 2), F.max("tilt") + 0.1).alias("t1"),
    )
    return P.rounded(out)
