"""Queries of generators, small predicates and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenite.functions import photometry
from selenite.operators import tracks
from selenite.plans import proxies as P
from selenite.plans.catalog import query
from selenite.sources import text


@query(
    P.with_views(
        """select track_id, shot_idx, coalesce(abs(sum(z) over a - sum(z) over b) > 20000 and count(z) over c = 5, false) as feature from v_shot
        window a as (partition by track_id order by shot_idx rows between 1 following and 2 following),
        b as (partition by track_id order by shot_idx rows between 2 preceding and 1 preceding),
        c as (partition by track_id order by shot_idx rows between 2 preceding and 2 following)""",
        "v_shot",
    )
)
def w07_gradient_feature(spark, d):
    rows = tracks.derivative_valid(P.shots(spark, d), ["track_id"], "shot_idx", "z", 2)
    rows = tracks.box_gradient(rows, ["track_id"], "shot_idx", "z", 2)
    feature = F.col("valid") & (F.abs("gradient") > 20000)
    return rows.select("track_id", F.col("shot_idx").cast("long").alias("shot_idx"), F.coalesce(feature, F.lit(False)).alias("feature"))


@query("select user_id as source, min(event_id % 360) as lon0, max(event_id % 360) as lon1, min(event_id % 90) as lat0, max(event_id % 90) as lat1 from events group by 1")
def sc23_track_bounds(spark, d):
    k = F.col("event_id")
    return P.table(spark, d, "events").groupBy(F.col("user_id").alias("source")).agg(
        F.min(k % 360).alias("lon0"), F.max(k % 360).alias("lon1"), F.min(k % 90).alias("lat0"), F.max(k % 90).alias("lat1")
    )


@query("select s_suppkey as id, cast(i as integer) as px, (s_suppkey + i) * 1.0::double as x, (s_suppkey * 2 + i) * 1.0::double as y from supplier, range(0, 4) t(i)")
def sc17_points_by_line(spark, d):
    k = F.col("s_suppkey")
    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat((k + i).cast("string"), F.lit(" "), (k * 2 + i).cast("string"), F.lit(" 0"))), "\n")
    rows = P.table(spark, d, "supplier").select(k.alias("id"), F.posexplode(F.split(whole, "\n")).alias("px", "line"))
    p = F.split("line", " ")
    return rows.select("id", "px", p[0].cast("double").alias("x"), p[1].cast("double").alias("y"))


@query(
    """select m.event_id, a.value as z_now, b.value as z_before from (select event_id, event_id * 3 % 1000 as i, event_id * 7 % 1000 as j from events) m
    join (select event_id % 1000 as px, max_by(value, event_id) as value from events where value > 20 group by 1) a on a.px = m.i
    join (select event_id % 1000 as px, max_by(value, event_id) as value from events where value > 20 group by 1) b on b.px = m.j"""
)
def j15_match_cloud_lookup(spark, d):
    k = F.col("event_id")
    rows = P.table(spark, d, "events")
    cloud = rows.where("value > 20").groupBy((k % 1000).alias("px")).agg(F.max_by("value", "event_id").alias("z"))
    found = rows.select("event_id", (k * 3 % 1000).alias("i"), (k * 7 % 1000).alias("j"))
    found = found.join(cloud.select(F.col("px").alias("i"), F.col("z").alias("z_now")), "i")
    return found.join(cloud.select(F.col("px").alias("j"), F.col("z").alias("z_before")), "j").select("event_id", "z_now", "z_before")


@query(P.with_views("select track_id, count(case when refl >= 0 then 1 end) as n_valid, count(case when n_pts > 2 and refl >= 0 then 1 end) as n_features, count(*) as n from v_shot group by track_id", "v_shot"))
def a23_counts(spark, d):
    valid = F.col("refl") >= 0
    return P.shots(spark, d).groupBy("track_id").agg(
        F.count(F.when(valid, 1)).alias("n_valid"), F.count(F.when((F.col("n_pts") > 2) & valid, 1)).alias("n_features"), F.count("*").alias("n")
    )


@query("select s_suppkey as id, round(s_suppkey % 300 - 150 + i * 0.1::double, 6) as lon, round(s_nationkey + j * 0.1::double, 6) as lat from supplier, range(0, 40) a(i), range(0, 30) b(j)")
def o14_geo_grid(spark, d):
    """A grid of 40 x 30 places from each supplier's corner on."""
    rows = P.table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(1199))).alias("i"))
    i = F.col("i")
    lon, lat = F.col("s_suppkey") % 300 - 150 + F.floor(i / 30) * 0.1, F.col("s_nationkey") + i % 30 * 0.1
    return P.rounded(rows.select(F.col("s_suppkey").alias("id"), lon.cast("double").alias("lon"), lat.cast("double").alias("lat")))


@query(
    """select s_suppkey as id, cast(i as integer) as corner_x, cast(j as integer) as corner_y, i * (2 + s_nationkey / 10.0::double) as x, j * (2 + s_nationkey / 10.0::double) as y
    from supplier, range(0, 9) a(i), range(0, 6) b(j)"""
)
def o15_chessboard(spark, d):
    """The corners of each supplier's board of 9 x 6 with squares of its own size."""
    rows = P.table(spark, d, "supplier").select("s_suppkey", (2 + F.col("s_nationkey") / F.lit(10.0)).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(53))).alias("i"))
    x, y = F.floor(F.col("i") / 6).cast("int"), (F.col("i") % 6).cast("int")
    return rows.select(F.col("s_suppkey").alias("id"), x.alias("corner_x"), y.alias("corner_y"), (x * F.col("side")).alias("x"), (y * F.col("side")).alias("y"))


@query("select s_suppkey as id, s_acctbal as h02, round(s_acctbal + 0.25, 6) as h02_fixed, round(s_acctbal * 2 - 0.5, 6) as h12_fixed from supplier")
def o16_georeference_shift(spark, d):
    b = F.col("s_acctbal")
    return P.rounded(P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), b.alias("h02"), (b + 0.25).alias("h02_fixed"), (b * 2 - 0.5).alias("h12_fixed")))


@query(P.with_views("select track_id, shot_idx, case when refl <> -1 and n_pts > 2 and x between 0 and 40 then image else -1.0 end as image, case when n_pts > 2 then x else -1.0 end as image_x from v_shot", "v_shot"))
def f13_i15_align_state(spark, d):
    ok = (F.col("refl") != -1) & (F.col("n_pts") > 2) & F.col("x").between(0, 40)
    return P.shots(spark, d).select(
        "track_id", F.col("shot_idx").cast("long").alias("shot_idx"), F.when(ok, F.col("image")).otherwise(F.lit(-1.0)).alias("image"),
        F.when(F.col("n_pts") > 2, F.col("x")).otherwise(F.lit(-1.0)).alias("image_x"),
    )


@query("select event_id, (event_id % 2 <> 0 or event_id % 3 <> 0 or event_id % 5 <> 0) as any_channel, (event_id % 2 <> 0 and event_id % 3 <> 0 and event_id % 5 <> 0) as all_channels from events")
def f20_channel_validity(spark, d):
    c = [F.col("event_id") % n != 0 for n in (2, 3, 5)]
    return P.table(spark, d, "events").select("event_id", (c[0] | c[1] | c[2]).alias("any_channel"), (c[0] & c[1] & c[2]).alias("all_channels"))


@query("select event_id, round(2.0 / (value * value / 300 + 2.0), 8) as weight from events")
def p15_foreground_weight(spark, d):
    return P.rounded(P.table(spark, d, "events").select("event_id", photometry.foreground_weight(F.col("value"), F.lit(2.0)).alias("weight")), 8)


@query("select s_suppkey as id, concat(s_suppkey, ' 0 1 0 ', s_nationkey, ' 2') as value from supplier")
def sk08_transform_lines(spark, d):
    parts = [F.col("s_suppkey"), F.lit(0), F.lit(1), F.lit(0), F.col("s_nationkey"), F.lit(2)]
    return P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat_ws(" ", *(p.cast("string") for p in parts)).alias("value"))


@query(
    """select o_custkey as track_id, o_orderkey as shot_id, round(2 * o_totalprice + 0.5 * m.c_acctbal, 4) as v from orders join customer m on m.c_custkey = o_custkey"""
)
def j17_track_transform(spark, d):
    per_track = P.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    rows = P.table(spark, d, "orders").join(per_track, "o_custkey")
    return P.rounded(rows.select(F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("shot_id"), (2 * F.col("o_totalprice") + 0.5 * F.col("c_acctbal")).alias("v")), 4)


@query("select s_suppkey as id, cast(s_suppkey % 7 as double) as min_err, cast(s_suppkey % 7 + 90 as double) as max_err, cast(s_suppkey as bigint) as n, cast(2 as integer) as n_bins from supplier")
def sc08_statistics_file(spark, d):
    k = F.col("s_suppkey")
    lines = F.array(
        F.concat(F.lit("minError= "), (k % 7).cast("string")), F.concat(F.lit("maxError= "), (k % 7 + 90).cast("string")), F.lit("avgError= 3.5"),
        F.concat(F.lit("numValidPts= "), k.cast("string")), F.lit("hist_0= 4"), F.lit("hist_1= 5"),
    )
    rows = P.table(spark, d, "supplier").select(k.alias("path"), F.posexplode(lines).alias("line_no", "line"))
    s = text.statistics_pairs(rows)
    return s.select(F.col("path").alias("id"), "min_err", "max_err", "n", F.size("hist").alias("n_bins"))
