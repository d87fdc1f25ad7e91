"""Queries of the matching and registration operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from selenite.functions import geo
from selenite.operators import matching, raster, registration
from selenite.plans import proxies as P
from selenite.plans.catalog import query

STRIDE = "(select greatest(1000, cast(ceil((max(vec_id) + 1) / 4.0) as bigint)) from embeddings)"
FEATURES = f"(select x * {STRIDE} + y as id, x as px, y as py, x * 1.0 as fx, y * 1.0 as fy, round(v, 6) * 10 as fz from v_raster where x % 4 = 0 and y % 4 = 0)"
CANDIDATES = "(select x, y, x + (y % 3) * 0.25 as cx, y + 0.5 as cy, round(v, 6) * 10 as cz from v_raster where v > -0.05)"


def features(spark, d, step: int = 4):
    rows = P.raster(spark, d).where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    x, y = F.col("x"), F.col("y")
    stride = max(1000, -(-P.height(spark, d) // step))  # no two features share an id
    return rows.select(
        (x.cast("long") * stride + y).alias("id"), x.alias("px"), y.alias("py"), (x * 1.0).cast("double").alias("fx"), (y * 1.0).cast("double").alias("fy"),
        (F.round("v", 6) * 10).alias("fz"),
    )


def candidates(spark, d):
    x, y = F.col("x"), F.col("y")
    rows = P.raster(spark, d).where("v > -0.05")
    return rows.select("x", "y", (x + (y % 3) * 0.25).cast("double").alias("cx"), (y + F.lit(0.5)).cast("double").alias("cy"), (F.round("v", 6) * 10).alias("cz"))


NEAREST = f"""select f.id, fx, fy, fz, b.cx, b.cy, b.cz, b.dist, b.y, b.x from {FEATURES} f left join (
    select *, row_number() over (partition by id order by dist, y, x) as k from (select f.id, c.x, c.y, cx, cy, cz,
    sqrt((fx - cx) * (fx - cx) + (fy - cy) * (fy - cy) + (fz - cz) * (fz - cz)) as dist
    from (select *, px + i as jx, py + j as jy from {FEATURES}, range(-2, 3) a(i), range(-2, 3) b(j)) f join {CANDIDATES} c on c.x = f.jx and c.y = f.jy)) b
    on b.id = f.id and b.k = 1"""


@query(P.with_views(f"select cast(id as bigint) as id, y, x, round(dist, 8) as dist from ({NEAREST})", "v_raster"))
def j04_o04_window_nearest(spark, d):
    found = matching.window_nearest(features(spark, d), candidates(spark, d), ["id"], 2)
    return P.rounded(found.select("id", "y", "x", "dist"), 8)


PAIRS = f"(select id, cx as r_x, cy as r_y, cz as r_z, fx as m_x, fy as m_y, fz as m_z from ({NEAREST}) where cx is not null)"


def pairs(spark, d):
    f = features(spark, d)
    found = matching.window_nearest(f, candidates(spark, d), ["id"], 2).where("cx is not null")
    ref = found.select("id", *(F.col(f"c{c}").alias(f"r_{c}") for c in "xyz"))
    return ref.join(f.select("id", *(F.col(f"f{c}").alias(f"m_{c}") for c in "xyz")), "id")


@query(P.with_views(f"select count(*) as n, round(avg(sqrt((r_x-m_x)*(r_x-m_x)+(r_y-m_y)*(r_y-m_y)+(r_z-m_z)*(r_z-m_z))), 8) as mean_err from {PAIRS}", "v_raster"))
def a13_f11_matching_error(spark, d):
    return P.rounded(registration.matching_errors(pairs(spark, d)).agg(F.count("*").alias("n"), F.avg("err").alias("mean_err")), 8)


@query(P.with_views(f"select {', '.join(f'round(avg(r_{c} - m_{c}), 8) as t_{c}' for c in 'xyz')} from {PAIRS}", "v_raster"))
def a10_f12_mean_translation(spark, d):
    return P.rounded(registration.mean_translation(pairs(spark, d)), 8)


COVARIANCE = ", ".join(f"round(sum(r_{i} * m_{j}) - sum(r_{i}) * sum(m_{j}) / count(*), 4) as s_{i}{j}" for i in "xyz" for j in "xyz")


@query(P.with_views(f"select count(*) as n, {COVARIANCE}, {', '.join(f'round(avg({p}_{c}), 4) as c{p}_{c}' for p in 'rm' for c in 'xyz')} from {PAIRS}", "v_raster"))
def a11_cross_covariance(spark, d):
    return P.rounded(registration.cross_covariance(pairs(spark, d)), 4)


@query(
    P.with_views(
        f"select {', '.join(f'round(avg(r_{c} - m_{c}), 6) as mean_{c}, round(stddev_pop(r_{c} - m_{c}), 6) as dev_{c}' for c in 'xyz')} from {PAIRS}", "v_raster"
    )
)
def a12_displacement_statistics(spark, d):
    return P.rounded(registration.displacement_statistics(pairs(spark, d)), 6)


@query(
    P.with_views(
        f"""select cast(id as bigint) as id from {PAIRS}, (select {", ".join(f"avg(r_{c} - m_{c}) as a_{c}, stddev_pop(r_{c} - m_{c}) as b_{c}" for c in "xyz")} from {PAIRS})
        where {" and ".join(f"abs(r_{c} - m_{c} - a_{c}) < b_{c}" for c in "xyz")}""",
        "v_raster",
    )
)
def f15_remove_outliers(spark, d):
    return registration.remove_outliers(pairs(spark, d)).select("id")


@query(
    P.with_views(
        f"""select {", ".join(f"round(sum((id % 3 + 1) * (r_{c} - m_{c})) / sum(id % 3 + 1), 8) as t_{c}" for c in "xyz")} from {PAIRS}
        where abs(r_x - m_x) < 2 and abs(r_y - m_y) < 2 and abs(r_z - m_z) < 1.5""",
        "v_raster",
    )
)
def a18_a19_f14_weighted_translation(spark, d):
    some = pairs(spark, d).withColumn("w", F.col("id") % 3 + 1)
    gate = (F.abs(F.col("r_x") - F.col("m_x")) < 2) & (F.abs(F.col("r_y") - F.col("m_y")) < 2) & (F.abs(F.col("r_z") - F.col("m_z")) < 1.5)
    return P.rounded(registration.weighted_translation(some.where(gate), "w"), 8)


@query(P.with_views(f"select round(avg(m_z / r_z), 6) as scale from {PAIRS} where abs(r_z) > 0.1", "v_raster"))
def a24_scale_factor(spark, d):
    return P.rounded(pairs(spark, d).where(F.abs("r_z") > 0.1).agg(F.avg(F.col("m_z") / F.col("r_z")).alias("scale")))


TERMS = {"x": "x", "y": "y", "e": "1.0", "u": "u", "v": "v"}
PRODUCTS = ", ".join(f"round(sum({TERMS[a]} * {TERMS[b]}), 4) as {a}_{b}" for i, a in enumerate(TERMS) for b in list(TERMS)[i:])


@query(f"select count(*) as n, {PRODUCTS} from (select l_quantity as x, l_discount * 100 as y, l_quantity * 2 + l_discount * 50 + 3 as u, l_tax * 100 as v from lineitem)")
def a16_a17_normal_sums(spark, d):
    q, c = F.col("l_quantity"), F.col("l_discount")
    rows = P.table(spark, d, "lineitem").select(q.alias("x"), (c * 100).alias("y"), (q * 2 + c * 50 + 3).alias("u"), (F.col("l_tax") * 100).alias("v"))
    terms = {k: F.lit(1.0) if k == "e" else F.col(k) for k in TERMS}
    return P.rounded(registration.normal_sums(rows, terms), 4)


NOISY = "(select l_quantity as x, l_discount * 100 as y, l_quantity * 2 + l_discount * 50 + 3 + l_tax as u, l_discount * 100 - 1 + l_linenumber % 3 as v from lineitem)"
DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"
NORMAL = ["xx", "xy", "x1", "xy", "yy", "y1", "x1", "y1", "n"]


def _cramer(column: int, target: str) -> str:
    right = [f"x{target}", f"y{target}", f"s{target}"]
    return DET.format(*(right[i // 3] if i % 3 == column else m for i, m in enumerate(NORMAL))) + " / " + DET.format(*NORMAL)


@query(
    "select " + ", ".join(f"round({_cramer(k % 3, 'uv'[k // 3])}, 6) as {c}" for k, c in enumerate("abcdef")) + " from (select sum(x * x) as xx, sum(x * y) as xy,"
    " sum(x) as x1, sum(y * y) as yy, sum(y) as y1, cast(count(*) as double) as n, sum(x * u) as xu, sum(y * u) as yu, sum(u) as su, sum(x * v) as xv, sum(y * v) as yv,"
    f" sum(v) as sv from {NOISY})"
)
def a16_solve_affine(spark, d):
    """The affine map of least squares under residues that are no map's."""
    q, c = F.col("l_quantity"), F.col("l_discount") * 100
    rows = P.table(spark, d, "lineitem").select(
        q.alias("x"), c.alias("y"), (q * 2 + c * 0.5 + 3 + F.col("l_tax")).alias("u"), (c - 1 + F.col("l_linenumber") % 3).alias("v")
    )
    m = registration.solve_affine(rows).ravel().tolist()
    return spark.createDataFrame([tuple(round(v, 6) + 0.0 for v in m)], "a double, b double, c double, d double, e double, f double")


@query("select cast(unnest(range(0, 9)) as integer) as i, unnest([1.1, 0.02, 3.0, -0.05, 0.95, 2.0, 0.0, 0.0, 1.0])::double as v")
def a26_j18_homography(spark, d):
    q, c = F.col("l_quantity") / 50, F.col("l_discount") * 10
    rows = P.table(spark, d, "lineitem").select(q.alias("x"), c.alias("y"), (1.1 * q + 0.02 * c + 3).alias("u"), (-0.05 * q + 0.95 * c + 2).alias("v"))
    h = registration.solve_homography(rows).ravel().tolist()
    return spark.createDataFrame([(i, round(v, 4) + 0.0) for i, v in enumerate(h)], "i int, v double")


@query()
def i01_i05_icp_known_shift(spark, d):
    """A surface matched to itself moved by half a pixel: motion and errors; tested against the known shift."""
    found = candidates(spark, d)

    def match(moved):
        at = moved.withColumn("px", F.round("fx").cast("int")).withColumn("py", F.round("fy").cast("int"))
        near = matching.window_nearest(at, found, ["id"], 2)
        return near.select("id", *(F.col(f"c{c}").alias(f"r_{c}") for c in "xyz"))

    start = features(spark, d, 8).drop("px", "py")
    r, t, errors = registration.iterate_closest(start, match, 4, 0.01)
    return spark.createDataFrame([(len(errors), *map(float, r.ravel()), *map(float, t), float(errors[-1]))], ", ".join(["n int", *(f"r{i} double" for i in range(9)), "tx double, ty double, tz double, err double"]))


BOX = "select {key} as id, {key} % 97 * 1.0 as x0, {key} % 97 + {key} % {w} + 0.5 as x1, {key} * 7 % 89 * 1.0 as y0, {key} * 7 % 89 + {key} % {w} + 0.5 as y1 from {table}"
LEFT, RIGHT = BOX.format(key="s_suppkey", w=5, table="supplier"), BOX.format(key="c_custkey", w=4, table="customer")


def boxes(spark, d, name, key, w):
    k = F.col(key)
    return P.table(spark, d, name).select(
        k.alias("id"), (k % 97 * 1.0).alias("x0"), (k % 97 + k % w + 0.5).alias("x1"), (k * 7 % 89 * 1.0).alias("y0"), (k * 7 % 89 + k % w + 0.5).alias("y1")
    )


@query(f"select l.id as l_id, r.id as r_id from ({LEFT}) l join ({RIGHT}) r on l.x0 <= r.x1 and r.x0 <= l.x1 and l.y0 <= r.y1 and r.y0 <= l.y1")
def j07_box_overlap(spark, d):
    return matching.box_join(boxes(spark, d, "supplier", "s_suppkey", 5), boxes(spark, d, "customer", "c_custkey", 4), 8.0)


@query(f"select r.id, cast(bool_or(coalesce(l.x0 <= r.x1 and r.x0 <= l.x1 and l.y0 <= r.y1 and r.y0 <= l.y1, false)) as integer) as overlaps from ({RIGHT}) r left join ({LEFT}) l on true group by r.id")
def j08_j23_overlap_flags(spark, d):
    return matching.overlap_flags(boxes(spark, d, "customer", "c_custkey", 4), boxes(spark, d, "supplier", "s_suppkey", 5), 8.0)


@query(
    P.with_views(
        "select a.x, a.y, round((a.v + b.v) / 2, 8) as v from v_raster a join v_raster b on b.x = cast(trunc(1.1 * a.x + 0.1 * a.y / 10 + 1) as integer) and b.y = cast(trunc(0.9 * a.y + 2) as integer)",
        "v_raster",
    )
)
def j09_p08_overlay(spark, d):
    rows = P.raster(spark, d)
    x, y = geo.homography([[1.1, 0.01, 1.0], [0.0, 0.9, 2.0], [0.0, 0.0, 1.0]], F.col("x"), F.col("y"))
    moved = rows.select("x", "y", "v", x.alias("tx"), y.alias("ty"))
    other = rows.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("v").alias("u"))
    return P.rounded(moved.join(raster.dealt(other), ["tx", "ty"]).select("x", "y", ((F.col("v") + F.col("u")) / 2).alias("v")), 8)


KEYS = "(select vec_id, embedding, vec_id % 2 as side from embeddings)"
DISTANCES = f"""(select a.vec_id as q_id, b.vec_id as t_id, list_sum(list_transform(range(1, 65), lambda i: power(cast(a.embedding[i] as double) - cast(b.embedding[i] as double), 2))) as dist2
    from {KEYS} a join {KEYS} b on a.side = {{q}} and b.side = {{t}})"""
RANKED = "(select *, row_number() over (partition by q_id order by dist2, t_id) as rank from {0})"


def keypoints(spark, d, side):
    rows = P.table(spark, d, "embeddings").where(F.col("vec_id") % 2 == side)
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("desc"))


@query(f"select q_id, t_id, cast(rank as integer) as rank, round(dist2, 6) as dist2 from {RANKED.format(DISTANCES.format(q=1, t=0))} where rank <= 2")
def j13_o03_nearest_descriptors(spark, d):
    return P.rounded(matching.nearest_descriptors(keypoints(spark, d, 1), keypoints(spark, d, 0)))


@query(
    f"""select q_id, min_by(t_id, rank) as t_id, round(min(dist2), 6) as d1, round(max(dist2), 6) as d2 from {RANKED.format(DISTANCES.format(q=1, t=0))}
    where rank <= 2 group by q_id having sqrt(min(dist2)) <= 0.97 * sqrt(max(dist2))"""
)
def j13_o05_ratio_test(spark, d):
    return P.rounded(matching.ratio_test(matching.nearest_descriptors(keypoints(spark, d, 1), keypoints(spark, d, 0)), 0.97))


@query(
    f"""select a.q_id, a.t_id, round(a.dist2, 6) as dist2 from {RANKED.format(DISTANCES.format(q=1, t=0))} a
    join {RANKED.format(DISTANCES.format(q=0, t=1))} b on a.q_id = b.t_id and a.t_id = b.q_id and a.rank = 1 and b.rank = 1"""
)
def j14_mutual_nearest(spark, d):
    a, b = keypoints(spark, d, 1), keypoints(spark, d, 0)
    return P.rounded(matching.mutual(matching.nearest_descriptors(a, b, 1), matching.nearest_descriptors(b, a, 1)))


@query(
    """select user_id, px, py, event_id, v from (select user_id, cast(event_id % 13 as integer) as px, cast(event_id % 7 as integer) as py, event_id, value as v,
    row_number() over (partition by user_id, event_id % 13, event_id % 7 order by event_id) as k from events) where k = 1"""
)
def a25_remove_duplicates(spark, d):
    k = F.col("event_id")
    rows = P.table(spark, d, "events").select("user_id", "event_id", (k % 13 + 0.25).alias("x"), (k % 7 + 0.5).alias("y"), F.col("value").alias("v"))
    return matching.remove_duplicates(rows, ["user_id"], ["event_id"], ["v"])


def _angles(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


GRID = "(select i * 81 + j * 9 + k as cand, (i - 4) * pi() / 40 as theta, (j - 4) * 5.0 as dx, (k - 4) * 5.0 as dy from range(0, 9) a(i), range(0, 9) b(j), range(0, 9) c(k))"


#: Turns and shifts around the identity: 9 x 9 x 9 candidates.
TURNS = [(i - 4) * math.pi / 40 for i in range(9)]
SHIFTS = [(i - 4) * 5.0 for i in range(9)]


SIZES = (3, 3, 9, 3, 3, 9)
#: A point of each supplier and where it should come to lie.
AIMS = "(select s_suppkey as id, (s_suppkey % 97)::double as x, (s_nationkey * 3)::double as y, (s_suppkey * 13 % 120)::double as u, (s_suppkey * 7 % 90)::double as v from supplier)"


def aims(spark, d):
    k = F.col("s_suppkey")
    values = {"x": k % 97, "y": F.col("s_nationkey") * 3, "u": k * 13 % 120, "v": k * 7 % 90}
    return P.table(spark, d, "supplier").select(k.alias("id"), *(c.cast("double").alias(n) for n, c in values.items()))


@query(
    f"""select id, min_by(cand, (err, cand)) as cand, min(err) as err from (select id, cand, round(pow(cos(theta) * x - sin(theta) * y + dx - u, 2) + pow(sin(theta) * x + cos(theta) * y + dy - v, 2), 4) as err
    from {AIMS}, {GRID}) group by id"""
)
def o13_search_grid(spark, d):
    """Of 9 x 9 x 9 turns and shifts around the identity, for each point the one that brings it nearest to where it should lie."""
    x, y = F.col("x"), F.col("y")
    gaps = []
    for c, s in ((F.cos(F.lit(t)), F.sin(F.lit(t))) for t in TURNS):
        gaps.append([[(at + shift - F.col(to)) ** 2 for shift in SHIFTS] for at, to in ((c * x - s * y, "u"), (s * x + c * y, "v"))])
    return matching.least_sum(aims(spark, d), "id", gaps, 4)


@query(
    f"""select id, min_by(cand, (err, cand)) as cand, min(err) as err from (select id, cand, round(pow(a * x + b * y + tx - u, 2) + pow(c * x + d * y + ty - v, 2), 4) as err from {AIMS}, (
    select ((((p0 * 3 + p1) * 9 + p2) * 3 + p3) * 3 + p4) * 9 + p5 as cand, cast(1 + (p0 - 1) * 0.1 as double) as a, cast((p1 - 1) * 0.1 as double) as b, cast((p2 - 4) * 5 as double) as tx,
    cast((p3 - 1) * 0.1 as double) as c, cast(1 + (p4 - 1) * 0.1 as double) as d, cast((p5 - 4) * 5 as double) as ty from """
    + ", ".join(f"range(0, {n}) r{k}(p{k})" for k, n in enumerate(SIZES))
    + ")) group by id"
)
def o12_affine_grid(spark, d):
    """Of 3 x 3 x 9 x 3 x 3 x 9 affine maps around the identity, for each point the one that brings it nearest to where it should lie."""
    near = [1 + (k - 1) * 0.1 for k in range(SIZES[0])], [(k - 1) * 0.1 for k in range(SIZES[1])]
    x, y = F.col("x"), F.col("y")
    off = lambda a, b, to: [(p * x + q * y + shift - F.col(to)) ** 2 for p in a for q in b for shift in SHIFTS]
    return matching.least_sum(aims(spark, d), "id", [(off(near[0], near[1], "u"), off(near[1], near[0], "v"))], 4)


@query(
    P.with_views(
        f"""select cand, round(err, 6) as err from (select cand, err, row_number() over (order by err, cand) as k from (
        select cand, avg(power(p.value - r.v * 100, 2)) as err from (select cand, value, cast(trunc(cos(theta) * px - sin(theta) * py + dx) as integer) as x,
        cast(trunc(sin(theta) * px + cos(theta) * py + dy) as integer) as y from v_pix cross join {GRID}) p join v_raster r on r.x = p.x and r.y = p.y
        group by cand having avg(power(p.value - r.v * 100, 2)) > 0)) where k = 1""",
        "v_pix",
        "v_raster",
    )
)
def j22_a09_best_transform(spark, d):
    """The candidate of least error: every point under every candidate of the stated grid meets its pixel."""
    rows = P.table(spark, d, "embeddings").select(F.col("vec_id").alias("y"), F.col("embedding").alias("v"))
    errors = matching.shift_errors(P.pixels(spark, d), rows, TURNS, SHIFTS, 64, 100.0)
    best = matching.argmin(errors, [], "err", ["cand"], [], positive=True)
    return P.rounded(best.select("cand", "err"))


@query(
    """select user_id, count(*) as n, [round(cos(sum(a)), 9) + 0.0, round(-sin(sum(a)), 9) + 0.0, 0.0, round(sin(sum(a)), 9) + 0.0, round(cos(sum(a)), 9) + 0.0, 0.0, 0.0, 0.0, 1.0] as r,
    [round(sum(cos(p) * value - sin(p)), 6) + 0.0, round(sum(sin(p) * value + cos(p)), 6) + 0.0, 0.0] as t from (select user_id, value, value / 1000 as a,
    coalesce(sum(value / 1000) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as p from events) group by user_id"""
)
def i08_compose_poses(spark, d):
    """Poses of each user's frames, composed in order; all turn about one axis, so SQL can add their angles."""
    a = F.col("value") / 1000
    rotation = F.array(F.cos(a), -F.sin(a), F.lit(0.0), F.sin(a), F.cos(a), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    rows = P.table(spark, d, "events").select("user_id", "event_id", rotation.alias("r"), F.array("value", F.lit(1.0), F.lit(0.0)).alias("t"))
    found = registration.compose_poses(rows, ["user_id"], "event_id", "r", "t", P.scratch(spark))
    near = lambda c, n: F.transform(c, lambda v: F.round(v, n) + 0.0).alias(c)
    return found.select("user_id", "n", near("r", 9), near("t", 6))


@query(
    """select user_id, event_id, n, round(cos(a), 9) as c, round(sin(a), 9) as s, round(sum(x) over w, 6) as tx, round(sum(y) over w, 6) as ty from (
    select *, value * cos(p) - sin(p) as x, value * sin(p) + cos(p) as y, p + value / 1000 as a from (
    select user_id, event_id, value, row_number() over w as n, coalesce(sum(value / 1000) over (w rows between unbounded preceding and 1 preceding), 0) as p
    from events window w as (partition by user_id order by event_id))) window w as (partition by user_id order by event_id rows unbounded preceding)"""
)
def i08_global_poses(spark, d):
    """The global pose of every frame of each user."""
    a = F.col("value") / 1000
    rotation = F.array(F.cos(a), -F.sin(a), F.lit(0.0), F.sin(a), F.cos(a), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    rows = P.table(spark, d, "events").select("user_id", "event_id", rotation.alias("r"), F.array("value", F.lit(1.0), F.lit(0.0)).alias("t"))
    found = registration.global_poses(rows, ["user_id"], "event_id", "r", "t", P.scratch(spark))
    values = {"c": F.col("r")[0], "s": F.col("r")[3], "tx": F.col("t")[0], "ty": F.col("t")[1]}
    return found.select("user_id", "event_id", "n", *((F.round(v, 9 if n in "cs" else 6) + 0.0).alias(n) for n, v in values.items()))
