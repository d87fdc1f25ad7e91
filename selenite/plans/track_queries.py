"""Queries of the track, photometry and statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenite.functions import photometry
from selenite.operators import stats, tracks, validity
from selenite.plans import proxies as P
from selenite.plans.catalog import query

SESSIONS = """select user_id, event_id, ts, value, s, sum(gap) over w as track_id, sum(fresh) over w as shots from (
    select *, case when ts <> before and floor(abs(epoch_us(ts) - epoch_us(before)) / 1e6) >= 3000 then 1 else 0 end as gap,
    case when ts <> before then 1 else 0 end as fresh from (
        select *, lag(ts) over (partition by user_id order by event_id) as before from v_event {where}))
    window w as (partition by user_id order by event_id rows unbounded preceding)"""


@query(
    P.with_views(
        f"""select user_id, event_id, cast(track_id as bigint) as track_id,
        cast(shots - min(shots) over (partition by user_id, track_id) as bigint) as shot_id
        from ({SESSIONS.format(where="where value between 1 and 80")})""",
        "v_event",
    )
)
def t01_t02_sessionize(spark, d):
    rows = P.events(spark, d).where(F.col("value").between(1, 80))  # before the window: rejected rows are no predecessors
    return tracks.sessionize(rows, ["user_id"], ["event_id"]).select("user_id", "event_id", "track_id", "shot_id")


@query(
    P.with_views(
        f"""select user_id, cast(track_id as bigint) as track_id, strftime(min(ts), '%Y-%m-%dT%H-%M-%S') as name,
        count(*) as n_returns from ({SESSIONS.format(where="")}) group by user_id, track_id""",
        "v_event",
    )
)
def t03_split_tracks(spark, d):
    return tracks.split_tracks(P.events(spark, d), ["user_id"], ["event_id"])


HOLES = """select *, case when refl < 0 and lag(refl) over w > 0 and lead(refl) over w > 0
    then (lag(refl) over w + lead(refl) over w) / 2 else refl end as filled from v_shot window w as (partition by track_id order by shot_idx)"""
VALID = f"""select *, count(filled) over v = 5 and min(filled) over v >= 0 as valid from ({HOLES})
    window v as (partition by track_id order by shot_idx rows between 2 preceding and 2 following)"""
GRADIENT = f"""select *, case when valid then sum(filled) over (partition by track_id order by shot_idx rows between 1 following and 2 following)
    - sum(filled) over (partition by track_id order by shot_idx rows between 2 preceding and 1 preceding) else 0.0 end as gradient from ({VALID})"""
SALIENT = f"""select *, coalesce(valid and abs(gradient) >= max(case when valid and nth = place then abs(gradient) end) over (partition by track_id), false)
    as salient from (select *, row_number() over (partition by track_id order by valid desc, abs(gradient)) as nth,
    least(ceil(0.7 * n_valid), n_valid - 1) + 1 as place from (select *, count(case when valid then 1 end) over (partition by track_id) as n_valid
    from ({GRADIENT})))"""


@query(P.with_views(f"select track_id, shot_idx, round(filled, 9) as refl from ({HOLES})", "v_shot"))
def w01_interpolate_holes(spark, d):
    out = tracks.interpolate_holes(P.shots(spark, d), ["track_id"], "shot_idx", "refl")
    return P.rounded(out.select("track_id", F.col("shot_idx").cast("long").alias("shot_idx"), "refl"), 9)

@query(P.with_views(f"select track_id, shot_idx, valid, round(gradient, 9) as gradient from ({GRADIENT})", "v_shot"))
def w02_w03_gradient(spark, d):
    out = tracks.interpolate_holes(P.shots(spark, d), ["track_id"], "shot_idx", "refl")
    out = tracks.box_gradient(tracks.derivative_valid(out, ["track_id"], "shot_idx", "refl", 2), ["track_id"], "shot_idx", "refl", 2)
    return P.rounded(out.select("track_id", F.col("shot_idx").cast("long").alias("shot_idx"), "valid", "gradient"), 9)


WEIGHT = " + ".join(
    f"coalesce({'lag' if k > 0 else 'lead'}(cast(salient as integer), {abs(k)}) over w, 0) * {(5 - abs(k)) / 5}" if k else "cast(salient as integer) * 1.0"
    for k in range(-2, 3)
)

@query(
    P.with_views(
        f"select track_id, shot_idx, salient, round(cast({WEIGHT} as double), 9) as weight from ({SALIENT}) window w as (partition by track_id order by shot_idx)",
        "v_shot",
    )
)
def w04_w08_w09_feature_weights(spark, d):
    out = tracks.feature_weights(P.shots(spark, d), ["track_id"], "shot_idx", "refl", 2, 0.3)
    return P.rounded(out.select("track_id", F.col("shot_idx").cast("long").alias("shot_idx"), "salient", "weight"), 9)

@query(
    P.with_views(
        """select track_id, shot_idx, round(sum(coalesce(step, 0)) over (partition by track_id order by shot_idx rows unbounded preceding), 6) as distance
        from (select *, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as step from v_shot window w as (partition by track_id order by shot_idx))""",
        "v_shot",
    )
)
def w05_cumulative_distance(spark, d):
    out = tracks.cumulative_distance(P.shots(spark, d), ["track_id"], "shot_idx", "x", "y")
    return P.rounded(out.select("track_id", F.col("shot_idx").cast("long").alias("shot_idx"), "distance"))


TAPS = " + ".join(f"lead(z, {i - 6}) over w * {t}" if i >= 6 else f"lag(z, {6 - i}) over w * {t}" for i, t in enumerate(tracks.STEP_TAPS))


@query(
    P.with_views(
        f"""select track_id, shot_idx, round(response, 4) as response, abs(response) > 2000 and round(response, 4) >= max(round(response, 4)) over f as feature
        from (select *, case when count(z) over f = 12 and min(case when n_pts > 1 then 1 else 0 end) over f = 1 then ({TAPS}) / 12 else 0.0 end as response
        from v_shot window w as (partition by track_id order by shot_idx),
        f as (partition by track_id order by shot_idx rows between 6 preceding and 5 following))
        window f as (partition by track_id order by shot_idx rows between 6 preceding and 5 following)""",
        "v_shot",
    )
)
def w06_matched_filter(spark, d):
    rows = P.shots(spark, d).withColumn("usable", F.col("n_pts") > 1)
    out = tracks.matched_filter(rows, ["track_id"], "shot_idx", "z", "usable", threshold=2000)
    return P.rounded(out.select("track_id", F.col("shot_idx").cast("long").alias("shot_idx"), "response", "feature"), 4)


@query(
    P.with_views(
        """select track_id, shot_idx, refl, image, n_valid from (select *, count(*) over (partition by track_id) as n_valid from v_shot
        where refl >= 0 and image >= 0) where n_valid >= 8""",
        "v_shot",
    )
)
def f21_sk07_track_profile(spark, d):
    out = tracks.track_profile(P.shots(spark, d), ["track_id"], "shot_idx", "refl", "image", 8)
    return out.select("track_id", F.col("shot_idx").cast("long").alias("shot_idx"), "refl", "image", "n_valid")


GAIN = """round(case when count(case when refl >= 0 and image >= 0 then 1 end) >= {least} then sum(case when refl >= 0 and image >= 0 then image end)
    / sum(case when refl >= 0 and image >= 0 then refl end) else 0.0 end, 6) as gain, 0.0::double as bias, count(case when refl >= 0 and image >= 0 then 1 end) as n_points"""


@query(P.with_views(f"select track_id, {GAIN.format(least=2)} from v_shot group by track_id", "v_shot"))
def a07_track_gain(spark, d):
    return P.rounded(tracks.gain(P.shots(spark, d), ["track_id"], "refl", "image"))


@query(P.with_views(f"select {GAIN.format(least=1)} from v_shot", "v_shot"))
def a07_global_gain(spark, d):
    return P.rounded(tracks.gain(P.shots(spark, d), [], "refl", "image", 1))


@query(P.with_views("select track_id, shot_idx, round(least(1.0, refl * 1.7 + 0.05), 9) as synth from v_shot", "v_shot"))
def p14_gain_bias(spark, d):
    synth = photometry.gain_bias(F.col("refl"), F.lit(1.7), F.lit(0.05))
    return P.rounded(P.shots(spark, d).select("track_id", F.col("shot_idx").cast("long").alias("shot_idx"), synth.alias("synth")), 9)

@query(
    P.with_views(
        "select coalesce(round(avg(case when refl <> -1 and image <> -1 then power(least(1.0, refl * 1.7) - image, 2) end), 6), -1.0) as mse from v_shot", "v_shot"
    )
)
def a08_transform_error(spark, d):
    ok = (F.col("refl") != -1) & (F.col("image") != -1)
    synth = photometry.gain_bias(F.col("refl"), F.lit(1.7), F.lit(0.0))
    mse = F.avg(F.when(ok, F.pow(synth - F.col("image"), 2)))
    return P.rounded(P.shots(spark, d).agg(F.coalesce(mse, F.lit(-1.0)).alias("mse")))


def histogram_sql(error: str, source: str, keys: str = "", edges=stats.EDGES) -> str:
    bins = [f"count(case when {error} > {a} and {error} <= {b} then 1 end)" for a, b in zip(edges[:-1], edges[1:], strict=True)]
    bins.append(f"count(case when {error} > {edges[-1]} then 1 end)")
    key = f"{keys}, " if keys else ""
    return f"select {key}min({error}) as min_err, max({error}) as max_err, avg({error}) as avg_err, count(*) as n, [{', '.join(bins)}] as hist from {source} where {error} >= 0" + (
        f" group by {keys}" if keys else ""
    )


ERRORS = "(select s, z / 10 - 500 as err from v_return)"
FLAT = "select {keys}round(min_err, 4) as min_err, round(max_err, 4) as max_err, round(avg_err, 4) as avg_err, n, cast(unnest(hist) as bigint) as in_bin, cast(unnest(range(0, 15)) as integer) as bin from ({inner})"


def flat(df, keys=()):
    out = df.select(*keys, "min_err", "max_err", "avg_err", "n", F.posexplode("hist").alias("bin", "in_bin"))
    return P.rounded(out, 4)


@query(P.with_views(FLAT.format(keys="", inner=histogram_sql("err", ERRORS)), "v_return"))
def a01_a02_error_statistics(spark, d):
    return flat(stats.error_statistics(P.returns(spark, d).select((F.col("z") / 10 - 500).alias("err"))))


@query(P.with_views(FLAT.format(keys="s, ", inner=histogram_sql("err", ERRORS, "s")), "v_return"))
def a01_error_statistics_by_detector(spark, d):
    rows = P.returns(spark, d).select("s", (F.col("z") / 10 - 500).alias("err"))
    return flat(stats.error_statistics(rows, ["s"]), ["s"])


@query(P.with_views(FLAT.format(keys="", inner=histogram_sql("err", ERRORS)), "v_return"))
def a03_merge_statistics(spark, d):
    rows = P.returns(spark, d).select("s", (F.col("z") / 10 - 500).alias("err"))
    return flat(stats.merge_statistics(stats.error_statistics(rows, ["s"])))


@query(
    P.with_views(
        """select track_id, shot_id, s, pt_idx, z from (select *, row_number() over (partition by track_id, shot_id order by pt_idx) as k
        from v_return where s = 3) where k = 1""",
        "v_return",
    )
)
def p07_detector_lookup(spark, d):
    rows = P.returns(spark, d).where("s = 3").groupBy("track_id", "shot_id")
    out = rows.agg(F.min("pt_idx").alias("pt_idx"), F.min_by("z", "pt_idx").alias("z"))
    return out.select("track_id", "shot_id", F.lit(3).alias("s"), F.col("pt_idx").cast("long").alias("pt_idx"), "z")


@query(
    P.with_views(
        """select track_id, shot_id, count(*) as n_returns, count(*) <= 5 and bool_or(s = 1) and bool_or(s = 2) and bool_or(s = 3) and bool_and(z > 1000)
        as valid, min(case when z <= 1000 then pt_idx end) as first_bad from v_return group by track_id, shot_id""",
        "v_return",
    )
)
def f05_f06_f07_shot_validity(spark, d):
    has = [F.bool_or(F.col("s") == k) for k in (1, 2, 3)]
    valid = (F.count("*") <= 5) & has[0] & has[1] & has[2] & F.bool_and(F.col("z") > 1000)
    bad = F.min(F.when(F.col("z") <= 1000, F.col("pt_idx"))).cast("long")
    return P.returns(spark, d).groupBy("track_id", "shot_id").agg(F.count("*").alias("n_returns"), valid.alias("valid"), bad.alias("first_bad"))


@query(
    P.with_views(
        "select track_id, shot_idx, case when n_pts > 2 and refl > 0 then round(1.5 * refl, 9) else -1.0 end as value from v_shot where shot_idx % 3 = 0 and n_pts > 1",
        "v_shot",
    )
)
def f09_sk04_sampled_reflectance(spark, d):
    value = F.when((F.col("n_pts") > 2) & (F.col("refl") > 0), 1.5 * F.col("refl")).otherwise(F.lit(-1.0))
    rows = P.shots(spark, d).where((F.col("shot_idx") % 3 == 0) & (F.col("n_pts") > 1))
    return P.rounded(rows.select("track_id", F.col("shot_idx").cast("long").alias("shot_idx"), value.alias("value")), 9)

@query(
    P.with_views(
        """select h.track_id, h.shot_id, coalesce(round(r.z, 4), -1.0) as altitude from v_shot h
        left join (select * from v_return where s = 2) r on r.track_id = h.track_id and r.shot_id = h.shot_id""",
        "v_shot",
    )
)
def sk05_detector_altitude(spark, d):
    one = P.returns(spark, d).where("s = 2").select("track_id", "shot_id", F.col("z").alias("alt"))
    out = P.shots(spark, d).join(one, ["track_id", "shot_id"], "left")
    return P.rounded(out.select("track_id", "shot_id", F.coalesce("alt", F.lit(-1.0)).alias("altitude")), 4)


@query(
    P.with_views(
        "select min(x) as x_min, max(x) as x_max, min(z) as z_min, max(z) as z_max, round(avg(x), 6) as cx, round(avg(z), 4) as cz from v_return", "v_return"
    )
)
def a04_a06_bounds_and_centroid(spark, d):
    rows = P.returns(spark, d)
    return rows.agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("z").alias("z_min"), F.max("z").alias("z_max"),
        F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("z"), 4).alias("cz"),
    )


LIGHT, CAMERA = (1e6, 2e6, 3e7), (0, 0, 1e6)


def ring_sql() -> str:
    """Beams, then crosses and lengths of the four faces, their sum, the angles, the law."""
    beam = ", ".join(f"min_by({c}, pt_idx) filter (where s = {k}) as {c}{k}" for k in range(1, 6) for c in "xyz")
    axes = {"x": "yz", "y": "zx", "z": "xy"}
    side = lambda c, k: f"(({c}{k} - {c}1)::double)"
    cross = ", ".join(
        f"{side(p, a)} * {side(q, b)} - {side(q, a)} * {side(p, b)} as c{f}{c}" for f, (a, b) in enumerate(tracks.RING) for c, (p, q) in axes.items()
    )
    size = ", ".join(f"sqrt(c{f}x * c{f}x + c{f}y * c{f}y + c{f}z * c{f}z) as l{f}" for f in range(4))
    total = ", ".join(" + ".join(f"coalesce(case when l{f} <> 0 then -c{f}{c} / l{f} end, 0.0)" for f in range(4)) + f" as t{c}" for c in "xyz")
    to = {n: {c: f"({float(v)} - {c}1)" for c, v in zip("xyz", at, strict=True)} for n, at in (("sun", LIGHT), ("eye", CAMERA))}
    dot = lambda a, b: " + ".join(f"{a[c]} * {b[c]}" for c in "xyz")
    normal = {c: f"t{c} / size" for c in "xyz"}
    far, near = (f"sqrt({dot(v, v)})" for v in to.values())
    weight = " + ".join(f"{c!r} * power(phase, {i}.0)" for i, c in enumerate(photometry.PHASE))
    up = "greatest(mu, 0.0)"
    return f"""select track_id, shot_id, n_returns, round(case when ok then case when mu0 < 0 or mu0 + {up} = 0 then 0.0
        else greatest(2 * ({weight}) * mu0 / (mu0 + {up}) + (1 - ({weight})) * mu0, 0.0) end else -1.0 end, 6) as reflectance from (
        select *, ({dot(normal, to["sun"])}) / {far} as mu0, ({dot(normal, to["eye"])}) / {near} as mu,
        degrees(acos(greatest(-1.0, least(1.0, ({dot(*to.values())}) / ({far} * {near}))))) as phase from (
        select *, size > 0 and n_returns <= 5 and x1 is not null as ok from (select *, sqrt(tx * tx + ty * ty + tz * tz) as size from (select *, {total} from (
        select *, {size} from (select *, {cross} from (select track_id, shot_id, count(*) as n_returns, {beam} from v_return group by track_id, shot_id)))))
        ) where ok union all by name select track_id, shot_id, count(*) as n_returns, false as ok from v_return group by track_id, shot_id
        ) qualify row_number() over (partition by track_id, shot_id order by ok desc) = 1"""


@query(P.with_views(ring_sql(), "v_return"))
def i14_ring_reflectance(spark, d):
    """Reflectances of all shots."""
    rows = P.returns(spark, d)
    return P.rounded(tracks.ring_reflectance(rows, ["track_id", "shot_id"], "s", ["x", "y", "z"], LIGHT, CAMERA))


@query(
    P.with_views(
        FLAT.format(
            keys="",
            inner=histogram_sql(
                "err",
                f"""(select abs(image - least(1.0, refl * gain)) * 1000 as err from v_shot join (select track_id as tk,
                {GAIN.format(least=2)} from v_shot group by track_id) on track_id = tk where refl >= 0 and image >= 0)""",
            ),
        ),
        "v_shot",
    )
)
def flagship_track_error_histogram(spark, d):
    """Tracks, a gain for each, and the histogram of what the gains leave."""
    rows = P.shots(spark, d)
    fitted = P.rounded(tracks.gain(rows, ["track_id"], "refl", "image")).select("track_id", "gain")
    both = rows.where("refl >= 0 and image >= 0").join(fitted, "track_id")
    synth = photometry.gain_bias(F.col("refl"), F.col("gain"), F.lit(0.0))
    return flat(stats.error_statistics(both.select((F.abs(F.col("image") - synth) * 1000).alias("err"))))


SAMPLED = "(select *, case when x <= 45 then z - 20000 end as value from v_return)"


def sampled(spark, d):
    """Returns with what an image holds under them; some lie outside."""
    return P.returns(spark, d).withColumn("value", F.when(F.col("x") <= 45, F.col("z") - 20000))


@query(
    P.with_views(
        f"""select track_id, shot_id, cast(pt_idx as integer) as pt_idx, case when bad is null or pt_idx < bad then value end as value, bad is null as valid from (
        select *, min(case when value is null or value <= -15000 then pt_idx end) over (partition by track_id, shot_id) as bad from {SAMPLED})""",
        "v_return",
    )
)
def f05_cube_validity(spark, d):
    """What each return keeps of a cube's values, and whether its shot counts."""
    rows = sampled(spark, d)
    shots = validity.cube_shots(rows, ["track_id", "shot_id"], "pt_idx", "value", F.lit(-15000.0))
    kept = validity.kept_values(rows, shots, ["track_id", "shot_id"], "pt_idx", ["value"])
    return kept.select("track_id", "shot_id", "pt_idx", "value", "valid")


@query(
    P.with_views(
        f"""select track_id, shot_id, n as n_returns, case when not ended and n <= 5 then cast(bad as integer) end as first_bad, not ended and n <= 5 as scanned,
        case when ended then shot_id % 2 = 0 else n <= 5 and bad is null and has end as valid,
        case when ended then 'not scanned' when n > 5 then 'many returns' when bad is not null then 'outside or zero' when not has then 'no detector' else '' end as cause from (
        select *, coalesce(bool_or(n > 5) over (partition by track_id order by shot_id rows between unbounded preceding and 1 preceding), false) as ended from (
        select track_id, shot_id, count(*) as n, min(case when value is null or value = 0 then pt_idx end) as bad, bool_or(s = 1) and bool_or(s = 2) and bool_or(s = 3) as has
        from {SAMPLED} group by track_id, shot_id))""",
        "v_return",
    )
)
def f06_image_validity(spark, d):
    """Which shots an image makes valid; a shot of many returns ends its track."""
    rows = sampled(spark, d).withColumn("was", F.col("shot_id") % 2 == 0)
    return validity.image_shots(rows, ["track_id"], "shot_id", "pt_idx", "s", "value", "was", P.parts(P.table(spark, d, "orders")))


@query(
    P.with_views(
        f"""select r.track_id, r.shot_id, r.n_returns, r.reflectance, r.n_returns <= 5 and centre and r.reflectance >= 0 as valid, case when r.n_returns > 5 then 'many returns' when not centre then 'no centre'
        when r.reflectance < 0 then 'no triangle' else '' end as cause from ({ring_sql()}) r join
        (select track_id, shot_id, bool_or(s = 1) as centre from v_return group by track_id, shot_id) c on c.track_id = r.track_id and c.shot_id = r.shot_id""",
        "v_return",
    )
)
def f07_reflectance_validity(spark, d):
    """Shots with a reflectance, and why others have none."""
    rows = P.returns(spark, d)
    return P.rounded(validity.reflectance_shots(rows, ["track_id", "shot_id"], "s", ["x", "y", "z"], LIGHT, CAMERA))
