"""Ordered operators over laser tracks: sessions, filters, weights, features.

All windows of a pipeline partition by the same keys, so Spark shuffles once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRACK_GAP_S = 3000
#: The salient-feature threshold and the 12 taps (outer quarters +1, middle -1).
FEATURE_THRESHOLD = 0.008
STEP_TAPS = (1, 1, 1, -1, -1, -1, -1, -1, -1, 1, 1, 1)


def in_range(lon: Column, lat: Column, radius_km: Column) -> Column:
    """Accepted returns; filter before any window, since rejected rows are no predecessors."""
    return lon.between(-180, 360) & lat.between(-90, 90) & radius_km.between(1720, 1750)


def seconds_apart(ts: Column, previous: Column) -> Column:
    micros = F.abs(F.unix_micros(ts.cast("timestamp")) - F.unix_micros(previous.cast("timestamp")))
    return F.floor(micros / 1_000_000)


def time_differs(ts: Column, previous: Column, threshold_s: int) -> Column:
    """Equal times never differ; others do from ``threshold_s`` whole seconds apart, in either direction."""
    return (ts != previous) & (seconds_apart(ts, previous) >= threshold_s)


def sessionize(returns: DataFrame, source: Sequence[str], order: Sequence[str], ts: str = "ts", gap_s: int = TRACK_GAP_S) -> DataFrame:
    """``track_id`` and ``shot_id`` (within the track), from 0, in file order.

    A track ends at a gap of ``gap_s`` whole seconds; a shot at any change of time.
    """
    w = W.partitionBy(*source).orderBy(*order)
    before = F.lag(ts).over(w)
    out = returns.withColumn("_gap", F.coalesce(time_differs(F.col(ts), before, gap_s), F.lit(False)))
    out = out.withColumn("_new", F.col("_gap") | F.coalesce(F.col(ts) != before, F.lit(False)))
    running = w.rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("track_id", F.sum(F.col("_gap").cast("long")).over(running))
    out = out.withColumn("_shot", F.sum(F.col("_new").cast("long")).over(running))
    first = F.min("_shot").over(W.partitionBy(*source, "track_id"))
    return out.withColumn("shot_id", F.col("_shot") - first).drop("_gap", "_new", "_shot")


def split_tracks(returns: DataFrame, source: Sequence[str], order: Sequence[str], ts: str = "ts") -> DataFrame:
    """Tracks with the name their file gets: the first time, with dashes for colons."""
    rows = sessionize(returns, source, order, ts)
    name = F.date_format(F.min(ts), "yyyy-MM-dd'T'HH-mm-ss")
    return rows.groupBy(*source, "track_id").agg(name.alias("name"), F.count("*").alias("n_returns"))


def interpolate_holes(rows: DataFrame, track: Sequence[str], order: str, value: str) -> DataFrame:
    """Negative values between two positive neighbours become their mean."""
    w = W.partitionBy(*track).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    hole = (F.col(value) < 0) & (before > 0) & (after > 0)
    return rows.withColumn(value, F.when(hole, (before + after) / 2).otherwise(F.col(value)))


def derivative_valid(rows: DataFrame, track: Sequence[str], order: str, value: str, half: int) -> DataFrame:
    """``valid`` where the row and ``half`` rows on each side exist and are not negative."""
    w = W.partitionBy(*track).orderBy(order).rowsBetween(-half, half)
    whole = (F.count(value).over(w) == 2 * half + 1) & (F.min(value).over(w) >= 0)
    return rows.withColumn("valid", whole)


def box_gradient(rows: DataFrame, track: Sequence[str], order: str, value: str, half: int) -> DataFrame:
    """``gradient``: the rows after minus the rows before, where valid; else 0."""
    w = W.partitionBy(*track).orderBy(order)
    after, before = F.sum(value).over(w.rowsBetween(1, half)), F.sum(value).over(w.rowsBetween(-half, -1))
    return rows.withColumn("gradient", F.when(F.col("valid"), after - before).otherwise(F.lit(0.0)))


def salient_by_quantile(rows: DataFrame, track: Sequence[str], top: float) -> DataFrame:
    """``salient``: the strongest share ``top`` of the valid gradients of each track.

    The threshold is the value at place ceil((1 - top) n) of the sorted strengths, ties kept.
    """
    strength = F.abs("gradient")
    ranked = W.partitionBy(*track).orderBy(F.col("valid").desc(), strength)
    n = F.sum(F.col("valid").cast("long")).over(W.partitionBy(*track))
    place = F.least(F.ceil((1 - top) * n), n - 1) + 1
    out = rows.withColumn("_at", F.when(F.col("valid"), F.row_number().over(ranked))).withColumn("_place", place)
    cut = F.max(F.when(F.col("_at") == F.col("_place"), strength)).over(W.partitionBy(*track))
    salient = F.coalesce(F.col("valid") & (strength >= cut), F.lit(False))
    return out.withColumn("salient", salient).drop("_at", "_place")


def pyramid_weights(rows: DataFrame, track: Sequence[str], order: str, half: int) -> DataFrame:
    """``weight``: each salient row adds (W - |distance|) / W to rows up to ``half`` away, W = 2 half + 1."""
    w = W.partitionBy(*track).orderBy(order)
    width = 2 * half + 1
    near = [F.coalesce(F.lag(F.col("salient").cast("double"), k).over(w), F.lit(0.0)) * ((width - abs(k)) / width) for k in range(-half, half + 1)]
    return rows.withColumn("weight", sum(near[1:], near[0]))


def feature_weights(rows: DataFrame, track: Sequence[str], order: str, value: str, half: int, top: float) -> DataFrame:
    """Holes, validity, gradient, quantile and weights, one after the other over one partitioning."""
    out = interpolate_holes(rows, track, order, value)
    out = derivative_valid(out, track, order, value, half)
    out = box_gradient(out, track, order, value, half)
    return pyramid_weights(salient_by_quantile(out, track, top), track, order, half)


def cumulative_distance(rows: DataFrame, track: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """``distance`` along the track in the plane, from 0."""
    w = W.partitionBy(*track).orderBy(order)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    out = rows.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return out.withColumn("distance", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_step")


def track_profile(rows: DataFrame, track: Sequence[str], order: str, synthetic: str, image: str, least: int = 25) -> DataFrame:
    """Points with both values, of tracks with at least ``least`` of them."""
    some = rows.where((F.col(synthetic) >= 0) & (F.col(image) >= 0))
    counted = some.withColumn("n_valid", F.count("*").over(W.partitionBy(*track)))
    return counted.where(F.col("n_valid") >= least)


def matched_filter(
    rows: DataFrame, track: Sequence[str], order: str, altitude: str, usable: str, taps: Sequence[float] = STEP_TAPS,
    threshold: float = FEATURE_THRESHOLD,
) -> DataFrame:
    """``response`` and ``feature``: a filter over rows -n/2 .. n/2-1, with larger neighbours suppressing.

    The response is 0 where the window leaves the track or holds an unusable row.
    """
    w = W.partitionBy(*track).orderBy(order)
    low, high = -(len(taps) // 2), len(taps) - len(taps) // 2 - 1
    frame = w.rowsBetween(low, high)
    whole = (F.count(altitude).over(frame) == len(taps)) & (F.min(F.col(usable).cast("int")).over(frame) == 1)
    total = sum((F.lead(altitude, low + i).over(w) * float(t) for i, t in enumerate(taps)), F.lit(0.0))
    out = rows.withColumn("response", F.when(whole, total / len(taps)).otherwise(F.lit(0.0)))
    largest = F.max("response").over(frame)
    return out.withColumn("feature", (F.abs("response") > threshold) & (F.col("response") >= largest))


def gain(rows: DataFrame, track: Sequence[str], reflectance: str, image: str, least: int = 2) -> DataFrame:
    """Per track: gain = sum of image over sum of reflectance of the usable points, bias 0; 0 with fewer than ``least``."""
    ok = (F.col(reflectance) >= 0) & (F.col(image) >= 0)
    sums = rows.groupBy(*track).agg(
        F.sum(F.when(ok, F.col(image))).alias("_i"), F.sum(F.when(ok, F.col(reflectance))).alias("_r"), F.count(F.when(ok, 1)).alias("n_points")
    )
    value = F.when((F.col("n_points") >= least) & (F.col("_r") != 0), F.col("_i") / F.col("_r")).otherwise(F.lit(0.0))
    return sums.select(*track, value.alias("gain"), F.lit(0.0).alias("bias"), "n_points")


#: The faces around the centre beam.
RING = ((2, 3), (3, 4), (4, 5), (5, 2))


def ring_reflectance(returns: DataFrame, shot: Sequence[str], detector: str, p: Sequence[str], light: Sequence[float], camera: Sequence[float]) -> DataFrame:
    """Reflectance of each shot from the normals of the faces around the centre beam (ring 2-3-4-5-2).

    -1 without a centre, with more than five returns or without any face. Of returns of
    one detector the first in ``pt_idx`` counts.
    """
    from selenite.functions import geo, photometry

    beam = [F.min_by(F.struct(*p), F.when(F.col(detector) == k, F.col("pt_idx"))) for k in range(1, 6)]
    shots = returns.groupBy(*shot).agg(F.count("*").alias("n_returns"), *(b.alias(f"b{k}") for k, b in enumerate(beam, 1)))
    point = {k: [F.col(f"b{k}")[c] for c in p] for k in range(1, 6)}
    # every step is a projection of its own: what several columns use is worked out once
    rows = shots
    for f, (a, b) in enumerate(RING):
        cross = geo.cross(geo.sub(point[a], point[1]), geo.sub(point[b], point[1]))
        rows = rows.withColumns({f"_c{f}{i}": c for i, c in enumerate(cross)})
    vectors = [[F.col(f"_c{f}{i}") for i in range(3)] for f in range(len(RING))]
    rows = rows.withColumns({f"_l{f}": geo.norm(v) for f, v in enumerate(vectors)})
    part = lambda f, i: F.coalesce(F.when(F.col(f"_l{f}") != 0, -vectors[f][i] / F.col(f"_l{f}")), F.lit(0.0))
    rows = rows.withColumns({f"_t{i}": sum((part(f, i) for f in range(1, len(RING))), part(0, i)) for i in range(3)})
    total = [F.col(f"_t{i}") for i in range(3)]
    rows = rows.withColumn("_size", geo.norm(total))
    usable = (F.col("n_returns") <= 5) & F.col("b1").isNotNull() & (F.col("_size") > 0)
    normal = [F.when(usable, c / F.col("_size")) for c in total]
    rows = rows.withColumns({f"_n{i}": c for i, c in enumerate(normal)})
    seen = photometry.angles(point[1], [F.col(f"_n{i}") for i in range(3)], light, camera)
    rows = rows.withColumns(dict(zip(("_mu0", "_mu", "_phase"), seen, strict=True)))
    value = photometry.lunar_lambertian(F.col("_mu0"), F.col("_mu"), F.col("_phase"))
    return rows.select(*shot, "n_returns", F.coalesce(F.when(usable, value), F.lit(-1.0)).alias("reflectance"))


def profile_lines(profile: DataFrame, track: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """(track, line_no, value): a line for each named value of a track's points in order, six decimals."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order), *(F.col(c).cast("double").alias(c) for c in values))))
    rows = profile.groupBy(*track).agg(listed.alias("p"))
    line = lambda c: F.array_join(F.transform("p", lambda q: F.format_string("%.6f", q[c])), " ")
    return rows.select(*track, F.posexplode(F.array(*map(line, values))).alias("line_no", "value"))
