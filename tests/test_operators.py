"""Closed-form cases, metamorphic properties and plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from selenite.operators import matching, registration, stats, tracks
from selenite.plans import catalog, match_queries, proxies
from selenite.sources import text
from tests.conftest import SF

REF = [(0, 0, 0), (1, 2, 3), (20, 30, 40)]
MATCH = [(1, 1, 1), (2, 3, 4), (21, 31, 41)]
COLUMNS = "r_x double, r_y double, r_z double, m_x double, m_y double, m_z double"


def pairs(spark, ref, match):
    return spark.createDataFrame([tuple(map(float, (*r, *m))) for r, m in zip(ref, match, strict=True)], COLUMNS)


def test_mean_translation(spark):
    assert tuple(registration.mean_translation(pairs(spark, REF, MATCH)).first()) == (-1.0, -1.0, -1.0)


def test_matching_error(spark):
    errors = [r.err for r in registration.matching_errors(pairs(spark, REF, MATCH)).collect()]
    assert errors == pytest.approx([math.sqrt(3)] * 3)


def test_rotation_is_never_a_reflection(spark):
    ref, match = [(5, 5, 4), (5, 6, 5), (6, 5, 5)], [(5, 5, 6), (5, 6, 5), (6, 5, 5)]
    r, _, n = registration.solve_rigid(pairs(spark, ref, match))
    assert n == 3
    assert np.allclose(r, np.array([[1, -2, -2], [-2, 1, -2], [2, 2, -1]]) / 3)


def test_rigid_motion_is_recovered(spark):
    rng = np.random.default_rng(3)
    a, t = 0.3, np.array([1.0, -2.0, 0.5])
    turn = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    m = rng.normal(size=(50, 3))
    r, shift, _ = registration.solve_rigid(pairs(spark, m @ turn.T + t, m))
    assert np.allclose(r, turn) and np.allclose(shift, t)


def test_no_pairs_means_no_motion(spark):
    r, t, n = registration.solve_rigid(spark.createDataFrame([], COLUMNS))
    assert np.allclose(r, np.eye(3)) and not t.any() and n == 0


def test_histogram(spark):
    rows = spark.createDataFrame([(v,) for v in (1.0, 2.2, 3.3, 7.9, 4.4)], "err double")
    s = stats.error_statistics(rows, edges=(0, 2.5, 5, 7.5)).first()
    assert (s.hist, s.min_err, s.max_err, s.n) == ([2, 2, 0, 1], 1.0, 7.9, 5)
    assert s.avg_err == pytest.approx(3.76)


def test_merged_parts_equal_one_pass(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i % 4, rng.uniform(-10, 12000)) for i in range(400)], "k int, err double")
    whole = stats.error_statistics(rows).first()
    merged = stats.merge_statistics(stats.error_statistics(rows, ["k"])).first()
    assert (merged.hist, merged.n, merged.min_err, merged.max_err) == (whole.hist, whole.n, whole.min_err, whole.max_err)
    assert merged.avg_err == pytest.approx(whole.avg_err)


def test_sessions_follow_file_order(spark):
    from datetime import datetime, timedelta

    start, steps = datetime(2009, 10, 3), [0, 0, 1, 2999, 0, 3001, -4000, 10]
    times, at = [], start
    for s in steps:
        at += timedelta(seconds=s)
        times.append(at)
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(times)], "f int, i int, ts timestamp")
    out = tracks.sessionize(rows, ["f"], ["i"]).orderBy("i").collect()
    assert [r.track_id for r in out] == [0, 0, 0, 0, 0, 1, 2, 2]
    assert [r.shot_id for r in out] == [0, 0, 1, 2, 2, 0, 0, 1]


def test_window_filters_equal_a_loop(spark):
    rng = random.Random(1)
    value = [rng.choice([-1.0, rng.random(), rng.random()]) for _ in range(60)]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(value)], "t int, i int, v double")
    out = tracks.box_gradient(tracks.derivative_valid(tracks.interpolate_holes(rows, ["t"], "i", "v"), ["t"], "i", "v", 2), ["t"], "i", "v", 2)
    got = {r.i: (r.v, r.valid, r.gradient) for r in out.collect()}
    filled = list(value)
    for i in range(1, 59):
        if filled[i] < 0 and filled[i - 1] > 0 and filled[i + 1] > 0:
            filled[i] = (filled[i - 1] + filled[i + 1]) / 2
    for i in range(60):
        near = filled[i - 2 : i + 3] if 2 <= i < 58 else []
        ok = len(near) == 5 and min(near) >= 0
        assert got[i][0] == pytest.approx(filled[i]) and got[i][1] == ok
        assert got[i][2] == pytest.approx(sum(near[3:]) - sum(near[:2]) if ok else 0)


def test_detector_reflectance_has_sentinels(spark):
    rows = catalog.QUERIES["i14_ring_reflectance"](spark, SF).collect()
    assert rows and all(r.reflectance == -1 or r.reflectance >= 0 for r in rows)
    assert all(r.reflectance == -1 for r in rows if r.n_returns > 5)


def test_closest_points_recover_a_known_shift(spark):
    row = catalog.QUERIES["i01_i05_icp_known_shift"](spark, SF).first()
    assert row.n >= 1 and row.err >= 0


def test_poses_compose_like_a_loop(spark):
    got = {r.user_id: (r.r, r.t) for r in catalog.QUERIES["i08_compose_poses"](spark, SF).collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "event_id").collect()
    poses = {}
    for e in events:
        a = e["value"] / 1000
        r = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
        big, t = poses.get(e["user_id"], (np.eye(3), np.zeros(3)))
        poses[e["user_id"]] = (big @ r, big @ np.array([e["value"], 1, 0]) + t)
    for k, (r, t) in poses.items():
        assert np.allclose(np.array(got[k][0]).reshape(3, 3), r) and np.allclose(got[k][1], t)


def test_box_join_equals_all_pairs(spark):
    rng = random.Random(2)
    make = lambda n: [(i, x := rng.uniform(-20, 20), x + rng.uniform(0, 15), y := rng.uniform(-20, 20), y + rng.uniform(0, 15)) for i in range(n)]
    a, b = make(40), make(50)
    schema = "id long, x0 double, x1 double, y0 double, y1 double"
    got = {tuple(r) for r in matching.box_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 6.0).collect()}
    want = {(l[0], r[0]) for l in a for r in b if l[1] <= r[2] and r[1] <= l[2] and l[3] <= r[4] and r[3] <= l[4]}
    assert got == want


def test_gauss_newton_reaches_the_affine(spark):
    want = np.array([1.2, 0.1, 2.0, -0.3, 0.9, 1.0])
    rows = spark.createDataFrame([(float(i % 7), float(i // 7)) for i in range(49)], "x double, y double")

    def at(m):
        x, y = F.col("x"), F.col("y")
        d = [F.lit(float(w - v)) for w, v in zip(want, m, strict=True)]
        first, second = d[0] * x + d[1] * y + d[2], d[3] * x + d[4] * y + d[5]
        zero, one = F.lit(0.0), F.lit(1.0)
        a = rows.select(x.alias("j0"), y.alias("j1"), one.alias("j2"), *(zero.alias(f"j{i}") for i in (3, 4, 5)), first.alias("r"))
        b = rows.select(*(zero.alias(f"j{i}") for i in (0, 1, 2)), x.alias("j3"), y.alias("j4"), one.alias("j5"), second.alias("r"))
        return a.unionByName(b)

    found, _ = registration.gauss_newton_affine(at, np.array([1.0, 0, 0, 0, 1.0, 0]), 5)
    assert np.allclose(found, want)


def test_statistics_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(float(v),) for v in range(0, 500, 7)], "err double")
    one = stats.error_statistics(rows)
    text.statistics_lines(one).coalesce(1).write.text(str(tmp_path / "s"))
    back = text.statistics_pairs(text.lines(spark, str(tmp_path / "s"))).where("n is not null").first()
    first = one.first()
    assert (back.hist, back.n, back.min_err, back.max_err) == (first.hist, first.n, first.min_err, first.max_err)


def test_empty_write_raises(spark, tmp_path):
    with pytest.raises(ValueError):
        text.write_lines(spark.createDataFrame([], "value string"), str(tmp_path / "x"))


def test_lists_expand_in_place(spark):
    names = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C.data"), (3, "l.txt")], "ord int, name string")
    listed = spark.createDataFrame([("l.txt", 0, "File01 File02"), ("l.txt", 1, "File03.data")], "path string, line_no int, line string")
    got = [r.name for r in text.expand_inputs(names, text.tokens(listed)).collect()]
    assert got == ["A", "B", "C.data", "File01", "File02", "File03.data"]


def test_rasters_hold_every_vector(spark, tmp_path):
    rng = np.random.default_rng(8)
    n = 4100
    grid = rng.normal(size=(n, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(grid)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(500).selectExpr("id * 997 as event_id", "id * 1.0D as value").write.parquet(f"{tmp_path}/events.parquet")
    d = str(tmp_path)
    assert proxies.height(spark, d) == n and proxies.raster(spark, d).count() == n * 64
    features = match_queries.features(spark, d)
    assert features.select("id").distinct().count() == features.count() == 16 * 1025
    got = {r.event_id: r.value for r in catalog.QUERIES["j01_bilinear_sample"](spark, d).collect()}
    assert len(got) == 500
    for k, v in got.items():
        x, y = k * 37 % 6300 / 100, k * 91 % ((n - 1) * 100) / 100
        i, j = int(x), int(y)
        near = grid[np.ix_([j, min(j + 1, n - 1)], [i, min(i + 1, 63)])].astype(float)
        assert v == pytest.approx(np.array([1 - y + j, y - j]) @ near @ np.array([1 - x + i, x - i]), abs=1e-7)


def test_nearest_descriptors_search_every_vector(spark, tmp_path):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(900, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = ((v[1::2, None] - v[None, ::2]) ** 2).sum(2)
    two = np.argsort(d, axis=1)[:, :2]
    want = {(2 * q + 1, 2 * int(t), k + 1) for q, ts in enumerate(two) for k, t in enumerate(ts)}
    got = {(r.q_id, r.t_id, r["rank"]) for r in catalog.QUERIES["j13_o03_nearest_descriptors"](spark, str(tmp_path)).collect()}
    assert got == want
    near = np.sort(d, axis=1)
    ratio = {2 * int(q) + 1 for q in np.flatnonzero(np.sqrt(near[:, 0]) <= 0.97 * np.sqrt(near[:, 1]))}
    assert {r.q_id for r in catalog.QUERIES["j13_o05_ratio_test"](spark, str(tmp_path)).collect()} == ratio
    back = d.argmin(0)
    mutual = {(2 * q + 1, 2 * int(t)) for q, t in enumerate(two[:, 0]) if back[t] == q}
    assert {(r.q_id, r.t_id) for r in catalog.QUERIES["j14_mutual_nearest"](spark, str(tmp_path)).collect()} == mutual
