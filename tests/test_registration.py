"""Registrations against known motions, chains against a plain search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from selenite.operators import graphs, registration, sfm
from selenite.plans import catalog
from tests.conftest import SF


def surface(x, y):
    return 10 * math.sin(x / 9) + 8 * math.cos(y / 7) + 3 * math.sin((x + y) / 5)


@pytest.fixture(scope="module")
def dem(spark):
    rows = [(x, y, float(x), float(y), surface(x, y)) for x in range(60) for y in range(60)]
    return spark.createDataFrame(rows, "x int, y int, cx double, cy double, cz double").cache()


def shifted(dem, t):
    """DEM points moved by t, as lidar points that look around the pixel they came from."""
    some = dem.where("x % 3 = 0 and y % 3 = 0 and x between 6 and 52 and y between 6 and 52")
    return some.select(
        (F.col("x") * 100 + F.col("y")).alias("id"), F.col("x").alias("px"), F.col("y").alias("py"), *((F.col(f"c{c}") + v).alias(f"f{c}") for c, v in zip("xyz", t))
    )


def test_lidar_to_dem_finds_a_shift(spark, dem):
    shift = (0.3, -0.2, 0.1)
    r, t, errors = registration.lidar_to_dem(shifted(dem, shift), dem, 2, (0.0, 0.0, 0.0))
    assert np.allclose(r, np.eye(3), atol=1e-6) and np.allclose(t, shift, atol=1e-3)
    assert len(errors) == 2 and errors[0] > 0.3 and errors[1] < 1e-3
    assert registration.lidar_to_dem(shifted(dem, shift).where("false"), dem, 2, (0, 0, 0))[2] == []


def test_multi_start_takes_the_best(spark, dem):
    shift = np.array([4.0, -3.0, 0.5])
    starts = [(np.eye(3), np.array([8.0, 8.0, 0.0])), (np.eye(3), -shift + 0.2), (np.eye(3), np.array([500.0, 0.0, 0.0]))]
    best, found = registration.multi_start(shifted(dem, shift), dem, 2, starts, 4)
    assert best == 1 and np.allclose(found[1][1], -shift, atol=0.05) and found[1][2] < 0.05
    assert found[2][2] == float("inf") and found[0][2] > found[1][2]


def image_points(spark, m, n=50):
    """Points whose values are what the map reads from the surface."""
    m = np.asarray(m, float).reshape(-1, 3)
    rows = []
    for x in range(8, n, 2):
        for y in range(8, n, 2):
            u, v, *w = m @ (x, y, 1)
            w = w[0] if w else 1.0
            rows.append((float(x), float(y), surface(u / w, v / w)))
    return spark.createDataFrame(rows, "px double, py double, value double")


def image(dem):
    return dem.select("x", "y", F.col("cz").alias("v")).cache()


@pytest.mark.parametrize("m, start", [([1, 0, 2, 0, 1, -1], [1, 0, 0, 0, 1, 0]), ([1, 0, 2, 0, 1, -1, 0, 0, 1], [1, 0, 0, 0, 1, 0, 0, 0, 1])])
def test_gauss_newton_aligns_points_with_an_image(spark, dem, m, start):
    points, grid = image_points(spark, m).cache(), registration.image_gradients(image(dem)).cache()
    found, errors = registration.gauss_newton(lambda h: registration.alignment_rows(points, grid, h), np.array(start, float), 20)
    found = found / found[8] if len(found) == 9 else found
    assert errors[-1] < errors[0] / 20 and len(errors) < 20
    for x, y in ((10, 10), (40, 20), (25, 45)):
        w = found[6] * x + found[7] * y + found[8] if len(found) == 9 else 1.0
        assert abs((found[0] * x + found[1] * y + found[2]) / w - (x + 2)) < 0.6 and abs((found[3] * x + found[4] * y + found[5]) / w - (y - 1)) < 0.6


def test_coarse_to_fine_reaches_a_far_shift(spark, dem):
    m, errors = registration.coarse_to_fine(image_points(spark, [1, 0, 4, 0, 1, 3]), image(dem), np.array([1.0, 0, 0, 0, 1, 0]), (4, 2, 1), 10)
    assert errors and abs(m @ (25, 25, 1) - (29, 28)).max() < 0.7


def plain_chains(rows):
    chains, out, first = [], [], rows[0][0]
    for frame, px, py, qx, qy in rows:
        at = next((k for k, (x, y) in enumerate(chains) if abs(x - px) + abs(y - py) < 1e-3), None) if frame != first else None
        if at is None:
            chains.append((qx, qy))
            out.append(len(chains) - 1)
        else:
            chains[at] = (qx, qy)
            out.append(at)
    return out


def test_chains_equal_a_plain_search(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(3):
        for i in range(300):
            p, q = rng.integers(0, 6, 4).reshape(2, 2) + rng.choice([0.0, 0.0004, -0.0006, 0.002], (2, 2))
            rows.append((s, i // 30, i, *map(float, p), *map(float, q)))
    df = spark.createDataFrame(rows, "seq int, frame int, i int, px double, py double, qx double, qy double").repartition(4)
    got = {(r.seq, r.i): r.chain for r in sfm.chain_matches(df, ["seq"], "frame", ["i"], f"file://{tmp_path}/c").collect()}
    for s in range(3):
        own = [r for r in rows if r[0] == s]
        assert [got[s, r[2]] for r in own] == plain_chains([(r[1], *r[3:]) for r in own])


def test_chains_over_many_frames_and_the_query(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows, at, i = [], rng.uniform(0, 900, (25, 2)), 0
    for f in range(40):
        new = at + rng.uniform(-3, 3, at.shape)
        new[rng.integers(0, 25, 2)] = rng.uniform(0, 900, (2, 2))  # lost, and found elsewhere
        for k in rng.permutation(25)[:23]:
            rows.append((0, f, i, *map(float, at[k]), *map(float, new[k])))
            i += 1
        at = new
    df = spark.createDataFrame(rows, "seq int, frame int, i int, px double, py double, qx double, qy double").repartition(3)
    got = {r.i: r.chain for r in sfm.chain_matches(df, ["seq"], "frame", ["i"], f"file://{tmp_path}/c").collect()}
    assert [got[r[2]] for r in rows] == plain_chains([(r[1], *r[3:]) for r in rows])
    assert sfm.chain_matches(df.where("false"), ["seq"], "frame", ["i"], f"file://{tmp_path}/e").count() == 0
    seen = catalog.QUERIES["j16_chain_links"](spark, SF).collect()
    for user in {r.user_id for r in seen}:
        own = sorted((r for r in seen if r.user_id == user), key=lambda r: r.event_id)
        assert [r.chain for r in own] == plain_chains([(r.frame, r.px, r.py, r.qx, r.qy) for r in own])


def test_components_of_paths_and_stars(spark, tmp_path):
    edges = [(i, i + 1) for i in range(0, 500)] + [(1000, 2000 + i) for i in range(50)] + [(3000, 3001), (3001, 3000), (7, 7), (4, 4), (9000, 9000)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {}
    for r in graphs.components(df, f"file://{tmp_path}/g").collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, got.values())) == [2, 51, 501] and all(root in nodes for root, nodes in got.items())
    assert graphs.components(df.where("false"), f"file://{tmp_path}/h").count() == 0


def test_relative_rotation_needs_pairs_and_a_body(spark):
    a = 0.3
    turn = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    m = np.random.default_rng(1).normal(size=(40, 3))
    rows = [(*map(float, turn @ p), *map(float, p)) for p in m]
    df = spark.createDataFrame(rows, "r_x double, r_y double, r_z double, m_x double, m_y double, m_z double")
    assert np.allclose(sfm.relative_rotation(df, 10, 1e-3), turn)
    assert sfm.relative_rotation(df, 41, 1e-3) is None
    assert sfm.relative_rotation(df.withColumn("r_z", F.lit(0.0)), 10, 1e-3) is None
