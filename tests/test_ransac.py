"""Outlier masks with planted outliers."""

import numpy as np
import pytest

from selenite.operators import ransac

H = np.array([[1.1, 0.05, 12.0], [-0.04, 0.95, -7.0], [1e-4, -5e-5, 1.0]])


def planted(spark, kind, seed, share, noise=0.2):
    """Three films of pairs, of which ``share`` are moved away."""
    rng = np.random.default_rng(seed)
    rows = []
    for film in range(3):
        p = rng.uniform(0, 600, (120, 2))
        if kind == "homography":
            q = np.c_[p, np.ones(120)] @ H.T
            q = q[:, :2] / q[:, 2:]
        else:  # points of a scene seen by two cameras
            z = rng.uniform(4, 9, 120)
            space = np.c_[(p - 300) / 500 * z[:, None], z]
            c, s = np.cos(0.1), np.sin(0.1)
            moved = space @ np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]).T + [0.8, 0.1, 0.2]
            q = moved[:, :2] / moved[:, 2:] * 500 + 300
        q = q + rng.uniform(-noise, noise, q.shape)
        bad = rng.random(120) < share
        q[bad] += rng.choice([-1, 1], (bad.sum(), 2)) * rng.uniform(30, 90, (bad.sum(), 2))
        rows += [(film, i, *map(float, (*p[i], *q[i])), bool(bad[i])) for i in range(120)]
    return spark.createDataFrame(rows, "film int, id int, x double, y double, u double, v double, bad boolean"), rows


@pytest.mark.parametrize("kind, method, share", [("homography", "ransac", 0.4), ("homography", "lmeds", 0.3), ("fundamental", "ransac", 0.25)])
def test_planted_outliers_are_found(spark, kind, method, share):
    df, rows = planted(spark, kind, 3, share)
    masked = ransac.outlier_mask(df, ["film"], kind, method)
    got = {(r.film, r.id): r.inlier for r in masked.collect()}
    bad = {(r[0], r[1]) for r in rows if r[-1]}
    if kind == "homography":
        assert all(not got[k] for k in bad)
    else:  # an epipolar line says nothing about the place along it
        assert sum(got[k] for k in bad) < 0.15 * len(bad)
    good = [k for k in got if k not in bad]
    assert sum(got[k] for k in good) > 0.95 * len(good)
    assert {(r.film, r.id): r.inlier for r in ransac.outlier_mask(df.repartition(5), ["film"], kind, method).collect()} == got
    for r in ransac.robust_models(masked, ["film"], kind).collect():
        m = np.reshape(r.model, (3, 3))
        if kind == "homography":
            assert np.allclose(m / m[2, 2], H, atol=[[2e-2, 2e-2, 1], [2e-2, 2e-2, 1], [1e-4, 1e-4, 1e-9]])
        else:
            assert abs(np.linalg.det(m)) < 1e-12
            p = np.array([(*x[2:6],) for x in rows if x[0] == r.film and not x[-1]])
            lines = np.c_[p[:, :2], np.ones(len(p))] @ m.T
            off = np.abs((np.c_[p[:, 2:], np.ones(len(p))] * lines).sum(1)) / np.hypot(lines[:, 0], lines[:, 1])
            assert np.median(off) < 0.5


def test_all_pairs_and_few_pairs(spark):
    df, rows = planted(spark, "homography", 4, 0.0, noise=0.0)
    assert ransac.outlier_mask(df, ["film"], "homography", "all").where("inlier").count() == len(rows)
    (m, *_) = ransac.robust_models(df.selectExpr("*", "true as inlier"), ["film"]).collect()
    assert np.allclose(np.reshape(m.model, (3, 3)) / m.model[8], H, atol=1e-6)
    few = df.where("id < 3 or film = 0").selectExpr("film", "id", "x", "y", "if(id = 50, null, u) as u", "v")
    got = ransac.outlier_mask(few, ["film"]).collect()
    assert len(got) == 126 and all(r.inlier == (r.film == 0 and r.id != 50) for r in got)
    flat = df.selectExpr("film", "id", "1.0 as x", "2.0 as y", "3.0 as u", "4.0 as v")
    assert ransac.outlier_mask(flat, ["film"]).where("inlier").count() == 0
    assert ransac.outlier_mask(df.where("false"), ["film"]).count() == 0
