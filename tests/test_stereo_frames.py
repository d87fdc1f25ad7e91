"""Semi-global matching and running products of poses against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from selenite.operators import registration, stereo


def plain_paths(cost, p1, p2, dx, dy):
    """cost: {(x, y): list of costs}."""
    out = {}

    def at(p):
        if p not in out:
            before = (p[0] - dx, p[1] - dy)
            if before not in cost:
                out[p] = cost[p]
            else:
                prev = at(before)
                least = min(prev)
                far = 10**12
                out[p] = [
                    c + min(prev[i], (prev[i - 1] if i else far) + p1, (prev[i + 1] if i + 1 < len(prev) else far) + p1, least + p2) - least for i, c in enumerate(cost[p])
                ]
        return out[p]

    for p in sorted(cost, key=lambda p: p[0] * dx + p[1] * dy):
        at(p)
    return out


def plain(left, right, n, half, p1, p2, directions, unique=0, check=None):
    cost = {}
    for x, y in left:
        around = [(x + i, y + j) for i in range(-half, half + 1) for j in range(-half, half + 1)]
        c = [sum(abs(left[p] - right[p[0] - d, p[1]]) for p in around) if all(p in left and (p[0] - d, p[1]) in right for p in around) else None for d in range(n)]
        if any(v is not None for v in c):
            cost[x, y] = [stereo.NO_WINDOW if v is None else v for v in c]
    paths = [plain_paths(cost, p1, p2, *way) for way in stereo.DIRECTIONS[:directions]]
    sums = {p: [sum(v) for v in zip(*(w[p] for w in paths))] for p in cost}
    out = {}
    for p, s in sums.items():
        d = s.index(min(s))
        if unique and any(abs(k - d) > 1 and c * 100 < s[d] * (100 + unique) for k, c in enumerate(s)):
            continue
        out[p] = (d, s[d])
    if check is not None:
        theirs = {}
        for (x, y), s in sums.items():
            if (x, y) in out:
                for k, c in enumerate(s):
                    theirs[x - k, y] = min(theirs.get((x - k, y), (c, k)), (c, k))
        out = {(x, y): v for (x, y), v in out.items() if abs(theirs[x - v[0], y][1] - v[0]) <= check}
    return out


@pytest.fixture(scope="module")
def pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 60, (14, 40))
    left = {(x, y): int(base[y, x]) for x in range(30) for y in range(14) if (x, y) != (12, 6)}
    right = {(x, y): int(base[y, x + (3 if y < 7 else 1)] + rng.integers(0, 9)) for x in range(30) for y in range(14)}
    return left, right


@pytest.mark.parametrize("options", [{"directions": 4}, {"directions": 8, "unique": 10}, {"directions": 8, "check": 0}])
def test_semi_global_equals_a_plain_loop(spark, pair, monkeypatch, options):
    monkeypatch.setattr(stereo, "LINES", 5)
    frames = [spark.createDataFrame([(x, y, v) for (x, y), v in side.items()], "x int, y int, v long") for side in pair]
    got = {(r.x, r.y): (r.d, r.cost) for r in stereo.semi_global_match(*frames, 5, half=1, p1=4, p2=20, **options).collect()}
    assert got == plain(*pair, 5, 1, 4, 20, **options) and len(got) > 100
    inner = [p for p in got if 6 < p[0] < 28 and p[1] not in (5, 6, 7, 8)]
    assert sum(got[p][0] == (3 if p[1] < 7 else 1) for p in inner) > 0.95 * len(inner)


def test_semi_global_of_empty_images(spark, pair):
    frame = spark.createDataFrame([(0, 0, 5)], "x int, y int, v long")
    assert stereo.semi_global_match(frame.where("false"), frame, 3).count() == 0


def rotations(rng, n):
    q = rng.normal(size=(n, 4))
    w, x, y, z = (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    m = [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)]
    return np.stack([*m, 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], 1)


@pytest.mark.parametrize("block", [3, 4096])
def test_global_poses_equal_a_plain_fold(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(registration, "BLOCK", block)
    rng = np.random.default_rng(4)
    sizes = {"long": 400, "one": 1, None: 7, "two": 2, "mid": 60}
    rows, want = [], {}
    for k, n in sizes.items():
        r, t = rotations(rng, n), rng.normal(size=(n, 3))
        g = np.eye(4)
        for i in range(n):
            g = g @ registration.motions(r[i : i + 1], t[i : i + 1])[0]
            rows.append((k, i, r[i].tolist(), t[i].tolist()))
            want[k, i] = (i + 1, g.copy())
    rows += [("one", 5, None, [0.0, 0.0, 0.0]), ("none", 1, None, None)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "film string, part int, r array<double>, t array<double>").repartition(3)
    got = registration.global_poses(df, ["film"], "part", "r", "t", f"file://{tmp_path}/a").collect()
    assert len(got) == len(want)
    for x in got:
        n, g = want[x.film, x.part]
        assert x.n == n and np.allclose(np.reshape(x.r, (3, 3)), g[:3, :3], atol=1e-9) and np.allclose(x.t, g[:3, 3], atol=1e-9)
    last = {x.film: x for x in registration.compose_poses(df, ["film"], "part", "r", "t", f"file://{tmp_path}/b").collect()}
    assert {k: x.n for k, x in last.items()} == sizes and np.allclose(last["long"].t, want["long", 399][1][:3, 3], atol=1e-9)
    assert registration.global_poses(df.where("false"), ["film"], "part", "r", "t", f"file://{tmp_path}/c").count() == 0


def test_a_film_of_a_million_poses(spark, tmp_path):
    """It spreads over the tasks, and each holds a block of poses at a time."""
    a = F.lit(2 * np.pi / 1000)
    zero, one = F.lit(0.0), F.lit(1.0)
    poses = spark.range(1_000_000, numPartitions=4).select(
        F.lit(1).alias("film"), "id", F.array(F.cos(a), -F.sin(a), zero, F.sin(a), F.cos(a), zero, zero, zero, one).alias("r"), F.array(one, zero, zero).alias("t")
    )
    got = registration.global_poses(poses, ["film"], "id", "r", "t", f"file://{tmp_path}/x").where("id % 1000 = 999")
    off = F.greatest(F.abs(F.col("r")[0] - 1), F.abs(F.col("t")[0]), F.abs(F.col("t")[1]), F.abs(F.col("n") - F.col("id") - 1))
    assert tuple(got.agg(F.count("*"), F.max(off) < 1e-5).first()) == (1000, True)
    assert spark.read.parquet(f"file://{tmp_path}/x").select("part").distinct().count() == 4
