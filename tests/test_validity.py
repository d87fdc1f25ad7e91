"""Shot validity by each of its causes."""

from pyspark.sql import functions as F

from selenite.operators import validity

NAN = float("nan")


def test_a_bad_return_ends_the_scan(spark):
    rows = [(1, 0, 1.0), (1, 1, 5.0), (1, 2, 0.5), (1, 3, 7.0), (2, 0, 3.0), (3, 0, None), (3, 1, 2.0), (4, 0, 2.0), (4, 1, NAN)]
    df = spark.createDataFrame(rows, "shot int, i int, v double")
    shots = validity.cube_shots(df, ["shot"], "i", "v", F.lit(0.5))
    got = {(r.shot, r.i): (r.v, r.valid) for r in validity.kept_values(df, shots, ["shot"], "i", ["v"]).collect()}
    assert got == {
        (1, 0): (1.0, False), (1, 1): (5.0, False), (1, 2): (None, False), (1, 3): (None, False), (2, 0): (3.0, True), (3, 0): (None, False), (3, 1): (None, False),
        (4, 0): (2.0, False), (4, 1): (None, False),
    }


def test_many_returns_end_the_track(spark):
    shot = lambda k, n, v=1.0, s=0: [("a", k, i, i % 5 + 1 + s, v, k != 9) for i in range(n)]
    rows = shot(1, 5) + shot(2, 3) + shot(3, 4, 0.0) + shot(4, 3, 1.0, 2) + shot(5, 2) + shot(6, 6) + shot(7, 5) + shot(9, 5)
    rows += [("b", 1, 0, 1, None, None), ("b", 2, 0, 2, 4.0, None)]
    df = spark.createDataFrame(rows, "track string, shot int, i int, s int, v double, was boolean")
    shots = validity.image_shots(df, ["track"], "shot", "i", "s", "v", "was")
    got = {(r.track, r.shot): (r.valid, r.cause, r.first_bad, r.scanned) for r in shots.collect()}
    assert got == {
        ("a", 1): (True, "", None, True), ("a", 2): (True, "", None, True), ("a", 3): (False, "outside or zero", 0, True), ("a", 4): (False, "no detector", None, True),
        ("a", 5): (False, "no detector", None, True), ("a", 6): (False, "many returns", None, False), ("a", 7): (True, "not scanned", None, False),
        ("a", 9): (False, "not scanned", None, False), ("b", 1): (False, "outside or zero", 0, True), ("b", 2): (False, "no detector", None, True),
    }
    kept = validity.kept_values(df.where("track = 'a' and shot in (1, 7)"), shots, ["track", "shot"], "i", ["v"], F.col("scanned"))
    assert {(r.shot, r.v) for r in kept.collect()} == {(1, 1.0), (7, None)}


def test_faces_of_a_shot(spark):
    at = {1: (0.0, 0.0, 10.0), 2: (-1.0, 0.0, 10.1), 3: (0.0, 1.0, 10.0), 4: (1.0, 0.0, 10.0), 5: (0.0, -1.0, 10.2)}
    shots = {1: [1, 2, 3, 4, 5], 2: [2, 3, 4, 5], 3: [1, 2, 4], 4: [1, 2, 3], 5: [1, 2, 3, 4, 5, 5], 6: [1]}
    rows = [(k, i, s, *at[s]) for k, beams in shots.items() for i, s in enumerate(beams)]
    df = spark.createDataFrame(rows, "shot int, pt_idx int, s int, x double, y double, z double")
    got = {r.shot: (r.valid, r.cause, r.reflectance >= 0) for r in validity.reflectance_shots(df, ["shot"], "s", ["x", "y", "z"], (0, 0, 1e6), (0, 0, 1e6)).collect()}
    good = (True, "", True)
    assert got == {1: good, 2: (False, "no centre", False), 3: (False, "no triangle", False), 4: good, 5: (False, "many returns", False), 6: (False, "no triangle", False)}
