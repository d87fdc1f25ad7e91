"""Plans and shapes that must hold on large tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from selenite.operators import matching, raster, sfm, stereo
from selenite.plans import catalog, proxies
from tests.conftest import SF


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pixels(spark, width, height):
    cell = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x")
    return spark.range(height).select(cell, F.col("id").cast("int").alias("y")).select("x", "y", (F.col("x") * 0.5 + F.col("y")).alias("v"))


def test_exploded_rows_are_never_broadcast(spark):
    """Spark takes exploded rows for far smaller than they are."""
    image = pixels(spark, 40, 50)
    found = raster.padded_pyramid(image, 40, 50, 16, 1, 2)
    assert "Broadcast" not in physical(found)
    assert {(r["level"], r["tx"], r["ty"], r["i"], r["j"]): r["v"] for r in found.collect()}[1, 0, 1, 3, 2] == 6 * 0.5 + 36
    assert "Broadcast" not in physical(raster.nearest(spark.range(3).selectExpr("id", "id as px", "id as py"), image, ["id"]))


def test_shift_errors_meet_the_pixels_of_every_candidate(spark):
    """Also left of the image, where a cut towards 0 goes up, and where a sum rounds up to a whole number."""
    rng = np.random.default_rng(3)
    image = rng.normal(size=(30, 12))
    points = [(float(x), float(y), float(v)) for x, y, v in zip(rng.uniform(-12, 20, 200), rng.uniform(-12, 40, 200), rng.normal(size=200), strict=True)]
    points += [(2.9999999999999996, 3.0, 1.0), (-0.5, -5.5, 2.0), (-5.0, 0.0, -1.0)] * 2
    thetas, shifts = [-0.2, 0.0, 0.3], [-5.0, 0.0, 5.0]
    sums = {}
    for i, t in enumerate(thetas):
        for j, dx in enumerate(shifts):
            for k, dy in enumerate(shifts):
                for px, py, v in points:
                    x, y = int(math.cos(t) * px - math.sin(t) * py + dx), int(math.sin(t) * px + math.cos(t) * py + dy)
                    if 0 <= x < 12 and 0 <= y < 30 and (math.cos(t) * px - math.sin(t) * py + dx > -1) and (math.sin(t) * px + math.cos(t) * py + dy > -1):
                        sums.setdefault((i * 3 + j) * 3 + k, []).append((v - 2 * image[y, x]) ** 2)
    rows = spark.createDataFrame([(y, [float(v) for v in image[y]]) for y in range(30)], "y long, v array<double>")
    found = matching.shift_errors(spark.createDataFrame(points, "px double, py double, value double"), rows, thetas, shifts, 12, 2.0)
    got = {r["cand"]: r["err"] for r in found.collect()}
    assert got.keys() == sums.keys()
    assert all(abs(got[c] - np.mean(v)) < 1e-9 for c, v in sums.items())


def test_least_sum_finds_the_first_of_all_sums(spark):
    """Ties by rounding too; null gaps give number 0."""
    lists = [([0.3, 0.1, 0.10004], [0.2, 0.20004]), ([0.1, 5.0, 0.0], [0.2, 0.7]), ([9.0, 9.0, 9.0], [1.0, 1.0])]
    rows = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None)], "id int, z double")
    z = F.col("z")
    gaps = [([z * 0 + a for a in (own if k else own[::-1])], [z + b for b in other]) for k, (own, other) in enumerate(lists)]
    got = {r["id"]: (r["cand"], r["err"]) for r in matching.least_sum(rows, "id", gaps, 3).collect()}
    for key, shift in ((1, 0.0), (2, 1.0)):
        sums = [round(a + b + shift, 3) for k, (own, other) in enumerate(lists) for a in (own if k else own[::-1]) for b in other]
        assert got[key] == (sums.index(min(sums)), min(sums))
    assert got[3] == (0, None)


def test_boxes_of_one_shape_are_compared_once(spark):
    """Shapes that overlap are few however often they come; pairs and flags are those of all boxes."""
    box = lambda k, w: (k % 5 * 1.0, k % 5 + w, k % 3 * 2.0, k % 3 * 2.0 + 0.5)
    left, right = [(k, *box(k, 0.25)) for k in range(60)], [(k, *box(k, 1.5)) for k in range(45)] + [(45, 90.0, 91.0, 90.0, 91.0), (45, *box(0, 1.5)), (46, 90.0, 91.0, 90.0, 91.0)]
    a, b = (spark.createDataFrame(rows, "id long, x0 double, x1 double, y0 double, y1 double") for rows in (left, right))
    pairs = [(k, n) for k, *p in left for n, *q in right if p[0] <= q[1] and q[0] <= p[1] and p[2] <= q[3] and q[2] <= p[3]]
    assert sorted((r["l_id"], r["r_id"]) for r in matching.box_join(a, b, 1.0).collect()) == sorted(pairs)
    assert matching.shape_pairs(a, b, 1.0).count() == len({(tuple(p), tuple(q)) for k, *p in left for n, *q in right if (k, n) in pairs and p[0] <= q[1] and q[0] <= p[1] and p[2] <= q[3] and q[2] <= p[3]})
    hit = {n for _, n in pairs}
    assert sorted((r["id"], r["overlaps"]) for r in matching.overlap_flags(b, a, 1.0).collect()) == [(n, int(n in hit)) for n in range(47)]


def test_returns_and_shots_are_dealt_by_the_length_of_their_tables(spark, monkeypatch):
    monkeypatch.setattr(proxies, "PART_ROWS", 500)
    lines = proxies.table(spark, SF, "lineitem").count()
    for found in (proxies.returns(spark, SF), proxies.shots(spark, SF)):
        sizes = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(sizes) < 1200 < lines


def test_chains_are_added_one_by_one():
    """A stream of matches needs no group: a family is left behind when the next begins."""
    chains = sfm.Chains()
    assert [chains.add(*m) for m in ((0, 0, 1, 1, True), (5, 5, 6, 6, True), (1, 1, 2, 2, False), (2, 2, 9, 9, False), (1, 1, 3, 3, False))] == [0, 1, 0, 0, 2]


def test_descriptors_travel_as_given(spark):
    """Floats are not widened before they are dealt out."""
    rows = spark.createDataFrame([(k, [float(k), 0.1]) for k in range(4)], "id long, desc array<float>")
    found = matching.nearest_descriptors(rows, rows.where("id > 0"), 1)
    assert "cast(desc" not in physical(found)
    assert sorted((r["q_id"], r["t_id"]) for r in found.collect()) == [(0, 1), (1, 1), (2, 2), (3, 3)]


def test_scan_lines_of_a_narrow_image_make_several_bundles():
    """A tall image of 64 columns has 64 lines along y, which one task must not follow alone."""
    assert 64 // stereo.LINES >= 8


def test_tracks_of_the_image_scan_are_dealt_by_the_number_of_shots(spark, monkeypatch):
    monkeypatch.setattr(proxies, "PART_ROWS", 100)
    found = catalog.QUERIES["f06_image_validity"](spark, SF)
    n = proxies.parts(proxies.table(spark, SF, "orders"))
    assert n > 4 and any("hashpartitioning(track_id" in x and f", {n})" in x for x in physical(found).splitlines())
