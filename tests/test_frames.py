"""The frame loop in batch and over a stream, and the table that is appended to."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from selenite.operators import frames, registration
from selenite.sources import appended
from tests.test_stereo_frames import rotations

SCHEMA = "film long, frame long, desc array<double>, x double, y double, z double"


@pytest.fixture(scope="module")
def films():
    """Key points of three films; frames with fewer points, flat ones, gaps in the numbers; and the true poses."""
    rng = np.random.default_rng(8)
    rows, poses = [], {}
    for film in range(3):
        world, desc = rng.normal(size=(40, 3)) * 10, rng.normal(size=(40, 24))
        g = np.eye(4)
        for i, frame in enumerate([0, 1, 2, 5, 6, 9]):
            if i:
                r = rotations(rng, 1)[0]
                g = g @ registration.motions(r, rng.normal(size=3))[0]
            few = film == 1 and frame == 5
            local = (np.c_[world, np.ones(40)] @ np.linalg.inv(g).T)[:, :3]
            rows += [(film, frame, (desc[k] + rng.normal(size=24) * 0.01).tolist(), *local[k].tolist()) for k in rng.permutation(40)[: 4 if few else 35]]
            poses[film, frame] = g.copy()
    rows += [(0, 1, None, 1.0, 1.0, 1.0), (0, 3, [0.0] * 6, None, 1.0, 1.0), (7, 0, [float("nan")] * 6, 0.0, 0.0, 0.0)]
    return rows, poses


def test_batch_finds_the_true_poses(spark, films, tmp_path):
    rows, poses = films
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.film, r.frame): r for r in frames.frame_poses(df, f"file://{tmp_path}/a").collect()}
    assert set(got) == set(poses)
    for (film, frame), r in got.items():
        if film == 1 and frame >= 5:
            continue
        assert r.moved == (frame > 0) and (r.matches >= 25 or frame == 0)
        assert np.allclose(np.reshape(r.r, (3, 3)), poses[film, frame][:3, :3], atol=1e-6) and np.allclose(r.t, poses[film, frame][:3, 3], atol=1e-5)
    assert not got[1, 5].moved and got[1, 5].r == got[1, 2].r and not got[1, 6].moved and got[1, 9].moved
    cloud = frames.mapped(df.where("film = 0 and frame in (0, 9)"), frames.frame_poses(df, f"file://{tmp_path}/b"))
    low, high = cloud.where("frame = 0").agg(F.min("x"), F.max("x")).first(), cloud.where("frame = 9").agg(F.min("x"), F.max("x")).first()
    assert np.allclose(low, high, atol=3)
    assert frames.frame_poses(df.where("false"), f"file://{tmp_path}/c").count() == 0


def test_stream_equals_batch(spark, films, tmp_path):
    rows, _ = films
    batch = {(r.film, r.frame): r for r in frames.frame_poses(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/p").collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        seen = {}
        for part in ([0, 1], [2, 5], [1, 6], [9]):  # frame 1 comes again, late
            spark.createDataFrame([r for r in rows if r[1] in part], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = frames.frame_poses_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
            query = appended.append_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check").trigger(availableNow=True).start()
            query.awaitTermination()
        for r in spark.read.parquet(f"file://{tmp_path}/out").collect():
            assert (r.film, r.frame) not in seen
            seen[r.film, r.frame] = r
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert set(seen) == set(batch)
    for k, r in seen.items():
        assert (r.matches, r.moved) == (batch[k].matches, batch[k].moved)
        assert np.allclose(r.r, batch[k].r, atol=1e-9) and np.allclose(r.t, batch[k].t, atol=1e-9)


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    rows = spark.range(10).withColumn("v", F.col("id") * 2)
    at = f"file://{tmp_path}/t"
    for batch, some in ((0, "id < 4"), (1, "id >= 4 and id < 7"), (1, "id >= 4 and id < 7"), (0, "id < 4"), (2, "id >= 7"), (3, "false")):
        appended.append_batch(rows.where(some), at, batch)
        got = sorted(r.id for r in appended.read_appended(spark, at, rows.schema).collect())
        assert got == list(range(len(got))) and (batch < 2 or len(got) == 10)
    with pytest.raises(ValueError, match="append_batch"):
        appended.append_batch(rows.withColumn("append_batch", F.lit(1)), at, 0)
