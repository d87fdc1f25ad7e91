"""The stream against the batch rule."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from selenite.operators import tracks
from selenite.streaming import sessions
from tests.conftest import SF


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").where("user_id % 10 = 1")
    rows = rows.select(F.col("user_id").alias("source"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts")).cache()
    for k in (0, 1):  # two micro-batches, in order of time
        half = F.percent_rank().over(Window.orderBy("ts", "id"))
        part = rows.withColumn("r", half).where(F.col("r") < 0.5 if k == 0 else F.col("r") >= 0.5).drop("r")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = sessions.sessionize_stream(stream).writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.source, r.id): (r.track_id, r.shot_id) for r in spark.table("sessions").collect()}
    want = {(r.source, r.id): (r.track_id, r.shot_id) for r in tracks.sessionize(rows, ["source"], ["ts", "id"]).collect()}
    assert got == want and got


def test_numbers_do_not_depend_on_the_cut():
    rng = np.random.default_rng(3)
    micros = np.sort(rng.choice(np.cumsum(rng.choice([0, 1, 400_000_000], 300)), 300)).astype(np.int64)
    tracks, shots = sessions.numbered(micros, (None, 0, 0), 300)
    last, t, s = None, 0, 0
    for i, m in enumerate(micros.tolist()):  # the rule, row by row
        if last is not None and m != last:
            t, s = (t + 1, 0) if abs(m - last) // 1_000_000 >= 300 else (t, s + 1)
        last = m
        assert (tracks[i], shots[i]) == (t, s)
    for cut in (1, 77, 299):
        a = sessions.numbered(micros[:cut], (None, 0, 0), 300)
        b = sessions.numbered(micros[cut:], (int(micros[cut - 1]), int(a[0][-1]), int(a[1][-1])), 300)
        assert np.array_equal(np.concatenate([a[0], b[0]]), tracks) and np.array_equal(np.concatenate([a[1], b[1]]), shots)
