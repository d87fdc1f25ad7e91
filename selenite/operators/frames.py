"""The frame loop: each frame's key points are matched with the frame before, the motion is fitted and composed.

``points``: film, frame, desc (array of reals), x, y, z; a row for each key point. One function
works a frame out from the one before. In batch, pairs of neighbouring frames are cogrouped,
so all of a film's frames are worked out at once, and the motions are composed by running products
(``registration.global_poses``). Over a stream, a film's last frame and pose are its state.

Defined results: the first frame only initialises (no matches, the identity); a frame with too few
matches or a flat determinant leaves the pose as it is; key points with nulls are left out, and a
frame without any other is as if it had not been; ties of a distance go to the earlier row in order of descriptor and place.
A stream takes a frame's key points in one micro-batch; frames at or before the film's last one are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from selenite.operators import registration
from selenite.operators.registration import kabsch

#: Of the nearest distance to the second nearest, at most.
RATIO = 0.8
MIN_MATCHES = 6
#: The least determinant of the points' covariance, over its largest eigenvalue cubed.
FLAT = 1e-9
OUTPUT = "film long, frame long, matches long, moved boolean, r array<double>, t array<double>"
BLOCK = 2048


@dataclass(frozen=True)
class Settings:
    ratio: float = RATIO
    min_matches: int = MIN_MATCHES
    flat: float = FLAT


def in_order(desc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key points sorted by value, so that results do not hang on the order of rows."""
    order = np.lexsort(np.hstack([place, desc]).T[::-1])
    return desc[order], place[order]


def nearest(now: np.ndarray, before: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``now`` and ``before`` that match: each the other's nearest, and nearer than ``ratio`` of the second nearest."""
    rows, others = [], []
    back, reach = np.full(len(before), -1), np.full(len(before), np.inf)
    for at in range(0, len(now), BLOCK):
        part = now[at : at + BLOCK]
        d = (part * part).sum(1)[:, None] - 2 * part @ before.T + (before * before).sum(1)
        nearer = d.min(0) < reach
        back[nearer], reach[nearer] = at + d.argmin(0)[nearer], d.min(0)[nearer]
        best = d.argmin(1)
        least = np.sqrt(np.maximum(0, d[np.arange(len(part)), best]))
        d[np.arange(len(part)), best] = np.inf
        second = np.sqrt(np.maximum(0, d.min(1))) if d.shape[1] > 1 else np.full(len(part), np.inf)
        good = least < ratio * second
        rows.append(at + np.flatnonzero(good))
        others.append(best[good])
    rows, others = np.concatenate(rows), np.concatenate(others)
    mutual = back[others] == rows
    return rows[mutual], others[mutual]


def frame_step(before, now, settings: Settings) -> tuple[int, np.ndarray | None, np.ndarray | None]:
    """(matches, r, t) that carry the frame's points onto the one before; none where the pair does not tell."""
    (old_desc, old), (desc, place) = before, now
    if not len(old) or not len(place):
        return 0, None, None
    rows, others = nearest(desc, old_desc, settings.ratio)
    if len(rows) < settings.min_matches:
        return len(rows), None, None
    p, q = place[rows], old[others]
    centred_p, centred_q = p - p.mean(0), q - q.mean(0)
    spread = np.linalg.eigvalsh(centred_p.T @ centred_p)
    if spread[2] <= 0 or np.prod(spread / spread[2]) < settings.flat:
        return len(rows), None, None
    r = kabsch(centred_q.T @ centred_p)
    return len(rows), r, q.mean(0) - r @ p.mean(0)


def arrays(table: pa.Table | pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    frame = table if isinstance(table, pd.DataFrame) else table.to_pandas()
    n = len(frame)
    desc = np.stack(frame["desc"].to_numpy()).astype(float) if n else np.zeros((0, 1))
    return in_order(desc, frame[["x", "y", "z"]].to_numpy(float))


def known(points: DataFrame) -> DataFrame:
    rows = points.select(F.col("film").cast("long").alias("film"), F.col("frame").cast("long").alias("frame"), F.col("desc").cast("array<double>").alias("desc"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    return rows.dropna().where(~F.exists("desc", lambda v: v.isNull() | F.isnan(v)) & (F.size("desc") > 0))


def frame_poses(points: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """(film, frame, matches, moved, r, t): the global pose of every frame. ``folder``: a new, shared one for the motions."""
    rows = known(points)
    order = Window.partitionBy("film").orderBy("frame")
    frames = rows.select("film", "frame").distinct().withColumn("before", F.lag("frame").over(order))
    now = rows.join(frames, ["film", "frame"])
    old = frames.where("before is not null").select("film", F.col("frame").alias("next"), F.col("before").alias("frame"))
    again = [F.col(c).alias(c) for c in ("desc", *"xyz")]  # columns of their own, so that both sides can be told apart
    old = rows.join(old, ["film", "frame"]).select(F.col("film").alias("film"), F.col("next").alias("frame"), *again)

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        film, frame = (left.column(c)[0].as_py() for c in ("film", "frame"))
        n, r, t = frame_step(arrays(right), arrays(left), settings)
        r, t, moved = (np.eye(3), np.zeros(3), False) if r is None else (r, t, True)
        columns = [[film], [frame], [n], [moved], [r.ravel().tolist()], [t.tolist()]]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table({c.split()[0]: pa.array(v, k) for c, v, k in zip(OUTPUT.split(", "), columns, kinds, strict=True)})

    pairs = now.drop("before").groupBy("film", "frame").cogroup(old.groupBy("film", "frame"))
    motions = pairs.applyInArrow(step, OUTPUT)
    motions.write.parquet(f"{folder}/motions")
    motions = points.sparkSession.read.schema(OUTPUT).parquet(f"{folder}/motions")
    poses = registration.global_poses(motions, ["film"], "frame", "r", "t", f"{folder}/poses")
    return poses.drop("n").join(motions.select("film", "frame", "matches", "moved"), ["film", "frame"]).select("film", "frame", "matches", "moved", "r", "t")


class FrameLoop(StatefulProcessor):
    """The state of a film: its last frame's number and key points, and the pose."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "frame long, width int, desc binary, place binary, pose binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows), ignore_index=True)
        before, pose, last = None, np.eye(4), None
        if self.last.exists():
            last, width, desc, place, held = self.last.get()
            before = np.frombuffer(desc).reshape(-1, width), np.frombuffer(place).reshape(-1, 3)
            pose = np.frombuffer(held).reshape(4, 4)
        out = []
        for frame, some in table.groupby("frame", sort=True):
            if last is not None and frame <= last:
                continue
            now, last = arrays(some), int(frame)
            n, r, t = (0, None, None) if before is None else frame_step(before, now, self.settings)
            if r is not None:
                pose = pose @ registration.motions(r[None], t[None])[0]
            out.append((key[0], last, n, r is not None, pose[:3, :3].ravel().tolist(), pose[:3, 3].tolist()))
            before = now
        if out:
            desc, place = before
            self.last.update((last, desc.shape[1], desc.tobytes(), place.tobytes(), pose.tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def frame_poses_stream(points: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``frame_poses`` over a stream of key points; the session's state store must be RocksDB."""
    grouped = known(points).groupBy("film")
    return grouped.transformWithStateInPandas(FrameLoop(settings), OUTPUT, "Append", "None")


def mapped(points: DataFrame, poses: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(film, frame, keep, x, y, z): the frames' points carried to the first frame's place."""
    row = lambda i: sum((F.col("r")[3 * i + k] * F.col(c) for k, c in enumerate("xyz")), F.col("t")[i])
    rows = points.join(poses.select("film", "frame", "r", "t"), ["film", "frame"])
    return rows.select("film", "frame", *keep, *(row(i).alias(c) for i, c in enumerate("xyz")))
