"""Track and shot sessions over a stream of returns, with state per source.

The batch rule (`selenite.operators.tracks.sessionize`) looks at the row before in
file order; here the row before is kept as state, so the order is the order of
arrival of each source, by time and id within a micro-batch. Rows later than the watermark
are left out. A source silent for ``EXPIRE_S`` behind the watermark loses its state and
starts again with track 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from selenite.operators.tracks import TRACK_GAP_S

OUTPUT = "source long, id long, ts timestamp, track_id long, shot_id long"
EXPIRE_S = 7 * 86_400
STATE = "micros long, track_id long, shot_id long"


def numbered(micros: np.ndarray, state: tuple[int | None, int, int], gap_s: int) -> tuple[np.ndarray, np.ndarray]:
    """Track and shot of sorted times behind a state: (last time, track, shot)."""
    last, track, shot = state
    before = np.concatenate([[micros[0] if last is None else last], micros[:-1]])
    far = np.abs(micros - before) // 1_000_000 >= gap_s
    far &= micros != before
    tracks = track + np.cumsum(far)
    steps = np.cumsum((micros != before) & ~far)
    at = np.maximum.accumulate(np.where(far, np.arange(len(micros)), -1))
    return tracks, np.where(at >= 0, steps - steps[at], steps + shot)


def assign(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, gap_s: int = TRACK_GAP_S) -> Iterator[pd.DataFrame]:
    """Number the rows of one source; the state is the last time, track and shot."""
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values(["ts", "id"], kind="stable")
    micros = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
    tracks, shots = numbered(micros, state.get if state.exists else (None, 0, 0), gap_s)
    state.update((int(micros[-1]), int(tracks[-1]), int(shots[-1])))
    state.setTimeoutTimestamp(max(int(micros[-1]) // 1000, state.getCurrentWatermarkMs()) + 1000 * EXPIRE_S)
    yield pd.DataFrame({"source": key[0], "id": rows["id"].to_numpy(), "ts": rows["ts"].to_numpy(), "track_id": tracks, "shot_id": shots})


def sessionize_stream(returns: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream (source, id, ts) with track and shot numbers, in append mode."""
    grouped = returns.select("source", "id", "ts").withWatermark("ts", late).groupBy("source")
    return grouped.applyInPandasWithState(assign, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def counts_in_windows(returns: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Returns and mean value of each source in tumbling event-time windows; later rows than ``late`` are left out."""
    w = F.window("ts", width)
    rows = returns.withWatermark("ts", late).groupBy(w, "source")
    return rows.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("source", F.col("window.start").alias("start"), "n", "mean")
