"""Possession intervals of a live stream: one small state per match."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "match long, gid long, start_frame long, end_frame long, n long"
#: The open run: its id, first and last frame and length.
STATE = "gid long, start long, last long, n long"


def intervals(owners: DataFrame, least: int, idle: str | None = None) -> DataFrame:
    """owners (match, frame, gid, at), a stream of each frame's owner -> intervals of at least so many consecutive frames of one id, each emitted once it is over.

    A run is over when a frame of another id or after a gap comes, or, with `idle` (such as '10 minutes'), when the watermark of `at` passes its match's newest row by that. Rows are taken by frame within a
    micro-batch; a frame not after the last one taken is late and left out. The state is four numbers per match, whatever the stream's length.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = list(state.get) if state.exists else None
        out = []

        def close():
            if run and run[3] >= least:
                out.append((key[0], run[0], run[1], run[2], run[3]))

        if state.hasTimedOut:
            close()
            state.remove()
            yield pd.DataFrame(out, columns=["match", "gid", "start_frame", "end_frame", "n"])
            return
        rows = pd.concat(list(batches)).sort_values("frame")
        for frame, gid in zip(rows["frame"].tolist(), rows["gid"].tolist()):
            if run and frame <= run[2]:
                continue
            if run and gid == run[0] and frame == run[2] + 1:
                run = [gid, run[1], frame, run[3] + 1]
            else:
                close()
                run = [gid, frame, frame, 1]
        state.update(tuple(run))
        if wait is not None:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["at"].max().timestamp() * 1000)) + wait)
        yield pd.DataFrame(out, columns=["match", "gid", "start_frame", "end_frame", "n"])

    wait = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    rows = owners.select(F.col("match").cast("long").alias("match"), F.col("frame").cast("long").alias("frame"), F.col("gid").cast("long").alias("gid"), "at")
    return rows.groupBy("match").applyInPandasWithState(step, OUT, STATE, "append", timeout)
