"""Acquisition cycles from file names: batch gate, and a stateful stream with stability and timeout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAMES = 16


def cycle_gate(files: DataFrame, frames: int = FRAMES) -> DataFrame:
    """cycle, files, positions, status: complete, duplicate (a position twice) or incomplete.

    files: cycle and position of names that fit the template. Each cycle is one group of counts.
    """
    seen = files.groupBy("cycle").agg(F.count("*").alias("files"), F.count_distinct("position").alias("positions"))
    status = F.when(F.col("files") > F.col("positions"), "duplicate").when(F.col("positions") == frames, "complete").otherwise("incomplete")
    return seen.select("cycle", "files", "positions", status.alias("status"))


SCHEMA = "cycle string, status string, positions int, last_ms long"


def assemble(files: DataFrame, stability_ms: int = 1000, timeout_ms: int = 60_000, frames: int = FRAMES, watermark: str = "1 second") -> DataFrame:
    """A stream of cycles that ended: complete after ``stability_ms`` without a new file, duplicate, or incomplete after ``timeout_ms``.

    files: a stream of cycle, position and ts (event time). State of a cycle is a bit for each
    position and two times, whatever arrives; event-time timers end it.
    """
    if not 250 <= stability_ms <= 60_000 or not 1000 <= timeout_ms <= 86_400_000:
        raise ValueError("stability is 250..60000 ms and the timeout 1..86400 s")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mask, twice, first, last = state.get if state.exists else (0, False, 0, 0)
        if state.hasTimedOut:
            status = "duplicate" if twice else "complete" if mask == (1 << frames) - 1 else "incomplete"
            state.remove()
            yield pd.DataFrame({"cycle": [key[0]], "status": [status], "positions": [bin(mask).count("1")], "last_ms": [last]})
            return
        for part in parts:
            for position, ts in zip(part["position"], part["ts"], strict=True):
                bit, ms = 1 << (int(position) - 1), int(ts.timestamp() * 1000)
                twice, mask = twice or bool(mask & bit), mask | bit
                first, last = min(first or ms, ms), max(last, ms)
        state.update((mask, twice, first, last))
        whole = mask == (1 << frames) - 1
        due = last + stability_ms if whole or twice else first + timeout_ms
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    stream = files.select("cycle", "position", "ts").withWatermark("ts", watermark)
    return stream.groupBy("cycle").applyInPandasWithState(step, SCHEMA, "mask long, twice boolean, first long, last long", "append", GroupStateTimeout.EventTimeTimeout)
