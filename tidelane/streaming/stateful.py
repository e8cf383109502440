"""Structured Streaming: tumbling rates, sessions, and a bounded reorder buffer with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_buckets(events: DataFrame, time: str, size: str, key: str, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Bytes and rows in tumbling windows; works on batches and, with a watermark, on streams."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).select(F.col("window.start").alias("start"), key, "n", "bytes")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key parted by silences of ``gap``."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def reorder_stream(events: DataFrame, key: str, pts: str, depth: int = 16, flush_ms: int | None = 60_000) -> DataFrame:
    """Emit (key, dts) in order from a heap of ``depth`` times for each key; what is left goes out
    after ``flush_ms`` without input (None: it stays)."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [group[0]] * len(held), "dts": sorted(held)})
            return
        for rows in batches:
            held += [int(x) for x in rows[pts]]
        held.sort()
        out, held = held[: max(0, len(held) - depth)], held[max(0, len(held) - depth) :]
        state.update((held,))
        if flush_ms is not None:
            state.setTimeoutDuration(flush_ms)
        yield pd.DataFrame({key: [group[0]] * len(out), "dts": out})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, dts long", "held array<long>", "append", GroupStateTimeout.NoTimeout if flush_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
