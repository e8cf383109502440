"""Operators whose state depends on their own earlier decisions.

Tracks are dealt in pieces between gaps at which any state would begin anew, told by windows.  Pieces go to tasks by a
hash and stream through them in order, so a task holds one batch and the state of one run, however long a piece or
however many pieces there are; one step is one run of rows, not a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[f for f in df.schema.fields if f.name != name], T.StructField(name, kind)])


#: Whether rows from ``lo`` to ``hi`` of a batch would open a run after the one that began with the state given.
Opens = Callable[[tuple, int, int], np.ndarray]


def run_flags(gap: np.ndarray, state_of: Callable[[int], tuple], opens: Opens, carried: tuple | None) -> tuple[np.ndarray, tuple | None]:
    """(first rows of runs in a batch, the state of the last run): rows of ``gap`` begin a piece and so a run.

    Each run costs a few vector tests over twice its length; pieces of one row cost none.
    """
    flags = gap.copy()
    starts = np.flatnonzero(gap)
    ends = np.append(starts[1:], len(gap))
    work = ends - starts > 1
    segments = list(zip(starts[work].tolist(), ends[work].tolist(), strict=True))
    first = int(starts[0]) if len(starts) else len(gap)
    if first:
        segments.insert(0, (-1, first))
    state = carried
    for a, b in segments:
        state, at, step = (carried, 0, 64) if a < 0 else (state_of(a), a + 1, 64)
        while at < b:
            hit = opens(state, at, min(b, at + step))
            if hit.any():
                at += int(hit.argmax())
                flags[at] = True
                state, at, step = state_of(at), at + 1, 64
            else:
                at, step = at + len(hit), 2 * step
    last = np.flatnonzero(flags)
    return flags, state_of(int(last[-1])) if len(last) else state


def _streamed(df: DataFrame, by: list[str], order: list[str], gap: Column, out: str, make: Callable[[], Callable[[pa.RecordBatch, np.ndarray], np.ndarray]]) -> DataFrame:
    """Add ``out``: what a function of a batch and its rows that begin pieces (``gap``) gives, one such function a task."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.drop(out).withColumn("__gap", gap)
    dealt = marked.withColumn("__piece", F.sum(F.col("__gap").cast("long")).over(upto))
    rows = dealt.repartition(*by, "__piece").sortWithinPartitions(*by, *order).drop("__piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = make()
        for batch in batches:
            if batch.num_rows:
                got = value(batch, batch.column("__gap").to_numpy(zero_copy_only=False).astype(bool))
                names = [n for n in batch.schema.names if n != "__gap"]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(got, pa.int64())], names=[*names, out])

    return rows.mapInArrow(run, _with(df, out, T.LongType()))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


class _Cutter:
    """Flags of runs by time and size; sizes are summed over the task's rows, as only differences count."""

    def __init__(self, values: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], opens: Callable[[pa.RecordBatch, np.ndarray], Opens]):
        self.values, self.opens = values, opens
        self.total, self.state = 0, None

    def __call__(self, batch: pa.RecordBatch, gap: np.ndarray) -> np.ndarray:
        time, size = self.values(batch)
        total = np.concatenate([[self.total], self.total + np.cumsum(size)])
        flags, self.state = run_flags(gap, lambda i: (time[i], total[i]), self.opens(batch, total), self.state)
        self.total = int(total[-1])
        return flags.astype(np.int64)


def greedy_cut(df: DataFrame, by: list[str], order: list[str], time: str, span: int, size: str | None = None, max_size: int = 0, out: str = "chunk", source: str | None = None) -> DataFrame:
    """Cut a track into chunks: a row opens a new chunk when it lies more than ``span`` after the chunk's first row,
    when the chunk would exceed ``max_size``, or when ``source`` (the track of an interleaved stream) changes.

    Rows more than ``span`` after the one before always open a chunk, so tracks are dealt in pieces between such gaps.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.coalesce(F.col(time) - F.max(time).over(before) > span, F.lit(True))
    if source is not None:
        gap = gap | ~F.col(source).eqNullSafe(F.lag(source).over(w))

    def values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return _column(batch, time), _column(batch, size) if size else np.zeros(batch.num_rows, np.int64)

    def opens(batch: pa.RecordBatch, total: np.ndarray) -> Opens:
        t = _column(batch, time)
        late = lambda s, lo, hi: t[lo:hi] - s[0] > span
        return late if size is None else (lambda s, lo, hi: late(s, lo, hi) | (total[lo + 1 : hi + 1] - s[1] > max_size))

    cut = _streamed(df, by, order, gap, "__first", lambda: _Cutter(values, opens))
    return cut.withColumn(out, F.sum("__first").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__first")


def cluster_cut(df: DataFrame, by: list[str], order: list[str], time: str, size: str, video_sync: str, *, max_ms: int = 5000, video_ms: int = 1000, max_bytes: int = 32 << 20, out: str = "cluster") -> DataFrame:
    """Clusters of a stream: a row opens one when the open one is ``max_ms`` old, when its relative time leaves 16 bits, when
    the bytes would exceed ``max_bytes``, or when it is a video key frame and the cluster is ``video_ms`` old.

    A row ``max_ms`` behind the latest of all before it always opens one.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    latest = F.greatest(F.max(time).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gap = F.lag(F.lit(1)).over(w).isNull() | (F.col(time) - latest >= max_ms)

    def opens(batch: pa.RecordBatch, total: np.ndarray) -> Opens:
        raw, key = _column(batch, time), batch.column(video_sync).to_numpy(zero_copy_only=False).astype(bool)

        def test(s: tuple, lo: int, hi: int) -> np.ndarray:
            age = raw[lo:hi] - s[0]
            return (age >= max_ms) | (age < -(1 << 15)) | (age >= 1 << 15) | (total[lo + 1 : hi + 1] - s[1] > max_bytes) | (key[lo:hi] & (age >= video_ms))

        return test

    values = lambda batch: (np.maximum(_column(batch, time), 0), _column(batch, size))
    cut = _streamed(df, by, order, gap, "__first", lambda: _Cutter(values, opens))
    return cut.withColumn(out, F.sum("__first").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__first")


class _Snapper:
    """Starts moved to where the durations since the run's first row lead."""

    def __init__(self, time: str, duration: str, tolerance: int):
        self.time, self.duration, self.tolerance = time, duration, tolerance
        self.total, self.state = 0, None

    def __call__(self, batch: pa.RecordBatch, gap: np.ndarray) -> np.ndarray:
        t, d = _column(batch, self.time), _column(batch, self.duration)
        before = self.total + np.cumsum(d) - d
        drift, carried = t - before, self.state
        flags, self.state = run_flags(gap, lambda i: (drift[i],), lambda s, lo, hi: np.abs(drift[lo:hi] - s[0]) > self.tolerance, carried)
        self.total = int(before[-1] + d[-1])
        start = np.maximum.accumulate(np.where(flags, np.arange(len(t)), -1))
        return before + np.where(start >= 0, drift[start], carried[0] if carried else 0)


def snap_contiguous(df: DataFrame, by: list[str], order: list[str], time: str, duration: str, tolerance: int, out: str = "snapped") -> DataFrame:
    """Move a start to the end of the row before, as moved itself, when it is within ``tolerance`` of it.

    A row whose drift (its start less all durations before it) is further than that from all drifts before it stays, whatever
    the run before it was.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    drifting = df.withColumn("__drift", F.col(time) - F.coalesce(F.sum(duration).over(upto), F.lit(0)))
    far = (F.col("__drift") - F.max("__drift").over(upto) > tolerance) | (F.min("__drift").over(upto) - F.col("__drift") > tolerance)
    return _streamed(drifting, by, order, F.coalesce(far, F.lit(True)), out, lambda: _Snapper(time, duration, tolerance)).drop("__drift")


def bounded_reorder(df: DataFrame, by: list[str], order: list[str], pts: str, depth: int = 16, out: str = "dts") -> DataFrame:
    """Decode times from a heap of ``depth`` presentation times; deeper reordering differs from a full sort.

    A sorted track needs no heap: where no time is more than ``depth`` places from its rank, the heap gives the sort.
    """
    import heapq

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        times = rows[pts].to_numpy()
        ranked = np.argsort(times, kind="stable")
        if not len(times) or (ranked - np.arange(len(times))).max() <= depth:
            return rows.assign(**{out: times[ranked]})
        heap, result = list(times[:depth].tolist()), []
        heapq.heapify(heap)
        result = [heapq.heappushpop(heap, t) for t in times[depth:].tolist()] + sorted(heap)
        return rows.assign(**{out: result})

    return df.groupBy(*by).applyInPandas(run, _with(df, out, df.schema[pts].dataType))
