"""Streams with keyed state and event-time timers: overlap timelines and a rate limiter that delays.

Both hold what may still change and let it go when the watermark proves it final.  Spark drops rows behind
the watermark before a processor sees them; here a late row must still count (clipped, or queued last), so each
row goes in twice: once with its time, which moves the watermark and holds nothing, and once without
one, which no watermark can drop.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

def with_clock(rows: DataFrame, late: str, **columns: str) -> DataFrame:
    """Each row as a tick that carries the watermark (column ``t``), and as itself without a time.

    ``columns`` are the caller's columns by the names that processors know them by (Spark renames some others).
    """
    marked = rows.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()], F.explode(F.array(F.lit(True), F.lit(False))).alias("tick"))
    timed = marked.withColumn("clock", F.when(F.col("tick"), F.timestamp_millis(F.col("t")))).withWatermark("clock", late)
    return timed.where(F.col("clock").isNull())  # ticks have moved the watermark and need not reach the processors


def by_key(given: DataFrame, processor: StatefulProcessor, key: str, columns: str, names: dict[str, str]) -> DataFrame:
    """Run ``processor`` for each key; its columns get the caller's names."""
    kind = dict(given.dtypes)["k"]
    out = given.groupBy("k").transformWithStateInPandas(processor, f"k {kind}, {columns}", "append", "EventTime")
    return out.withColumnsRenamed({"k": key, **names})


def arrived(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        if len(rows):  # a batch that only fires timers has no columns
            yield rows[~rows["tick"]]


class Timed(StatefulProcessor):
    """A processor with one timer a key: at the next moment when something becomes final."""

    def wake_at(self, handle: StatefulProcessorHandle, at: int | None) -> None:
        for old in handle.listTimers():
            if old != at:
                handle.deleteTimer(old)
        if at is not None:
            handle.registerTimer(at)

    def close(self) -> None:
        pass


class OverlapTimeline(Timed):
    """Elementary slices of overlapping cues.  State: the cues that reach beyond the last slice, and its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cues = handle.getListState("cues", "s long, e long, id long")
        self.position = handle.getValueState("position", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.cues.get()]
        at = self.position.get()[0] if self.position.exists() else None
        for batch in arrived(rows):
            for s, e, i in batch[["t", "e", "i"]].itertuples(index=False):
                s = int(s) if at is None else max(int(s), at)  # a late cue is clipped to what has not left yet
                if e > s:
                    held.append((s, int(e), int(i)))
        yield from self._leave(key, held, at, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.position.get()[0] if self.position.exists() else None
        yield from self._leave(key, [tuple(x) for x in self.cues.get()], at, timerValues.getCurrentWatermarkInMs())

    def _leave(self, key: tuple, held: list[tuple[int, int, int]], at: int | None, watermark: int) -> Iterator[pd.DataFrame]:
        """Give out the slices that end at or before the watermark, and hold the rest."""
        edges = sorted({x for s, e, _ in held for x in (s, e)} | ({at} if at is not None else set()))
        edges = [x for x in edges if at is None or x >= at]
        out, active, n = [], [], 0
        queue = sorted(held)
        for a, b in zip(edges, edges[1:]):
            if b > watermark:
                break
            while n < len(queue) and queue[n][0] <= a:
                active.append(queue[n])
                n += 1
            active = [c for c in active if c[1] > a]
            ids = sorted(i for _, _, i in active)
            out.append((key[0], a, b, len(ids), ",".join(map(str, ids))))
            at = b
        left = [(max(s, at) if at is not None else s, e, i) for s, e, i in held if at is None or e > at]
        if left:
            self.cues.put(left)
        else:
            self.cues.clear()
        if at is not None:
            self.position.update((at,))
        self.wake_at(self.handle, next((x for x in edges[1:] if x > max(watermark, at if at is not None else x - 1)), None))
        if out:
            yield pd.DataFrame(out, columns=["k", "slice_from", "slice_to", "n", "ids"])


def overlap_stream(cues: DataFrame, key: str, start: str, end: str, ident: str, late: str = "10 seconds") -> DataFrame:
    """Slices (key, slice_from, slice_to, n, ids) of a stream of cues, times in milliseconds.

    A slice leaves once the watermark of the starts passes its end.  A cue that comes later than ``late`` is
    clipped to the end of its key's last slice, not dropped.  ``ids`` are whole numbers.
    """
    given = with_clock(cues, late, k=key, t=start, e=end, i=ident)
    return by_key(given, OverlapTimeline(), key, "slice_from long, slice_to long, n long, ids string", {})


class RateLimiter(Timed):
    """At most ``permits`` admissions in any window; rows wait.  State: waiting rows and the last ``permits`` admissions."""

    def __init__(self, permits: int, window: int):
        self.permits, self.window = permits, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, id long")
        self.stamps = handle.getListState("stamps", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.waiting.get()]
        for batch in arrived(rows):
            held += [(int(t), int(i)) for t, i in batch[["t", "i"]].itertuples(index=False)]
        yield from self._admit(key, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._admit(key, [tuple(x) for x in self.waiting.get()], timerValues.getCurrentWatermarkInMs())

    def _admit(self, key: tuple, held: list[tuple[int, int]], watermark: int) -> Iterator[pd.DataFrame]:
        held.sort()
        stamps = sorted(x[0] for x in self.stamps.get())
        out, n, due = [], 0, None
        for t, ident in held:
            due = max([t, *stamps[-1:], *([stamps[-self.permits] + self.window] if len(stamps) >= self.permits else [])])
            if due > watermark:
                break
            out.append((key[0], ident, t, due))
            stamps = [*stamps, due][-self.permits :]
            n, due = n + 1, None
        if held[n:]:
            self.waiting.put(held[n:])
        else:
            self.waiting.clear()
        if stamps:
            self.stamps.put([(t,) for t in stamps])
        self.wake_at(self.handle, due)
        if out:
            yield pd.DataFrame(out, columns=["k", "i", "t", "admitted_at"])


def rate_limit_stream(requests: DataFrame, key: str, time: str, ident: str, permits: int, window: int, late: str = "10 seconds") -> DataFrame:
    """Requests (key, ident, time, admitted_at), each leaving once the watermark passes its admission; times in milliseconds.

    The batch form is ``rules.delayed_requests``.  A request that comes later than ``late`` waits behind those admitted before it.
    """
    given = with_clock(requests, late, k=key, t=time, i=ident)
    return by_key(given, RateLimiter(permits, window), key, "i long, t long, admitted_at long", {"i": ident, "t": time})


class ReorderBuffer(Timed):
    """Times in order from a heap of ``depth`` for each key; the rest leaves when the watermark passes it."""

    def __init__(self, depth: int):
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [x[0] for x in self.held.get()]
        for batch in arrived(rows):
            held += [int(t) for t in batch["t"]]
        yield from self._leave(key, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._leave(key, [x[0] for x in self.held.get()], timerValues.getCurrentWatermarkInMs())

    def _leave(self, key: tuple, held: list[int], watermark: int) -> Iterator[pd.DataFrame]:
        held.sort()
        final = sum(t <= watermark for t in held)
        cut = max(final, len(held) - self.depth)
        if held[cut:]:
            self.held.put([(t,) for t in held[cut:]])
        else:
            self.held.clear()
        self.wake_at(self.handle, held[cut] if held[cut:] else None)
        if cut > 0:
            yield pd.DataFrame({"k": [key[0]] * cut, "dts": held[:cut]})


def reorder_by_watermark(samples: DataFrame, key: str, pts: str, depth: int = 16, late: str = "10 seconds") -> DataFrame:
    """(key, dts) in order, times in milliseconds: a time leaves when ``depth`` later ones wait or the watermark passes it."""
    return by_key(with_clock(samples, late, k=key, t=pts), ReorderBuffer(depth), key, "dts long", {})


class PageCues(Timed):
    """A page lasts until the next page or an erasure of its key.  State: transmissions that are not final."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, page string")
        self.shown = handle.getValueState("shown", "t long, page string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.waiting.get()]
        for batch in arrived(rows):
            held += [(int(t), "" if pd.isna(p) else str(p)) for t, p in batch[["t", "page"]].itertuples(index=False)]
        yield from self._leave(key, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._leave(key, [tuple(x) for x in self.waiting.get()], timerValues.getCurrentWatermarkInMs())

    def _leave(self, key: tuple, held: list[tuple[int, str]], watermark: int) -> Iterator[pd.DataFrame]:
        held.sort()
        since, page = tuple(self.shown.get()) if self.shown.exists() else (None, "")
        out, n = [], 0
        for t, new in held:
            if t > watermark:
                break
            n += 1
            if new == page:
                continue
            if page.strip() and t > since:
                out.append((key[0], since, t, page))
            since, page = t, new
        if held[n:]:
            self.waiting.put(held[n:])
        else:
            self.waiting.clear()
        if since is not None:
            self.shown.update((since, page))
        self.wake_at(self.handle, held[n][0] if held[n:] else None)
        if out:
            yield pd.DataFrame(out, columns=["k", "since", "until", "page"])


def page_cue_stream(pages: DataFrame, key: str, time: str, page: str, late: str = "10 seconds") -> DataFrame:
    """Cues (key, start, end, page) of a stream of page transmissions; a null or empty page erases."""
    given = with_clock(pages, late, k=key, t=time, page=page)
    return by_key(given, PageCues(), key, "since long, until long, page string", {"since": "start", "until": "end", "page": page})
