"""Ordered operators within a track: every window is partitioned, none is global."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def merge_timeline(df: DataFrame, by: list[str], track: str, seq: str, time: str) -> DataFrame:
    """Interleave tracks on one clock: a row waits for the rows before it in its track, ties go to the earlier track.

    Adds ``eff`` (the time at which the row is due) and ``pos`` (its place in the merged order, from 1).
    """
    eff = F.max(time).over(_w([*by, track], [seq]).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("eff", eff).withColumn("pos", F.row_number().over(_w(by, ["eff", track, seq])).cast("long"))


def prefix_sum(df: DataFrame, by: list[str], order: list[str], duration: str, out: str = "dts") -> DataFrame:
    """Start of each row: the sum of all durations before it."""
    before = F.sum(duration).over(_w(by, order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(out, F.coalesce(before, F.lit(0).cast(df.schema[duration].dataType)))


def strictly_increasing(df: DataFrame, by: list[str], order: list[str], time: str, out: str = "fixed") -> DataFrame:
    """Raise times as little as needed so that each is greater than the one before: max(t, last + 1)."""
    w = _w(by, order)
    rn = F.row_number().over(w).cast("long")
    shifted = df.withColumn("__rn", rn).withColumn("__d", F.col(time) - F.col("__rn"))
    return shifted.withColumn(out, F.max("__d").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__rn")).drop("__rn", "__d")


def unwrap_counter(df: DataFrame, by: list[str], order: str, raw: str, modulus: int, out: str = "unwrapped", block: int = 1 << 16) -> DataFrame:
    """Undo wraparound of a counter: each step is the one of least size modulo ``modulus``.

    ``order`` is an integer; its blocks of ``block`` values are unwrapped by themselves and then shifted by what the
    blocks before add up to, so one long track is the work of many tasks.
    """
    rows = df.withColumn("__b", F.floor(F.col(order) / block))
    inner = _w([*by, "__b"], [order])
    near = lambda step: step - F.bround(step / modulus).cast("long") * modulus
    rows = rows.withColumn("__s", near(F.col(raw) - F.lag(raw).over(inner)))
    ends = rows.groupBy(*by, "__b").agg(F.min_by(raw, order).alias("__first"), F.max_by(raw, order).alias("__last"), F.coalesce(F.sum("__s"), F.lit(0)).alias("__t"))
    chain = _w(by, ["__b"])
    jump = F.coalesce(near(F.col("__first") - F.lag("__last").over(chain)), F.col("__first"))
    ends = ends.withColumn("__j", jump).withColumn("__o", F.sum(F.col("__j") + F.col("__t")).over(chain.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__t"))
    rows = rows.join(ends.select(*by, "__b", "__o"), [*by, "__b"])
    inside = F.sum(F.coalesce("__s", F.lit(0))).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.col("__o") + inside).select(*df.columns, out)


def reorder_by_presentation(df: DataFrame, by: list[str], order: list[str], pts: str, out: str = "dts") -> DataFrame:
    """Decode times of rows in decode order: the i-th row takes the i-th smallest presentation time."""
    slots = df.withColumn("__slot", F.row_number().over(_w(by, order)))
    sorted_times = df.select(*by, F.col(pts).alias(out), F.row_number().over(_w(by, [pts])).alias("__slot"))
    return slots.join(sorted_times, [*by, "__slot"]).drop("__slot")


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, out: str = "island") -> DataFrame:
    """Number runs of rows: a new run begins where ``starts`` is true (null counts as true)."""
    return df.withColumn(out, F.sum(F.coalesce(starts, F.lit(True)).cast("long")).over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def run_length(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Run-length encode: by, island, value, n."""
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(_w(by, order))) | (F.row_number().over(_w(by, order)) == 1)
    marked = islands(df.withColumn("__c", changed), by, order, F.col("__c"))
    return marked.groupBy(*by, "island").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))


def expand_runs(df: DataFrame, count: str) -> DataFrame:
    """Run-length decode: each row ``count`` times, with ``i`` from 0."""
    return df.where(F.col(count) > 0).withColumn("i", F.explode(F.sequence(F.lit(0), (F.col(count) - 1).cast("int"))))


def merge_touching(df: DataFrame, by: list[str], start: str, end: str, ident: str) -> DataFrame:
    """Join cues of one value where one ends exactly when the next starts; duplicates are matched one to one."""
    numbered = df.withColumn("__dup", F.row_number().over(_w([*by, start, end], [ident])))
    keys = [*by, "__dup"]
    joined = islands(numbered.withColumn("__new", F.col(start) != F.lag(end).over(_w(keys, [start, ident]))), keys, [start, ident], F.col("__new"))
    return joined.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("__dup", "island")


def overlap_slices(df: DataFrame, by: list[str], start: str, end: str, ident: str, cell: int | None = None) -> DataFrame:
    """Elementary slices between all boundaries with the sorted ids active in each; gaps are kept, trailing ones cannot arise.

    Events are dealt into time cells, each into all that it touches, and a slice meets the events of the cell in which
    it begins.  A cell is as wide as the mean event (or ``cell``), so events make about two rows each.
    """
    if cell is None:
        mean = df.agg(F.avg(F.col(end) - F.col(start))).first()[0]
        cell = max(1, int(mean or 1))
    edges = df.select(*by, F.explode(F.array(start, end)).alias("__at")).distinct()
    slices = edges.withColumn("__to", F.lead("__at").over(_w(by, ["__at"]))).where("__to is not null")
    slices = slices.withColumn("__cell", F.floor(F.col("__at") / cell))
    events = df.select(*by, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(ident).alias("__id"))
    events = events.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__s") / cell), F.floor(F.col("__e") / cell))))
    s, e = slices.alias("s"), events.alias("e")
    on = (F.col("s.__cell") == F.col("e.__cell")) & (F.col("e.__s") <= F.col("s.__at")) & (F.col("e.__e") >= F.col("s.__to"))
    for c in by:
        on = on & (F.col(f"s.{c}") == F.col(f"e.{c}"))
    grouped = s.join(e, on, "left").groupBy(*[F.col(f"s.{c}").alias(c) for c in by], F.col("s.__at").alias("slice_from"), F.col("s.__to").alias("slice_to"))
    return grouped.agg(F.count("e.__id").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("e.__id")), lambda x: x.cast("string")), ",").alias("ids"))


def missing_durations(df: DataFrame, by: list[str], order: list[str], time: str, duration: str, default: int, out: str = "end_time") -> DataFrame:
    """End of each cue: its own duration when positive, else the next start, else ``default`` later; never before start + 1."""
    own = F.when(F.col(duration) > 0, F.col(time) + F.col(duration))
    return df.withColumn(out, F.greatest(F.coalesce(own, F.lead(time).over(_w(by, order)), F.col(time) + default), F.col(time) + 1))


def snap_to_grid(time: Column, grid: Column | int, tolerance: Column | int) -> Column:
    """The nearest multiple of ``grid`` when it is within ``tolerance``, else the time itself (half rounds to even)."""
    grid = grid if isinstance(grid, Column) else F.lit(grid)
    near = F.bround(time / grid).cast("long") * grid
    return F.when(F.abs(near - time) <= tolerance, near).otherwise(time)


def anchored_timeline(df: DataFrame, by: list[str], order: list[str], duration: str, known: str, out: str = "start") -> DataFrame:
    """Starts from durations, shifted so that the first known end position is met."""
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("__end", F.sum(duration).over(w))
    anchor = F.first(F.col(known) - F.col("__end"), ignorenulls=True).over(_w(by, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return summed.withColumn(out, F.coalesce(anchor, F.lit(0)) + F.col("__end") - F.col(duration)).drop("__end")


def picture_reorder(df: DataFrame, by: list[str], order: str, kind: str, out: str = "display") -> DataFrame:
    """Display rank from decode order: a B picture is shown at once, an I or P picture when the next reference arrives."""
    w = _w(by, [order])
    slotted = df.withColumn("__slot", F.row_number().over(w))
    reference = F.when(F.col(kind) != "B", F.col("__slot"))
    following = F.min(reference).over(w.rowsBetween(1, Window.unboundedFollowing))
    last = F.max("__slot").over(Window.partitionBy(*by)) + 1
    due = F.when(F.col(kind) == "B", F.col("__slot") * 2 + 1).otherwise(F.coalesce(following, last) * 2)
    return slotted.withColumn("__due", due).withColumn(out, F.row_number().over(_w(by, ["__due", "__slot"])).cast("long")).drop("__slot", "__due")


def group_contiguous(df: DataFrame, by: list[str], order: list[str], position: str, size: str, cap: int) -> DataFrame:
    """Number byte-contiguous groups of at most ``cap`` rows."""
    gap = F.col(position) != F.lag(F.col(position) + F.col(size)).over(_w(by, order))
    runs = islands(df.withColumn("__g", gap), by, order, F.col("__g"), "__run").drop("__g")
    inside = F.floor((F.row_number().over(_w([*by, "__run"], order)) - 1) / cap)
    return runs.withColumn("part", inside).withColumnRenamed("__run", "run")


def fixed_times(df: DataFrame, by: list[str], order: list[str], dts: str, pts: str, video: Column) -> DataFrame:
    """``fixed_dts`` strictly increasing; presentation times of video stay (``fixed_pts``), others move with their decode time."""
    raised = strictly_increasing(df, by, order, dts, "fixed_dts")
    return raised.withColumn("fixed_pts", F.when(video, F.col(pts)).otherwise(F.col(pts) + F.col("fixed_dts") - F.col(dts)))


def end_trim(df: DataFrame, by: list[str], order: list[str], duration: str, known: str) -> DataFrame:
    """(by, trim): what the last row's known end takes off the anchored timeline, the last row's duration at most."""
    placed = anchored_timeline(df, by, order, duration, known, "__start")
    last = placed.groupBy(*by).agg(F.max_by(F.struct("__start", duration, known), F.struct(*order)).alias("r"))
    over = F.col("r.__start") + F.col(f"r.{duration}") - F.col(f"r.{known}")
    return last.select(*by, F.coalesce(F.when(over > 0, F.least(over, F.col(f"r.{duration}"))), F.lit(0)).alias("trim"))


def peak_rate(df: DataFrame, by: list[str], time: str, size: str, unit: int) -> DataFrame:
    """(by, peak, total): the most bytes in any stretch of ``unit`` ticks that begins at a multiple of it."""
    buckets = df.groupBy(*by, F.floor(F.col(time) / unit).alias("__b")).agg(F.sum(size).alias("__s"))
    return buckets.groupBy(*by).agg(F.max("__s").alias("peak"), F.sum("__s").alias("total"))


def roll_up_cues(boxes: DataFrame, by: list[str], order: list[str], start: str, end: str, forced: str, y: str, x: str, text: str) -> DataFrame:
    """Adjacent boxes that begin together as one cue: the latest end, forced if any is, texts a line each from top to bottom, then left to right."""
    runs = islands(boxes.withColumn("__g", F.col(start) != F.lag(start).over(_w(by, order))), by, order, F.col("__g"), "cue")
    lines = F.array_sort(F.collect_list(F.struct(F.col(y), F.col(x), F.struct(*order).alias("__o"), F.col(text).alias("__t"))))
    grouped = runs.groupBy(*by, "cue").agg(F.min(start).alias(start), F.max(end).alias(end), F.bool_or(F.coalesce(F.col(forced), F.lit(False))).alias(forced), lines.alias("__l"))
    shown = F.filter(F.transform("__l", lambda r: r["__t"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return grouped.withColumn(text, F.array_join(shown, "\n")).drop("__l")
