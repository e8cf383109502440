"""Plans of edits: where a file's index may be rewritten in place, and logs of undoable changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.timeline import islands

#: The least free box, and bytes of a Matroska void (id and one size byte).
FREE_HEAD, VOID_HEAD = 8, 2


def index_slots(boxes: DataFrame, by: list[str]) -> DataFrame:
    """(by, slot_start, slot_end, at_end): the stretch around a file's moov that may be overwritten.

    ``boxes``: by, kind, offset, size, referenced (a kept track has data in it).  Padding and mdat boxes that no track
    refers to are free, next to the moov on both sides.
    """
    w = Window.partitionBy(*by).orderBy("offset")
    free = F.col("kind").isin("free", "skip", "wide") | ((F.col("kind") == "mdat") & ~F.coalesce(F.col("referenced"), F.lit(False)))
    usable = boxes.withColumns({"__u": free | (F.col("kind") == "moov"), "__last": F.lead("offset").over(w).isNull()})
    runs = islands(usable.withColumn("__c", (F.col("__u") != F.lag("__u").over(w))), by, ["offset"], F.col("__c"), "__run").where("__u")
    slots = runs.groupBy(*by, "__run").agg(F.min("offset").alias("slot_start"), F.max(F.col("offset") + F.col("size")).alias("slot_end"), F.bool_or("__last").alias("at_end"), F.bool_or(F.col("kind") == "moov").alias("__m"))
    return slots.where("__m").drop("__m", "__run")


def index_edit(slots: DataFrame, moov: str, extra: str) -> DataFrame:
    """Add ``plan`` (tail: write and cut the file, slot: write and fill with ``filler`` bytes, rewrite: copy the file), and ``filler``.

    ``moov`` and ``extra`` are columns of new sizes; what is left must be nothing or hold a free box.
    """
    left = F.col("slot_end") - F.col("slot_start") - F.col(moov) - F.col(extra)
    plan = F.when(F.col("at_end"), "tail").when((left == 0) | (left >= FREE_HEAD), "slot").otherwise("rewrite")
    return slots.withColumns({"plan": plan, "filler": F.when(plan == "slot", left).otherwise(F.lit(0))})


def size_length(n: Column) -> Column:
    """Bytes of a Matroska size that holds ``n`` (all ones are kept for the unknown size)."""
    out = F.lit(8)
    for width in range(7, 0, -1):
        out = F.when(n < (1 << 7 * width) - 1, width).otherwise(out)
    return out


def element_places(regions: DataFrame, by: list[str]) -> DataFrame:
    """Where each changed element goes on the first pass: into its own room and the voids behind it, or to the end.

    ``regions``: by, position, size, kind (an element's name or ``void``), id_bytes, and for changed elements payload (new bytes; null
    for others).  Adds ``room``, ``place`` (exact, wide: the size takes one byte more, void: ``filler`` bytes of void follow, append)
    and ``filler``.  Rooms of different elements do not overlap, so one pass decides all of them.
    """
    w = Window.partitionBy(*by).orderBy("position")
    marked = regions.withColumn("__own", F.col("kind") != "void")
    owned = islands(marked, by, ["position"], F.col("__own"), "__slot")
    room = F.sum("size").over(Window.partitionBy(*by, "__slot"))
    needed = F.col("id_bytes") + size_length(F.col("payload")) + F.col("payload")
    left = F.col("room") - F.col("needed")
    placed = owned.withColumns({"room": room, "needed": needed, "__first": F.row_number().over(w)}).where("__own and payload is not null")
    place = F.when(left == 0, "exact").when((left == 1) & (size_length(F.col("payload")) < 8), "wide").when(left >= VOID_HEAD, "void").otherwise("append")
    return placed.withColumn("place", place).withColumn("filler", F.when(F.col("place") == "void", left).otherwise(F.lit(0))).drop("__own", "__slot", "__first", "needed")


def current_values(log: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """(by, key, value) after all edits, undos and redos of each document's log.

    ``log``: by, seq, op (edit, undo, redo), txn and for edits key, old, new.  Edits of one transaction are undone together; an
    edit that changes nothing is not recorded; a recorded one empties what could be done again.  Every step changes
    the number of transactions in effect by one, so a transaction is in effect at the end if it is the last one
    that brought its depth about and that depth is not above the last.
    """
    real = log.where((F.col("op") != "edit") | ~F.col("old").eqNullSafe(F.col("new")))
    steps = real.groupBy(*by, F.when(F.col("op") == "edit", F.col("txn")).otherwise(-F.col("seq") - 1).alias("step")).agg(F.min("seq").alias("seq"), F.first("op").alias("op"))
    w = Window.partitionBy(*by).orderBy("seq")
    # how far undos reach below the start never matters: logs undo what they recorded, and others are cut off at 0
    change = F.when(F.col("op") == "undo", -1).otherwise(1)
    run = steps.withColumn("__s", F.sum(change).over(w))
    floor = F.least(F.min("__s").over(w), F.lit(0))
    deep = run.withColumn("depth", F.col("__s") - floor)
    final = deep.groupBy(*by).agg(F.max_by("depth", "seq").alias("__final"))
    last = deep.where("op = 'edit'").groupBy(*by, "depth").agg(F.max_by("step", "seq").alias("txn"))
    live = last.join(final, by).where(F.col("depth") <= F.col("__final")).select(*by, "txn")
    edits = real.where("op = 'edit'").join(live, [*by, "txn"])
    return edits.groupBy(*by, *key).agg(F.max_by("new", "seq").alias("value"))


def best_readings(readings: DataFrame, by: list[str], confidence: str, engine_order: str) -> DataFrame:
    """Of several engines' readings of one picture the most confident, of ties the earlier engine's; blank ones lose to any other."""
    blank = F.trim(F.coalesce(F.col("text"), F.lit(""))) == ""
    rank = F.struct((~blank).cast("int"), F.coalesce(F.col(confidence), F.lit(0.0)), -F.col(engine_order))
    return readings.groupBy(*by).agg(F.max_by(F.struct(*[c for c in readings.columns if c not in by]), rank).alias("r")).select(*by, "r.*")
