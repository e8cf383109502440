"""Prefix sums over a keyed table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.llm.storage import Scratch


def running_offsets(table: DataFrame, key: str, value: Column, out: str, by: list[str] | None = None, block: int = 256) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows with a smaller integer ``key`` (within ``by``).

    Keys must be unique within ``by``.  The sum is taken in two levels, inside blocks of ``block``
    keys and over block totals, so no task sees more than ``block`` or (keys / block) rows.
    """
    by = by or []
    cut = table.withColumn("__v", value).withColumn("__b", F.floor(F.col(key) / block))
    totals = cut.groupBy(*by, "__b").agg(F.sum("__v").alias("__t"))
    w = Window.partitionBy(*by).orderBy("__b") if by else Window.orderBy("__b")
    totals = totals.withColumn("__o", F.coalesce(F.sum("__t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    inner = Window.partitionBy(*by, "__b").orderBy(key)
    inside = cut.withColumn("__i", F.coalesce(F.sum("__v").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    on = F.col("i.__b") == F.col("t.__b")
    for c in by:
        on = on & F.col(f"i.{c}").eqNullSafe(F.col(f"t.{c}"))
    joined = inside.alias("i").join(totals.alias("t"), on)
    return joined.select(*[F.col(f"i.{c}") for c in table.columns], (F.col("i.__i") + F.col("t.__o")).alias(out))


def numbered(rows: DataFrame, by: list[str], out: str, scratch: Scratch, name: str) -> DataFrame:
    """Add ``out``: a number from 0 for each row within ``by``, in two levels by the partition that the row was written from.

    No task sees more rows of a group than one partition holds, and the driver none.
    """
    held = scratch.keep(rows.withColumn("__m", F.monotonically_increasing_id()), name).withColumn("__p", F.shiftright("__m", 33))
    counts = held.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__o", before)
    on = F.col("r.__p") == F.col("c.__p")
    for c in by:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}"))
    inside = held.withColumn("__i", F.row_number().over(Window.partitionBy(*by, "__p").orderBy("__m")) - 1)
    joined = inside.alias("r").join(counts.alias("c"), on)
    return joined.select(*[F.col(f"r.`{c}`") for c in rows.columns], (F.col("r.__i") + F.col("c.__o")).alias(out))
