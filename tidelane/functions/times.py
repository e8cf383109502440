"""Times of chapters and cues: parsing, formatting and tick scaling with half-to-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ms(c: Column) -> Column:
    """``h:m:s.fff`` (one to three parts, comma or point) in milliseconds; null when malformed."""
    text = F.replace(F.trim(c), F.lit(","), F.lit("."))
    fold = F.aggregate(F.split(text, ":"), F.lit(0.0), lambda a, x: a * 60 + x.cast("double"))
    good = F.rlike(text, F.lit(r"^(\d+:){0,2}\d+(\.\d*)?$"))
    return F.when(good, F.bround(F.when(good, fold) * 1000).cast("long"))


def format_ms(ms: Column, separator: str = ".") -> Column:
    part = lambda v, n: F.lpad(v.cast("long").cast("string"), n, "0")
    hours = F.floor(ms / 3_600_000)
    hours = F.when(hours < 100, part(hours, 2)).otherwise(hours.cast("string"))
    return F.concat(hours, F.lit(":"), part(F.floor(ms / 60_000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit(separator), part(ms % 1000, 3))


def format_centi(ms: Column) -> Column:
    """The ASS form h:mm:ss.cc, rounded half to even."""
    cs = F.bround(ms / 10).cast("long")
    part = lambda v, n: F.lpad(v.cast("long").cast("string"), n, "0")
    return F.concat(F.floor(cs / 360_000).cast("string"), F.lit(":"), part(F.floor(cs / 6000) % 60, 2), F.lit(":"), part(F.floor(cs / 100) % 60, 2), F.lit("."), part(cs % 100, 2))


def rescale(ticks: Column, source: int, target: int) -> Column:
    return F.bround(ticks * target / source).cast("long")
