"""Batch jobs over files: running a queue, output names, look-ups of files and keys, export plans and exclusive writes."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.text import name_format
from tidelane.operators.joins import small_side
from tidelane.operators.timeline import islands

_LOG = logging.getLogger(__name__)

MOVIE_NAME = "{Name}"
TV_NAME = "{TV Show} s{TV Season:00}e{TV Episode #:00}"
#: The extension of a raw export by codec.
EXPORT_EXTENSIONS = {
    "h264": ".h264", "hevc": ".h265", "vvc": ".h266", "evc": ".evc", "av1": ".ivf", "vp8": ".ivf", "vp9": ".ivf", "mpeg1video": ".m1v", "mpeg2video": ".m2v", "mpeg4": ".m4v", "vc1": ".vc1", "aac": ".aac", "ac3": ".ac3", "eac3": ".eac3", "ac4": ".ac4",
    "dts": ".dts", "truehd": ".thd", "mp2": ".mp2", "mp3": ".mp3", "flac": ".flac", "alac": ".caf", "pcm": ".wav", "opus": ".opus", "vorbis": ".ogg", "srt": ".srt", "tx3g": ".srt", "ass": ".ass", "ssa": ".ssa", "webvtt": ".vtt", "pgs": ".sup", "vobsub": ".idx",
}


def run_queue(paths: Iterable[str], process: Callable[[str], None], stop: Callable[[], bool] = lambda: False) -> dict[str, str]:
    """Run the ready jobs one after another; a failure marks its job and the next one runs, ``stop`` leaves the rest ready."""
    status = dict.fromkeys(paths, "Ready")
    for path in status:
        if stop():
            break
        status[path] = "Completed" if guarded(path, lambda path=path: process(path) or True, False) else "Failed"
    return status


def guarded(operation: str, body: Callable[[], object], fallback: object) -> object:
    """The result of ``body``; a failure is logged and gives ``fallback``."""
    try:
        return body()
    except Exception as failure:
        _LOG.warning("%s failed: %s", operation, failure)
        return fallback


def output_name(columns: dict[str, Column], media_kind: Column, movie: str = MOVIE_NAME, tv: str = TV_NAME) -> Column:
    """A job's output name from its tags: the TV pattern for TV shows (by kind, or by show and episode), else the movie pattern."""
    has = lambda c: columns.get(c, F.lit(None)).isNotNull()
    is_tv = F.coalesce(media_kind == "tv", F.lit(False)) | (has("TV Show") & has("TV Episode #"))
    return F.when(is_tv, name_format(tv, columns)).otherwise(name_format(movie, columns))


def key_by_precedence(*sources: Column) -> Column:
    """The first key that is given: the user's, the environment's, the file's, the built-in one."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in sources])


def scan_once(requests: DataFrame, key: list[str], scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every request with the rows of its source; a source that many requests name is scanned once."""
    return requests.join(scan(requests.select(*key).distinct()), key)


def first_existing(places: DataFrame, names: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """For each group the first (place, name) in order that is a file; places and names are short lists."""
    tried = places.join(names, by).withColumn("path", F.concat("place", F.lit("/"), "name"))
    found = tried.join(files.select("path").distinct(), "path", "left_semi")
    return found.groupBy(*by).agg(F.min_by("path", F.struct("place_ord", "name_ord")).alias("path"))


def attached_packets(packets: DataFrame, wanted: DataFrame, pid: str = "pid") -> DataFrame:
    """Packets of the streams that someone reads (``wanted`` has a handful of pids); all others are dropped before assembly."""
    return packets.join(small_side(wanted.select(pid).distinct()), pid, "left_semi")


def export_plan(tracks: DataFrame, codec: str = "codec") -> DataFrame:
    """Tracks that can be exported raw, with the file's extension."""
    known = F.create_map(*[F.lit(x) for pair in EXPORT_EXTENSIONS.items() for x in pair])
    return tracks.withColumn("extension", F.try_element_at(known, F.lower(codec))).where("extension is not null")


def page_cues(pages: DataFrame, by: list[str], time: str, text: str) -> DataFrame:
    """Cues of a page stream such as teletext: a page lasts until its text changes or it is erased (blank)."""
    w = Window.partitionBy(*by).orderBy(time)
    changed = ~F.col(text).eqNullSafe(F.lag(text).over(w)) | F.lag(time).over(w).isNull()
    runs = islands(pages.withColumn("__c", changed), by, [time], F.col("__c"))
    cues = runs.groupBy(*by, "island").agg(F.min(time).alias("start"), F.first(text).alias(text))
    ended = cues.withColumn("end", F.lead("start").over(Window.partitionBy(*by).orderBy("start")))
    return ended.where(F.trim(F.coalesce(text, F.lit(""))) != "").drop("island")


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write to a place that must not exist yet; the files appear all at once when the job commits, or not at all."""
    df.write.mode("errorifexists").format(kind).save(path)
