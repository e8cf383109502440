"""Track rules: selection, lookups by source, timeline shifts, container changes and copies.

Tables hold one row a track with a file key (``by``), ``kind``, ``pos`` and what a rule reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.joins import first_match, small_side
from tidelane.operators.rules import in_id_list


def selected_tracks(tracks: DataFrame, action: str = "action") -> DataFrame:
    """Tracks to be written: no chapters, and none that is skipped; no action means passthrough."""
    return tracks.where((F.col("kind") != "chapters") & (F.coalesce(F.col(action), F.lit("passthrough")) != "skip"))


def of_kind(tracks: DataFrame, *kinds: str) -> DataFrame:
    return tracks.where(F.col("kind").isin(*kinds))


def picked_tracks(tracks: DataFrame, ident: str, ids: str | None = None, only: str | None = None) -> DataFrame:
    """Tracks of an id list; without one, those not skipped and of the kind ``only`` (any if None)."""
    if ids is not None:
        return tracks.where(in_id_list(F.col(ident), ids))
    kept = tracks.where(F.coalesce("action", F.lit("passthrough")) != "skip")
    return kept if only is None else kept.where(F.lower("kind") == only.lower())


def with_samples(tracks: DataFrame, samples: DataFrame, key: list[str]) -> DataFrame:
    """Tracks that have samples; raises when there are tracks and none has any."""
    kept = tracks.join(samples.select(*key).distinct(), key, "left_semi")
    if kept.isEmpty() and not tracks.isEmpty():
        raise ValueError("no track has samples")
    return kept


def presentation_time(samples: DataFrame, dts: str = "dts", offset: str = "cts") -> DataFrame:
    """Add ``pts``: decode time plus composition offset (none means 0)."""
    return samples.withColumn("pts", F.col(dts) + F.coalesce(F.col(offset), F.lit(0)))


def merged_hdr(container: str, stream: str, groups: dict[str, tuple[list[str], Column, Column]]) -> Column:
    """HDR metadata of the container completed by the bitstream's, each group taken whole from the first that has it.

    ``groups`` maps a name to its fields and the tests whether the container or the bitstream has it.
    """
    parts = []
    for fields, has_own, has_other in groups.values():
        for x in fields:
            own, other = F.col(f"{container}.{x}"), F.col(f"{stream}.{x}")
            parts.append(F.when(F.coalesce(has_own, F.lit(False)) | ~F.coalesce(has_other, F.lit(False)), own).otherwise(other).alias(x))
    return F.when(F.col(container).isNull(), F.col(stream)).when(F.col(stream).isNull(), F.col(container)).otherwise(F.struct(*parts))


def source_tracks(tracks: DataFrame, demuxed: DataFrame, key: list[str], order: str) -> DataFrame:
    """Every track with the first demuxed track of its path and id."""
    first = first_match(demuxed, key, [F.asc(order)])
    return tracks.join(first, key, "left")


def adopted_tracks(written: DataFrame, saved: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Written tracks with ``columns`` of the re-read track at the same place; those without one are dropped.

    Both sides are ordered by ``pos``; blank or zero values of the re-read track leave the old ones.
    """
    place = lambda t: t.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("pos")))
    fresh = place(saved).select(*by, "__n", *[F.col(c).alias(f"__{c}") for c in columns])
    joined = place(written).join(fresh, [*by, "__n"])
    for c in columns:
        blank = F.lit("") if dict(saved.dtypes)[c] == "string" else F.lit(0)
        joined = joined.withColumn(c, F.coalesce(F.nullif(F.col(f"__{c}"), blank), F.col(c)))
    return joined.drop("__n", *[f"__{c}" for c in columns])


def total_duration(tracks: DataFrame, by: list[str], duration: str, offset: str) -> DataFrame:
    """A file's length: the latest end of a track."""
    return tracks.groupBy(*by).agg(F.greatest(F.max(F.col(duration) + F.col(offset)), F.lit(0)).alias("total"))


def preroll_shift(tracks: DataFrame, by: list[str], first_pts: str) -> DataFrame:
    """Add ``shift`` and the shifted ``offset``: where video starts before zero, all tracks of the file move by as much."""
    early = F.max(F.when(F.col("kind") == "video", -(F.col(first_pts) + F.col("offset")))).over(Window.partitionBy(*by))
    shift = F.greatest(F.coalesce(early, F.lit(0)), F.lit(0))
    return tracks.withColumn("shift", shift).withColumn("offset", F.col("offset") + F.col("shift"))


def destination(source: Column, name: Column | None = None, folder: str | None = None, extension: str | None = None) -> Column:
    """Output path of a job: in ``folder`` or beside the source, under ``name`` or the source's, with ``extension`` or the source's."""
    file = F.regexp_extract(source, r"([^/]*)$", 1)
    stem, own = F.regexp_replace(file, r"\.[^.]*$", ""), F.regexp_extract(file, r"(\.[^.]*)$", 1)
    where = F.lit(folder.rstrip("/")) if folder else F.regexp_replace(source, r"/[^/]*$", "")
    return F.concat(where, F.lit("/"), stem if name is None else F.coalesce(name, stem), F.lit(extension) if extension else own)


def queue_totals(jobs: DataFrame, by: list[str]) -> DataFrame:
    """Jobs completed and failed."""
    count = lambda s: F.count_if(F.col("status") == s)
    return jobs.groupBy(*by).agg(count("Completed").alias("completed"), count("Failed").alias("failed"))


def apply_color(tracks: DataFrame, color: Column) -> DataFrame:
    """Give video tracks the colour description, each keeping its own range flag."""
    own = F.struct(*[(F.col("color.full_range") if f == "full_range" else color[f]).alias(f) for f in tracks.schema["color"].dataType.names])
    return tracks.withColumn("color", F.when(F.col("kind") == "video", own).otherwise(F.col("color")))


def supported_actions(tracks: DataFrame, support: DataFrame) -> DataFrame:
    """Every track with its codec's level and suggested action in the target container; unknown codecs are unsupported.

    ``support`` (codec, target, level, suggested) is a small dimension.
    """
    s = small_side(support.withColumnsRenamed({"codec": "__codec", "target": "__target"}))
    joined = tracks.join(s, (F.col("codec") == F.col("__codec")) & (F.col("target") == F.col("__target")), "left").drop("__codec", "__target")
    return joined.withColumns({"level": F.coalesce("level", F.lit("unsupported")), "suggested": F.coalesce("suggested", F.lit("skip"))})


def container_switch(tracks: DataFrame, choices: DataFrame, key: list[str]) -> DataFrame:
    """Tracks whose action must change for a new container, with the new one.

    ``choices`` (key, action, ord, level) are the actions offered, the recommended one first.  An offered action
    stays, and so does passthrough where the container takes the track unchanged; tracks that could not
    be read have no choices and stay as they are.
    """
    offered = choices.groupBy(*key).agg(F.collect_set("action").alias("__offered"), F.min_by("action", "ord").alias("recommended"), F.max("level").alias("__level"))
    own = F.coalesce("action", F.lit("passthrough"))
    joined = tracks.join(offered, key)
    kept = F.array_contains("__offered", own) | ((own == "passthrough") & (F.col("__level") == "passthrough"))
    return joined.where(~kept).drop("__offered", "__level")


def duplicate_tracks(tracks: DataFrame, by: list[str], chosen: Column) -> DataFrame:
    """A pending, disabled copy (id 0) right after each chosen subtitle track with a source; positions are numbered anew."""
    copies = tracks.where(chosen & (F.col("kind") == "subtitle") & F.col("source").isNotNull())
    copies = copies.withColumns({"track_id": F.lit(0).cast(tracks.schema["track_id"].dataType), "enabled": F.lit(False), "is_default": F.lit(False), "__copy": F.lit(1)})
    both = tracks.withColumn("__copy", F.lit(0)).unionByName(copies)
    return both.withColumn("new_pos", F.row_number().over(Window.partitionBy(*by).orderBy("pos", "__copy")).cast("long")).drop("__copy")


def seek_points(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Blocks that a seek index lists: every sync block of the first video track, else one a cluster of the first audio (or first) track."""
    rank = F.when(F.col("kind") == "video", 0).when(F.col("kind") == "audio", 1).otherwise(2)
    ranked = blocks.withColumn("__k", F.struct(rank.alias("r"), F.col("track")))
    ranked = ranked.withColumn("__best", F.min("__k").over(Window.partitionBy(*by))).where("sync and __k = __best").drop("__best")
    nth = F.row_number().over(Window.partitionBy(*by, "cluster").orderBy("seq"))
    return ranked.withColumn("__n", nth).where((F.col("__k.r") == 0) | (F.col("__n") == 1)).drop("__k", "__n")


def table_summary(runs: DataFrame, by: list[str], n: str, size: str, fixed: str) -> DataFrame:
    """Sample count and bytes of size tables without expanding them: one fixed size for all samples, or the runs' sizes."""
    return runs.groupBy(*by).agg(F.sum(n).alias("samples"), F.sum(F.col(n) * F.coalesce(F.nullif(F.col(fixed), F.lit(0)), F.col(size))).alias("bytes"))


def unpacked_pictures(samples: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows that pack two pictures (``pictures`` = 2) give two; the second takes the slot of the placeholder that follows.

    Adds ``part`` (0 or 1), ``slot``, the row whose time a picture takes, and ``late``, whether it comes one sample's duration
    after that; placeholders (``pictures`` = 0) vanish.  Without a placeholder behind it, the second picture takes the
    next row's slot and that row's first picture is late (``slot`` is null at the end of a track).
    """
    w = Window.partitionBy(*by).orderBy(order)
    opened = samples.withColumns({"__next": F.lead(order).over(w), "__late": F.coalesce(F.lag("pictures").over(w) == 2, F.lit(False))}).where("pictures > 0")
    opened = opened.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("pictures") - 1)))
    opened = opened.withColumn("late", (F.col("part") == 0) & F.col("__late"))
    return opened.withColumn("slot", F.when(F.col("part") == 0, F.col(order)).otherwise(F.col("__next"))).drop("__next", "__late")


def typical_duration(runs: DataFrame, by: list[str], order: str, n: str, delta: str) -> DataFrame:
    """The duration of the longest single run of a track's table (the first of several; runs of 0 do not count; 0 without any)."""
    rank = F.when(F.col(delta) > 0, F.struct(F.col(n), -F.col(order)))
    return runs.groupBy(*by).agg(F.coalesce(F.max_by(delta, rank), F.lit(0)).alias("typical"))


def rank_artwork(art: DataFrame, by: list[str], language: str, score: str, ident: str, wanted: list[str], out: str = "place") -> DataFrame:
    """Places from 1: by the language (the first of ``wanted`` before the others of it, then none, then any other), then by score (none is 0)."""
    known = F.nullif(F.lower(F.trim(language)), F.lit(""))
    rank = F.when(known.isNull(), 0)
    for i, w in enumerate(wanted):
        rank = rank.when(known == w.lower(), len(wanted) - i)
    w = Window.partitionBy(*by).orderBy(rank.otherwise(-1).desc(), F.coalesce(F.col(score), F.lit(0)).desc(), ident)
    return art.withColumn(out, F.row_number().over(w).cast("long"))
