"""Source detection: every format scores a file's head and name; the best score wins, ties by registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROBE_BYTES = 4096
#: (container, hex pattern of the head, file extensions), in order of registration.
FORMATS = (
    ("mp4", r"^.{8}66747970", ("mp4", "m4v", "m4a", "mov")),
    ("matroska", r"^1A45DFA3", ("mkv", "webm", "mka")),
    ("mpegts", r"^47.{374}47|^.{8}47.{382}47", ("ts", "m2ts", "mts")),
    ("ogg", r"^4F676753", ("ogg", "opus", "oga")),
    ("flac", r"^664C6143", ("flac",)),
    ("srt", r"^(?:EFBBBF)?3[0-9]+0D?0A.*2D2D3E", ("srt",)),
    ("vtt", r"^(?:EFBBBF)?574542565454", ("vtt",)),
    ("ass", r"^(?:EFBBBF)?5B53637269707420496E666F5D", ("ass", "ssa")),
)


def detect_sources(files: DataFrame) -> DataFrame:
    """(path, container, score) for files with path and head (bytes): 100 by content, 50 by name alone."""
    head = F.hex(F.substring("head", 1, PROBE_BYTES))
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    scores = [F.struct(F.when(F.rlike(head, F.lit(p)), 100).when(extension.isin(*names), 50).otherwise(0).alias("score"), F.lit(-i).alias("tie"), F.lit(c).alias("container")) for i, (c, p, names) in enumerate(FORMATS)]
    best = F.array_max(F.array(*scores))
    return files.withColumn("__b", best).select("path", F.when(F.col("__b.score") > 0, F.col("__b.container")).alias("container"), F.col("__b.score").alias("score"))


def scan_heads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, PROBE_BYTES).alias("head"))


def image_kind(data: str) -> Column:
    """Image format of a binary column by its magic bytes."""
    h = F.hex(F.substring(data, 1, 8))
    return F.when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("89504E47"), "png").when(h.startswith("47494638"), "gif").when(h.startswith("424D"), "bmp")


#: Files that a task of ``sidecars`` sorts.
FOLDER_ROWS = 250_000


def sidecars(files: DataFrame, bases: DataFrame) -> DataFrame:
    """Files that start with a base's name in the same folder, in order of name.

    Folders are dealt to tasks by the counted files, so neither side is broadcast (rows made by an explode look few to
    the planner) and what a task sorts does not grow with the files.
    """
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-files.count() // FOLDER_ROWS))
    folder = lambda c: F.regexp_extract(c, r"^(.*/)?", 1)
    stem = lambda c: F.lower(F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"\.[^.]*$", ""))
    b = bases.select(F.col("path").alias("base"), folder("path").alias("folder"), stem("path").alias("stem"))
    f = files.select("path", folder("path").alias("folder"), F.lower(F.regexp_extract("path", r"([^/]*)$", 1)).alias("name"))
    found = f.repartition(tasks, "folder").join(b.repartition(tasks, "folder").hint("merge"), "folder").where(F.col("name").startswith(F.col("stem")) & (F.col("path") != F.col("base")))
    return found.select("base", "path", F.row_number().over(Window.partitionBy("folder", "base").orderBy("path")).cast("long").alias("ord"))
