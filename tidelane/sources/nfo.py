"""NFO sidecars: XML metadata of movies, shows and episodes, their candidates, merge and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "title string, showtitle string, season int, episode int, year int, aired string, premiered string, plot string, mpaa string, studio string, genre array<string>, director array<string>, credits array<string>, actor array<struct<name: string, role: string>>, thumb array<string>"


def parse_nfo(files: DataFrame) -> DataFrame:
    """One row a file with the fields of ``SCHEMA``; text after the document (a bare url) is ignored."""
    body = F.regexp_extract("text", r"(?s)^.*?(<(movie|tvshow|episodedetails)\b.*</\2>)", 1)
    return files.withColumn("__x", F.from_xml(F.nullif(body, F.lit("")), SCHEMA)).select("path", "__x.*")


def nfo_candidates(media: DataFrame) -> DataFrame:
    """(path, ord, nfo): where a media file's metadata may lie, in order of preference."""
    folder, stem = F.regexp_extract("path", r"^(.*/)", 1), F.regexp_replace("path", r"\.[^./]*$", "")
    parent = F.regexp_extract("path", r"^(.*/)[^/]+/[^/]*$", 1)
    names = F.array(F.concat(stem, F.lit(".nfo")), F.concat(folder, F.lit("movie.nfo")), F.concat(folder, F.lit("tvshow.nfo")), F.concat(parent, F.lit("tvshow.nfo")))
    return media.select("path", F.posexplode(names).alias("ord", "nfo"))


def fill_from_show(episodes: DataFrame, shows: DataFrame, key: str) -> DataFrame:
    """Fields that an episode lacks come from its show."""
    s = shows.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in shows.columns if c != key])
    joined = episodes.join(s, F.col(key) == F.col("__k"), "left")
    filled = lambda c: F.coalesce(c, f"__{c}").alias(c) if c != key and f"__{c}" in joined.columns else F.col(c)
    return joined.select(*[filled(c) for c in episodes.columns])


def to_nfo(columns: dict[str, Column], root: str = "episodedetails") -> Column:
    """An XML document of the given fields; absent ones are left out."""
    return F.to_xml(F.struct(*[c.alias(k) for k, c in columns.items()]), {"rowTag": root})
