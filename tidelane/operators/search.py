"""Rules of metadata search over stored provider tables: passes, defaults, caps, dates, store names and lenient values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.joins import first_match, small_side


def first_pass(passes: list[DataFrame], query: list[str]) -> DataFrame:
    """Results of the first pass that found anything for a query (a strict search, then one without the year)."""
    tagged = None
    for i, rows in enumerate(passes):
        rows = rows.withColumn("__pass", F.lit(i))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    return tagged.withColumn("__best", F.min("__pass").over(Window.partitionBy(*query))).where("__pass = __best").drop("__pass", "__best")


def default_provider(providers: DataFrame, kind: list[str], preferred: Column) -> DataFrame:
    """The provider of each kind: the preferred one if configured, else the first configured, else the preferred, else the first."""
    rank = F.when(preferred & F.col("configured"), 0).when(F.col("configured"), 1).when(preferred, 2).otherwise(3)
    return first_match(providers.withColumn("__rank", rank), kind, [F.asc("__rank"), F.asc("ord")]).drop("__rank")


def capped_episodes(shows: DataFrame, seasons: DataFrame, episodes: DataFrame, query: list[str], cap: int) -> DataFrame:
    """Episodes of the chosen shows' seasons above 0, in order of show, season and episode, at most ``cap`` a query."""
    found = shows.join(seasons.where("season > 0"), "show").join(episodes, ["show", "season"])
    nth = F.row_number().over(Window.partitionBy(*query).orderBy("show_ord", "season", "episode"))
    return found.withColumn("place", nth.cast("long")).where(F.col("place") <= cap)


def release_certification(dates: DataFrame, movie: list[str], country: str) -> DataFrame:
    """A movie's certification in a country: of theatrical releases (type 3) first, then digital ones (4), then any."""
    known = dates.where((F.lower("country") == country.lower()) & (F.trim("certification") != ""))
    order = F.when(F.col("type") == 3, 0).when(F.col("type") == 4, 1).otherwise(2)
    return first_match(known.withColumn("__o", order), movie, [F.asc("__o"), F.asc("ord")]).drop("__o")


def find_storefront(rows: DataFrame, storefronts: DataFrame, asked: str, default: str = "US") -> DataFrame:
    """The storefront of a numeric id, else of an ISO code (UK means GB), else of a name; else the default one (null without any)."""
    text = F.trim(F.col(asked))
    text = F.when(F.upper(text) == "UK", F.lit("GB")).otherwise(text)
    number = F.rlike(text, F.lit(r"^\d+$"))
    first = lambda name, c: small_side(storefronts.where(c.isNotNull()).groupBy(c.alias(name)).agg(F.min("id").alias(f"{name}_id")))
    found = rows.withColumns({"__number": F.when(number, text), "__iso": F.when(~number, F.upper(text)), "__name": F.when(~number, F.lower(text))})
    for name, c in (("__number", F.col("id").cast("string")), ("__iso", F.upper("iso")), ("__name", F.lower("name"))):
        found = found.join(first(name, c), name, "left")
    chosen = F.coalesce("__number_id", "__iso_id", "__name_id").cast("string")
    keyed = storefronts.withColumn("__key", F.col("id").cast("string"))
    given = storefronts.where(F.col("iso") == default).groupBy(F.lit("default").alias("__key")).agg(F.min_by(F.struct(*storefronts.columns), "id").alias("s")).select("s.*", "__key")
    out = found.withColumn("__key", F.coalesce(chosen, F.lit("default"))).join(small_side(keyed.unionByName(given)), "__key", "left")
    return out.select(*rows.columns, *storefronts.columns)


def normal_date(c: Column) -> Column:
    """A date as yyyy-MM-dd in UTC where the text is a time, else the trimmed text; blank is null."""
    text = F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd"), text)


def date_of_millis(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def season_number(collection: Column) -> Column:
    """The number after "Season", "Series" or "Volume" in a collection's name."""
    return F.nullif(F.regexp_extract(collection, r"(?i)\b(?:season|series|volume)\s+(\d{1,4})\b", 1), F.lit("")).cast("int")


def episode_title(name: Column) -> Column:
    """An episode's name without a leading "Season 5, Episode 1:"."""
    return F.trim(F.regexp_replace(name, r"(?i)^\s*season\s+\d+,\s*episode\s+\d+\s*:\s*", ""))


def artwork_url(url: Column, size: int) -> Column:
    """An artwork's address at another square size: the last ``/WxH`` part is replaced."""
    return F.regexp_replace(url, r"^(.*)/\d+x\d+(?:bb|-\d+)?\.", rf"$1/{size}x{size}bb.")


def filled_url(pattern: Column, width: int, height: int) -> Column:
    """An image address from ``{w}x{h}{c}.{f}``."""
    for token, value in (("{w}", str(width)), ("{h}", str(height)), ("{c}", ""), ("{f}", "jpg")):
        pattern = F.replace(pattern, F.lit(token), F.lit(value))
    return pattern


def lenient_text(document: Column, path: str) -> Column:
    """A string, number or truth value of a JSON document as text; anything else is null."""
    value = F.get_json_object(document, path)
    return F.when(~F.rlike(F.coalesce(value, F.lit("")), F.lit(r"^[\[{]")), value)


def lenient_int(document: Column, path: str) -> Column:
    """A JSON number or numeric string as an integer, decimals cut; anything else is null."""
    text = F.trim(lenient_text(document, path))
    return F.when(F.rlike(text, F.lit(r"^[+-]?\d+(\.\d+)?$")), F.regexp_replace(text, r"\..*$", "")).try_cast("int")
