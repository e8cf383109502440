"""Release names: an ordered cascade of patterns gives kind, title, season, episodes, year, air date and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File extensions that are cut off.
MEDIA_EXTENSIONS = "mkv mk3d mp4 m4v mov avi wmv ts m2ts mts webm mpg mpeg ogm ogv flv 3gp divx vob nfo srt ass ssa sub idx m4a mka".split()
#: The words of release names that end a title, as patterns.
RELEASE_WORDS = [
    r"\d{3,4}[pi]", "4k", "8k", "uhd", r"hdr(?:10)?(?:\+|plus)?", "dv", "dovi", "sdr", "blu-?ray", "bdrip", "brrip", "bdremux", "bd", "dvd(?:rip|scr|r|9|5)?", "web(?:-?dl|-?rip)?",
    "hdtv", "pdtv", "sdtv", "dsr", "hdrip", "tvrip", "vhsrip", "cam", "ts", "telesync", "screener", r"[xh][\. ]?26[45]", "hevc", "avc", "xvid", "divx", "vc-?1", "mpeg-?2", "av[12]", "vp9", "10-?bit", "8-?bit",
    r"aac(?:2[\. ]0|5[\. ]1)?", "ac-?3", "e-?ac-?3", "dts(?:-?hd|-?x|-?ma)?", r"dd(?:p|\+)?[257][\. ][01]", r"dd(?:p|\+)?", "truehd", "atmos", "flac", "mp3", "opus", "lpcm",
    "remux", "proper", "repack", "rerip", "extended", "unrated", "uncut", r"directors[\. ]?cut", "theatrical", "limited", "internal", "multi", "multisubs", "subbed", "dubbed", r"dual[\. ]?audio", "complete",
    "nf", "amzn", "dsnp", "hmax", "atvp", "hulu", "pcok", "itunes", "criterion", "remastered", "imax",
]
#: How seasons' folders are called.
SEASON_FOLDERS = "Season Series Staffel Saison Temporada S".split()



def _by_first_letter(words: list[str]) -> str:
    """One pattern for all words; those that begin with a plain letter share it, so most are not tried at a place."""
    groups: dict[str, list[str]] = {}
    for w in words:
        plain = w[0].isalpha() and (len(w) == 1 or w[1] not in "?*+{|")
        groups.setdefault(w[0] if plain else "", []).append(w[1:] if plain else w)
    return "|".join("|".join(rest) if not first else f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())


_TAG = rf"(?:{_by_first_letter(RELEASE_WORDS)})(?![A-Za-z0-9])"
_GAP = r"[\s._\-]"
_YEAR = r"(?:19|20)\d{2}"
#: Patterns after a lazily matched title: season (group 2), episode (3) and further episodes (4).
_EPISODES = [
    rf"(?<![A-Za-z0-9])s(\d{{1,4}}){_GAP}?e(\d{{1,4}})((?:(?:{_GAP}?-?{_GAP}?e|-)\d{{1,4}})*)(?!\d)",
    r"(?<![A-Za-z0-9])(\d{1,2})x(\d{1,3})((?:(?:-\d{1,2}x|-|x)\d{1,3})*)(?![\dp])",
    rf"(?<![A-Za-z])season{_GAP}*(\d{{1,4}}){_GAP}*[,\-]?{_GAP}*(?:episode|ep\.?){_GAP}*(\d{{1,4}})()",
    rf"(?<![A-Za-z])s(\d{{1,2}}){_GAP}+(?:episode|ep\.?){_GAP}*(\d{{1,4}})()(?!\d)",
    rf"(?<![A-Za-z0-9])(?:episode|ep\.?|e)(){_GAP}*(\d{{1,4}})()(?![\dA-Za-z])",
]
_ANIME = r"(?i)^\s*\[([^\]]+)\]\s*(.+?)\s+-\s+(?:ep?\s*)?(\d{1,4})(?:\s*-\s*(\d{1,4}))?(?:v\d)?(?:\s*(?:end|final))?\s*(?:[\[(].*)?(?:\.\w{2,4})?$"
_DATE = rf"^(.+?)(?<!\d)({_YEAR})[.\-_ ](0[1-9]|1[0-2])[.\-_ ](0[1-9]|[12]\d|3[01])(?!\d)"
_LAST_YEAR = rf"^(.+)(?<![\dA-Za-z])[(\[]?({_YEAR})[)\]]?(?![\dA-Za-z])"
_TRAILING_YEAR = rf"^(.+?)[(\[]?({_YEAR})[)\]]?$"


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def clean_title(c: Column) -> Column:
    """Cut at a release word, keep the points of acronyms, turn separators into blanks, drop empty brackets and loose ends."""
    starts = F.rlike(c, F.lit(rf"(?i)^{_TAG}"))
    c = F.when(starts, c).otherwise(F.regexp_replace(c, rf"(?is)^(.+?)(?<![A-Za-z0-9]){_TAG}.*$", "$1"))
    acronyms = F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9])(?:[A-Za-z]\.){2,}(?:[A-Za-z](?![A-Za-z0-9]))?"), F.lit(0))
    kept = F.aggregate(acronyms, c, lambda text, a: F.replace(text, a, F.translate(a, ".", "\u0001")))
    c = F.when(F.rlike(c, F.lit(r"[A-Za-z]\.[A-Za-z]\.")), kept).otherwise(c)
    c = F.regexp_replace(c, r"(?:_|\.(?!\s))+|\s+", " ")
    c = F.regexp_replace(F.replace(c, F.lit("\u0001"), F.lit(".")), r"\(\s*\)|\[\s*\]", " ")
    return F.regexp_replace(F.regexp_replace(c, r"\s{2,}", " "), r"^[ \-–,(\[{~]+|[ \-–,(\[{~]+$", "")


def without_year(title: Column) -> tuple[Column, Column]:
    """(title, year) of a title that may end in a year."""
    year = _part(title, _TRAILING_YEAR, 2).cast("int")
    rest = F.regexp_replace(F.regexp_extract(title, _TRAILING_YEAR, 1), r"^[ \-(\[]+|[ \-(\[]+$", "")
    return F.when(year.isNotNull(), rest).otherwise(title), year


def folder_title(path: Column) -> Column:
    """The title in the nearest folder that is no season's folder."""
    folders = F.slice(F.split(path, r"[/\\]"), 1, F.greatest(F.size(F.split(path, r"[/\\]")) - 1, F.lit(0)))
    season = rf"(?i)^(?:{'|'.join(SEASON_FOLDERS)})\s*\d{{1,4}}$|^specials?$"
    named = F.filter(folders, lambda x: (x != "") & ~F.rlike(x, F.lit(season)))
    return without_year(clean_title(F.when(F.size(named) > 0, F.element_at(named, -1))))[0]


def parse_names(df: DataFrame, column: str, this_year: int) -> DataFrame:
    """Add kind, title, year, season, episode, last_episode, air_date and release_group."""
    name = F.regexp_extract(F.col(column), r"([^/\\]*)$", 1)
    stem = F.regexp_replace(name, rf"(?i)\.(?:{'|'.join(MEDIA_EXTENSIONS)})$", "")
    lead = r"^\s*\[([^\]]+)\]\s*"
    rows = df.withColumn("__stem", stem)
    bare = F.regexp_replace(F.regexp_replace("__stem", lead, ""), rf"\[(?!{_YEAR}\])[^\]]*\]", " ")
    rows = rows.withColumns({"__s": bare, "__group": F.trim(_part(F.col("__stem"), lead, 1)), "__anime": F.rlike("__stem", F.lit(_ANIME))})
    s, numbers = F.col("__s"), F.regexp_extract_all
    forms = [rf"(?is)^(.*?){p}" for p in _EPISODES]
    form = F.when(F.col("__anime"), -1)
    for i, p in enumerate(forms):
        form = form.when(F.rlike(s, F.lit(p)), i)
    aired = F.concat_ws("-", *[F.regexp_extract(s, _DATE, g) for g in (2, 3, 4)])
    form = form.when(F.try_to_date(F.nullif(aired, F.lit("--"))).isNotNull(), 10)
    last_year = _part(s, _LAST_YEAR, 2).cast("int")
    form = form.when((last_year <= this_year + 2) & (clean_title(F.regexp_extract(s, _LAST_YEAR, 1)) != ""), 11).otherwise(12)
    rows = rows.withColumn("__form", form)
    f = F.col("__form")

    def by_form(get: list[Column], other: Column) -> Column:
        out = F.when(f == 0, get[0])
        for i in range(1, len(get)):
            out = out.when(f == i, get[i])
        return out.otherwise(other)

    before = by_form([F.regexp_extract(s, p, 1) for p in forms], F.when(f == -1, F.regexp_extract("__stem", _ANIME, 2)).when(f == 10, F.regexp_extract(s, _DATE, 1)).when(f == 11, F.regexp_extract(s, _LAST_YEAR, 1)).otherwise(s))
    rows = rows.withColumn("__clean", clean_title(before))
    tv_title, tv_year = without_year(F.col("__clean"))
    season_at = r"(?i)^(.*?)\s+(?:s|season\s*)(\d{1,2})$"
    anime_season = _part(F.col("__clean"), season_at, 2).cast("int")
    title = F.when(f == -1, F.when(anime_season.isNotNull(), F.trim(F.regexp_extract("__clean", season_at, 1))).otherwise(F.col("__clean"))).when(f <= 10, tv_title).otherwise(F.col("__clean"))
    title = F.when(title != "", title).otherwise(F.when(f <= 10, F.coalesce(folder_title(F.col(column)), F.lit(""))).otherwise(clean_title(F.col("__stem"))))
    episode = by_form([_part(s, p, 3).cast("int") for p in forms], F.when(f == -1, _part(F.col("__stem"), _ANIME, 3).cast("int")))
    season = by_form([_part(s, p, 2).cast("int") for p in forms], F.when(f == -1, F.coalesce(anime_season, F.lit(1))))
    tail = by_form([F.regexp_extract(s, p, 4) for p in forms[:2]], F.when(f == -1, F.regexp_extract("__stem", _ANIME, 4)).otherwise(F.lit("")))
    last = F.try_element_at(numbers(F.regexp_replace(tail, r"\d+x", ""), F.lit(r"\d+"), F.lit(0)), F.lit(-1)).cast("int")
    group = F.coalesce(F.col("__group"), F.when((f < 12) | F.rlike(s, F.lit(rf"(?is)(?<![A-Za-z0-9]){_TAG}")), _part(s, r"-([A-Za-z0-9]+)$", 1)))
    return rows.select(
        *df.columns,
        F.when(f <= 10, "tv").otherwise("movie").alias("kind"),
        title.alias("title"),
        F.when(f.between(0, 4), tv_year).when(f == 10, _part(s, _DATE, 2).cast("int")).when(f == 11, last_year).alias("year"),
        season.alias("season"),
        episode.alias("episode"),
        F.when((f == -1) | (last != episode), last).alias("last_episode"),
        F.when(f == 10, aired).alias("air_date"),
        F.when(f == -1, F.trim(F.regexp_extract("__stem", _ANIME, 1))).otherwise(group).alias("release_group"),
    )
