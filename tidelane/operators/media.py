"""Track and container tables: sample-table expansion, edit lists, rule-driven tags, ratings, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.joins import asof_join, first_match, small_side
from tidelane.operators.timeline import expand_runs, prefix_sum


def expand_sample_table(runs: DataFrame, chunk_runs: DataFrame, by: list[str]) -> DataFrame:
    """Samples of run-length tables.

    ``runs`` (by, run, n, delta) gives durations, ``chunk_runs`` (by, first_chunk, per_chunk) the samples
    in each chunk from a chunk on.  Adds seq, dts and the chunk of each sample (both from 1).
    """
    samples = expand_runs(runs, "n")
    w = Window.partitionBy(*by).orderBy("run", "i")
    samples = samples.withColumn("seq", F.row_number().over(w).cast("long"))
    samples = prefix_sum(samples, by, ["seq"], "delta")
    nxt = F.lead("first_chunk").over(Window.partitionBy(*by).orderBy("first_chunk"))
    spans = chunk_runs.withColumn("__samples", (nxt - F.col("first_chunk")) * F.col("per_chunk"))
    spans = prefix_sum(spans.withColumn("__samples", F.coalesce("__samples", F.lit(0).cast("long"))), by, ["first_chunk"], "__samples", "before")
    spans = spans.select(*by, (F.col("before") + 1).alias("from_seq"), "first_chunk", "per_chunk")
    found = asof_join(samples, spans, by, "seq", "from_seq", ["from_seq", "first_chunk", "per_chunk"])
    return found.withColumn("chunk", F.col("first_chunk") + F.floor((F.col("seq") - F.col("from_seq")) / F.col("per_chunk")))


def edit_offsets(edits: DataFrame, by: list[str], order: str, duration: str, media_time: str) -> DataFrame:
    """Start offset (empty edits before the first media edit), media start, and media end if that edit is the last."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = edits.withColumn("__media", F.col(media_time) >= 0)
    marked = marked.withColumn("__seen", F.coalesce(F.max(F.col("__media").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    marked = marked.withColumn("__first", F.col("__media") & (F.sum(F.col("__media").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1))
    marked = marked.withColumn("__last", F.lead(order).over(w).isNull())
    end = F.when(F.col("__first") & F.col("__last"), F.col(media_time) + F.col(duration))
    return marked.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("__seen") == 0, F.col(duration))), F.lit(0)).alias("start_offset"), F.max(F.when(F.col("__first"), F.col(media_time))).alias("media_start"), F.max(end).alias("media_end"))


def consume_by_rules(tags: DataFrame, rules: DataFrame, by: list[str], rule_key: str, tag_key: str, within: list[str] | None = None) -> DataFrame:
    """Match tags to ordered rules by upper-cased name; each tag serves one rule and each target takes one tag, first wins.

    ``rules`` (rule_key, target, ord) is a small dimension, ``tags`` has by, tag_key and pos.  Both have the columns ``within``
    (a level, a context): a rule that names one holds for tags of it alone, one that leaves it null for all.
    """
    within = within or []
    named = small_side(rules.withColumnsRenamed({c: f"__{c}" for c in within}))
    on = F.upper(F.col(tag_key)) == F.upper(F.col(rule_key))
    for c in within:
        on = on & (F.col(f"__{c}").isNull() | (F.col(f"__{c}") == F.col(c)))
    joined = tags.join(named, on).drop(*[f"__{c}" for c in within])
    once = first_match(joined, [*by, "pos"], [F.asc("ord")])
    return first_match(once, [*by, "target"], [F.asc("ord"), F.asc("pos")])


#: Fixed values of rating systems: (system, country, media, code, value).
RATINGS = [
    ("mpaa", "US", "movie", "NR", 0), ("mpaa", "US", "movie", "G", 100), ("mpaa", "US", "movie", "PG", 200), ("mpaa", "US", "movie", "PG-13", 300), ("mpaa", "US", "movie", "R", 400), ("mpaa", "US", "movie", "NC-17", 500),
    ("us-tv", "US", "tv", "TV-Y", 100), ("us-tv", "US", "tv", "TV-Y7", 200), ("us-tv", "US", "tv", "TV-G", 300), ("us-tv", "US", "tv", "TV-PG", 400), ("us-tv", "US", "tv", "TV-14", 500), ("us-tv", "US", "tv", "TV-MA", 600),
    ("de-movie", "DE", "movie", "Ab 12 Jahren", 200), ("de-movie", "DE", "movie", "Ab 16 Jahren", 500), ("de-tv", "DE", "tv", "Ab 12 Jahren", 200), ("de-tv", "DE", "tv", "Ab 16 Jahren", 500),
    ("uk-movie", "GB", "movie", "12A", 325), ("uk-movie", "GB", "movie", "15", 350),
]


def normal_certification(c: Column) -> tuple[Column, Column]:
    """(country prefix, certification without it, without a leading ``Rated``, and with ``TV-`` for ``TV_``)."""
    c = F.trim(c)
    country = F.nullif(F.regexp_extract(c, r"^([^:]{1,3}):", 1), F.lit(""))
    c = F.trim(F.regexp_replace(c, r"^[^:]{1,3}:", ""))
    c = F.trim(F.regexp_replace(c, r"(?i)^rated ", ""))
    return country, F.nullif(F.regexp_replace(c, r"(?i)^tv_", "TV-"), F.lit(""))


def lookup_ratings(rows: DataFrame, ratings: DataFrame) -> DataFrame:
    """Rating of (certification, country, media); no country means the US, and a US ``TV-`` code is one of TV whatever the media.

    Within the row's media, then within any: the same code, else the same name, else the same letters and digits, else
    for a mere number (with FSK or a plus at most) the first code with that number; an unrated row gets the entry of country ``*``.
    """
    country, certification = normal_certification(F.col("certification"))
    asked = rows.withColumns({"__c": certification, "__country": F.upper(F.coalesce(country, F.nullif(F.trim("country"), F.lit("")), F.lit("US")))})
    tv = (F.col("__country") == "US") & F.upper("__c").startswith("TV-")
    asked = asked.withColumn("__media", F.when(tv, "tv").otherwise(F.col("media")))
    compact = lambda c: F.regexp_replace(F.upper(c), r"[^\p{L}\p{Nd}]", "")
    first_number = lambda c: F.regexp_extract(c, r"(\d+)", 1)
    mere = F.rlike(F.trim(F.regexp_replace("__c", "(?i)fsk", "")), F.lit(r"^[-+]?\s*\d+\s*\+?$"))
    r = ratings.withColumnsRenamed({c: f"r_{c}" for c in ratings.columns})
    entry = F.struct(*r.columns)
    same = [F.upper("r_code"), F.upper("r_name"), compact(F.col("r_code")), first_number("r_code")]
    keys = lambda media, country, values: [F.concat_ws("|", m, country, F.lit(str(i)), v) for m in (media, F.lit("*")) for i, v in enumerate(values)]
    table = r.select(entry.alias("entry"), F.explode(F.array(*keys(F.col("r_media"), F.col("r_country"), same), F.when(F.col("r_country") == "*", "unrated"))).alias("__key")).where("__key is not null")
    first = table.groupBy("__key").agg(F.min_by("entry", "entry.r_ord").alias("entry"))
    # each distinct question is answered once, by equality with its keys from the narrowest to the widest
    by = ["__c", "__country", "__media"]
    wanted = [F.upper("__c"), F.upper("__c"), compact(F.col("__c")), F.when(mere, first_number("__c"))]
    usable = [F.when(F.col("__c").isNotNull() & v.isNotNull(), k) for k, v in zip(keys(F.col("__media"), F.col("__country"), wanted), wanted * 2, strict=True)]
    unrated = F.when(F.upper("__c").isin("NR", "UNRATED", "NOT RATED"), "unrated")
    questions = asked.select(*by).distinct().select(*by, F.posexplode(F.array(*usable, unrated)).alias("__rank", "__key")).where("__key is not null")
    answers = questions.join(small_side(first), "__key").groupBy(*by).agg(F.min_by("entry", "__rank").alias("entry"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    return asked.alias("a").join(answers.alias("b"), on, "left").select(*[F.col(f"a.`{c}`") for c in rows.columns], "b.entry.*")


#: Words of names of auxiliary tracks.
AUXILIARY = ("director", "commentary", "lyric", "karaoke", "sign")


def characteristics(name: Column, kind: Column, forced: Column | None = None, auxiliary: tuple[str, ...] = AUXILIARY) -> Column:
    """Media characteristics that a track's name and kind tell."""
    low = F.lower(F.coalesce(name, F.lit("")))
    has = lambda *w: F.greatest(*[low.contains(x).cast("int") for x in w], F.lit(0)) == 1
    text, captions = kind.isin("subtitle", "captions"), kind == "captions"
    heard = text & (has("sdh", "hearing") | captions)
    only = text & (has("forced") | (F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False)))
    parts = [F.when(has(*auxiliary), "auxiliary"), F.when(heard, "transcribes-dialog"), F.when(heard, "describes-music-and-sound"), F.when(only, "forced-only")]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def chinese_script(language: Column, name: Column) -> Column:
    """zh-Hans or zh-Hant where the name tells and the language has no script yet."""
    low, open_ = F.lower(name), F.lower(language).startswith("zh") & ~language.contains("-")
    return F.when(open_ & low.contains("simplified"), "zh-Hans").when(open_ & low.contains("traditional"), "zh-Hant").otherwise(language)


def video_timescale(frame_ns: Column) -> Column:
    """(timescale, ticks) on which a frame's duration is an integer: NTSC rates over 1001, whole rates over 1000, else 90 kHz."""
    fps = F.lit(1e9) / F.nullif(frame_ns, F.lit(0))
    answer = lambda scale, ticks: F.struct(scale.cast("long").alias("timescale"), ticks.cast("long").alias("ticks"))
    out = F.when(fps.isNull(), answer(F.lit(90000), F.lit(0)))
    for scale in (24000, 30000, 48000, 60000, 120000):
        out = out.when(F.abs(fps - scale / 1001) < 0.0005, answer(F.lit(scale), F.lit(1001)))
    whole = F.bround(fps)
    out = out.when((whole > 0) & (F.abs(fps - whole) < 0.0005), answer(whole * 1000, F.lit(1000)))
    return out.otherwise(answer(F.lit(90000), F.bround(frame_ns * 90000 / F.lit(1e9))))


def nearest_rate(wanted: Column, supported: list[int]) -> Column:
    """The supported rate nearest to the wanted one, the lower on a tie."""
    return F.array_min(F.array(*[F.struct(F.abs(wanted - r).alias("d"), F.lit(r).alias("r")) for r in supported]))["r"]


def pivot_statistics(tags: DataFrame, tracks: DataFrame, names: list[str], bridge: DataFrame | None = None) -> DataFrame:
    """Statistics tags (uid, name, value) by their track.

    Where tracks have numbers but no uids, ``bridge`` (number, uid) leads from one to the other; a uid that it lacks is lost.
    """
    wide = tags.groupBy("uid").pivot("name", names).agg(F.max("value"))
    if bridge is None:
        return tracks.join(wide, "uid", "left")
    return tracks.join(wide.join(bridge.select("number", "uid"), "uid").drop("uid"), "number", "left")


def add_imported(tracks: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Put imported tracks behind the present ones but before chapters, and number all anew."""
    both = tracks.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    place = F.when(F.col("kind") == "chapters", 2).otherwise(F.col("__new"))
    return both.withColumn("new_pos", F.row_number().over(Window.partitionBy(*by).orderBy(place, "pos")).cast("long")).drop("__new")


def prefill(tv_show: Column, tv_season: Column, movie: Column, parsed_kind: Column, parsed_title: Column) -> Column:
    """Search terms by precedence: TV tags, movie tag, file name."""
    return F.coalesce(F.when(tv_show.isNotNull() & tv_season.isNotNull(), F.struct(F.lit("tv").alias("kind"), tv_show.alias("title"))), F.when(movie.isNotNull(), F.struct(F.lit("movie").alias("kind"), movie.alias("title"))), F.struct(parsed_kind.alias("kind"), parsed_title.alias("title")))
