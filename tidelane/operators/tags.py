"""Tag rows: values by kind, catalog order, editor groups, presets, and rows of Vorbis comments and MP4 item lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.operators.joins import small_side, upsert_tags


def tag_value(kind: Column, text: Column) -> Column:
    """The canonical text of a tag's value: lists split and joined again, yes or no, numbers, ``number/total``; null if it is malformed.

    Kinds: string, text, date and rating keep their text; list, bool, integer, enum, pair.
    """
    t = F.nullif(F.trim(text), F.lit(""))
    items = F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x)), lambda x: x != "")
    up = F.upper(t)
    number = lambda c: F.when(F.rlike(c, F.lit(r"^\s*[+-]?\d+\s*$")), F.trim(c).try_cast("int"))
    first, second = number(F.split_part(t, F.lit("/"), F.lit(1))), F.nullif(F.trim(F.regexp_replace(t, r"^[^/]*/?", "")), F.lit(""))
    total = F.when(second.isNull(), 0).otherwise(number(second))
    pair = F.when(first.isNotNull() & total.isNotNull(), F.when(total > 0, F.concat(first.cast("string"), F.lit("/"), total.cast("string"))).otherwise(first.cast("string")))
    return (
        F.when(kind == "list", F.nullif(F.array_join(items, ", "), F.lit("")))
        .when(kind == "bool", F.when(up.isin("1", "YES", "TRUE", "ON"), "Yes").when(up.isin("0", "NO", "FALSE", "OFF"), "No"))
        .when(kind.isin("integer", "enum"), number(t).cast("string"))
        .when(kind == "pair", pair)
        .otherwise(F.nullif(text, F.lit("")))
    )


def in_catalog_order(tags: DataFrame, catalog: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    """(by, tags): the tag names of each file in catalog order; unknown ones last, by name."""
    c = small_side(catalog.select(F.col("name").alias("__name"), "ord"))
    known = tags.join(c, F.col(name) == F.col("__name"), "left")
    place = F.struct(F.coalesce("ord", F.lit(1 << 30)).alias("o"), F.col(name).alias("n"))
    return known.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["n"]).alias("tags"))


def by_editor_group(tags: DataFrame, catalog: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    """(by, editor_group, tags): the tags of each editor group in catalog order."""
    c = small_side(catalog.select(F.col("name").alias("__name"), "ord", "editor_group"))
    known = tags.join(c, F.col(name) == F.col("__name"))
    return known.groupBy(*by, "editor_group").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(name).alias("n")))), lambda x: x["n"]).alias("tags"))


def apply_preset(tags: DataFrame, preset: DataFrame, files: DataFrame, by: list[str], *, overwrite: bool) -> DataFrame:
    """Every file's tags merged with a preset (name, value); a malformed or empty preset value changes nothing."""
    wanted = files.select(*by).distinct().crossJoin(small_side(preset.where("value is not null").select("name", "value")))
    return upsert_tags(tags.select(*by, "name", "value"), wanted, [*by, "name"], "value", overwrite=overwrite)


def front_covers_first(pictures: DataFrame, by: list[str]) -> DataFrame:
    """(by, pictures): front covers (type 3) before others, each in their order; empty pictures are dropped."""
    place = F.struct(F.when(F.col("type") == 3, 0).otherwise(1).alias("k"), F.col("ord").alias("o"), F.col("picture").alias("p"))
    held = pictures.where(F.col("bytes") > 0)
    return held.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["p"]).alias("pictures"))


def vorbis_comments(comments: DataFrame, fields: DataFrame, by: list[str]) -> DataFrame:
    """Tag rows of Vorbis comments ``KEY=value``: known keys (any case) get their tag, values of one tag are joined in order, others keep their key."""
    rows = comments.where(F.instr("comment", "=") > 1)
    rows = rows.withColumns({"key": F.upper(F.substring_index("comment", "=", 1)), "text": F.regexp_replace("comment", r"(?s)^[^=]*=", "")}).where("text <> ''")
    f = small_side(fields.select(F.upper("field").alias("__field"), "tag"))
    named = rows.join(f, F.col("key") == F.col("__field"), "left").withColumn("name", F.coalesce("tag", "key"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return named.groupBy(*by, "name").agg(F.array_join(parts, ", ").alias("value"))


def item_list(tags: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """(by, atoms): what an MP4 item list holds: the atom of each known tag by rule order, then unknown tags as free-form items by name."""
    r = small_side(rules.select(F.col("tag").alias("__tag"), "atom", "ord"))
    known = tags.join(r, F.col("name") == F.col("__tag"), "left")
    atom = F.coalesce("atom", F.concat(F.lit("----:"), F.col("name")))
    row = F.struct(F.coalesce("ord", F.lit(1 << 30)).alias("o"), atom.alias("a"), F.col("value").alias("v"))
    return known.where("value <> ''").groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: F.concat(x["a"], F.lit("="), x["v"])), "\n").alias("atoms"))


def tags_by_level(tags: DataFrame, levels: DataFrame, by: list[str]) -> DataFrame:
    """(by, level, xml): Matroska-like tag elements by target level (collection 70, season 60, item 50), known names by rule, others on the item."""
    r = small_side(levels.select(F.col("tag").alias("__tag"), "level", "element"))
    known = tags.join(r, F.col("name") == F.col("__tag"), "left").withColumns({"level": F.coalesce("level", F.lit(50)), "element": F.coalesce("element", "name")})
    parts = F.transform(F.array_sort(F.collect_list(F.struct("element", "value"))), lambda x: F.concat(x["element"], F.lit("="), x["value"]))
    return known.where("value <> ''").groupBy(*by, "level").agg(F.array_join(parts, ";").alias("simple_tags"))
