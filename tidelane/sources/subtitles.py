"""Text subtitles and chapter lists: whole-file scans to rows, and ordered text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions.text import strip
from tidelane.functions.times import format_centi, format_ms, parse_ms


def decode_text(content: Column) -> Column:
    """Text of raw bytes: UTF-16 with a byte order mark, else UTF-8 when valid, else Latin-1."""
    head = F.hex(F.substring(content, 1, 3))
    utf8 = F.try_validate_utf8(content.cast("string"))
    text = F.when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16")).when(utf8.isNotNull(), utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", decode_text(F.col("content")).alias("text"))


def _blocks(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split(strip(F.col("text")), r"\n[ \t]*\n+")).alias("n", "block"))


def _cues(blocks: DataFrame, arrow: str) -> DataFrame:
    found = blocks.where(F.rlike("block", F.lit(arrow)))
    cell = lambda g: F.regexp_extract("block", arrow, g)
    cues = found.select("path", "n", parse_ms(cell(1)).alias("start_ms"), parse_ms(cell(2)).alias("end_ms"), strip(cell(3)).alias("settings"), strip(cell(4)).alias("text"))
    return _numbered(cues)


def _numbered(cues: DataFrame) -> DataFrame:
    return cues.withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("start_ms", "n")).cast("long")).drop("n")


def parse_srt(files: DataFrame) -> DataFrame:
    """Cues of SubRip texts, stably sorted by start."""
    return _cues(_blocks(files), r"(?s)(\d+:\d+:\d+[,.]\d+)[ \t]*-->[ \t]*(\d+:\d+:\d+[,.]\d+)([^\n]*)\n?(.*)$")


def parse_vtt(files: DataFrame) -> DataFrame:
    """Cues of WebVTT texts; header, style and note blocks hold no cue."""
    blocks = _blocks(files).where(~F.rlike("block", F.lit(r"^(WEBVTT|STYLE|NOTE|REGION)")) | F.rlike("block", F.lit(r"(?m)^WEBVTT.*\n.*-->")))
    return _cues(blocks, r"(?s)((?:\d+:)?\d+:\d+\.\d+)[ \t]*-->[ \t]*((?:\d+:)?\d+:\d+\.\d+)([^\n]*)\n?(.*)$")


def parse_ass(files: DataFrame) -> DataFrame:
    """Dialogue lines of ASS texts by the layout of their Format line; the last field keeps its commas."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.nullif(F.regexp_extract("line", r"^\[(.+)\]", 1), F.lit("")), True).over(w)
    layout = F.last(F.nullif(F.regexp_extract("line", r"^Format:\s*(.*)$", 1), F.lit("")), True).over(w)
    rows = lines.withColumns({"section": section, "layout": layout}).where("section = 'Events' and line like 'Dialogue:%'")
    rows = rows.withColumns({"names": F.transform(F.split("layout", ","), lambda x: strip(x)), "body": F.regexp_replace("line", r"^Dialogue:\s*", "")})
    rows = rows.withColumn("cells", F.split(F.col("body"), ",", F.size("names")))
    cell = lambda name: F.trim(F.try_element_at("cells", F.array_position("names", name).cast("int")))
    text = F.regexp_replace(F.regexp_replace(cell("Text"), r"\{[^}]*\}", ""), r"\\[Nn]", "\n")
    return _numbered(rows.select("path", "n", parse_ms(cell("Start")).alias("start_ms"), parse_ms(cell("End")).alias("end_ms"), F.coalesce(F.try_to_number(cell("Layer"), F.lit("99999")).cast("int"), F.lit(0)).alias("layer"), cell("Style").alias("style"), text.alias("text")))


def _joined(df: DataFrame, by: str, order: str, line: Column, glue: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return df.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x["l"]), glue).alias("text"))


def to_srt(cues: DataFrame, by: str = "path") -> DataFrame:
    """One SubRip text a file; empty cues are skipped and none ends before it starts."""
    cues = cues.where(F.length(F.trim("text")) > 0).withColumn("end_ms", F.greatest("end_ms", F.col("start_ms") + 1))
    cues = cues.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy("start_ms", "seq")))
    line = F.concat(F.col("__n").cast("string"), F.lit("\n"), format_ms(F.col("start_ms"), ","), F.lit(" --> "), format_ms(F.col("end_ms"), ","), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _joined(cues, by, "__n", line, "\n")


def to_vtt(cues: DataFrame, by: str = "path") -> DataFrame:
    cues = cues.where(F.length(F.trim("text")) > 0).withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy("start_ms", "seq")))
    line = F.concat(format_ms(F.col("start_ms")), F.lit(" --> "), format_ms(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _joined(cues, by, "__n", line, "\n").withColumn("text", F.concat(F.lit("WEBVTT\n\n"), F.col("text")))


def to_ass(cues: DataFrame, by: str = "path") -> DataFrame:
    head = "[Script Info]\nScriptType: v4.00+\n\n[Events]\nFormat: Layer, Start, End, Style, Text\n"
    cues = cues.where(F.length(F.trim("text")) > 0).withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy("start_ms", "seq")))
    line = F.concat(F.lit("Dialogue: 0,"), format_centi(F.col("start_ms")), F.lit(","), format_centi(F.col("end_ms")), F.lit(",Default,"), F.replace(F.col("text"), F.lit("\n"), F.lit("\\N")))
    return _joined(cues, by, "__n", line, "\n").withColumn("text", F.concat(F.lit(head), F.col("text"), F.lit("\n")))


def parse_chapters(files: DataFrame) -> DataFrame:
    """Chapters of the CHAPTERnn= form or, where that gives no time, of ``time title`` lines; missing titles are numbered."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    time = r"^CHAPTER(\d+)\s*=\s*([\d:.,]+)\s*$"
    name = r"^CHAPTER(\d+)NAME\s*=(.*)$"
    get = lambda p, g: F.regexp_extract("line", p, g)
    times = lines.where(F.rlike("line", F.lit(time))).select("path", get(time, 1).cast("int").alias("k"), parse_ms(get(time, 2)).alias("start_ms")).where("start_ms is not null")
    names = lines.where(F.rlike("line", F.lit(name))).select("path", get(name, 1).cast("int").alias("k"), F.nullif(F.trim(get(name, 2)), F.lit("")).alias("title"))
    first = times.join(names, ["path", "k"], "left").select("path", "start_ms", "title", F.col("k").alias("n"))
    plain = r"^\s*(\d+:\d+(?::\d+)?(?:[.,]\d+)?)(?:\s+(.*))?$"
    second = lines.where(F.rlike("line", F.lit(plain))).select("path", parse_ms(get(plain, 1)).alias("start_ms"), F.nullif(F.trim(get(plain, 2)), F.lit("")).alias("title"), "n")
    chapters = first.unionByName(second.join(times.select("path").distinct(), "path", "left_anti"))
    seq = F.row_number().over(Window.partitionBy("path").orderBy("start_ms", "n"))
    return chapters.withColumn("seq", seq.cast("long")).select("path", "seq", "start_ms", F.coalesce("title", F.concat(F.lit("Chapter "), F.col("seq").cast("string"))).alias("title"))


def parse_chapter_titles(files: DataFrame) -> DataFrame:
    """(path, seq, title) of ``number,title`` or plain title lines; quotes around a title and blank lines go."""
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("n", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    title = F.regexp_replace(strip(F.regexp_replace("line", r"^\s*[+-]?\d{1,9}\s*,", "")), r'^"+|"+$', "")
    return lines.select("path", F.row_number().over(Window.partitionBy("path").orderBy("n")).cast("long").alias("seq"), title.alias("title"))


def to_chapter_text(chapters: DataFrame, by: str = "path", *, numbered: bool = True) -> DataFrame:
    """The CHAPTERnn= form, numbered anew by start (two digits at least), or one ``time title`` line a chapter."""
    chapters = chapters.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy("start_ms", "seq")))
    n = F.concat(F.when(F.col("seq") < 10, "0").otherwise(""), F.col("seq").cast("string"))
    if numbered:
        line = F.concat(F.lit("CHAPTER"), n, F.lit("="), format_ms(F.col("start_ms")), F.lit("\nCHAPTER"), n, F.lit("NAME="), F.col("title"))
    else:
        line = F.concat(format_ms(F.col("start_ms")), F.lit(" "), F.col("title"))
    return _joined(chapters, by, "seq", line, "\n").withColumn("text", F.concat(F.col("text"), F.lit("\n")))
