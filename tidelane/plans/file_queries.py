"""Queries of readers and sinks: whole files are made from table rows, read, and compared with what went into them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions import text
from tidelane.functions.bits import joined_bytes
from tidelane.functions.times import format_centi, format_ms
from tidelane.plans.queries import _t, query
from tidelane.sources import containers, detect, mp4, nfo, programs, ranges, subtitles
from tidelane.sources.workdir import new_place

#: Orders stand in for cues: their customer is the file, the key gives the times.
_CUES = """
c AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS k, o_orderkey * 1700 + 250 AS start_ms, o_orderkey * 1700 + 250 + 1 + o_orderkey % 1500 AS end_ms, o_orderpriority || chr(10) || o_orderstatus AS text FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_ms) AS seq FROM c)"""
_MS = "CASE WHEN {0} < 36000000 THEN '0' ELSE '' END || CAST({0} // 3600000 AS VARCHAR) || ':' || lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0') || '{1}' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')"


def _cues(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("o_orderkey") * 1700 + 250
    o = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("seq"), start.alias("start_ms"), F.concat("o_orderpriority", F.lit("\n"), "o_orderstatus").alias("text"))
    return o.withColumn("end_ms", F.col("start_ms") + 1 + F.col("seq") % 1500)


def _files(cues: DataFrame, block: Column, glue: str, head: str = "") -> DataFrame:
    """One text a path, its blocks from the last cue to the first."""
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("seq", block.alias("b"))), False), lambda x: x["b"])
    return cues.groupBy("path").agg(F.concat(F.lit(head), F.array_join(blocks, glue)).alias("text"))


@query(f"WITH {_CUES} SELECT path, seq, start_ms, end_ms, text FROM n")
def q_srt_read(spark: SparkSession, d: str) -> DataFrame:
    block = F.concat(F.lit("7\r\n"), format_ms(F.col("start_ms"), ","), F.lit(" --> "), format_ms(F.col("end_ms"), ","), F.lit("\r\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")))
    raw = _files(_cues(spark, d), block, "\r\n \r\n").select("path", F.encode(F.concat(F.lit("﻿"), "text"), "UTF-8").alias("content"))
    return subtitles.parse_srt(raw.select("path", subtitles.decode_text(F.col("content")).alias("text"))).select("path", "seq", "start_ms", "end_ms", "text")


@query(f"WITH {_CUES} SELECT path, string_agg(seq || chr(10) || {_MS.format('start_ms', ',')} || ' --> ' || {_MS.format('end_ms', ',')} || chr(10) || text || chr(10), chr(10) ORDER BY seq) AS text FROM n GROUP BY path")
def q_srt_write(spark: SparkSession, d: str) -> DataFrame:
    return subtitles.to_srt(_cues(spark, d))


@query(f"WITH {_CUES} SELECT path, seq, start_ms, end_ms, 'align:start' AS settings, text FROM n")
def q_vtt_read(spark: SparkSession, d: str) -> DataFrame:
    block = F.concat(F.lit("id\n"), format_ms(F.col("start_ms")), F.lit(" --> "), format_ms(F.col("end_ms")), F.lit(" align:start\n"), "text")
    files = _files(_cues(spark, d), block, "\n\n", "WEBVTT - test\n\nSTYLE\n::cue { color: red }\n\nNOTE none\n\n")
    return subtitles.parse_vtt(files).select("path", "seq", "start_ms", "end_ms", "settings", "text")


@query(f"WITH {_CUES} SELECT path, 'WEBVTT' || chr(10) || chr(10) || string_agg({_MS.format('start_ms', '.')} || ' --> ' || {_MS.format('end_ms', '.')} || chr(10) || text || chr(10), chr(10) ORDER BY seq) AS text FROM n GROUP BY path")
def q_vtt_write(spark: SparkSession, d: str) -> DataFrame:
    return subtitles.to_vtt(_cues(spark, d))


@query(f"""WITH {_CUES}, r AS (SELECT *, CAST(round_even(start_ms / 10.0::DOUBLE, 0) AS BIGINT) * 10 AS s, CAST(round_even(end_ms / 10.0::DOUBLE, 0) AS BIGINT) * 10 AS e FROM n)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY s, k DESC) AS seq, s AS start_ms, e AS end_ms, CAST(k % 3 AS INT) AS layer, 'Top' AS style, text || ', and more' AS text FROM r
""")
def q_ass_read(spark: SparkSession, d: str) -> DataFrame:
    head = "[Script Info]\nTitle: x\n\n[V4+ Styles]\nFormat: Name, Fontname\nStyle: Top,Arial\n\n[Events]\nFormat: Layer, Start, End, Style, Name, Text\n"
    block = F.concat(F.lit("Dialogue: "), (F.col("seq") % 3).cast("string"), F.lit(","), format_centi(F.col("start_ms")), F.lit(","), format_centi(F.col("end_ms")), F.lit(",Top,,{\\b1}"), F.replace("text", F.lit("\n"), F.lit("\\N")), F.lit(", and more"))
    return subtitles.parse_ass(_files(_cues(spark, d), block, "\n", head)).select("path", "seq", "start_ms", "end_ms", "layer", "style", "text")


_CS = "CAST({0} // 360000 AS VARCHAR) || ':' || lpad(CAST({0} // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({0} % 100 AS VARCHAR), 2, '0')"


@query(f"""WITH {_CUES}, r AS (SELECT *, CAST(round_even(start_ms / 10.0::DOUBLE, 0) AS BIGINT) AS s, CAST(round_even(end_ms / 10.0::DOUBLE, 0) AS BIGINT) AS e FROM n)
SELECT path, '[Script Info]' || chr(10) || 'ScriptType: v4.00+' || chr(10) || chr(10) || '[Events]' || chr(10) || 'Format: Layer, Start, End, Style, Text' || chr(10)
       || string_agg('Dialogue: 0,' || {_CS.format('s')} || ',' || {_CS.format('e')} || ',Default,' || replace(text, chr(10), chr(92) || 'N'), chr(10) ORDER BY seq) || chr(10) AS text FROM r GROUP BY path
""")
def q_ass_write(spark: SparkSession, d: str) -> DataFrame:
    return subtitles.to_ass(_cues(spark, d))


@query("""
WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS k, o_orderkey * 60000 AS start_ms, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS title FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_ms) AS seq FROM c) SELECT path, seq, start_ms, coalesce(title, 'Chapter ' || seq) AS title FROM n
""")
def q_chapters_read(spark: SparkSession, d: str) -> DataFrame:
    """Files of odd customers in the numbered form, of even ones as lines of time and title."""
    k = F.col("o_orderkey")
    c = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("path"), k.alias("seq"), (k * 60000).alias("start_ms"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("title"), (F.col("o_custkey") % 2).alias("odd"))
    number, time = F.col("seq").cast("string"), format_ms(F.col("start_ms"))
    named = F.concat(F.lit("CHAPTER"), number, F.lit("="), time, F.coalesce(F.concat(F.lit("\nCHAPTER"), number, F.lit("NAME="), "title"), F.lit("")))
    plain = F.concat(time, F.coalesce(F.concat(F.lit(" "), "title"), F.lit("")))
    return subtitles.parse_chapters(_files(c, F.when(F.col("odd") == 1, named).otherwise(plain), "\n"))


@query(f"""
WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey * 60000 AS ms, o_orderpriority AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders)
SELECT path, string_agg('CHAPTER' || CASE WHEN seq < 10 THEN '0' ELSE '' END || seq || '=' || {_MS.format('ms', '.')} || chr(10) || 'CHAPTER' || CASE WHEN seq < 10 THEN '0' ELSE '' END || seq || 'NAME=' || title, chr(10) ORDER BY seq) || chr(10) AS text FROM c GROUP BY path
""")
def q_chapters_write(spark: SparkSession, d: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    c = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("path"), (F.col("o_orderkey") * 60000).alias("start_ms"), F.col("o_orderpriority").alias("title"), seq.alias("seq"))
    return subtitles.to_chapter_text(c)


@query("""
WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN 'Part, ' || o_orderkey ELSE o_orderstatus END AS title FROM orders)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY k DESC) AS seq, title FROM c
""")
def q_chapter_titles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(", "), "o_orderpriority")).when(k % 3 == 1, F.concat(F.lit('"Part, '), k.cast("string"), F.lit('" '))).otherwise(F.concat(F.lit("\n"), "o_orderstatus"))
    c = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("path"), k.alias("seq"), line.alias("line"))
    return subtitles.parse_chapter_titles(_files(c, F.col("line"), "\r\n"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_name || ' & Co' AS title, p_size AS season, p_brand || ';' || p_type AS genres, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS plot FROM part")
def q_nfo_read(spark: SparkSession, d: str) -> DataFrame:
    plot = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<plot>"), "p_type", F.lit("</plot>"))).otherwise(F.lit(""))
    xml = F.concat(F.lit("<?xml version='1.0'?>\n<episodedetails><title>"), "p_name", F.lit(" &amp; Co</title><season>"), F.col("p_size").cast("string"), F.lit("</season><genre>"), "p_brand", F.lit("</genre><genre>"), "p_type", F.lit("</genre>"), plot, F.lit("</episodedetails>\nhttps://x.example/1"))
    got = nfo.parse_nfo(_t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), xml.alias("text")))
    return got.select("path", "title", "season", F.array_join("genre", ";").alias("genres"), "plot")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_name || ' <1>' AS title, p_size AS season, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS studio FROM part")
def q_nfo_write(spark: SparkSession, d: str) -> DataFrame:
    """Written documents read again."""
    columns = {"title": F.concat("p_name", F.lit(" <1>")), "season": F.col("p_size"), "studio": F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))}
    return nfo.parse_nfo(_t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), nfo.to_nfo(columns).alias("text"))).select("path", "title", "season", "studio")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END AS ord, CASE WHEN p_partkey % 4 = 0 THEN 'own' ELSE 'movie' END AS nfo FROM part WHERE p_partkey % 4 <> 3
""")
def q_nfo_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first candidate that exists: a quarter of the files have one of their own, and all but another quarter a movie's."""
    k = F.col("p_partkey").cast("string")
    media = _t(spark, d, "part").select(F.concat(F.lit("/m/"), k, F.lit("/film.mkv")).alias("path"), "p_partkey")
    have = media.where("p_partkey % 4 = 0").select(F.concat(F.lit("/m/"), k, F.lit("/film.nfo")).alias("nfo"))
    have = have.unionByName(media.where("p_partkey % 4 <> 3").select(F.concat(F.lit("/m/"), k, F.lit("/movie.nfo")).alias("nfo")))
    found = nfo.nfo_candidates(media).join(have, "nfo", "left_semi").groupBy("path").agg(F.min_by("nfo", "ord").alias("nfo"), (F.min("ord") + 1).alias("ord"))
    return found.select(F.regexp_extract("path", r"/m/(\d+)/", 1).alias("path"), "ord", F.when(F.col("nfo").like("%film.nfo"), "own").otherwise("movie").alias("nfo"))


@query("""
WITH w(k, container, score) AS (VALUES (0, 'matroska', 100), (1, 'mp4', 100), (2, 'ogg', 100), (3, 'flac', 100), (4, 'srt', 50), (5, 'vtt', 100), (6, 'ass', 100), (7, NULL, 0), (8, 'mp4', 50), (9, 'matroska', 100))
SELECT p_partkey, container, score FROM part JOIN w ON p_partkey % 10 = k
""")
def q_detect(spark: SparkSession, d: str) -> DataFrame:
    forms = [("x.mkv", "1A45DFA3" + "00" * 12), ("x.mkv", "00000018" + b"ftypisom".hex()), ("x", b"OggS\0\2".hex()), ("x.bin", b"fLaC".hex()), ("x.srt", b"nothing".hex()), ("x.txt", b"WEBVTT\n".hex()), ("x", "EFBBBF" + b"[Script Info]\n".hex()), ("x.bin", b"nothing".hex()), ("x.m4v", ""), ("x.mp4", "1A45DFA3")]
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("head")) for n, h in forms])
    rows = _t(spark, d, "part").select(F.element_at(cells, (F.col("p_partkey") % 10 + 1).cast("int")).alias("c"), "p_partkey")
    rows = rows.select(F.concat(F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/"), "c.name").alias("path"), F.unhex("c.head").alias("head"))
    return detect.detect_sources(rows).select(F.regexp_extract("path", r"^/(\d+)/", 1).cast("long").alias("p_partkey"), "container", "score")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'bmp' END AS kind FROM part")
def q_image_kind(spark: SparkSession, d: str) -> DataFrame:
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("FFD8FFE0", "89504E470D0A1A0A", "474946383961", "424D0000", "00")])
    rows = _t(spark, d, "part").select("p_partkey", F.element_at(heads, (F.col("p_partkey") % 5 + 1).cast("int")).alias("data"))
    return rows.select("p_partkey", detect.image_kind("data").alias("kind"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS base, name, row_number() OVER (PARTITION BY p_partkey ORDER BY name) AS ord FROM part, (VALUES ('film.de.srt'), ('Film.en.srt'), ('film.srt')) n(name) WHERE name <> 'film.de.srt' OR p_size > 20
""")
def q_sidecars(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select(F.concat(F.lit("/m/"), F.col("p_partkey").cast("string"), F.lit("/")).alias("folder"), "p_size")
    names = F.array(*[F.lit(n) for n in ("film.de.srt", "Film.en.srt", "film.srt", "other.srt", "film.mkv")])
    files = p.select("folder", "p_size", F.explode(names).alias("name")).where("name <> 'film.de.srt' or p_size > 20").select(F.concat("folder", "name").alias("path"))
    found = detect.sidecars(files, p.select(F.concat("folder", F.lit("film.mkv")).alias("path")))
    return found.select(F.regexp_extract("base", r"/m/(\d+)/", 1).alias("base"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "ord")


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' END AS language, CASE p_partkey % 3 WHEN 0 THEN 'I see ' || p_name WHEN 1 THEN chr(9834) || ' ' || p_name || ' ' || chr(9834) ELSE 'hello' || chr(10) || p_name END AS ocr FROM part
""")
def q_ocr_clean(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".ENG.forced", "_de", " French", ".1")]), (k % 4 + 1).cast("int"))
    raw = F.when(k % 3 == 0, F.concat(F.lit("| see  "), "p_name", F.lit("\r\n."))).when(k % 3 == 1, F.concat(F.lit("J "), "p_name", F.lit(" I"))).otherwise(F.concat(F.lit("heIlo\n\n "), "p_name"))
    return _t(spark, d, "part").select("p_partkey", text.language_from_name(suffix).alias("language"), text.clean_ocr(raw).alias("ocr"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(n AS BIGINT) AS n, CAST(CASE n WHEN 0 THEN 103 WHEN 1 THEN 101 ELSE 65 END AS INT) AS kind, CAST(CASE n WHEN 2 THEN 1 + octet_length(encode(p_name)) ELSE 3 END AS BIGINT) AS bytes FROM part, (VALUES (0), (1), (2)) v(n)
""")
def q_annexb(spark: SparkSession, d: str) -> DataFrame:
    """Elementary streams of three units (first byte 67, 65 and 41 in hex) behind three- and four-byte start codes."""
    body = F.concat(F.unhex(F.lit("00000001" + "674242" + "000001" + "658080" + "00000001" + "41")), F.encode("p_name", "UTF-8"))
    files = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), body.alias("content"))
    units = containers.scan(files, containers.annexb_units, containers.ANNEXB_SCHEMA)
    first = F.conv(F.hex(containers.payload(F.col("content"), F.col("position"), F.lit(1))), 16, 10).cast("int")
    return units.join(files, "path").select("path", "n", first.alias("kind"), F.col("size").alias("bytes"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    """Parts as samples: the brand is the file, each name a payload."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = _t(spark, d, "part").select(F.concat(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"), F.lit(".mp4")).alias("path"), "p_partkey", "p_size", "p_name", (F.row_number().over(w) - 1).cast("long").alias("n"))
    cells = {"track": F.lit(1).cast("long"), "duration": F.col("p_size").cast("long") + 1, "shift": F.col("p_partkey") % 5 - 2, "sync": F.col("p_partkey") % 3 == 0, "timescale": F.lit(1000).cast("long")}
    return p.withColumns(cells | {"handler": F.lit("vide"), "codec": F.lit("avc1"), "entry": F.lit(b""), "width": F.lit(16), "height": F.lit(16), "payload": F.encode("p_name", "UTF-8")})


_PARTS = """
p AS (SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') || '.mp4' AS path, p_partkey, p_name, CAST(p_size + 1 AS BIGINT) AS duration, CAST(p_partkey % 5 - 2 AS BIGINT) AS shift, p_partkey % 3 = 0 AS sync,
        row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)"""


@query(f"""
WITH {_PARTS} SELECT path, n, duration, CAST(coalesce(sum(duration) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dts, shift, sync, p_name AS name FROM p
""")
def q_mp4_mux(spark: SparkSession, d: str) -> DataFrame:
    """MP4 files written from samples and read again by index and by position."""
    place = new_place(spark, "mp4")
    mp4.written(mp4.mux(_packed(spark, d)), place, tasks=8).write.format("noop").mode("overwrite").save()
    index = ranges.scan_ranges(ranges.file_ranges(ranges.listed(spark, place), tasks=8), ranges.mp4_index, ranges.INDEX_SCHEMA)
    back = ranges.with_payload(mp4.movie_samples(index))
    return back.select(F.regexp_extract("path", r"[^/]*$", 0).alias("path"), "n", "duration", "dts", "shift", "sync", F.decode("payload", "UTF-8").alias("name"))


def _u32(c: Column | int) -> Column:
    """Four big-endian bytes."""
    return F.unhex(F.lpad(F.hex(F.lit(c) if isinstance(c, int) else c), 8, "0"))


def _box(kind: str, *parts: Column) -> Column:
    body = F.concat(*parts)
    return F.concat(_u32(8 + F.octet_length(body)), F.encode(F.lit(kind), "UTF-8"), body)


@query("""
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS f FROM orders),
s AS (SELECT path, k, f, i, CASE WHEN f % 2 = 0 THEN 40 ELSE k % 50 + 1 END AS duration, k % 100 + i AS size FROM o, (VALUES (0), (1), (2)) v(i)),
r AS (SELECT *, 3 * f + i AS n, max(CASE WHEN f % 5 = 4 THEN f END) OVER (PARTITION BY path ORDER BY f, i ROWS UNBOUNDED PRECEDING) AS told FROM s)
SELECT path, n, CAST(size AS BIGINT) AS size, CAST(duration AS BIGINT) AS duration, i = 0 AS sync,
       CAST(CASE WHEN told IS NULL THEN 0 ELSE 100000 * told END + sum(duration) OVER (PARTITION BY path, told ORDER BY n) - duration AS BIGINT) AS dts FROM r
""")
def q_fragmented(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as fragments of three samples: durations of every second from the movie's defaults, the decode time told by every fifth."""
    k, f = F.col("o_orderkey"), F.col("f")
    o = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("path"), "o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("f"))
    even = f % 2 == 0
    tfhd = F.when(even, _box("tfhd", _u32(0x20000), _u32(1))).otherwise(_box("tfhd", _u32(0x20008), _u32(1), _u32(k % 50 + 1)))
    tfdt = F.when(f % 5 == 4, _box("tfdt", _u32(0), _u32(100_000 * f))).otherwise(F.lit(b""))
    trun = _box("trun", _u32(0x205), _u32(3), _u32(0), _u32(0), *[_u32(k % 100 + i) for i in range(3)])
    o = o.select("path", "f", F.concat(tfhd, tfdt, trun).alias("traf")).select("path", "f", _box("traf", F.col("traf")).alias("traf"))
    moofs = o.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("f", _box("moof", F.col("traf")).alias("b")))).alias("b"))
    moov = _box("moov", _box("mvex", _box("trex", _u32(0), _u32(1), _u32(1), _u32(40), _u32(5), _u32(0x10000))))
    files = moofs.select("path", F.concat(_box("ftyp", F.encode(F.lit("iso5"), "UTF-8")), moov, joined_bytes(F.col("b.b"))).alias("content"))
    index = ranges.scan_ranges(ranges.first_ranges(ranges.file_ranges(files, 1 << 20)), ranges.mp4_index, ranges.INDEX_SCHEMA)
    return mp4.fragment_samples(index).select("path", "n", "size", "duration", "sync", "dts")


def _packets(p: DataFrame, pid: Column, pieces: Column) -> Column:
    """Transport packets of the pieces of a payload, each stuffed to 184 bytes by an adaptation field."""
    def one(x: Column, i: Column) -> Column:
        room = 184 - F.octet_length(x)
        stuffing = F.when(room == 0, F.lit(b"")).when(room == 1, F.lit(b"\0")).otherwise(F.concat(F.unhex(F.lpad(F.hex(room - 1), 2, "0")), F.lit(b"\0"), F.unhex(F.repeat(F.lit("FF"), (room - 2).cast("int")))))
        head = F.concat(F.lit(b"\x47"), F.unhex(F.lpad(F.hex(pid + F.when(i == 0, 0x4000).otherwise(0)), 4, "0")), F.unhex(F.lpad(F.hex(F.when(room == 0, 0x10).otherwise(0x30) + i % 16), 2, "0")))
        return F.concat(head, stuffing, x)

    return joined_bytes(F.transform(pieces, one))


def _pieces(data: Column) -> Column:
    n = F.ceil(F.octet_length(data) / 184)
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.substring(data, (i * 184 + 1).cast("int"), F.lit(184)))


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS path, 7 AS program, CAST(512 + i AS INT) AS pid, CAST(CASE i % 3 WHEN 0 THEN 27 WHEN 1 THEN 15 ELSE 6 END AS INT) AS stream_type, CASE WHEN i % 3 = 2 THEN 'eng' END AS language, CAST(s_suppkey % 32 AS INT) AS version
FROM supplier, range(0, 40) r(i)
""")
def q_program_tables(spark: SparkSession, d: str) -> DataFrame:
    """A file a supplier with an association and a map of 40 streams over three packets, before it a damaged copy of another version; the check sums are made by the reader's own CRC."""
    @F.pandas_udf("binary")
    def checked(heads: pd.Series) -> pd.Series:
        return heads.map(bytes) + pd.Series([int(c).to_bytes(4) for c in programs.mpeg_crc32([bytes(h) for h in heads])], index=heads.index)

    def section(table: int, extension: int, version: Column, body: Column) -> Column:
        u16 = lambda c: F.unhex(F.lpad(F.hex(c), 4, "0"))
        return checked(F.concat(F.unhex(F.lpad(F.hex(F.lit(table)), 2, "0")), u16(0xB000 + F.octet_length(body) + 9), u16(F.lit(extension)), F.unhex(F.lpad(F.hex(0xC1 + version * 2), 2, "0")), F.lit(b"\0\0"), body))

    kinds, entries = (0x1B, 0x0F, 0x06), []
    for i in range(40):
        held = b"\x0a\x04eng\0" if i % 3 == 2 else b""
        entries.append(bytes([kinds[i % 3]]) + (0xE200 + i).to_bytes(2) + (0xF000 + len(held)).to_bytes(2) + held)
    streams = F.lit(b"\xe2\x00\xf0\x00" + b"".join(entries))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), (F.col("s_suppkey") % 32).cast("int").alias("v"))
    s = s.withColumns({"pat": section(0, 1, F.lit(0), F.lit(b"\x00\x07\xe1\x00")), "pmt": section(2, 7, F.col("v"), streams), "other": section(2, 7, (F.col("v") + 1) % 32, streams)})
    damaged = F.concat(F.substring(F.col("other"), F.lit(1), F.lit(100)), F.lit(b"\x99\x99\x99"), F.substring(F.col("other"), F.lit(104), F.octet_length("other")))
    parts = [_packets(s, F.lit(pid), _pieces(F.concat(F.lit(b"\0"), c))) for pid, c in ((0, F.col("pat")), (0x100, F.col("pmt")), (0x100, damaged))]
    files = s.select("path", F.concat(*parts).alias("content"))
    packets = ranges.scan_ranges(ranges.file_ranges(files, 500), ranges.ts_packets, ranges.PACKET_SCHEMA)
    return programs.programs(packets).select("path", "program", "pid", "stream_type", "language", "version")


@query("""
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS k, o_orderpriority AS text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT path, i // 4 AS cluster, i % 4 AS block, CAST(k % 7 + 1 AS BIGINT) AS track, CAST(1000 * (i // 4) + k % 100 AS BIGINT) AS time, k % 2 = 0 AS keyframe, text FROM o
""")
def q_matroska_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A film a customer, four frames a cluster, read in ranges of 100 bytes whose borders fall anywhere."""
    k, i = F.col("o_orderkey"), F.col("i")
    byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    sized = lambda c: F.concat(F.unhex(F.concat(F.lit("01"), F.lpad(F.hex(F.octet_length(c)), 14, "0"))), c)
    o = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("path"), "o_orderkey", "o_orderpriority", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("i"))
    body = F.concat(byte(0x80 + k % 7 + 1), F.unhex(F.lpad(F.hex(k % 100), 4, "0")), F.when(k % 2 == 0, F.lit(b"\x80")).otherwise(F.lit(b"\0")), F.encode("o_orderpriority", "UTF-8"))
    join = lambda c: joined_bytes(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["b"]))
    clusters = o.groupBy("path", F.floor(i / 4).alias("c")).agg(join(F.struct("i", F.concat(F.lit(b"\xa3"), sized(body)).alias("b"))).alias("frames"))
    held = F.concat(F.lit(b"\xe7\x84"), _u32(1000 * F.col("c")), "frames")
    films = clusters.groupBy("path").agg(join(F.struct("c", F.concat(F.lit(ranges.CLUSTER), sized(held)).alias("b"))).alias("all"))
    files = films.select("path", F.concat(F.lit(b"\x1a\x45\xdf\xa3\x80\x18\x53\x80\x67\x01" + b"\xff" * 7), "all").alias("content"))
    frames = ranges.scan_ranges(ranges.file_ranges(files, 100), ranges.matroska_frames, ranges.FRAME_SCHEMA)
    nth = F.dense_rank().over(Window.partitionBy("path").orderBy("cluster")) - 1
    named = frames.withColumn("nth", nth).join(files, "path")
    return named.select("path", F.col("nth").cast("long").alias("cluster"), "block", "track", "time", "keyframe", F.decode(containers.payload(F.col("content"), F.col("position"), F.col("size")), "UTF-8").alias("text"))
