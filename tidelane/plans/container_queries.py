"""Queries of codec headers, detectors, chapters, tags, frames and written films, over bytes made from table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions.bits import joined_bytes
from tidelane.operators import headers
from tidelane.plans.queries import _events, _t, query
from tidelane.sources import chapters, containers, elementary, mkv, mp4, ranges, tagbytes
from tidelane.sources.workdir import new_place


def _ue(c: Column) -> Column:
    """An unsigned Exp-Golomb number as text of bits."""
    code = F.bin(c + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(code) - 1), code)


def _unit(bits: Column, head: str) -> Column:
    """A unit's bytes of text of bits: closed by a one, filled up, kept free of start codes."""
    cells = F.transform(F.regexp_extract_all(F.concat(bits, F.lit("10000000")), F.lit("[01]{8}"), F.lit(0)), lambda x: F.lpad(F.conv(x, 2, 16), 2, "0"))
    safe = F.regexp_replace(F.concat(F.array_join(cells, ","), F.lit(",")), "00,00,(?=0[0-3],)", "00,00,03,")
    return F.unhex(F.concat(F.lit(head), F.replace(safe, F.lit(","), F.lit(""))))


@query("""
SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 66 ELSE 100 END AS BIGINT) AS profile, CAST(p_size AS BIGINT) AS level, CAST(16 * p_size AS BIGINT) AS width, CAST(32 * (p_partkey % 70 + 1) - 8 AS BIGINT) AS height,
       CAST(CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 10 END AS BIGINT) AS bit_depth, CAST(2002 AS BIGINT) AS rate_ticks, CAST(p_partkey AS BIGINT) AS rate_scale, CAST(12 AS BIGINT) AS aspect_width, true AS whole FROM part
""")
def q_codec_headers(spark: SparkSession, d: str) -> DataFrame:
    """H.264 parameter sets of interlaced, cropped pictures, in even rows of the baseline and in odd ones of the high profile."""
    k, size, even = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 2 == 0
    u = lambda n, c: F.lpad(F.bin(c), n, "0")
    zero, one = F.lit("0"), F.lit("1")
    high = F.when(even, F.lit("")).otherwise(F.concat(_ue(F.lit(1)), _ue(F.lit(2)), _ue(F.lit(2)), zero, zero))
    bits = F.concat(F.when(even, u(8, F.lit(66))).otherwise(u(8, F.lit(100))), F.lit("00000000"), u(8, size), _ue(F.lit(0)), high, _ue(F.lit(0)), _ue(F.lit(2)), _ue(F.lit(4)), zero, _ue(size - 1), _ue(k % 70), zero, zero, one, one, _ue(F.lit(0)), _ue(F.lit(0)), _ue(F.lit(1)), _ue(F.lit(1)))
    bits = F.concat(bits, one, one, u(8, F.lit(2)), zero, zero, zero, one, u(32, F.lit(1001)), u(32, k))
    units = _t(spark, d, "part").select("p_partkey", bits.alias("bits")).select("p_partkey", F.lit("h264").alias("codec"), _unit(F.col("bits"), "67").alias("data"))
    return headers.codec_headers(units).select("p_partkey", "profile", "level", "width", "height", "bit_depth", "rate_ticks", "rate_scale", "aspect_width", "whole")


@query("""
WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id, coalesce(bool_or(n <= 5 AND event_type = 'click'), false) AS clicked, coalesce(bool_or(n <= 20 AND event_type IN ('error', 'purchase') AND floor(value) % 2 = 1), false) AS odd FROM r WHERE n <= 20 GROUP BY user_id
""")
def q_detect_first(spark: SparkSession, d: str) -> DataFrame:
    """Detectors over a user's first events: a partial aggregate of twenty rows a user, no sort of all."""
    rules = {"clicked": (("click",), 5, lambda data: F.lit(True)), "odd": (("error", "purchase"), 20, lambda data: F.decode(data, "UTF-8").cast("long") % 2 == 1)}
    samples = _t(spark, d, "events").select("user_id", "event_id", "event_type", F.encode(F.floor("value").cast("string"), "UTF-8").alias("data"))
    return headers.detect(samples, ["user_id"], "event_id", codec="event_type", detectors=rules)


@query("""
WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id, event_id, event_type FROM r WHERE n <= 3
""")
def q_first_samples(spark: SparkSession, d: str) -> DataFrame:
    return headers.first_samples(_events(spark, d).select("user_id", "event_id", "event_type"), ["user_id"], "event_id", 3)


def _element(kind: bytes, *parts: Column) -> Column:
    body = F.concat(*parts)
    return F.concat(F.lit(kind), F.unhex(F.concat(F.lit("01"), F.lpad(F.hex(F.octet_length(body)), 14, "0"))), body)


@query("""
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS k, o_orderpriority AS title, o_orderstatus AS inner_title FROM orders),
c AS (SELECT path, k * 1000 AS start_ms, title FROM o UNION ALL SELECT path, k * 1000 + 500, inner_title FROM o WHERE k % 3 > 0 UNION ALL SELECT path, k * 1000 + 200, 'deep' FROM o)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY start_ms) AS seq, start_ms, title FROM c
""")
def q_matroska_chapters(spark: SparkSession, d: str) -> DataFrame:
    """A film a customer: a first edition that does not count, and a default one with atoms three deep, some hidden."""
    k = F.col("o_orderkey").cast("long")
    shown = lambda title: _element(b"\x80", _element(b"\x85", F.encode(title, "UTF-8")))
    start = lambda ms: _element(b"\x91", F.unhex(F.lpad(F.hex(ms * 1_000_000), 16, "0")))
    o = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("path"), "o_orderkey", "o_orderstatus", shown(F.col("o_orderpriority")).alias("shown"), _element(b"\xb6", start(k * 1000 + 200), shown(F.lit("deep"))).alias("deep"))
    o = o.withColumn("inner", _element(b"\xb6", start(k * 1000 + 500), _element(b"\x98", F.when(k % 3 == 0, F.lit(b"\1")).otherwise(F.lit(b"\0"))), shown(F.col("o_orderstatus")), F.col("deep")))
    o = o.groupBy("path").agg(F.collect_list(_element(b"\xb6", start(k * 1000), F.col("shown"), F.col("inner"))).alias("atoms")).select("path", joined_bytes(F.col("atoms")).alias("atoms"))
    o = o.select("path", *[_element(b"\x45\xb9", _element(b"\x45\xdb", F.lit(bytes([n]))), F.col("atoms")).alias(name) for n, name in enumerate(("first", "chosen"))])
    files = o.select("path", F.concat(F.lit(b"\x1a\x45\xdf\xa3\x80\x18\x53\x80\x67\x01" + b"\xff" * 7 + b"\xec\x83abc"), _element(b"\x10\x43\xa7\x70", F.col("first"), F.col("chosen"))).alias("content"))
    return chapters.matroska_chapters(ranges.file_ranges(files, 1 << 20)).select("path", "seq", "start_ms", "title")


@query("""
WITH p AS (SELECT p_brand AS path, p_partkey, CAST(p_size AS BIGINT) AS duration, p_name AS title, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS seq FROM part)
SELECT path, seq, CAST(coalesce(sum(duration * 10) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 250 AS BIGINT) AS start_ms, title FROM p
""")
def q_mp4_chapters(spark: SparkSession, d: str) -> DataFrame:
    """A movie a brand: its first track refers to a text track of the parts' names, which begins with an empty edit."""
    u = lambda n, c: F.unhex(F.lpad(F.hex(F.lit(c) if isinstance(c, int) else c), 2 * n, "0"))
    box = lambda kind, *parts: F.concat(u(4, 8 + F.octet_length(F.concat(*parts))), F.encode(F.lit(kind), "UTF-8"), *parts)
    full = lambda kind, *parts: box(kind, u(4, 0), *parts)
    name = F.encode("p_name", "UTF-8")
    sample = F.concat(u(2, F.octet_length(name)), name)
    p = _t(spark, d, "part").select(F.col("p_brand").alias("path"), "p_partkey", "p_size", sample.alias("b"))
    p = p.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "b", u(4, F.octet_length("b")).alias("s"), F.concat(u(4, 1), u(4, F.col("p_size"))).alias("t")))).alias("rows"))
    p = p.select("path", F.size("rows").alias("n"), *[joined_bytes(F.col(f"rows.{c}")).alias(c) for c in "bst"])
    n = F.col("n")
    p = p.withColumn("table", F.concat(full("stsz", u(4, 0), u(4, n), F.col("s")), full("stts", u(4, n), F.col("t")), full("stsc", u(4, 1), u(4, 1), u(4, n), u(4, 1)), full("stco", u(4, 1), u(4, 24))))
    edit = box("edts", full("elst", u(4, 1), u(4, 150), u(4, 0xFFFFFFFF), u(4, 0x10000)))
    p = p.withColumn("media", F.concat(full("mdhd", u(8, 0), u(4, 100), u(4, 0)), full("hdlr", u(4, 0), F.encode(F.lit("text"), "UTF-8"), u(4, 0)), box("minf", box("stbl", F.col("table")))))
    p = p.withColumn("text", F.concat(full("tkhd", u(8, 0), u(4, 2)), edit, box("mdia", F.col("media"))))
    first = box("trak", full("tkhd", u(8, 0), u(4, 1)), box("tref", box("chap", u(4, 2))))
    p = p.withColumn("movie", F.concat(full("mvhd", u(8, 0), u(4, 600)), first, box("trak", F.col("text"))))
    files = p.select("path", F.concat(box("ftyp", F.encode(F.lit("isom"), "UTF-8"), u(4, 0)), box("mdat", F.col("b")), box("moov", F.col("movie"))).alias("content"))
    index = ranges.scan_ranges(ranges.first_ranges(ranges.file_ranges(files, 1 << 20)), ranges.mp4_index, ranges.INDEX_SCHEMA)
    return chapters.track_chapters(index, files).select("path", "seq", "start_ms", "title")


@query("""
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) || '.mkv' AS path, o_orderkey AS k, o_orderpriority AS text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)
SELECT path, CAST(k % 3 + 1 AS BIGINT) AS track, CAST(n * 1700 AS BIGINT) AS time, k % 2 = 0 AS keyframe, text FROM o
""")
def q_matroska_mux(spark: SparkSession, d: str) -> DataFrame:
    """A film a customer, written with clusters and cues and read again in ranges, payloads by position."""
    k = F.col("o_orderkey")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = _t(spark, d, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit(".mkv")).alias("path"), (k % 3 + 1).cast("long").alias("track"), n.cast("long").alias("n"), (n * 1700).cast("long").alias("time_ms"), (k % 2 == 0).alias("keyframe"), F.encode("o_orderpriority", "UTF-8").alias("payload"))
    kinds = F.element_at(F.array(F.lit("video"), F.lit("audio"), F.lit("subtitle")), F.col("track").cast("int"))
    samples = o.withColumns({"kind": kinds, "codec": F.lit("V_TEST"), "private": F.lit(None).cast("binary"), "width": F.lit(16), "height": F.lit(16), "rate": F.lit(48_000.0), "channels": F.lit(2)})
    place = new_place(spark, "mkv")
    made = new_place(spark, "made")  # the list of files that the writer gives; many small ones are slow to list again
    mp4.written(mkv.mux(samples), place, tasks=8).write.parquet(f"{made}/files")
    files = spark.read.parquet(f"{made}/files").select(F.concat(F.lit(f"{place}/"), "path").alias("path"), F.col("bytes").alias("size"))
    frames = ranges.scan_ranges(ranges.file_ranges(files, 1 << 20, tasks=8), ranges.matroska_frames, ranges.FRAME_SCHEMA)
    return ranges.with_payload(frames).select(F.regexp_extract("path", r"[^/]*$", 0).alias("path"), "track", "time", "keyframe", F.decode("payload", "UTF-8").alias("text"))


@query("""
SELECT p_brand AS path, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS BIGINT) AS pos, CASE WHEN p_partkey % 3 = 0 THEN '----:com.example:' || p_type ELSE chr(169) || 'nam' END AS name, p_name AS value FROM part
""")
def q_tag_items(spark: SparkSession, d: str) -> DataFrame:
    """Item lists written from rows and read again."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("----:com.example:"), "p_type")).otherwise(F.lit("©nam"))
    items = _t(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").cast("long").alias("pos"), name.alias("name"), F.lit(1).alias("kind"), F.encode("p_name", "UTF-8").alias("value"))
    return tagbytes.read_items(tagbytes.write_items(items)).select("path", "pos", "name", F.decode("value", "UTF-8").alias("value"))


@query("SELECT p_brand AS path, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS BIGINT) AS pos, upper(p_type) AS name, p_name || '=1' AS value FROM part")
def q_vorbis_blocks(spark: SparkSession, d: str) -> DataFrame:
    tags = _t(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").cast("long").alias("pos"), F.lower("p_type").alias("name"), F.concat("p_name", F.lit("=1")).alias("value"))
    return tagbytes.read_comments(tagbytes.write_comments(tags)).select("path", "pos", "name", "value")


@query("SELECT p_brand AS path, CASE WHEN p_partkey % 2 = 0 THEN 50 ELSE 30 END AS level, CASE WHEN p_partkey % 2 = 1 THEN CAST(p_size % 5 AS BIGINT) END AS track_uid, p_type AS name, p_name AS value, 'und' AS language FROM part")
def q_matroska_tags(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("p_partkey") % 2 == 1
    tags = _t(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").cast("long").alias("pos"), F.when(odd, 30).otherwise(50).alias("level"), F.when(odd, (F.col("p_size") % 5).cast("long")).alias("track_uid"), F.col("p_type").alias("name"), F.col("p_name").alias("value"), F.lit(None).cast("string").alias("language"))
    return tagbytes.read_matroska_tags(tagbytes.write_matroska_tags(tags)).select("path", "level", "track_uid", "name", "value", "language")


@query("""
WITH p AS (SELECT p_brand AS path, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS n, CAST(96 + k % 300 AS INT) AS size, CAST(512 AS INT) AS samples, CAST(CASE WHEN k % 2 = 0 THEN 48000 ELSE 44100 END AS INT) AS rate FROM p
""")
def q_dts_frames(spark: SparkSession, d: str) -> DataFrame:
    """A stream a brand with a false sync word in each frame's payload."""
    k = F.col("p_partkey")
    size = 96 + k % 300
    bits = F.lit((1 << 47) | (31 << 42) | (15 << 34)) + (size - 1) * (1 << 20) + F.when(k % 2 == 0, 13 << 10).otherwise(8 << 10)
    frame = F.concat(F.lit(elementary.DTS_SYNC), F.unhex(F.lpad(F.hex(bits.cast("long")), 12, "0")), F.lit(elementary.DTS_SYNC), F.unhex(F.repeat(F.lit("55"), (size - 14).cast("int"))))
    streams = _t(spark, d, "part").groupBy(F.col("p_brand").alias("path")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", frame.alias("b")))).alias("rows"))
    files = streams.select("path", F.concat(F.lit(b"\x7f\xfe\x80\x01"), joined_bytes(F.col("rows.b"))).alias("content"))
    return containers.scan(files, elementary.dts_frames, elementary.DTS_SCHEMA).select("path", "n", "size", "samples", "rate")


@query("""
SELECT p_brand AS path, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n, CAST(CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 6 END AS INT) AS kind, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE CAST(octet_length(encode(p_name)) * (p_partkey % 9) AS BIGINT) END AS size FROM part
""")
def q_av1_units(spark: SparkSession, d: str) -> DataFrame:
    """A stream a brand: delimiters and frames with sizes of one to three bytes."""
    k = F.col("p_partkey")
    hex2 = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    body = F.when(k % 4 == 0, F.lit("")).otherwise(F.repeat("p_name", (k % 9).cast("int")))
    n = F.octet_length(body)
    size = F.when(n < 128, hex2(n)).when(n < 1 << 14, F.concat(hex2(128 + n % 128), hex2(F.floor(n / 128)))).otherwise(F.concat(hex2(128 + n % 128), hex2(128 + F.floor(n / 128) % 128), hex2(F.floor(n / (1 << 14)))))
    unit = F.concat(F.when(k % 4 == 0, F.lit(b"\x12")).otherwise(F.lit(b"\x32")), F.unhex(size), F.encode(body, "UTF-8"))
    streams = _t(spark, d, "part").groupBy(F.col("p_brand").alias("path")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", unit.alias("b")))).alias("rows"))
    files = streams.select("path", joined_bytes(F.col("rows.b")).alias("content"))
    return containers.scan(files, elementary.obu_units, elementary.OBU_SCHEMA).select("path", "n", "kind", "size")


@query("""
WITH p AS (SELECT p_brand AS track, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part),
u AS (SELECT track, k, n, i, CASE WHEN i = 0 THEN 10 + 2 * (k % 30) ELSE 8 END AS size, i = 0 AND k % 4 = 0 AS sync FROM p, (VALUES (0), (1)) v(i)),
f AS (SELECT *, min(CASE WHEN sync THEN n END) OVER (PARTITION BY track) AS first FROM u)
SELECT track, 2 * (n - first) + i AS unit, CAST(size AS BIGINT) AS size, sync, CAST(first * 1920 + (2 * (n - first) + i) * 40 AS BIGINT) AS dts FROM f WHERE n >= first
""")
def q_truehd_units(spark: SparkSession, d: str) -> DataFrame:
    """A track a brand, blocks of two access units; one block in four begins with a major sync, and those before the first go."""
    k = F.col("p_partkey")
    size = 10 + 2 * (k % 30)
    head = F.concat(F.unhex(F.lpad(F.hex((0x4000 + size / 2).cast("long")), 4, "0")), F.lit(b"\0\0"))
    first = F.when(k % 4 == 0, F.concat(head, F.lit(headers.MAJOR_SYNC + b"\0"), F.unhex(F.repeat(F.lit("00"), (size - 9).cast("int"))))).otherwise(F.concat(head, F.unhex(F.repeat(F.lit("11"), (size - 4).cast("int")))))
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    blocks = _t(spark, d, "part").select(F.col("p_brand").alias("track"), n.cast("long").alias("n"), (n * 40).cast("long").alias("pts"), F.concat(first, F.lit(b"\x40\x04\0\0abcd")).alias("data"))
    return headers.truehd_units(blocks, ["track"], "n", "pts", 1000).select("track", "unit", "size", "sync", "dts")
