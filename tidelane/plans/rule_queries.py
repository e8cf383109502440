"""Queries of the track, tag and search rules over the driver's tables, beside their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions import audio
from tidelane.operators import edits, joins, media, rules, search, stateful, tags, timeline, tracks
from tidelane.plans.queries import _events, _t, query

#: Orders stand in for tracks: their customer is the file.
_TRACKS = """
t AS (SELECT o_custkey AS file, o_orderkey AS track_id, o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' WHEN 2 THEN 'subtitle' ELSE 'chapters' END AS kind,
        CASE o_orderstatus WHEN 'F' THEN 'skip' WHEN 'O' THEN 'convert' END AS action FROM orders)"""


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("video", "audio", "subtitle", "chapters")])
    kind = F.element_at(kinds, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("kind")
    action = F.when(F.col("o_orderstatus") == "F", "skip").when(F.col("o_orderstatus") == "O", "convert").alias("action")
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("track_id"), F.col("o_orderkey").alias("pos"), kind, action)


@query(f"WITH {_TRACKS} SELECT track_id, kind FROM t WHERE kind IN ('video', 'audio', 'subtitle') AND (action IS NULL OR action <> 'skip')")
def q_track_select(spark: SparkSession, d: str) -> DataFrame:
    return tracks.selected_tracks(_tracks(spark, d)).select("track_id", "kind")


@query(f"WITH {_TRACKS} SELECT track_id FROM t WHERE kind = 'video' OR kind = 'audio'")
def q_of_kind(spark: SparkSession, d: str) -> DataFrame:
    return tracks.of_kind(_tracks(spark, d), "video", "audio").select("track_id")


@query(f"""WITH {_TRACKS}
SELECT 'only' AS mode, track_id FROM t WHERE kind = 'audio' AND action IS DISTINCT FROM 'skip'
UNION ALL SELECT 'ids', track_id FROM t WHERE track_id = 2 OR track_id BETWEEN 5 AND 9 UNION ALL SELECT 'all', track_id FROM t WHERE action IS DISTINCT FROM 'skip'
""")
def q_only_kind(spark: SparkSession, d: str) -> DataFrame:
    t = _tracks(spark, d)
    modes = {"only": tracks.picked_tracks(t, "track_id", only="Audio"), "ids": tracks.picked_tracks(t, "track_id", "2,5-9", "audio"), "all": tracks.picked_tracks(t, "track_id")}
    only, ids, every = (df.select(F.lit(m).alias("mode"), "track_id") for m, df in modes.items())
    return only.unionByName(ids).unionByName(every)


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30)")
def q_with_samples(spark: SparkSession, d: str) -> DataFrame:
    samples = _t(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return tracks.with_samples(_t(spark, d, "orders").select("o_orderkey"), samples, ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) + CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey AS BIGINT) ELSE 0 END AS pts FROM lineitem")
def q_presentation_time(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("dts"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).alias("cts"))
    return tracks.presentation_time(x).select("l_orderkey", "l_linenumber", "pts")


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS cll, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 END AS fall, CASE WHEN p_partkey % 5 = 0 THEN p_size + 2 END AS lum, p_partkey % 7 AS k FROM part)
SELECT p_partkey, CASE WHEN k = 0 OR (cll IS NULL AND fall IS NULL) THEN 100 ELSE cll END AS max_cll, CASE WHEN k = 0 OR (cll IS NULL AND fall IS NULL) THEN NULL ELSE fall END AS max_fall, CASE WHEN k = 0 OR lum IS NULL THEN 200 ELSE lum END AS max_luminance FROM p
""")
def q_hdr_merge(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    own = F.struct(F.when(k % 2 == 0, size).alias("max_cll"), F.when(k % 3 == 0, size + 1).alias("max_fall"), F.when(k % 5 == 0, size + 2).alias("max_luminance"))
    stream = F.struct(F.lit(100).alias("max_cll"), F.lit(None).cast("int").alias("max_fall"), F.lit(200).alias("max_luminance"))
    p = _t(spark, d, "part").select("p_partkey", F.when(k % 7 != 0, own).alias("c"), stream.alias("s"))
    level = lambda x: F.col(f"{x}.max_cll").isNotNull() | F.col(f"{x}.max_fall").isNotNull()
    lum = lambda x: F.col(f"{x}.max_luminance").isNotNull()
    merged = tracks.merged_hdr("c", "s", {"light": (["max_cll", "max_fall"], level("c"), level("s")), "display": (["max_luminance"], lum("c"), lum("s"))})
    return p.select("p_partkey", merged.alias("m")).select("p_partkey", "m.*")


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, arg_min(l_suppkey, l_partkey * 100000 + l_suppkey) AS codec FROM lineitem WHERE l_quantity > 25 GROUP BY ALL)
SELECT DISTINCT l_orderkey, l_linenumber, codec FROM lineitem LEFT JOIN f USING (l_orderkey, l_linenumber)
""")
def q_track_lookup(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "lineitem")
    demuxed = x.where("l_quantity > 25").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("codec"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("ord"))
    return tracks.source_tracks(x.select("l_orderkey", "l_linenumber").distinct(), demuxed, ["l_orderkey", "l_linenumber"], "ord").select("l_orderkey", "l_linenumber", "codec")


@query("""
WITH a AS (SELECT o_custkey AS file, o_orderkey AS pos, 'old' AS format, CAST(o_orderkey AS BIGINT) AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
b AS (SELECT o_custkey AS file, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS format, CAST(o_orderkey % 5 AS BIGINT) AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F')
SELECT a.file, a.pos, CASE WHEN b.format = '' THEN a.format ELSE b.format END AS format, CASE WHEN b.id = 0 THEN a.id ELSE b.id END AS id FROM a JOIN b USING (file, n)
""")
def q_adoption(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").withColumns({"file": F.col("o_custkey"), "pos": F.col("o_orderkey")})
    written = o.select("file", "pos", F.lit("old").alias("format"), F.col("o_orderkey").alias("id"))
    saved = o.where("o_orderstatus = 'F'").select("file", "pos", F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderpriority")).alias("format"), (F.col("o_orderkey") % 5).alias("id"))
    return tracks.adopted_tracks(written, saved, ["file"], ["format", "id"])


@query("""
WITH t AS (SELECT o_custkey AS file, o_orderkey AS track_id, CASE WHEN o_orderkey % 4 = 0 THEN 'video' ELSE 'audio' END AS kind, o_orderkey % 40 - 20 AS first_pts, o_orderkey % 7 AS "offset", CAST(floor(o_totalprice) AS BIGINT) AS dur FROM orders),
s AS (SELECT file, greatest(0, max(CASE WHEN kind = 'video' THEN -(first_pts + "offset") ELSE 0 END)) AS shift, max(dur + "offset") AS total FROM t GROUP BY file)
SELECT t.file, track_id, CAST(shift AS BIGINT) AS shift, CAST("offset" + shift AS BIGINT) AS new_offset, CAST(total AS BIGINT) AS total FROM t JOIN s ON t.file = s.file
""")
def q_timeline_shift(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = _t(spark, d, "orders").select(F.col("o_custkey").alias("file"), k.alias("track_id"), F.when(k % 4 == 0, "video").otherwise("audio").alias("kind"), (k % 40 - 20).alias("first_pts"), (k % 7).alias("offset"), F.floor("o_totalprice").alias("dur"))
    total = tracks.total_duration(t, ["file"], "dur", "offset")
    return tracks.preroll_shift(t, ["file"], "first_pts").join(total, "file").select("file", "track_id", "shift", F.col("offset").alias("new_offset"), "total")


@query("""
SELECT p_partkey, '/in/' || p_brand || '/' || p_partkey || '.final.m4v' AS beside, '/out/' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_partkey || '.final' END || '.mp4' AS moved FROM part
""")
def q_destinations(spark: SparkSession, d: str) -> DataFrame:
    source = F.concat(F.lit("/in/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".final.m4v"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))
    return _t(spark, d, "part").select("p_partkey", tracks.destination(source).alias("beside"), tracks.destination(source, name, "/out/", ".mp4").alias("moved"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O') AS failed FROM orders GROUP BY o_custkey")
def q_queue_totals(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Failed").otherwise("Ready")
    return tracks.queue_totals(_t(spark, d, "orders").select("o_custkey", status.alias("status")), ["o_custkey"])


@query(f"WITH {_TRACKS} SELECT track_id, CASE WHEN kind = 'video' THEN 9 ELSE CAST(track_id % 10 AS INT) END AS primaries, track_id % 2 = 0 AS full_range FROM t")
def q_color_space(spark: SparkSession, d: str) -> DataFrame:
    color = F.struct((F.col("track_id") % 10).cast("int").alias("primaries"), (F.col("track_id") % 2 == 0).alias("full_range"))
    done = tracks.apply_color(_tracks(spark, d).withColumn("color", color), F.struct(F.lit(9).alias("primaries"), F.lit(None).cast("boolean").alias("full_range")))
    return done.select("track_id", "color.primaries", "color.full_range")


@query("""
WITH s(codec, level, suggested) AS (VALUES ('c0', 'passthrough', 'passthrough'), ('c1', 'converted', 'tx3g'), ('c2', 'passthrough', 'passthrough'))
SELECT p_partkey, coalesce(level, 'unsupported') AS level, coalesce(suggested, 'skip') AS suggested FROM part LEFT JOIN s ON codec = 'c' || p_size % 5 AND p_brand <> 'Brand#13'
""")
def q_support(spark: SparkSession, d: str) -> DataFrame:
    support = spark.createDataFrame([("c0", "mp4", "passthrough", "passthrough"), ("c1", "mp4", "converted", "tx3g"), ("c2", "mp4", "passthrough", "passthrough"), ("c3", "matroska", "passthrough", "passthrough")], "codec string, target string, level string, suggested string")
    p = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("c"), (F.col("p_size") % 5).cast("string")).alias("codec"), F.when(F.col("p_brand") == "Brand#13", "ogg").otherwise("mp4").alias("target"))
    return tracks.supported_actions(p, support).select("p_partkey", "level", "suggested")


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'aac' WHEN 1 THEN 'ac3' WHEN 2 THEN NULL ELSE 'passthrough' END AS action, o_orderkey % 3 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'tx3g' ELSE 'aac' END AS recommended FROM t
WHERE (k = 0 AND coalesce(action, '') NOT IN ('tx3g', 'ac3')) OR (k = 1 AND action IN ('ac3'))
""")
def q_container_switch(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = _t(spark, d, "orders").select("o_orderkey", F.when(k % 4 == 0, "aac").when(k % 4 == 1, "ac3").when(k % 4 == 3, "passthrough").alias("action"))
    offers = F.when(k % 3 == 0, F.array(*[F.struct(F.lit(a).alias("action"), F.lit(i).alias("ord"), F.lit("unsupported").alias("level")) for i, a in enumerate(["tx3g", "ac3"])]))
    offers = offers.when(k % 3 == 1, F.array(*[F.struct(F.lit(a).alias("action"), F.lit(i).alias("ord"), F.lit("passthrough").alias("level")) for i, a in enumerate(["aac", "skip"])]))
    choices = t.select("o_orderkey", F.explode(offers).alias("c")).select("o_orderkey", "c.*")
    return tracks.container_switch(t, choices, ["o_orderkey"]).select("o_orderkey", "recommended")


@query("""
WITH t AS (SELECT o_custkey, o_orderkey AS pos, 0 AS copy, o_orderkey AS track_id, TRUE AS enabled FROM orders UNION ALL SELECT o_custkey, o_orderkey, 1, 0, FALSE FROM orders WHERE o_orderkey % 4 = 2 AND o_orderstatus = 'F' AND o_totalprice > 50000)
SELECT o_custkey, pos, track_id, enabled, row_number() OVER (PARTITION BY o_custkey ORDER BY pos, copy) AS new_pos FROM t
""")
def q_duplicate_track(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = _t(spark, d, "orders").select("o_custkey", k.alias("pos"), k.alias("track_id"), F.when(k % 4 == 2, "subtitle").otherwise("audio").alias("kind"), F.when(F.col("o_totalprice") > 50000, "x.mkv").alias("source"), F.lit(True).alias("enabled"), F.lit(True).alias("is_default"), "o_orderstatus")
    return tracks.duplicate_tracks(t, ["o_custkey"], F.col("o_orderstatus") == "F").select("o_custkey", "pos", "track_id", "enabled", "new_pos")


@query("""
WITH e AS (SELECT user_id, event_id, event_id // 20 AS cluster, CASE event_id % 3 WHEN 0 THEN CASE WHEN user_id % 2 = 0 THEN 'video' ELSE 'subtitle' END ELSE 'audio' END AS kind, event_id % 3 AS track, value > 20 AS sync FROM events),
r AS (SELECT *, CASE kind WHEN 'video' THEN 0 WHEN 'audio' THEN 10 ELSE 20 END + track AS k FROM e), m AS (SELECT *, min(k) OVER (PARTITION BY user_id) AS best FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, cluster ORDER BY event_id) AS n FROM m WHERE k = best AND sync)
SELECT user_id, event_id FROM n WHERE kind = 'video' OR n = 1
""")
def q_seek_points(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    kind = F.when(F.col("event_id") % 3 != 0, "audio").when(F.col("user_id") % 2 == 0, "video").otherwise("subtitle")
    blocks = e.select("user_id", F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 20).alias("cluster"), kind.alias("kind"), (F.col("event_id") % 3).alias("track"), (F.col("value") > 20).alias("sync"))
    return tracks.seek_points(blocks, ["user_id"]).select("user_id", F.col("seq").alias("event_id"))


@query("SELECT p_brand, CAST(sum(p_partkey % 9) AS BIGINT) AS samples, CAST(sum((p_partkey % 9) * CASE WHEN p_size > 25 THEN 512 ELSE p_size END) AS BIGINT) AS bytes FROM part GROUP BY p_brand")
def q_table_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = _t(spark, d, "part").select("p_brand", (F.col("p_partkey") % 9).alias("n"), F.col("p_size").cast("long").alias("size"), F.when(F.col("p_size") > 25, 512).otherwise(0).cast("long").alias("fixed"))
    return tracks.table_summary(runs, ["p_brand"], "n", "size", "fixed")


@query("""
WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 2 WHEN 'error' THEN 0 ELSE 1 END AS pictures, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events)
SELECT user_id, event_id, 0 AS part, event_id AS slot FROM e WHERE pictures > 0 UNION ALL SELECT user_id, event_id, 1, nxt FROM e WHERE pictures = 2
""")
def q_packed_pictures(spark: SparkSession, d: str) -> DataFrame:
    pictures = F.when(F.col("event_type") == "view", 2).when(F.col("event_type") == "error", 0).otherwise(1)
    return tracks.unpacked_pictures(_t(spark, d, "events").select("user_id", "event_id", pictures.alias("pictures")), ["user_id"], "event_id").select("user_id", "event_id", "part", "slot")


@query("""
WITH RECURSIVE e AS (SELECT event_type, event_id, event_id * 480 + (event_id * 7919) % 2400 AS dts, CAST(1024 AS BIGINT) AS frames, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS i, user_id FROM events),
r AS (SELECT user_id, event_type, event_id, i, dts AS snapped, frames FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.i, CASE WHEN abs(e.dts - r.snapped - r.frames) <= 48000 // 50 THEN r.snapped + r.frames ELSE e.dts END, e.frames FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.i = r.i + 1)
SELECT event_id, snapped FROM r
""")
def q_pcm_snap(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("user_id", "event_type", "event_id", (F.col("event_id") * 480 + F.col("event_id") * 7919 % 2400).alias("dts"), F.lit(1024).cast("long").alias("frames"))
    return stateful.snap_contiguous(e, ["user_id", "event_type"], ["event_id"], "dts", "frames", 48000 // 50).select("event_id", "snapped")


@query("""
SELECT l_orderkey, CASE WHEN count(DISTINCT l_linenumber) > 1 THEN 'VBR ' || CAST(CAST(round_even(avg(l_linenumber), 0) AS BIGINT) AS VARCHAR) ELSE 'CBR ' || CAST(min(l_linenumber) AS VARCHAR) END || ' kbps' AS mode,
       coalesce(avg(CASE WHEN l_quantity > 25 THEN l_discount END), 0.0::DOUBLE) AS confidence FROM lineitem GROUP BY l_orderkey
""")
def q_rate_mode(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "lineitem")
    return x.groupBy("l_orderkey").agg(audio.rate_mode(F.col("l_linenumber"), F.struct("l_partkey", "l_suppkey")).alias("mode"), audio.mean_confidence(F.when(F.col("l_quantity") > 25, F.col("l_discount"))).alias("confidence"))


@query("""
WITH p AS (SELECT p_partkey, p_size % 10 AS ch, CAST(CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 32000 WHEN 2 THEN 44100 WHEN 3 THEN 88200 WHEN 4 THEN 96000 ELSE 22050 END AS INT) AS rate, p_partkey % 40 AS bits FROM part)
SELECT p_partkey, CASE WHEN ch = 1 THEN 1 WHEN ch = 2 THEN 2 WHEN ch <= 0 THEN 2 WHEN ch > 8 THEN 8 ELSE ch END AS multi, CASE WHEN ch = 1 THEN 1 ELSE 2 END AS prologic, CASE WHEN ch <= 0 THEN 2 WHEN ch > 6 THEN 6 ELSE ch END AS ac3,
       CASE WHEN ch >= 5 THEN 640 WHEN ch >= 3 THEN 448 WHEN ch = 2 THEN 192 ELSE 96 END AS kbps, CASE rate WHEN 0 THEN 48000 WHEN 88200 THEN 44100 WHEN 96000 THEN 48000 ELSE rate END AS aac_rate,
       CASE rate WHEN 32000 THEN 32000 WHEN 44100 THEN 44100 WHEN 88200 THEN 44100 ELSE 48000 END AS ac3_rate, CASE WHEN bits = 0 THEN 24 WHEN bits <= 16 THEN 16 WHEN bits <= 24 THEN 24 ELSE 32 END AS bits FROM p
""")
def q_audio_predict(spark: SparkSession, d: str) -> DataFrame:
    rates = F.array(*[F.lit(x) for x in (0, 32000, 44100, 88200, 96000, 22050)])
    ch, rate = F.col("p_size") % 10, F.element_at(rates, (F.col("p_partkey") % 6 + 1).cast("int"))
    return _t(spark, d, "part").select("p_partkey", audio.aac_channels("multichannel", ch).alias("multi"), audio.aac_channels("prologic2", ch).alias("prologic"), audio.ac3_channels(ch).alias("ac3"), audio.ac3_bitrate(ch).alias("kbps"), audio.aac_rate(rate).alias("aac_rate"), audio.ac3_rate(rate).alias("ac3_rate"), audio.lossless_bits(F.col("p_partkey") % 40).alias("bits"))


@query("SELECT user_id, CAST(bit_or(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 ELSE 0 END) AS INT) AS style, CAST(sum(CAST(length(props) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY user_id")
def q_style_fold(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 4).otherwise(0)
    g = _t(spark, d, "events").groupBy("user_id").agg(F.collect_list(flag).alias("runs"), F.sum(F.length("props").cast("long")).alias("bytes"))
    return g.select("user_id", F.aggregate("runs", F.lit(0), lambda a, x: a.bitwiseOR(x)).alias("style"), "bytes")


_CATALOG = [("Title", 1, "main"), ("Artist", 2, "main"), ("Genre", 3, "main"), ("Show", 4, "tv"), ("Season", 5, "tv")]
_TAGS = """
c(name, ord, editor_group) AS (VALUES ('Title', 1, 'main'), ('Artist', 2, 'main'), ('Genre', 3, 'main'), ('Show', 4, 'tv'), ('Season', 5, 'tv')),
g AS (SELECT DISTINCT o_custkey AS file, CASE o_orderkey % 6 WHEN 0 THEN 'Title' WHEN 1 THEN 'Artist' WHEN 2 THEN 'Genre' WHEN 3 THEN 'Show' WHEN 4 THEN 'Season' ELSE 'X-Own' END AS name FROM orders)"""


def _file_tags(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("Title", "Artist", "Genre", "Show", "Season", "X-Own")])
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("name")).distinct()


def _catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CATALOG, "name string, ord int, editor_group string")


@query(f"WITH {_TAGS} SELECT file, string_agg(g.name, ',' ORDER BY coalesce(ord, 99), g.name) AS tags FROM g LEFT JOIN c USING (name) GROUP BY file")
def q_catalog_order(spark: SparkSession, d: str) -> DataFrame:
    return tags.in_catalog_order(_file_tags(spark, d), _catalog(spark), ["file"]).select("file", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_TAGS} SELECT file, editor_group, string_agg(g.name, ',' ORDER BY ord) AS tags FROM g JOIN c USING (name) GROUP BY file, editor_group")
def q_tag_groups(spark: SparkSession, d: str) -> DataFrame:
    return tags.by_editor_group(_file_tags(spark, d), _catalog(spark), ["file"]).select("file", "editor_group", F.array_join("tags", ",").alias("tags"))


@query("""
WITH want(k, value) AS (VALUES (0, 'a, b'), (1, 'Yes'), (2, 'No'), (3, NULL), (4, '12'), (5, NULL), (6, '3/10'), (7, '3'), (8, NULL), (9, ' kept '), (10, NULL), (11, '7'))
SELECT o_orderkey, value FROM orders JOIN want ON o_orderkey % 12 = k
""")
def q_tag_values(spark: SparkSession, d: str) -> DataFrame:
    forms = [("list", " a ,, b"), ("bool", "on"), ("bool", "FALSE"), ("bool", "maybe"), ("integer", " 12 "), ("integer", "twelve"), ("pair", "3 / 10"), ("pair", "3/"), ("pair", "x/2"), ("string", " kept "), ("text", ""), ("pair", " 7 ")]
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t in forms])
    rows = _t(spark, d, "orders").select("o_orderkey", F.element_at(cells, (F.col("o_orderkey") % 12 + 1).cast("int")).alias("c"))
    return rows.select("o_orderkey", tags.tag_value(F.col("c.kind"), F.col("c.text")).alias("value"))


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS file FROM orders), old AS (SELECT file, 'Genre' AS name, 'old' AS value FROM o WHERE file % 2 = 0 UNION ALL SELECT file, 'Show', 'kept' FROM o),
p(name, value) AS (VALUES ('Genre', 'Drama'), ('Artist', 'Tide'))
SELECT file, name, value FROM old WHERE name = 'Show' UNION ALL SELECT file, name, coalesce(CASE WHEN name = 'Genre' AND file % 2 = 0 THEN 'old' END, value) FROM o, p
""")
def q_preset(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("file")).distinct()
    old = o.where("file % 2 = 0").select("file", F.lit("Genre").alias("name"), F.lit("old").alias("value")).unionByName(o.select("file", F.lit("Show").alias("name"), F.lit("kept").alias("value")))
    preset = spark.createDataFrame([("Genre", "Drama"), ("Artist", "Tide"), ("Season", None)], "name string, value string")
    return tags.apply_preset(old, preset, o, ["file"], overwrite=False)


@query("""
WITH p AS (SELECT o_custkey AS file, o_orderkey AS ord, o_orderkey % 5 AS type, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 10 END AS bytes FROM orders)
SELECT file, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY CASE WHEN type = 3 THEN 0 ELSE 1 END, ord) AS pictures FROM p WHERE bytes > 0 GROUP BY file
""")
def q_cover_first(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = _t(spark, d, "orders").select(F.col("o_custkey").alias("file"), k.alias("ord"), (k % 5).alias("type"), F.when(k % 7 == 0, 0).otherwise(10).alias("bytes"), k.cast("string").alias("picture"))
    return tags.front_covers_first(p, ["file"]).select("file", F.array_join("pictures", ",").alias("pictures"))


@query("""
WITH c AS (SELECT o_custkey AS file, o_orderkey AS ord, CASE o_orderkey % 4 WHEN 0 THEN 'Artist' WHEN 1 THEN 'Artist' WHEN 2 THEN 'X_OWN' END AS name, CASE WHEN o_orderkey % 4 = 2 THEN 'a=b' ELSE o_orderpriority END AS value FROM orders)
SELECT file, name, string_agg(value, ', ' ORDER BY ord) AS value FROM c WHERE name IS NOT NULL GROUP BY file, name
""")
def q_vorbis_tags(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    comment = F.when(k % 4 == 0, F.concat(F.lit("ARTIST="), p)).when(k % 4 == 1, F.concat(F.lit("performer="), p)).when(k % 4 == 2, F.lit("x_own=a=b")).otherwise(F.lit("=no key"))
    fields = spark.createDataFrame([("artist", "Artist"), ("Performer", "Artist")], "field string, tag string")
    return tags.vorbis_comments(_t(spark, d, "orders").select(F.col("o_custkey").alias("file"), k.alias("ord"), comment.alias("comment")), fields, ["file"])


@query(f"""
WITH {_TAGS}, r(name, atom, pos) AS (VALUES ('Title', '(c)nam', 1), ('Genre', '(c)gen', 2), ('Season', 'tvsn', 3))
SELECT file, string_agg(coalesce(atom, '----:' || g.name) || '=' || lower(g.name), chr(10) ORDER BY coalesce(pos, 99), coalesce(atom, '----:' || g.name)) AS atoms FROM g LEFT JOIN r USING (name) GROUP BY file
""")
def q_item_list(spark: SparkSession, d: str) -> DataFrame:
    r = spark.createDataFrame([("Title", "(c)nam", 1), ("Genre", "(c)gen", 2), ("Season", "tvsn", 3)], "tag string, atom string, ord int")
    return tags.item_list(_file_tags(spark, d).withColumn("value", F.lower("name")), r, ["file"])


@query(f"""
WITH {_TAGS}, r(name, level, element) AS (VALUES ('Show', 70, 'TITLE'), ('Season', 60, 'PART_NUMBER'), ('Title', 50, 'TITLE'))
SELECT file, coalesce(level, 50) AS level, string_agg(coalesce(element, g.name) || '=' || lower(g.name), ';' ORDER BY coalesce(element, g.name)) AS simple_tags FROM g LEFT JOIN r USING (name) GROUP BY ALL
""")
def q_tag_levels(spark: SparkSession, d: str) -> DataFrame:
    r = spark.createDataFrame([("Show", 70, "TITLE"), ("Season", 60, "PART_NUMBER"), ("Title", 50, "TITLE")], "tag string, level int, element string")
    return tags.tags_by_level(_file_tags(spark, d).withColumn("value", F.lower("name")), r, ["file"])


@query("""
WITH a AS (SELECT o_custkey, o_orderkey, year(o_orderdate) = 1995 AS strict FROM orders), b AS (SELECT *, max(CAST(strict AS INT)) OVER (PARTITION BY o_custkey) AS any_strict FROM a)
SELECT o_custkey, o_orderkey FROM b WHERE strict OR any_strict = 0
""")
def q_retry_search(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    return search.first_pass([o.where("y = 1995").drop("y"), o.drop("y")], ["o_custkey"])


@query("""
WITH p AS (SELECT p_brand AS kind, p_partkey AS ord, p_size > 30 AS configured, p_partkey % 11 = 3 AS preferred FROM part)
SELECT kind, arg_min(ord, CASE WHEN preferred AND configured THEN 0 WHEN configured THEN 100000 WHEN preferred THEN 200000 ELSE 300000 END * 1000 + ord) AS provider FROM p GROUP BY kind
""")
def q_default_provider(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("ord"), (F.col("p_size") > 30).alias("configured"))
    return search.default_provider(p, ["kind"], F.col("ord") % 11 == 3).select("kind", F.col("ord").alias("provider"))


@query("""
WITH x AS (SELECT o_custkey AS q, l_orderkey AS no, l_linenumber - 1 AS season, l_partkey AS episode FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT q, no, season, episode, row_number() OVER (PARTITION BY q ORDER BY no, season, episode) AS place FROM x WHERE season > 0)
SELECT * FROM r WHERE place <= 7
""")
def q_episodes(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("show"), (F.col("l_linenumber") - 1).alias("season"), F.col("l_partkey").alias("episode")).distinct()
    shows = _t(spark, d, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("show"), F.col("o_orderkey").alias("show_ord"))
    return search.capped_episodes(shows, x.select("show", "season").distinct(), x, ["q"], 7).select("q", F.col("show").alias("no"), "season", "episode", "place")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 6 AS type, o_orderpriority AS cert FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 <> 0)
SELECT o_custkey, arg_min(cert, CASE type WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE 2 END * 1000000000000 + o_orderkey) AS cert FROM r GROUP BY o_custkey
""")
def q_release_dates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = _t(spark, d, "orders").select("o_custkey", k.alias("ord"), (k % 6).alias("type"), F.when(F.col("o_orderstatus") == "P", "de").otherwise("us").alias("country"), F.when(k % 5 == 0, " ").otherwise(F.col("o_orderpriority")).alias("certification"))
    return search.release_certification(r, ["o_custkey"], "US").select("o_custkey", F.col("certification").alias("cert"))


@query("""
WITH want(k, iso) AS (VALUES (0, 'US'), (1, 'GB'), (2, 'DE'), (3, 'GB'), (4, 'DE'), (5, 'US'), (6, 'US'), (7, 'FR'))
SELECT o_orderkey, iso FROM orders JOIN want ON o_orderkey % 8 = k
""")
def q_storefront(spark: SparkSession, d: str) -> DataFrame:
    stores = spark.createDataFrame([(143441, "US", "United States"), (143444, "GB", "United Kingdom"), (143443, "DE", "Germany"), (143442, "FR", "France")], "id int, iso string, name string")
    asked = F.array(*[F.lit(x) for x in ("us", "UK", " germany ", "143444", "DE", "Atlantis", None, "France")])
    rows = _t(spark, d, "orders").select("o_orderkey", F.element_at(asked, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("asked"))
    return search.find_storefront(rows, stores, "asked").select("o_orderkey", "iso")


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN 'soon' END AS date, strftime(ts, '%Y-%m-%d') AS day FROM events
""")
def q_dates(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    shown = F.when(F.col("event_id") % 3 == 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, F.lit(" soon ")).otherwise(F.lit("  "))
    return e.select("event_id", search.normal_date(shown).alias("date"), search.date_of_millis(F.floor(F.col("t") / 1000)).alias("day"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 <> 2 THEN p_size END AS season, p_name AS episode, 'https://img.example/' || p_brand || '/600x600bb.jpg' AS art, 'https://img.example/' || p_partkey || '/1280x720.jpg' AS filled FROM part
""")
def q_store_names(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    collection = F.when(k % 3 == 0, F.concat(F.lit("River Gate, Season "), size)).when(k % 3 == 1, F.concat(F.lit("River Gate series "), size, F.lit(" (Deluxe)"))).otherwise(F.lit("River Gate 7"))
    episode = F.when(k % 2 == 0, F.concat(F.lit("Season "), size, F.lit(", Episode 1: "), "p_name")).otherwise(F.concat("p_name", F.lit(" ")))
    art = F.concat(F.lit("https://img.example/"), "p_brand", F.lit("/100x100"), F.when(k % 2 == 0, "bb").otherwise("-85"), F.lit(".jpg"))
    return _t(spark, d, "part").select("p_partkey", search.season_number(collection).alias("season"), search.episode_title(episode).alias("episode"), search.artwork_url(art, 600).alias("art"), search.filled_url(F.concat(F.lit("https://img.example/"), k.cast("string"), F.lit("/{w}x{h}{c}.{f}")), 1280, 720).alias("filled"))


@query("""
WITH want(k, text, number) AS (VALUES (0, '87', 87), (1, 'x7', NULL), (2, 'true', NULL), (3, NULL, NULL), (4, NULL, NULL), (5, '12.9', 12))
SELECT event_id, text, CAST(number AS INT) AS number FROM events JOIN want ON event_id % 6 = k
""")
def q_json_lenient(spark: SparkSession, d: str) -> DataFrame:
    forms = F.array(*[F.lit(x) for x in ('{"k": 87}', '{"k": "x7"}', '{"k": true}', '{"k": null}', '{"k": [1]}', '{"k": 12.9}')])
    e = _t(spark, d, "events").select("event_id", F.element_at(forms, (F.col("event_id") % 6 + 1).cast("int")).alias("doc"))
    return e.select("event_id", search.lenient_text(F.col("doc"), "$.k").alias("text"), search.lenient_int(F.col("doc"), "$.k").alias("number"))


@query("""
WITH a AS (SELECT o_custkey AS file, o_orderpriority AS name, 0 AS src, o_orderkey AS i FROM orders UNION ALL SELECT o_custkey, lower(o_orderpriority), 1, o_orderkey FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY file, lower(name) ORDER BY src, i) AS n FROM a)
SELECT file, string_agg(name, ',' ORDER BY src, i) AS names FROM r WHERE n = 1 GROUP BY file
""")
def q_merged_names(spark: SparkSession, d: str) -> DataFrame:
    """Recent names, then remote ones, without repeats whatever the case."""
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("i"))
    both = o.withColumn("src", F.lit(0)).unionByName(o.select("file", F.lower("name").alias("name"), "i", F.lit(1).alias("src")))
    once = joins.first_match(both.withColumn("low", F.lower("name")), ["file", "low"], [F.asc("src"), F.asc("i")])
    return once.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "i", "name"))), lambda x: x["name"]), ",").alias("names"))


@query("""
WITH l AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderkey % 9) FILTER (o_orderstatus = 'F')) AS a, list_sort(list(DISTINCT o_orderkey % 7) FILTER (o_orderstatus = 'O')) AS b FROM orders GROUP BY o_custkey)
SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') AS picks, len(coalesce(a, [])) + len(coalesce(b, [])) AS credits, nullif(CAST(o_custkey % 3 AS BIGINT), 1) AS style FROM l
""")
def q_id_union(spark: SparkSession, d: str) -> DataFrame:
    """Picks of two lists united, two lists of credits concatenated, and a style field dropped where it equals the default."""
    pick = lambda s, n: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey") % n))
    g = _t(spark, d, "orders").groupBy("o_custkey").agg(pick("F", 9).alias("a"), pick("O", 7).alias("b"))
    return g.select("o_custkey", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("picks"), F.size(F.concat("a", "b")).cast("long").alias("credits"), F.nullif(F.col("o_custkey") % 3, F.lit(1)).alias("style"))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice, o_orderkey) AS cues FROM orders GROUP BY o_custkey")
def q_cue_sort(spark: SparkSession, d: str) -> DataFrame:
    """The sort of cues by time; where the order of equal keys is open, ids decide."""
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("cues"))


@query("""
SELECT p_partkey, CASE WHEN x LIKE '%commentary%' OR x LIKE '%sign%' THEN 'auxiliary,' ELSE '' END || CASE WHEN p_size % 2 = 0 AND (x LIKE '%sdh%' OR p_size % 4 = 0) THEN 'transcribes-dialog,describes-music-and-sound,' ELSE '' END || CASE WHEN p_size % 2 = 0 AND x LIKE '%forced%' THEN 'forced-only,' ELSE '' END AS found,
       CASE p_partkey % 3 WHEN 0 THEN 'zh-Hans' WHEN 1 THEN 'zh-Hant' ELSE 'zh-TW' END AS language
FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'commentary' WHEN 1 THEN 'english sdh' WHEN 2 THEN 'forced signs' WHEN 3 THEN 'main' END AS n FROM part), LATERAL (SELECT coalesce(n, '') AS x)
""")
def q_characteristics(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.element_at(F.array(*[F.lit(x) for x in ("Commentary", "English SDH", "Forced signs", "Main", None)]), (k % 5 + 1).cast("int"))
    kind = F.when(size % 4 == 0, "captions").when(size % 2 == 0, "subtitle").otherwise("audio")
    found = F.concat(F.array_join(media.characteristics(name, kind), ","), F.lit(","))
    script = media.chinese_script(F.when(k % 3 == 2, "zh-TW").otherwise("zh"), F.when(k % 3 == 0, "Chinese (Simplified)").otherwise("Traditional Chinese"))
    return _t(spark, d, "part").select("p_partkey", F.when(found == ",", "").otherwise(found).alias("found"), script.alias("language"))


@query("""
WITH q AS (SELECT o_orderkey AS path, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Ready' ELSE 'Working' END AS status FROM orders)
SELECT o_orderkey AS path, 'new' AS status FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey NOT IN (SELECT path FROM q WHERE status IN ('Ready', 'Working')) UNION ALL SELECT path, CASE WHEN status = 'Working' THEN 'Ready' ELSE status END FROM q
""")
def q_queue_admission(spark: SparkSession, d: str) -> DataFrame:
    """New jobs that the queue admits, and the queue after a restart; two steps of one pipeline."""
    o = _t(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Ready").otherwise("Working")
    queue = o.select(F.col("o_orderkey").alias("path"), status.alias("status"))
    new = rules.admit_jobs(o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("path")), queue)
    return rules.run_steps(queue, [rules.restart_jobs, lambda df: new.select("path", F.lit("new").alias("status")).unionByName(df)])


@query(f"""
WITH {_TRACKS}, a AS (SELECT *, CASE WHEN track_id % 5 = 0 THEN '' WHEN track_id % 5 = 1 THEN 'und' WHEN track_id % 5 = 2 THEN NULL ELSE 'en' END AS language FROM t)
SELECT track_id, CASE WHEN language = 'en' THEN 'en' ELSE 'de' END AS language, row_number() OVER (PARTITION BY file, kind ORDER BY track_id % 2, pos) = 1 AS enabled FROM a
""")
def q_complete_languages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("track_id")
    language = F.when(k % 5 == 0, "").when(k % 5 == 1, "und").when(k % 5 > 2, "en")
    t = rules.complete_languages(_tracks(spark, d).withColumn("language", language), "de")
    return rules.first_of_kind(t, ["file", "kind"], [F.asc(k % 2), F.asc("pos")]).select("track_id", "language", "enabled")


@query("""
WITH t AS (SELECT o_custkey AS file, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN 'en' ELSE 'de' END AS language, o_orderkey % 5 = 0 AS aux, o_orderkey % 2 AS alt_group FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY file, language ORDER BY aux, pos) = 1 AND language = 'en' AS pick FROM t), g AS (SELECT *, max(CASE WHEN pick THEN alt_group END) OVER (PARTITION BY file) AS picked FROM r)
SELECT pos, CASE WHEN pick THEN TRUE WHEN alt_group = picked THEN FALSE ELSE TRUE END AS enabled FROM g
""")
def q_enable_language(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = _t(spark, d, "orders").select(F.col("o_custkey").alias("file"), k.alias("pos"), F.lit("audio").alias("kind"), F.when(k % 3 == 0, "en").otherwise("de").alias("language"), (k % 5 == 0).alias("is_auxiliary"), (k % 2).alias("alt_group"), F.lit(True).alias("enabled"))
    return rules.enable_language(t, ["file"], "en").select("pos", "enabled")


@query("""
WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id AS other, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events WHERE event_type = 'click')
SELECT user_id, event_id, other FROM a JOIN b USING (user_id, n)
""")
def q_zip(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    a, b = e.where("event_type = 'view'").select("user_id", "event_id"), e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("other"), (-F.col("t")).alias("back"))
    return joins.zip_by_position(a, b, ["user_id"], ["event_id"], ["back"]).select("user_id", "event_id", "other")


@query("SELECT DISTINCT CAST(o_custkey AS BIGINT) AS s_suppkey FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def q_missing_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that requests (orders' customers) name and the table of suppliers lacks."""
    return rules.missing_ids(_t(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey")), "s_suppkey", _t(spark, d, "orders").select(F.col("o_custkey").cast("long")))


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS k FROM events)
SELECT user_id, event_id, CAST(max(ms - k // 3 * 43200000) OVER (PARTITION BY user_id, k % 3 ORDER BY k) + k // 3 * 43200000 AS BIGINT) AS admitted_at FROM e
""")
def q_rate_delay(spark: SparkSession, d: str) -> DataFrame:
    """At most three events of a user in half a day, the others later."""
    e = _events(spark, d).select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return rules.delayed_requests(e, ["user_id"], "ms", "event_id", 3, 43_200_000).select("user_id", "event_id", "admitted_at")


@query("""
SELECT c_custkey, '{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' AS json, 'https://api.example/s?q=' || replace(c_name, '#', '%23') || '&api_key=***&page=2' AS address FROM customer
""")
def q_json_rows(spark: SparkSession, d: str) -> DataFrame:
    from tidelane.functions.text import redact

    url = F.concat(F.lit("https://api.example/s?q="), F.url_encode("c_name"), F.lit("&api_key=s3cret&page=2"))
    return _t(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))).alias("json"), redact(url).alias("address"))


@query("""
WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 2 WHEN 'error' THEN 0 ELSE 1 END AS pictures FROM events),
b AS (SELECT *, lag(pictures) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e)
SELECT user_id, event_id, pictures, coalesce(before = 2, false) AS late FROM b WHERE pictures > 0
""")
def q_late_pictures(spark: SparkSession, d: str) -> DataFrame:
    """First pictures that come a duration late, as the row before them packed two."""
    pictures = F.when(F.col("event_type") == "view", 2).when(F.col("event_type") == "error", 0).otherwise(1)
    opened = tracks.unpacked_pictures(_t(spark, d, "events").select("user_id", "event_id", pictures.alias("pictures")), ["user_id"], "event_id")
    return opened.where("part = 0").select("user_id", "event_id", "pictures", "late")


@query("""
WITH r AS (SELECT p_brand, p_size % 12 AS n, p_partkey % 5 AS delta, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 5 > 0 THEN p_size % 12 ELSE -1 END DESC, p_partkey) AS r FROM part)
SELECT p_brand, CAST(delta AS BIGINT) AS typical FROM r WHERE r = 1
""")
def q_typical_duration(spark: SparkSession, d: str) -> DataFrame:
    runs = _t(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") % 12).alias("n"), (F.col("p_partkey") % 5).cast("long").alias("delta"))
    return tracks.typical_duration(runs, ["p_brand"], "p_partkey", "n", "delta")


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE -1 END DESC, o_totalprice DESC, o_orderkey) AS place FROM orders
""")
def q_artwork(spark: SparkSession, d: str) -> DataFrame:
    return tracks.rank_artwork(_t(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "o_totalprice", "o_orderkey", ["f", "o"]).select("o_custkey", "o_orderkey", "place")


@query("""
WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 3600000000 AS dts, epoch_us(ts) // 3600000000 + 2 AS pts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT *, max(dts - rn) OVER (PARTITION BY user_id ORDER BY event_id) + rn AS fixed_dts FROM e)
SELECT user_id, event_id, fixed_dts, CASE WHEN event_type = 'view' THEN pts ELSE pts + fixed_dts - dts END AS fixed_pts FROM f
""")
def q_fixed_times(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "event_id", "event_type", F.floor(F.col("t") / 3_600_000_000).alias("dts")).withColumn("pts", F.col("dts") + 2)
    return timeline.fixed_times(e, ["user_id"], ["event_id"], "dts", "pts", F.col("event_type") == "view").select("user_id", "event_id", "fixed_dts", "fixed_pts")


@query("""
WITH e AS (SELECT user_id, event_id, 1 + event_id % 900 AS dur, CASE WHEN event_id % 3 > 0 THEN 1000 + event_id % 5000 END AS granule FROM events),
s AS (SELECT *, sum(dur) OVER (PARTITION BY user_id ORDER BY event_id) AS upto FROM e),
a AS (SELECT user_id, arg_min(granule - upto, event_id) FILTER (WHERE granule IS NOT NULL) AS shift, arg_max(dur, event_id) AS dur, max(upto) AS upto, max_by(coalesce(granule, -1), event_id) AS granule FROM s GROUP BY user_id)
SELECT user_id, CAST(CASE WHEN granule >= 0 AND coalesce(shift, 0) + upto > granule THEN least(coalesce(shift, 0) + upto - granule, dur) ELSE 0 END AS BIGINT) AS trim FROM a
""")
def q_end_trim(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    e = _t(spark, d, "events").select("user_id", "event_id", (k % 900 + 1).alias("dur"), F.when(k % 3 > 0, k % 5000 + 1000).alias("granule"))
    return timeline.end_trim(e, ["user_id"], ["event_id"], "dur", "granule").select("user_id", F.col("trim").cast("long").alias("trim"))


@query("""
WITH b AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS s FROM events GROUP BY ALL) SELECT user_id, max(s) AS peak, CAST(sum(s) AS BIGINT) AS total FROM b GROUP BY user_id
""")
def q_peak_rate(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "t", F.round(F.col("value") * 100).cast("long").alias("size"))
    return timeline.peak_rate(e, ["user_id"], "t", "size", 86_400_000_000)


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 86400000000 AS s, epoch_us(ts) // 86400000000 + event_id % 4 AS f, event_type = 'error' AS forced, event_id % 3 AS y, event_id % 5 AS x, CASE WHEN event_id % 7 > 0 THEN event_type ELSE '' END AS text FROM events),
g AS (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM e),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS cue FROM g)
SELECT user_id, CAST(cue AS BIGINT) AS cue, min(s) AS s, max(f) AS f, bool_or(forced) AS forced, coalesce(string_agg(text, chr(10) ORDER BY y, x, event_id) FILTER (WHERE text <> ''), '') AS text FROM i GROUP BY user_id, cue
""")
def q_cue_rollup(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("event_id"), F.floor(F.col("t") / 86_400_000_000)
    e = _events(spark, d).select("user_id", "event_id", day.alias("s"), (day + k % 4).alias("f"), (F.col("event_type") == "error").alias("forced"), (k % 3).alias("y"), (k % 5).alias("x"), F.when(k % 7 > 0, F.col("event_type")).otherwise("").alias("text"))
    return timeline.roll_up_cues(e, ["user_id"], ["event_id"], "s", "f", "forced", "y", "x", "text").select("user_id", "cue", "s", "f", "forced", "text")


@query("""
WITH s AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN n END) AS view, max(CASE WHEN event_type = 'click' THEN n END) AS click FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id)
SELECT CAST(c_custkey AS BIGINT) AS number, view, click FROM customer LEFT JOIN s ON c_custkey * 2 = user_id AND c_custkey % 5 > 0
""")
def q_stats_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Statistics by uid reach tracks that have numbers alone; a fifth of the numbers has no uid."""
    tags = _t(spark, d, "events").groupBy(F.col("user_id").alias("uid"), F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    numbers = _t(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("number"))
    bridge = numbers.where("number % 5 > 0").select("number", (F.col("number") * 2).alias("uid"))
    return media.pivot_statistics(tags, numbers, ["view", "click"], bridge)


@query("""
WITH p AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) - p_size AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
b AS (SELECT *, r = 5 OR p_partkey % 4 IN (0, 3) OR (p_partkey % 4 = 1 AND p_size % 2 = 1) AS usable FROM p),
i AS (SELECT *, sum(CASE WHEN usable THEN 0 ELSE 1 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS blocked FROM b),
s AS (SELECT p_brand, blocked, min(place) AS slot_start, max(place + p_size) AS slot_end, bool_or(r = n) AS at_end FROM i WHERE usable GROUP BY p_brand, blocked HAVING bool_or(r = 5))
SELECT p_brand, CAST(slot_start AS BIGINT) AS slot_start, CAST(slot_end AS BIGINT) AS slot_end,
       CASE WHEN at_end THEN 'tail' WHEN slot_end - slot_start - 40 = 0 OR slot_end - slot_start - 40 >= 8 THEN 'slot' ELSE 'rewrite' END AS plan,
       CAST(CASE WHEN NOT at_end AND (slot_end - slot_start - 40 = 0 OR slot_end - slot_start - 40 >= 8) THEN slot_end - slot_start - 40 ELSE 0 END AS BIGINT) AS filler FROM s
""")
def q_index_edit(spark: SparkSession, d: str) -> DataFrame:
    """A file a brand: its fifth part is the index, others are free, data or foreign boxes; the new index has 40 bytes."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    kind = F.when(F.row_number().over(w) == 5, "moov").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("free", "mdat", "uuid", "skip")]), (k % 4 + 1).cast("int")))
    boxes = _t(spark, d, "part").select("p_brand", kind.alias("kind"), (F.sum(size).over(w) - size).alias("offset"), size.alias("size"), (F.col("p_size") % 2 == 0).alias("referenced"))
    slots = edits.index_slots(boxes, ["p_brand"]).withColumns({"moov": F.lit(30), "extra": F.lit(10)})
    return edits.index_edit(slots, "moov", "extra").select("p_brand", "slot_start", "slot_end", "plan", F.col("filler").cast("long").alias("filler"))


@query("""
WITH n AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn, count(*) OVER (PARTITION BY o_custkey) - 1 AS mx FROM orders)
SELECT o_custkey, o_orderstatus, arg_max(o_orderpriority, rn) AS value FROM n WHERE rn % 5 = 0 OR (rn % 5 = 1 AND rn // 5 = mx // 5 AND mx % 5 IN (1, 3)) GROUP BY o_custkey, o_orderstatus
""")
def q_undo_redo(spark: SparkSession, d: str) -> DataFrame:
    """Logs of a customer that repeat edit, edit, undo, redo, undo; one edit in five lasts."""
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    op = F.when(rn % 5 < 2, "edit").when(rn % 5 == 3, "redo").otherwise("undo")
    log = _t(spark, d, "orders").select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("seq"), op.alias("op"), F.col("o_orderkey").alias("txn"), F.lit(None).cast("string").alias("old"), F.col("o_orderpriority").alias("new"))
    return edits.current_values(log, ["o_custkey"], ["o_orderstatus"])


@query("SELECT user_id, arg_max(event_id, (CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END, value, -event_id)) AS event_id FROM events GROUP BY user_id")
def q_best_readings(spark: SparkSession, d: str) -> DataFrame:
    """Events as readings: errors are blank, the value is the confidence."""
    e = _t(spark, d, "events").select("user_id", "event_id", "value", F.when(F.col("event_type") != "error", F.col("event_type")).alias("text"))
    return edits.best_readings(e, ["user_id"], "value", "event_id").select("user_id", "event_id")


@query("""
WITH p AS (SELECT p_brand, p_partkey, CASE p_size % 3 WHEN 0 THEN 'aac_plus_ac3' WHEN 1 THEN 'aac_plus_passthrough' END AS asked, p_partkey % 2 = 0 AS enabled, CAST(p_size % 4 AS INT) AS alt FROM part),
o AS (SELECT *, 0 AS part FROM p WHERE asked IS NOT NULL UNION ALL SELECT *, 1 FROM p)
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, part) AS new_pos, CASE WHEN part = 0 THEN 'aac' WHEN asked = 'aac_plus_ac3' THEN 'ac3' WHEN asked IS NOT NULL THEN 'passthrough' END AS action,
       enabled AND (part = 0 OR asked IS NULL) AS enabled, CASE WHEN asked IS NULL OR alt > 0 THEN alt ELSE 1 END AS alt_group, CASE WHEN part = 1 AND asked IS NOT NULL THEN row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, part) - 1 END AS fallback FROM o
""")
def q_audio_pairs(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("p_size") % 3 == 0, "aac_plus_ac3").when(F.col("p_size") % 3 == 1, "aac_plus_passthrough")
    p = _t(spark, d, "part").select("p_brand", "p_partkey", asked.alias("action"), (F.col("p_partkey") % 2 == 0).alias("enabled"), F.lit(False).alias("is_default"), (F.col("p_size") % 4).cast("int").alias("alt_group"))
    return rules.audio_pairs(p, ["p_brand"], "p_partkey").select("p_brand", "p_partkey", "new_pos", "action", "enabled", "alt_group", "fallback")
