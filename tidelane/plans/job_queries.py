"""Queries of job, style and streaming rules over the driver's tables, beside their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.functions import styles
from tidelane.operators import jobs
from tidelane.plans.queries import _events, _t, query


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand || ' s' || lpad(CAST(p_size AS VARCHAR), 2, '0') || 'e' || CASE WHEN p_partkey < 10 THEN '0' ELSE '' END || p_partkey WHEN p_size % 5 <> 0 THEN p_name END AS name FROM part
""")
def q_output_names(spark: SparkSession, d: str) -> DataFrame:
    tv = F.col("p_size") % 3 == 0
    columns = {"Name": F.when(F.col("p_size") % 5 != 0, F.col("p_name")), "TV Show": F.when(tv, F.col("p_brand")), "TV Season": F.when(tv, F.col("p_size")), "TV Episode #": F.when(tv, F.col("p_partkey"))}
    return _t(spark, d, "part").select("p_partkey", jobs.output_name(columns, F.lit(None).cast("string")).alias("name"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'user' WHEN c_custkey % 3 = 0 THEN 'environment' WHEN c_custkey % 2 = 0 THEN 'file' ELSE 'built-in' END AS key FROM customer")
def q_key_precedence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    key = jobs.key_by_precedence(F.when(k % 5 == 0, "user").otherwise(" "), F.when(k % 3 == 0, " environment"), F.when(k % 2 == 0, "file").otherwise(""), F.lit("built-in"))
    return _t(spark, d, "customer").select("c_custkey", key.alias("key"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def q_scan_once(spark: SparkSession, d: str) -> DataFrame:
    scan = lambda keys: _t(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey").join(keys, "o_custkey")
    return jobs.scan_once(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], scan).select("o_orderkey", "c_name")


@query("""
WITH p AS (SELECT p_partkey, x.place, x.i, y.name, y.j, x.place || '/' || y.name AS path FROM part, (VALUES ('/a', 1), ('/b', 2)) x(place, i), (VALUES ('lib1', 1), ('lib2', 2)) y(name, j)),
f AS (SELECT * FROM p WHERE (p_partkey % 2 = 0 AND path = '/b/lib1') OR (p_partkey % 3 = 0 AND path = '/a/lib2'))
SELECT p_partkey, arg_min(path, i * 10 + j) || '.' || p_partkey AS path FROM f GROUP BY p_partkey
""")
def q_first_existing(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    rows = lambda cells, c: _t(spark, d, "part").select("p_partkey", F.explode(F.array(*[F.struct(v.alias(c), F.lit(i).alias(f"{c}_ord")) for i, v in enumerate(cells)])).alias("x")).select("p_partkey", f"x.{c}", f"x.{c}_ord")
    places, names = rows([F.lit("/a"), F.lit("/b")], "place"), rows([F.concat(F.lit("lib1."), k), F.concat(F.lit("lib2."), k)], "name")
    p = _t(spark, d, "part")
    files = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("/b/lib1."), k).alias("path")).unionByName(p.where("p_partkey % 3 = 0").select(F.concat(F.lit("/a/lib2."), k).alias("path")))
    return jobs.first_existing(places, names, files, ["p_partkey"])


@query("SELECT event_id, user_id AS pid FROM events WHERE user_id IN (3, 5, 8)")
def q_attached_packets(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(3,), (8,), (5,), (5,), (100000,)], "pid long")
    return jobs.attached_packets(_t(spark, d, "events").select("event_id", F.col("user_id").alias("pid")), wanted).select("event_id", "pid")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '.h264' WHEN 1 THEN '.srt' ELSE '.flac' END AS extension FROM part WHERE p_size % 4 <> 3")
def q_export_plan(spark: SparkSession, d: str) -> DataFrame:
    codec = F.element_at(F.array(F.lit("H264"), F.lit("tx3g"), F.lit("flac"), F.lit("unknown")), F.col("p_size") % 4 + 1)
    return jobs.export_plan(_t(spark, d, "part").select("p_partkey", codec.alias("codec"))).select("p_partkey", "extension")


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, CASE event_type WHEN 'error' THEN '' ELSE event_type END AS page FROM events),
f AS (SELECT *, CASE WHEN page = lag(page) OVER (PARTITION BY user_id ORDER BY t) THEN 0 ELSE 1 END AS c FROM e),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM f),
g AS (SELECT user_id, island, min(t) AS start, any_value(page) AS page FROM i GROUP BY user_id, island), n AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS fin FROM g)
SELECT user_id, start, page, fin AS "end" FROM n WHERE page <> ''
""")
def q_page_cues(spark: SparkSession, d: str) -> DataFrame:
    page = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    return jobs.page_cues(_events(spark, d).select("user_id", "t", page.alias("page")), ["user_id"], "t", "page")


@query("""
SELECT p_partkey, p_brand || ' ' || p_type || '<x>' || p_name AS text, '0-' || length(p_brand) || ':1;' || length(p_brand) || '-' || length(p_brand) + 1 || ':3;' || length(p_brand) + 1 || '-' || length(p_brand) + 1 + length(p_type) || ':2' AS runs,
       CASE WHEN p_size % 2 = 0 THEN 8 ELSE 2 END AS alignment, CASE WHEN p_size < length(p_brand) THEN 5 WHEN p_size = length(p_brand) THEN 7 WHEN p_size <= length(p_brand) + length(p_type) THEN 6 ELSE 4 END AS style
FROM part
""")
def q_styled_markup(spark: SparkSession, d: str) -> DataFrame:
    override = F.when(F.col("p_size") % 2 == 0, "{\\an8}").otherwise(F.lit("{\\pos(1,2)}"))
    markup = F.concat(override, F.lit("<b><font color='red'>"), "p_brand", F.lit("</font><I> </b>"), "p_type", F.lit("</i><x>"), "p_name")
    rows = _t(spark, d, "part").select("p_partkey", "p_size", styles.srt_styled(markup).alias("s"))
    runs = F.array_join(F.transform("s.runs", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"), F.lit(":"), r["style"].cast("string"))), ";")
    return rows.select("p_partkey", "s.text", runs.alias("runs"), "s.alignment", styles.style_at(F.col("s.runs"), F.col("p_size"), F.lit(styles.UNDERLINE)).alias("style"))


@query("""
WITH w(k, rgba, back) AS (VALUES (0, 'FF8000FF', '&H000080FF'), (1, 'FF80007F', '&H800080FF'), (2, '010000FF', '&H00000001'), (3, NULL, NULL), (4, 'FFFFFFEB', '&H14FFFFFF'))
SELECT p_partkey, rgba, back, CASE p_size % 12 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 5 THEN 7 WHEN 6 THEN 8 WHEN 7 THEN 9 WHEN 9 THEN 4 WHEN 10 THEN 5 WHEN 11 THEN 6 ELSE 2 END AS keypad,
       CASE p_size % 12 WHEN 1 THEN 1 WHEN 3 THEN 3 WHEN 5 THEN 5 WHEN 6 THEN 6 WHEN 7 THEN 7 WHEN 9 THEN 9 WHEN 10 THEN 10 WHEN 11 THEN 11 ELSE 2 END AS legacy, CAST(round_even(p_size * 1.5::DOUBLE, 0) AS INT) AS margin
FROM part JOIN w ON p_partkey % 5 = k
""")
def q_ass_styles(spark: SparkSession, d: str) -> DataFrame:
    forms = F.array(*[F.lit(x) for x in ("&H0080FF&", "&H800080FF", " 1 ", "&Hxyz", "&Hffffff&")])
    k = (F.col("p_partkey") % 5).cast("int")
    rgba = styles.ass_color(F.element_at(forms, k + 1), F.when(k == 4, 20).otherwise(0))
    keypad = styles.from_legacy_alignment(F.col("p_size") % 12)
    return _t(spark, d, "part").select("p_partkey", rgba.alias("rgba"), styles.to_ass_color(rgba).alias("back"), keypad.alias("keypad"), styles.to_legacy_alignment(keypad).alias("legacy"), styles.rescaled(F.col("p_size"), 640, 960).alias("margin"))
