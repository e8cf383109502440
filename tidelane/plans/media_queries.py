"""More queries over the driver's tables: sample tables, edit lists, rule and rating lookups, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions import markup
from tidelane.operators import media, rules, stateful, timeline
from tidelane.plans.queries import HOUR, _events, _t, query


@query("""
WITH r AS (SELECT p_brand, p_partkey AS run, p_size % 4 AS n, p_size AS delta FROM part),
s AS (SELECT p_brand, run, i, delta FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM r WHERE n > 0)),
q AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY run, i) AS seq FROM s)
SELECT p_brand, seq, coalesce(CAST(sum(delta) OVER (PARTITION BY p_brand ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS dts,
       CASE WHEN seq <= 4 THEN 1 + (seq - 1) // 2 ELSE 3 + (seq - 5) // 3 END AS chunk FROM q
""")
def q_sample_table(spark: SparkSession, d: str) -> DataFrame:
    runs = _t(spark, d, "part").select("p_brand", F.col("p_partkey").alias("run"), (F.col("p_size") % 4).cast("long").alias("n"), F.col("p_size").cast("long").alias("delta"))
    chunks = runs.select("p_brand").distinct().select("p_brand", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("first_chunk"), F.lit(2).cast("long").alias("per_chunk")), F.struct(F.lit(3).cast("long").alias("first_chunk"), F.lit(3).cast("long").alias("per_chunk")))).alias("c")).select("p_brand", "c.*")
    return media.expand_sample_table(runs, chunks, ["p_brand"]).select("p_brand", "seq", "dts", "chunk")


@query("""
WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS dur, CASE WHEN event_type = 'view' THEN -1 ELSE event_id END AS mt FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, min(CASE WHEN mt >= 0 THEN event_id END) OVER (PARTITION BY user_id) AS first, max(event_id) OVER (PARTITION BY user_id) AS last FROM e)
SELECT user_id, coalesce(CAST(sum(CASE WHEN first IS NULL OR event_id < first THEN dur END) AS BIGINT), 0) AS start_offset, max(CASE WHEN event_id = first THEN mt END) AS media_start,
       max(CASE WHEN event_id = first AND event_id = last THEN mt + dur END) AS media_end FROM f GROUP BY user_id
""")
def q_edit_list(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("dur"), F.when(F.col("event_type") == "view", -1).otherwise(F.col("event_id")).alias("mt"))
    return media.edit_offsets(e, ["user_id"], "event_id", "dur", "mt")


@query("""
WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS dur, CASE WHEN event_id % 5 = 0 THEN event_id * 10 END AS known FROM events),
f AS (SELECT *, CAST(sum(dur) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin FROM e),
a AS (SELECT user_id, min_by(known - fin, event_id) AS shift FROM f WHERE known IS NOT NULL GROUP BY user_id)
SELECT f.user_id, event_id, coalesce(shift, 0) + fin - dur AS start FROM f LEFT JOIN a ON f.user_id = a.user_id
""")
def q_anchored_timeline(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("dur"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") * 10).alias("known"))
    return timeline.anchored_timeline(e, ["user_id"], ["event_id"], "dur", "known").select("user_id", "event_id", "start")


@query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id % 7 = 0 AS gap FROM events),
p AS (SELECT *, i * 4 + CAST(sum(CAST(gap AS INT)) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pos FROM e),
f AS (SELECT *, CASE WHEN pos = lag(pos) OVER (PARTITION BY user_id ORDER BY i) + 4 THEN 0 ELSE 1 END AS c FROM p),
r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM f)
SELECT user_id, event_id, run, (row_number() OVER (PARTITION BY user_id, run ORDER BY i) - 1) // 3 AS part FROM r
""")
def q_contiguous_groups(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = _t(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("i"), (F.col("event_id") % 7 == 0).cast("long").alias("gap"))
    e = e.select("user_id", "event_id", "i", (F.col("i") * 4 + F.sum("gap").over(Window.partitionBy("user_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).alias("p"), F.lit(4).cast("long").alias("size"))
    return timeline.group_contiguous(e, ["user_id"], ["i"], "p", "size", 3).select("user_id", "event_id", "run", "part")


@query("""
WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS t FROM events)
SELECT event_id, CASE WHEN abs(CAST(round_even(t / 40.0::DOUBLE, 0) AS BIGINT) * 40 - t) <= 8 THEN CAST(round_even(t / 40.0::DOUBLE, 0) AS BIGINT) * 40 ELSE t END AS snapped FROM e
""")
def q_grid_snap(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", F.floor(F.col("t") / 1000).alias("ms"))
    return e.select("event_id", timeline.snap_to_grid(F.col("ms"), 40, 8).cast("long").alias("snapped"))


@query("""
WITH u(rule_name, target, ord) AS (VALUES ('VIEW', 'watched', 1), ('click', 'pressed', 2), ('view', 'pressed', 3), ('purchase', 'bought', 4), ('signup', 'watched', 5)),
j AS (SELECT user_id, event_id AS pos, target, ord FROM events JOIN u ON upper(event_type) = upper(rule_name)),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, pos ORDER BY ord) AS r FROM j),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, target ORDER BY ord, pos) AS q FROM a WHERE r = 1)
SELECT user_id, target, pos FROM b WHERE q = 1
""")
def q_tag_rules(spark: SparkSession, d: str) -> DataFrame:
    u = spark.createDataFrame([("VIEW", "watched", 1), ("click", "pressed", 2), ("view", "pressed", 3), ("purchase", "bought", 4), ("signup", "watched", 5)], "rule_name string, target string, ord int")
    tags = _t(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("pos"))
    return media.consume_by_rules(tags, u, ["user_id"], "rule_name", "event_type").select("user_id", "target", "pos")


@query("""
WITH u(rule, target, ord, level, context) AS (VALUES ('VIEW', 'seen', 1, 1, NULL), ('view', 'looked', 2, NULL, 'odd'), ('click', 'pressed', 3, 0, 'odd'), ('click', 'seen', 4, 2, NULL), ('error', 'pressed', 5, NULL, NULL)),
t AS (SELECT user_id, event_type, event_id AS pos, event_id % 3 AS level, CASE WHEN event_id % 2 = 1 THEN 'odd' ELSE 'even' END AS context FROM events),
a AS (SELECT t.user_id, u.target, t.pos, u.ord, row_number() OVER (PARTITION BY t.user_id, t.pos ORDER BY u.ord) AS r FROM t JOIN u ON upper(u.rule) = upper(t.event_type) AND coalesce(u.level, t.level) = t.level AND coalesce(u.context, t.context) = t.context),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, target ORDER BY ord, pos) AS q FROM a WHERE r = 1)
SELECT user_id, target, pos FROM b WHERE q = 1
""")
def q_tag_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Rules that hold at one level, in one context, or anywhere."""
    u = spark.createDataFrame([("VIEW", "seen", 1, 1, None), ("view", "looked", 2, None, "odd"), ("click", "pressed", 3, 0, "odd"), ("click", "seen", 4, 2, None), ("error", "pressed", 5, None, None)], "rule string, target string, ord int, level int, context string")
    k = F.col("event_id")
    tags = _t(spark, d, "events").select("user_id", "event_type", k.alias("pos"), (k % 3).cast("int").alias("level"), F.when(k % 2 == 1, "odd").otherwise("even").alias("context"))
    return media.consume_by_rules(tags, u, ["user_id"], "rule", "event_type", within=["level", "context"]).select("user_id", "target", "pos")


@query("""
WITH want(k, rating) AS (VALUES (0, 'mpaa|PG-13|300'), (1, 'mpaa|R|400'), (2, 'mpaa|PG-13|300'), (3, 'mpaa|PG|200'), (4, 'us-tv|TV-14|500'), (5, 'us-tv|TV-MA|600'), (6, 'us-tv|TV-PG|400'), (7, 'de-movie|Ab 16 Jahren|500'),
  (8, 'de-tv|Ab 12 Jahren|200'), (9, 'uk-movie|15|350'), (10, 'uk-movie|12A|325'), (11, 'mpaa|NR|0'), (12, NULL), (13, NULL), (14, NULL), (15, 'de-movie|Ab 16 Jahren|500'))
SELECT o_orderkey, rating FROM orders JOIN want ON o_orderkey % 16 = k
""")
def q_ratings(spark: SparkSession, d: str) -> DataFrame:
    asked = [("PG-13", "US", "movie"), ("Rated R", "US", "movie"), ("pg-13", None, "movie"), ("US:PG", "DE", "movie"), ("TV-14", "US", "tv"), ("TV_MA", "US", "tv"), ("TV-PG", "US", "movie"), ("16", "DE", "movie"), ("FSK 12", "DE", "tv"),
             ("15", "GB", "movie"), ("12A", "GB", "movie"), ("NR", "US", "movie"), ("Not Rated", "ES", "movie"), ("", "US", "movie"), ("XYZ", "US", "movie"), ("16+", "DE", "movie")]
    table = spark.createDataFrame([(*r[:4], r[3], r[4], i) for i, r in enumerate(media.RATINGS)], "system string, country string, media string, code string, name string, value int, ord int")
    forms = F.array(*[F.struct(F.lit(c).alias("certification"), F.lit(n).cast("string").alias("country"), F.lit(m).alias("media")) for c, n, m in asked])
    rows = _t(spark, d, "orders").select("o_orderkey", F.element_at(forms, (F.col("o_orderkey") % 16 + 1).cast("int")).alias("a")).select("o_orderkey", "a.*")
    found = media.lookup_ratings(rows, table)
    return found.select("o_orderkey", F.when(F.col("r_code").isNotNull(), F.concat_ws("|", "r_system", "r_name", "r_value")).alias("rating"))


@query("""
WITH w(k, timescale, ticks) AS (VALUES (0, 24000, 1001), (1, 30000, 1001), (2, 48000, 1001), (3, 60000, 1001), (4, 120000, 1001), (5, 25000, 1000), (6, 50000, 1000), (7, 24000, 1000), (8, 90000, 0), (9, 90000, 6300), (10, 90000, 2700000))
SELECT p_partkey, CAST(timescale AS BIGINT) AS timescale, CAST(ticks AS BIGINT) AS ticks, CASE WHEN r <= 33050 THEN 22050 WHEN r <= 46050 THEN 44100 ELSE 48000 END AS rate
FROM (SELECT p_partkey, p_partkey % 11 AS k, p_size * 1000 + 10 AS r FROM part) JOIN w USING (k)
""")
def q_timescale(spark: SparkSession, d: str) -> DataFrame:
    durations = [41708333, 33366667, 20854167, 16683333, 8341667, 40000000, 20000000, 41666667, 0, 70000000, 30000000000]
    f = F.element_at(F.array(*[F.lit(x).cast("long") for x in durations]), (F.col("p_partkey") % 11 + 1).cast("int"))
    scale = media.video_timescale(f)
    return _t(spark, d, "part").select("p_partkey", scale["timescale"].alias("timescale"), scale["ticks"].alias("ticks"), media.nearest_rate(F.col("p_size") * 1000 + 10, [22050, 44100, 48000]).alias("rate"))


@query("""
WITH s AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN n END) AS view, max(CASE WHEN event_type = 'click' THEN n END) AS click FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id)
SELECT c_custkey AS uid, view, click FROM customer LEFT JOIN s ON c_custkey = user_id
""")
def q_stats_pivot(spark: SparkSession, d: str) -> DataFrame:
    tags = _t(spark, d, "events").groupBy(F.col("user_id").alias("uid"), F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return media.pivot_statistics(tags, _t(spark, d, "customer").select(F.col("c_custkey").alias("uid")), ["view", "click"])


@query("""
WITH a AS (SELECT o_custkey, o_orderkey AS pos, CASE WHEN o_orderstatus = 'P' THEN 'chapters' ELSE 'audio' END AS kind, 0 AS new FROM orders WHERE o_orderkey % 3 <> 0
           UNION ALL SELECT o_custkey, o_orderkey, 'audio', 1 FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_custkey, pos, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN kind = 'chapters' THEN 2 ELSE new END, pos) AS new_pos FROM a
""")
def q_import_tracks(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    old = o.where("o_orderkey % 3 <> 0").select("o_custkey", F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderstatus") == "P", "chapters").otherwise("audio").alias("kind"))
    new = o.where("o_orderkey % 3 = 0").select("o_custkey", F.col("o_orderkey").alias("pos"), F.lit("audio").alias("kind"))
    return media.add_imported(old, new, ["o_custkey"]).select("o_custkey", "pos", "new_pos")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 60000000 AS t, 1 + event_id % 5 AS size, event_id % 3 = 0 AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, key, t AS first, size AS total, CAST(0 AS BIGINT) AS cluster FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.event_id, e.i, e.key, CASE WHEN c THEN e.t ELSE first END, CASE WHEN c THEN e.size ELSE total + e.size END, cluster + CASE WHEN c THEN 1 ELSE 0 END
      FROM (SELECT e.*, r.first, r.total, r.cluster, e.t - r.first >= 5000 OR r.total + e.size > 14 OR (e.key AND e.t - r.first >= 1000) AS c FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) e)
SELECT user_id, event_id, cluster, key OR row_number() OVER (PARTITION BY user_id, cluster ORDER BY i) = 1 AS cue FROM r
""")
def q_cluster_cues(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "event_id", "t", F.floor(F.col("t") / 60_000_000).alias("ms"), (1 + F.col("event_id") % 5).alias("size"), (F.col("event_id") % 3 == 0).alias("key"))
    cut = stateful.cluster_cut(e, ["user_id"], ["t", "event_id"], "ms", "size", "key", max_bytes=14)
    first = F.row_number().over(Window.partitionBy("user_id", "cluster").orderBy("t", "event_id")) == 1
    return cut.select("user_id", "event_id", "cluster", (F.col("key") | first).alias("cue"))


@query("""
WITH u AS (SELECT DISTINCT user_id, event_id // 4 AS txn FROM events WHERE event_type = 'error'),
l AS (SELECT e.user_id, e.event_type AS field, e.event_id AS seq, CAST(floor(value) AS BIGINT) AS new FROM events e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM u WHERE u.txn = e.event_id // 4))
SELECT user_id, field, max_by(new, seq) AS value FROM l GROUP BY ALL
""")
def q_edit_log(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("user_id", F.col("event_type").alias("field"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 4).alias("txn"), F.when(F.col("event_type") == "error", "undo").otherwise("set").alias("op"), F.floor("value").cast("long").alias("new"))
    return rules.current_state(e, ["user_id", "field"])


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'tv' WHEN c_custkey % 5 = 0 THEN 'movie' ELSE 'file' END AS kind,
       CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE 'x' END AS title FROM customer
""")
def q_prefill(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    found = media.prefill(F.when(k % 3 == 0, F.col("c_name")), F.when(k % 2 == 0, 1), F.when(k % 5 == 0, F.col("c_mktsegment")), F.lit("file"), F.lit("x"))
    return _t(spark, d, "customer").select("c_custkey", found.alias("p")).select("c_custkey", "p.kind", "p.title")


@query("""
WITH p AS (SELECT p_partkey, p_name AS a, p_brand AS b, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 3 END AS style FROM part)
SELECT p_partkey, a || ' & ' || chr(10) || b AS text, '0-' || length(a) || ':' || style || ';' || length(a) + 4 || '-' || length(a) + 4 + length(b) || ':3' AS runs,
       CASE style WHEN 1 THEN '<b>' WHEN 2 THEN '<i>' WHEN 4 THEN '<u>' ELSE '<b><i>' END || a || CASE style WHEN 1 THEN '</b>' WHEN 2 THEN '</i>' WHEN 4 THEN '</u>' ELSE '</i></b>' END || ' &amp; ' || chr(10) || '<b><i>' || b || '</i></b>' AS vtt FROM p
""")
def q_markup_formats(spark: SparkSession, d: str) -> DataFrame:
    """ASS text to styled text, to a timed text sample and back, and on to WebVTT."""
    tags = F.element_at(F.array(*[F.lit(x) for x in ("\\b1", "\\i1", "\\u1", "\\b700\\i1")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    ass = F.concat(F.lit("{\\an8}{"), tags, F.lit("}"), "p_name", F.lit("{\\r} & {a comment}\\N{\\i1\\b1}"), "p_brand")
    read = _t(spark, d, "part").select("p_partkey", markup.ass_styled(ass).alias("s"))
    back = read.select("p_partkey", markup.tx3g_styled(markup.to_tx3g(F.col("s.text"), F.col("s.runs"))).alias("s"))
    shown = F.array_join(F.transform("s.runs", lambda r: F.format_string("%d-%d:%d", r["start"], r["end"], r["style"])), ";")
    return back.select("p_partkey", F.col("s.text").alias("text"), shown.alias("runs"), markup.to_vtt_markup(F.col("s.text"), F.col("s.runs")).alias("vtt"))
