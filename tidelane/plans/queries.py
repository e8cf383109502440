"""Queries over the driver's tables, one for each group of operators, beside their DuckDB SQL.

``events`` stands in for sample streams (track = event_type or user_id, seq = event_id), other tables
for dimensions and plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions import names, text, times
from tidelane.operators import joins, rules, stateful, timeline
from tidelane.streaming.stateful import rate_buckets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = 3_600_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with SQL where it has any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))


@query("""
WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t FROM events),
f AS (SELECT *, max(t) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS eff FROM e)
SELECT user_id, event_id, eff, row_number() OVER (PARTITION BY user_id ORDER BY eff, event_type, event_id) AS pos FROM f
""")
def q_merge_timeline(spark: SparkSession, d: str) -> DataFrame:
    merged = timeline.merge_timeline(_events(spark, d), ["user_id"], "event_type", "event_id", "t")
    return merged.select("user_id", "event_id", "eff", "pos")


@query("""
WITH e AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS size, (epoch_us(ts) // 1000) AS ms FROM events),
g AS (SELECT event_type, count(*) AS frames, CAST(sum(size) AS BIGINT) AS bytes, min(ms) AS first_ms, max(ms) AS last_ms FROM e GROUP BY event_type)
SELECT *, greatest(0, last_ms - least(first_ms, last_ms)) AS duration_ms,
       CASE WHEN last_ms > first_ms THEN bytes * 8000 // (last_ms - first_ms) ELSE 0 END AS bps FROM g
""")
def q_track_stats(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_type", F.round(F.col("value") * 100).cast("long").alias("size"), F.floor(F.col("t") / 1000).alias("ms"))
    g = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("frames"), F.sum("size").alias("bytes"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    duration = F.greatest(F.lit(0).cast("long"), F.col("last_ms") - F.least("first_ms", "last_ms"))
    return g.withColumn("duration_ms", duration).withColumn("bps", F.expr("CASE WHEN last_ms > first_ms THEN bytes * 8000 div (last_ms - first_ms) ELSE 0 END"))


@query("""
SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS dts FROM lineitem
""")
def q_prefix_sum(spark: SparkSession, d: str) -> DataFrame:
    return timeline.prefix_sum(_t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_quantity"], "l_quantity").select("l_orderkey", "l_linenumber", "dts")


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 3600000000 AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
SELECT user_id, event_id, h, max(h - rn) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + rn AS fixed FROM e
""")
def q_dts_fix(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "event_id", F.floor(F.col("t") / HOUR).alias("h"))
    return timeline.strictly_increasing(e, ["user_id"], ["event_id"], "h")


@query("""
WITH e AS (SELECT event_type, event_id, (epoch_us(ts) // 1000000) % 1048576 AS raw FROM events),
s AS (SELECT *, raw - lag(raw) OVER (PARTITION BY event_type ORDER BY event_id) AS step FROM e)
SELECT event_type, event_id, CAST(sum(coalesce(step - CAST(round_even(step / 1048576.0::DOUBLE, 0) AS BIGINT) * 1048576, raw)) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unwrapped FROM s
""")
def q_unwrap(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_type", "event_id", (F.floor(F.col("t") / 1_000_000) % (1 << 20)).alias("raw"))
    return timeline.unwrap_counter(e, ["event_type"], "event_id", "raw", 1 << 20).drop("raw")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS slot FROM lineitem),
b AS (SELECT l_orderkey, l_shipdate AS dts, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate) AS slot FROM lineitem)
SELECT l_orderkey, l_linenumber, epoch_us(dts) AS dts FROM a JOIN b USING (l_orderkey, slot)
""")
def q_reorder(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("pts"))
    return timeline.reorder_by_presentation(li, ["l_orderkey"], ["l_linenumber"], "pts").select("l_orderkey", "l_linenumber", "dts")


@query("""
WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM events),
i AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM e)
SELECT user_id, island, any_value(event_type) AS event_type, count(*) AS n FROM i GROUP BY user_id, island
""")
def q_rle(spark: SparkSession, d: str) -> DataFrame:
    return timeline.run_length(_t(spark, d, "events"), ["user_id"], ["event_id"], "event_type")


@query("""
WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) // 3600000000 AS s, epoch_us(ts) // 3600000000 + 1 AS e FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, s, e ORDER BY event_id) AS dup FROM e),
f AS (SELECT *, CASE WHEN s = lag(e) OVER (PARTITION BY user_id, event_type, dup ORDER BY s, event_id) THEN 0 ELSE 1 END AS c FROM n),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id, event_type, dup ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, event_type, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY user_id, event_type, dup, island
""")
def q_session_merge(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "event_type", "event_id", F.floor(F.col("t") / HOUR).alias("s")).withColumn("e", F.col("s") + 1)
    return timeline.merge_touching(e, ["user_id", "event_type"], "s", "e", "event_id")


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 1 + CAST(floor(abs(value) * 1000) AS BIGINT) AS e FROM events),
b AS (SELECT DISTINCT user_id, unnest([s, e]) AS f FROM e),
l AS (SELECT user_id, f, lead(f) OVER (PARTITION BY user_id ORDER BY f) AS t FROM b)
SELECT l.user_id, l.f AS slice_from, l.t AS slice_to, count(e.event_id) AS n, coalesce(string_agg(CAST(e.event_id AS VARCHAR), ',' ORDER BY e.event_id), '') AS ids
FROM l LEFT JOIN e ON l.user_id = e.user_id AND e.s <= l.f AND e.e >= l.t WHERE l.t IS NOT NULL GROUP BY ALL
""")
def q_overlap_slices(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "event_id", F.floor(F.col("t") / 1_000_000).alias("s"), F.floor(F.abs("value") * 1000).alias("len"))
    return timeline.overlap_slices(e.withColumn("e", F.col("s") + 1 + F.col("len")), ["user_id"], "s", "e", "event_id")


@query("""
WITH e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS ms, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS dur FROM events)
SELECT user_id, event_id, greatest(coalesce(CASE WHEN dur > 0 THEN ms + dur END, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id), ms + 2000), ms + 1) AS end_time FROM e
""")
def q_lead_duration(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "event_id", F.floor(F.col("t") / 1000).alias("ms"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.floor("value")).cast("long").alias("dur"))
    return timeline.missing_durations(e, ["user_id"], ["ms", "event_id"], "ms", "dur", 2000).select("user_id", "event_id", "end_time")


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type FROM events),
s AS (SELECT user_id, t, max(event_id) AS signup_id FROM e WHERE event_type = 'signup' GROUP BY user_id, t)
SELECT e.user_id, e.event_id, s.signup_id, s.t AS signup_t FROM e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.t >= s.t
""")
def q_asof(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "event_id", "t", "event_type")
    s = e.where("event_type = 'signup'").groupBy("user_id", F.col("t").alias("signup_t")).agg(F.max("event_id").alias("signup_id"))
    return joins.asof_join(e.drop("event_type"), s, ["user_id"], "t", "signup_t", ["signup_id", "signup_t"]).drop("t")


@query("""
WITH r AS (SELECT CAST(floor(p_retailprice / 100) AS BIGINT) * 10000 AS lo, count(*) AS parts FROM part GROUP BY 1),
x AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice) AS BIGINT) AS off FROM lineitem)
SELECT x.l_orderkey, x.l_linenumber, coalesce(a.lo, b.lo) AS lo, coalesce(a.parts, b.parts) AS parts
FROM x LEFT JOIN r a ON x.off >= a.lo AND x.off < a.lo + 5000 LEFT JOIN r b ON x.off = b.lo + 5000
""")
def q_range_join(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "part").groupBy((F.floor(F.col("p_retailprice") / 100) * 10000).alias("lo")).agg(F.count(F.lit(1)).alias("parts"))
    r = r.withColumn("hi", F.col("lo") + 5000)
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round("l_extendedprice").cast("long").alias("off"))
    return joins.region_lookup(x, r, [], "off", "lo", "hi", ["lo", "parts"], 5000).select("l_orderkey", "l_linenumber", "lo", "parts")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS lang, o_orderstatus = 'F' AS takes FROM orders),
c AS (SELECT w.o_orderkey, c.o_orderkey AS fb, row_number() OVER (PARTITION BY w.o_orderkey ORDER BY
        CASE WHEN c.lang = w.lang AND c.o_orderkey < w.o_orderkey THEN 0 WHEN c.lang = w.lang THEN 1 WHEN c.o_orderkey < w.o_orderkey THEN 2 ELSE 3 END, abs(c.o_orderkey - w.o_orderkey)) AS r
      FROM o w JOIN o c ON w.o_custkey = c.o_custkey AND w.o_orderkey <> c.o_orderkey WHERE NOT w.takes AND c.takes)
SELECT o.o_orderkey, c.fb AS fallback FROM o LEFT JOIN c ON o.o_orderkey = c.o_orderkey AND r = 1
""")
def q_nearest_pref(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    takes = F.col("o_orderstatus") == "F"
    return joins.nearest_preferred(o, ["o_custkey"], "o_orderkey", "o_orderkey", ~takes, takes, "o_orderpriority").select("o_orderkey", "fallback")


_RULES = [(1, None, None, "any"), (2, 3, None, "nation"), (3, None, "BUILDING", "segment"), (4, 3, "BUILDING", "both"), (5, 3, None, "late")]


@query("""
WITH u(ord, nk, seg, choice) AS (VALUES (1, NULL, NULL, 'any'), (2, 3, NULL, 'nation'), (3, NULL, 'BUILDING', 'segment'), (4, 3, 'BUILDING', 'both'), (5, 3, NULL, 'late')),
j AS (SELECT c_custkey, choice, row_number() OVER (PARTITION BY c_custkey ORDER BY (CASE WHEN nk IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN seg IS NOT NULL THEN 2 ELSE 0 END) DESC, ord) AS r
      FROM customer LEFT JOIN u ON (nk IS NULL OR nk = c_nationkey) AND (seg IS NULL OR seg = c_mktsegment))
SELECT c_custkey, choice FROM j WHERE r = 1
""")
def q_most_specific(spark: SparkSession, d: str) -> DataFrame:
    u = spark.createDataFrame(_RULES, "ord int, nk int, seg string, choice string")
    return joins.most_specific(_t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), u, [("c_nationkey", "nk"), ("c_mktsegment", "seg")], "ord", ["choice"]).select("c_custkey", "choice")


_LANGUAGES = [("en", "eng", "eng"), ("de", "deu", "ger"), ("fr", "fra", "fre"), ("zh", "zho", "chi")]


@query("""
WITH l(tag, t, b) AS (VALUES ('en', 'eng', 'eng'), ('de', 'deu', 'ger'), ('fr', 'fra', 'fre'), ('zh', 'zho', 'chi')),
c AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'EN' WHEN 1 THEN 'de' WHEN 2 THEN 'ger' WHEN 3 THEN 'FRA' WHEN 4 THEN 'fre' WHEN 5 THEN 'zho' WHEN 6 THEN 'chi' WHEN 7 THEN 'xx' END AS code FROM orders)
SELECT o_orderkey, coalesce((SELECT t FROM l WHERE lower(code) IN (tag, l.t, l.b)), 'und') AS iso_t, coalesce((SELECT b FROM l WHERE lower(code) IN (tag, l.t, l.b)), 'und') AS iso_b FROM c
""")
def q_dim_chain(spark: SparkSession, d: str) -> DataFrame:
    dim = joins.small_side(spark.createDataFrame(_LANGUAGES, "tag string, t string, b string"))
    codes = F.array(*[F.lit(c) for c in ("EN", "de", "ger", "FRA", "fre", "zho", "chi", "xx", None)])
    rows = _t(spark, d, "orders").select("o_orderkey", F.lower(F.element_at(codes, (F.col("o_orderkey") % 9 + 1).cast("int"))).alias("code"))
    for c in ("tag", "t", "b"):
        rows = rows.join(dim.select(F.struct("t", "b").alias(f"by_{c}"), F.col(c).alias("key")).dropDuplicates(["key"]), F.col("code") == F.col("key"), "left").drop("key")
    found = F.coalesce("by_tag", "by_t", "by_b")
    return rows.select("o_orderkey", F.coalesce(found["t"], F.lit("und")).alias("iso_t"), F.coalesce(found["b"], F.lit("und")).alias("iso_b"))


@query("""
WITH old AS (SELECT c_custkey AS id, c_mktsegment AS v FROM customer),
new AS (SELECT c_custkey AS id, c_name AS v FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, c_name FROM customer WHERE c_custkey % 7 = 0),
kept AS (SELECT * FROM old WHERE NOT (v = 'BUILDING' AND id NOT IN (SELECT id FROM new)))
SELECT coalesce(n.id, k.id) AS id, coalesce(n.v, k.v) AS v FROM kept k FULL JOIN new n ON k.id = n.id
""")
def q_tag_merge(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("v")).unionAll(c.where("c_custkey % 7 = 0").select((F.col("c_custkey") + 1000000).alias("id"), "c_name"))
    return joins.upsert_tags(old, new, ["id"], "v", overwrite=True, drop_missing=F.col("v") == "BUILDING")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 150000)")
def q_anti(spark: SparkSession, d: str) -> DataFrame:
    urgent = _t(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 150000").select("o_custkey").distinct()
    return _t(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)
""")
def q_symdiff(spark: SparkSession, d: str) -> DataFrame:
    of = lambda s: _t(spark, d, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct()
    return joins.symmetric_difference(of("F"), of("O"), ["k"])


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def q_count_back(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", F.count(F.lit(1)).over(Window.partitionBy("o_custkey")).alias("n"))


@query("""
WITH p AS (SELECT p_partkey, p_brand, p_type, p_size = 1 AS is_main, p_size > 10 AS ok, max(CAST(p_size = 1 AS INT)) OVER (PARTITION BY p_brand, p_type) AS has FROM part)
SELECT p_partkey, has = 0 AND ok AND row_number() OVER (PARTITION BY p_brand, p_type ORDER BY ok DESC, p_partkey) = 1 AS chosen FROM p
""")
def q_group_main(spark: SparkSession, d: str) -> DataFrame:
    return rules.main_of_group(_t(spark, d, "part"), ["p_brand", "p_type"], ["p_partkey"], F.col("p_size") == 1, F.col("p_size") > 10).select("p_partkey", "chosen")


@query("""
WITH g AS (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, q AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY n DESC, q) AS r FROM g) WHERE r = 1
""")
def q_mode(spark: SparkSession, d: str) -> DataFrame:
    g = _t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    return joins.first_match(g, ["l_returnflag", "l_linestatus"], [F.desc("n"), F.asc("q")]).withColumnRenamed("q", "mode")


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events),
r AS (SELECT user_id, delta, row_number() OVER (PARTITION BY user_id ORDER BY delta) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e WHERE delta IS NOT NULL)
SELECT user_id, delta AS upper_median FROM r WHERE i = n // 2
""")
def q_upper_median(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("delta", F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("event_id"))).where("delta is not null")
    w = Window.partitionBy("user_id")
    ranked = e.select("user_id", "delta", (F.row_number().over(w.orderBy("delta")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return ranked.where(F.col("i") == F.floor(F.col("n") / 2)).select("user_id", F.col("delta").alias("upper_median"))


@query("""
SELECT event_type, epoch_us(date_trunc('hour', ts)) AS start_us, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY ALL
""")
def q_rate_buckets(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("long").alias("size"))
    return rate_buckets(e, "ts", "size", "event_type", "1 hour").select("event_type", F.unix_micros("start").alias("start_us"), "n", "bytes")


@query("""
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CAST(1 << (event_id % 12) AS BIGINT) AS f, event_type = 'error' AS err FROM events)
SELECT user_id, bit_or(f) AS flags, bool_or(err) AS any_error FROM e WHERE i <= 48 GROUP BY user_id
""")
def q_flag_fold(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("i <= 48")
    flag = F.expr("shiftleft(1L, cast(event_id % 12 as int))")
    return e.groupBy("user_id").agg(F.bit_or(flag).alias("flags"), F.bool_or(F.col("event_type") == "error").alias("any_error"))


@query("""
SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, bool_or(role = 'system') AS has_system, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, coalesce(text, '')) AS joined FROM conversations GROUP BY conv_id
""")
def q_group_rollup(spark: SparkSession, d: str) -> DataFrame:
    line = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    parts = F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last_turn"), F.bool_or(F.col("role") == "system").alias("has_system"), F.array_join(parts, "\n").alias("joined"))


@query("""
SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, lower(o_orderpriority) ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1
""")
def q_distinct_by(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").withColumn("p", F.lower("o_orderpriority"))
    return joins.first_match(o, ["o_custkey", "p"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("""
WITH m AS (SELECT p_brand, p_partkey, p_size = 7 AS x, max(CAST(p_size = 7 AS INT)) OVER (PARTITION BY p_brand) AS has FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY x DESC, p_partkey) AS rank FROM m)
SELECT p_brand, p_partkey, rank FROM r WHERE CASE WHEN has = 1 THEN x AND rank <= 3 ELSE rank <= 1 END
""")
def q_rank_fallback(spark: SparkSession, d: str) -> DataFrame:
    return rules.top_with_fallback(_t(spark, d, "part"), ["p_brand"], F.col("p_size") == 7, ["p_partkey"], 3, 1).select("p_brand", "p_partkey", "rank")


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(least(abs(year(o_orderdate) - 1995), 2), 2), o_totalprice DESC, o_orderkey) AS place FROM orders
""")
def q_proximity(spark: SparkSession, d: str) -> DataFrame:
    distance = F.coalesce(F.least(F.abs(F.year("o_orderdate") - 1995), F.lit(2)), F.lit(2))
    w = Window.partitionBy("o_custkey").orderBy(distance, F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("""
WITH g AS (SELECT user_id, event_type, bool_or(value > 50) AS has_video, count(*) AS streams, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id, event_type AS program FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY has_video DESC, streams DESC, first) AS r FROM g) WHERE r = 1
""")
def q_program_choice(spark: SparkSession, d: str) -> DataFrame:
    g = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.bool_or(F.col("value") > 50).alias("has_video"), F.count(F.lit(1)).alias("streams"), F.min("event_id").alias("first"))
    return joins.first_match(g, ["user_id"], [F.desc("has_video"), F.desc("streams"), F.asc("first")]).select("user_id", F.col("event_type").alias("program"))


@query("""
WITH n AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM n WHERE r = 1) WHERE place <= 3
""")
def q_mru(spark: SparkSession, d: str) -> DataFrame:
    return rules.recent_first(_t(spark, d, "events"), ["user_id"], F.lower("event_type"), "ts", "event_id", 3).select("user_id", "event_id", "place")


@query("""
WITH m AS (SELECT max(epoch_us(ts)) AS now FROM events),
l AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, event_id FROM l, m WHERE r = 1 AND now - t <= 172800000000
""")
def q_ttl(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    now = e.agg(F.max("t")).first()[0]
    return rules.fresh_entries(e, ["user_id"], "t", "event_id", now, 48 * HOUR).select("user_id", "event_id")


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, lag(epoch_us(ts), 3) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS nth FROM events)
SELECT user_id, event_id, nth IS NULL OR t - nth >= 86400000000 AS admitted FROM e
""")
def q_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return rules.rate_limited(_events(spark, d), ["user_id"], "t", "event_id", 3, 24 * HOUR).select("user_id", "event_id", "admitted")


@query("""
WITH s AS (SELECT o_custkey, CAST(greatest(max(epoch_us(o_orderdate)) - min(epoch_us(o_orderdate)) - 1, 0) // 86400000000 AS BIGINT) AS days FROM orders GROUP BY o_custkey)
SELECT o_custkey, unnest(generate_series(0, days, 90)) AS start_day, 'Chapter ' || (unnest(generate_series(0, days, 90)) // 90 + 1) AS title FROM s
""")
def q_series(spark: SparkSession, d: str) -> DataFrame:
    t = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    s = _t(spark, d, "orders").groupBy("o_custkey").agg(F.floor(F.greatest(F.max(t) - F.min(t) - 1, F.lit(0)) / (24 * HOUR)).alias("days"))
    x = s.select("o_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("days"), F.lit(90).cast("long"))).alias("start_day"))
    return x.withColumn("title", F.concat(F.lit("Chapter "), (F.floor(F.col("start_day") / 90) + 1).cast("string")))


@query("""
WITH x AS (SELECT p_brand, p_partkey, unnest(CASE WHEN p_size > 40 THEN [0, 1] ELSE [0] END) AS part, p_size > 40 AS two FROM part WHERE coalesce(CASE WHEN p_size = 5 THEN 'skip' END, 'passthrough') <> 'skip')
SELECT p_brand, p_partkey, CASE WHEN NOT two THEN 'passthrough' WHEN part = 0 THEN 'convert' ELSE 'keep' END AS action, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, part) AS new_pos FROM x
""")
def q_plan_expand(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").withColumn("asked", F.when(F.col("p_size") == 5, "skip")).where("coalesce(asked, 'passthrough') <> 'skip'")
    return rules.expand_plan(p, "p_partkey", ["p_brand"], F.col("p_size") > 40, "convert", "keep").select("p_brand", "p_partkey", "action", "new_pos")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey = 1 OR s_suppkey BETWEEN 3 AND 5 OR s_suppkey BETWEEN 10 AND 60")
def q_idlist(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").where(rules.in_id_list(F.col("s_suppkey"), "1, 3-5,10-60")).select("s_suppkey")


@query("""
SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_partial, bool_and(o_totalprice > 1000) AS all_large, count(DISTINCT o_orderpriority) = 1 AS uniform FROM orders GROUP BY o_custkey
""")
def q_exists_policy(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("any_partial"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"), (F.count_distinct("o_orderpriority") == 1).alias("uniform"))


@query("""
SELECT c_custkey, c_name || ' [' || nullif(trim(n_name), '') || '/' || CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END || ']' AS title FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def q_template(spark: SparkSession, d: str) -> DataFrame:
    j = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    columns = {"Name": F.col("c_name"), "Nation": F.col("n_name"), "Segment": F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))}
    return j.select("c_custkey", text.template("{Name} [{Nation}/{Segment}]", columns).alias("title"))


@query("""
SELECT p_partkey, upper(p_brand) || ' s' || CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size || 'e' || CASE WHEN p_partkey < 10 THEN '000' WHEN p_partkey < 100 THEN '00' WHEN p_partkey < 1000 THEN '0' ELSE '' END || p_partkey || ' ' ||
       upper(p_type[1]) || lower(p_type[2:]) || ' ' || upper(split_part(p_name, ' ', 1)[1]) || lower(split_part(p_name, ' ', 1)[2:]) || '-' || upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) || ' ' ||
       lower(split_part(p_name, ' ', 1)) || upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) || ' ' || 1990 + p_size AS name FROM part
""")
def q_name_format(spark: SparkSession, d: str) -> DataFrame:
    columns = {"Brand": F.col("p_brand"), "Season": F.col("p_size"), "Episode": F.col("p_partkey"), "Type": F.col("p_type"), "Name": F.col("p_name"), "Date": F.concat((F.col("p_size") + 1990).cast("string"), F.lit("-03-09"))}
    return _t(spark, d, "part").select("p_partkey", text.name_format("{Brand|upper} s{Season:00}e{Episode:0000} {Type|capitalize} {Name|train} {Name|camel} {Date:yyyy}", columns).alias("name"))


@query(r"""
SELECT p_partkey, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(p_type || '/' || p_name || ' ?.', '[/\\]', '-', 'g'), '[<>:"|?*\x00-\x1F]', '', 'g'), '\s+', ' ', 'g')), '[. ]+$', '') AS safe FROM part
""")
def q_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", text.sanitize(F.concat("p_type", F.lit("/"), "p_name", F.lit(" ?."))).alias("safe"))


@query("""
WITH e AS (SELECT event_id, (epoch_us(ts) // 1000) % 86400000 AS ms FROM events)
SELECT event_id, lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS shown,
       ms AS parsed, CAST(round_even(ms * 90000.0::DOUBLE / 1000.0::DOUBLE / 7.0::DOUBLE, 0) AS BIGINT) AS ticks FROM e
""")
def q_time_parse(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", (F.floor(F.col("t") / 1000) % 86_400_000).alias("ms"))
    shown = e.withColumn("shown", times.format_ms(F.col("ms")))
    return shown.select("event_id", "shown", times.parse_ms(F.col("shown")).alias("parsed"), F.bround(F.col("ms") * 90000.0 / 1000.0 / 7.0).cast("long").alias("ticks"))


@query(r"""
SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>|</p>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS plain FROM pages
""")
def q_strip_html(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("plain"))


@query("""
SELECT doc_id, nullif(array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> ''))), '; '), '') AS names FROM documents
""")
def q_names(spark: SparkSession, d: str) -> DataFrame:
    parts = text.clean_names(F.split("text", ","))
    return _t(spark, d, "documents").select("doc_id", F.nullif(F.array_join(F.array_sort(parts), "; "), F.lit("")).alias("names"))


@query("""
WITH r AS (SELECT p_partkey, p_size * 128 AS w, (p_partkey % 25) * 67 AS h FROM part)
SELECT p_partkey, CASE WHEN w <= 1920 AND h <= 1088 THEN CASE WHEN w <= 1280 AND h <= 720 THEN CASE WHEN w = 1280 OR h = 720 THEN 1 ELSE 0 END ELSE 2 END ELSE 2 END AS hd,
       CASE WHEN w <= 1920 AND h <= 1088 THEN CASE WHEN w <= 1280 AND h <= 720 THEN CASE WHEN w = 1280 OR h = 720 THEN 1 ELSE 0 END ELSE 2 END ELSE 3 END AS hd4k FROM r
""")
def q_hd_class(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("p_size") * 128, F.col("p_partkey") % 25 * 67
    return _t(spark, d, "part").select("p_partkey", text.hd_class(w, h).alias("hd"), text.hd_class(w, h, detect_4k=True).alias("hd4k"))


@query("""
SELECT p_partkey, CASE p_size WHEN 1 THEN 'Mono' WHEN 2 THEN 'Stereo' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' ELSE p_size || ' ch' END AS name FROM part
""")
def q_pretty_name(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", text.channel_name(F.col("p_size")).alias("name"))


@query("SELECT doc_id, sha256(source || '|' || lang || '|' || coalesce(text, '')) AS key FROM documents")
def q_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", text.cache_key(F.col("source"), F.col("lang"), F.coalesce("text", F.lit(""))).alias("key"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 11 AS f, o_orderkey % 97 AS no, 1 + o_orderkey % 12 AS s, 1 + o_orderkey % 140 AS e, 1950 + o_orderkey % 70 AS y FROM orders)
SELECT o_orderkey, CASE WHEN f IN (3, 4, 10) THEN 'movie' ELSE 'tv' END AS kind,
       CASE f WHEN 4 THEN 'Quiet Harbour' WHEN 7 THEN 'A.B.C.Files' WHEN 8 THEN 'Dr. Vale' ELSE 'River ' || no || 'th Gate' END AS title,
       CASE WHEN f IN (2, 3, 6, 10) THEN y END AS year, CASE f WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 6 THEN NULL WHEN 10 THEN NULL WHEN 5 THEN 1 ELSE s END AS season,
       CASE WHEN f IN (3, 4, 6, 10) THEN NULL ELSE e END AS episode, CASE WHEN f IN (1, 9) THEN e + 1 END AS last_episode,
       CASE WHEN f = 6 THEN y || '-0' || 1 + s % 9 || '-1' || e % 10 END AS air_date, CASE f WHEN 0 THEN 'TIDE' WHEN 3 THEN 'TIDE' WHEN 5 THEN 'Tide' WHEN 10 THEN 'Tide' WHEN 9 THEN 'E' || CASE WHEN e < 9 THEN '0' ELSE '' END || e + 1 END AS release_group FROM o
""")
def q_name_parse(spark: SparkSession, d: str) -> DataFrame:
    """Names of eleven forms, made from a show's number, season, episode and year; the SQL knows what went into them."""
    forms = [
        "River.%1$dth.Gate.S%2$02dE%3$02d.1080p.WEB-DL.x264-TIDE.mkv", "river_%1$dth_gate_s%2$02de%3$de%5$d_uncut.mkv", "River %1$dth Gate (%4$d) - %2$dx%3$02d - Low Water.avi", "River.%1$dth.Gate.%4$d.2160p.BluRay-TIDE.mkv",
        "Quiet.Harbour.1080p.WEB.h264.mkv", "[Tide] River %1$dth Gate - %3$02dv2 (720p) [0A1B2C3D].mkv", "River.%1$dth.Gate.%4$d.%6$s.Guest.Name.720p.mkv", "A.B.C.Files.Season.%2$d.Episode.%3$d.mkv",
        "Dr. Vale S%2$02dE%3$02d.mkv", "/media/TV/River %1$dth Gate (1999)/Season %2$d/S%2$02dE%3$02d-E%5$02d.mkv", "[Tide] River %1$dth Gate [%4$d] [1080p].mp4",
    ]
    k = F.col("o_orderkey")
    show, season, episode, year = k % 97, k % 12 + 1, k % 140 + 1, k % 70 + 1950
    day = F.format_string("0%d.1%d", season % 9 + 1, episode % 10)
    shown = F.array(*[F.format_string(x, show, season, episode, year, episode + 1, day) for x in forms])
    rows = _t(spark, d, "orders").select("o_orderkey", F.element_at(shown, (k % 11 + 1).cast("int")).alias("input")).repartition(spark.sparkContext.defaultParallelism)  # narrow rows, much work each
    lower = F.when(k % 11 == 1, F.regexp_replace("title", "^river (.*) gate$", "River $1 Gate")).otherwise(F.col("title"))
    return names.parse_names(rows, "input", 2025).withColumn("title", lower).drop("input")


@query(r"""
SELECT doc_id, trim(regexp_replace(replace(lower(strip_accents(text)), '&', ' and '), '[^\p{L}\p{Nd}]+', ' ', 'g'), ' ') AS title FROM documents
""")
def q_title_norm(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", text.normal_title(F.col("text")).alias("title"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, t, t AS first, CAST(0 AS BIGINT) AS chunk FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.event_id, e.i, e.t, CASE WHEN e.t - r.first > 86400000000 THEN e.t ELSE r.first END, r.chunk + CASE WHEN e.t - r.first > 86400000000 THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, chunk FROM r
""")
def q_greedy_cut(spark: SparkSession, d: str) -> DataFrame:
    return stateful.greedy_cut(_events(spark, d).select("user_id", "event_id", "t"), ["user_id"], ["t", "event_id"], "t", 24 * HOUR).select("user_id", "event_id", "chunk")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, t AS snapped FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN abs(e.t - r.snapped - 3600000000) <= 28800000000 THEN r.snapped + 3600000000 ELSE e.t END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, snapped FROM r
""")
def q_audio_snap(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "event_id", "t", F.lit(HOUR).cast("long").alias("dur"))
    return stateful.snap_contiguous(e, ["user_id"], ["t", "event_id"], "t", "dur", 8 * HOUR).select("user_id", "event_id", "snapped")


@query("""
WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'B' WHEN 'click' THEN 'P' ELSE 'I' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS slot FROM events),
f AS (SELECT *, min(CASE WHEN kind <> 'B' THEN slot END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, max(slot) OVER (PARTITION BY user_id) + 1 AS last FROM e)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN kind = 'B' THEN slot * 2 + 1 ELSE coalesce(nxt, last) * 2 END, slot) AS display FROM f
""")
def q_picture_reorder(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "B").when(F.col("event_type") == "click", "P").otherwise("I")
    return timeline.picture_reorder(_t(spark, d, "events").withColumn("kind", kind), ["user_id"], "event_id", "kind").select("user_id", "event_id", "display")


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS c FROM events),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS n FROM i GROUP BY user_id, s
""")
def q_session_window(spark: SparkSession, d: str) -> DataFrame:
    from tidelane.streaming.stateful import sessions

    s = sessions(_events(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts")), "ts", "user_id", "6 hours")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
