"""Queries that run as streams over the event table, beside SQL for the rows that the last watermark makes final.

The table comes in one micro-batch, so no row is late, and a second batch without data moves the watermark to the
last event less the allowed lateness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.plans.queries import _t, query
from tidelane.streaming import timers
from tidelane.streaming.run import finished

_E = "e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) // 1000 AS ms FROM events), last AS (SELECT max(ms) - 10000 AS w FROM e)"
PARTS = 8


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = _t(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


@query(f"""
WITH {_E}, c AS (SELECT user_id, event_id, ms AS s, ms + 1 + CAST(floor(abs(value) * 1000000) AS BIGINT) AS f FROM e),
b AS (SELECT DISTINCT user_id, unnest([s, f]) AS edge FROM c),
l AS (SELECT user_id, edge, lead(edge) OVER (PARTITION BY user_id ORDER BY edge) AS upto FROM b)
SELECT l.user_id, l.edge AS slice_from, l.upto AS slice_to, count(c.event_id) AS n, coalesce(string_agg(CAST(c.event_id AS VARCHAR), ',' ORDER BY c.event_id), '') AS ids
FROM l LEFT JOIN c ON l.user_id = c.user_id AND c.s <= l.edge AND c.f >= l.upto WHERE l.upto <= (SELECT w FROM last) GROUP BY ALL
""")
def q_overlap_stream(spark: SparkSession, d: str) -> DataFrame:
    e = _stream(spark, d).withColumn("until", F.col("ms") + 1 + F.floor(F.abs("value") * 1_000_000))
    return finished(timers.overlap_stream(e, "user_id", "ms", "until", "event_id"), partitions=PARTS)


@query(f"""
WITH {_E}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS k FROM e),
a AS (SELECT user_id, event_id, ms, CAST(max(ms - k // 3 * 43200000) OVER (PARTITION BY user_id, k % 3 ORDER BY k) + k // 3 * 43200000 AS BIGINT) AS admitted_at FROM k)
SELECT * FROM a WHERE admitted_at <= (SELECT w FROM last)
""")
def q_rate_stream(spark: SparkSession, d: str) -> DataFrame:
    return finished(timers.rate_limit_stream(_stream(spark, d), "user_id", "ms", "event_id", 3, 43_200_000), partitions=PARTS)


@query(f"WITH {_E}, r AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC) AS n FROM e) SELECT user_id, ms AS dts FROM r WHERE n > 16 OR ms <= (SELECT w FROM last)")
def q_reorder_stream(spark: SparkSession, d: str) -> DataFrame:
    return finished(timers.reorder_by_watermark(_stream(spark, d), "user_id", "ms"), partitions=PARTS)


@query(f"""
WITH {_E}, p AS (SELECT user_id, ms, CASE event_type WHEN 'error' THEN '' ELSE event_type END AS page FROM e WHERE ms <= (SELECT w FROM last)),
f AS (SELECT *, CASE WHEN page = lag(page) OVER (PARTITION BY user_id ORDER BY ms, page) THEN 0 ELSE 1 END AS c FROM p),
g AS (SELECT user_id, ms AS start, page, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, page) AS fin FROM f WHERE c = 1)
SELECT user_id, start, fin AS "end", page FROM g WHERE page <> '' AND fin > start
""")
def q_page_stream(spark: SparkSession, d: str) -> DataFrame:
    page = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    return finished(timers.page_cue_stream(_stream(spark, d).withColumn("page", page), "user_id", "ms", "page"), partitions=PARTS)
