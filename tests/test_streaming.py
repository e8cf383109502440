"""The streaming forms give the batch results once all input is processed."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidelane.operators import jobs, rules
from tidelane.operators.timeline import overlap_slices
from tidelane.streaming import stateful, timers
from tidelane.streaming.run import finished


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
        return [tuple(r) for r in spark.table(name).collect()]
    finally:
        q.stop()


def test_rates_and_sessions(spark, tmp_path):
    data = spark.createDataFrame([("a", 0, 5), ("a", 1, 7), ("b", 1, 1), ("a", 100, 2)], "k string, s long, size long").withColumn("ts", F.timestamp_seconds("s"))
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in stateful.rate_buckets(data, "ts", "size", "k").select("k", "n", "bytes", F.unix_micros("start")).collect()}
    live = run(spark, stateful.rate_buckets(stream, "ts", "size", "k").select("k", "n", "bytes", F.unix_micros("start")), "rates", "complete")
    assert set(live) == batch
    got = sorted(tuple(r) for r in stateful.sessions(data, "ts", "k", "10 seconds").select("k", "n").collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]


def test_reorder_emits_in_order(spark, tmp_path):
    data = spark.createDataFrame([("a", t) for t in (3, 1, 2, 5, 4, 6)], "k string, pts long")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    got = run(spark, stateful.reorder_stream(stream, "k", "pts", depth=2, flush_ms=None), "reordered")
    assert [t for _, t in got] == [1, 2, 3, 4]


@pytest.mark.parametrize("order", ["forward", "backward", "mixed"])
def test_timelines_and_limits_equal_their_batch_forms_in_any_order(spark, tmp_path, order):
    """Twelve micro-batches within the lateness, and a last row far behind that lets all others leave."""
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.randrange(4000) + (900_000 if rng.random() < 0.2 else 0), rng.randrange(1, 3000), i) for i in range(72)]
    data = [(k, s, s + n, i, f"p{i % 3}" if i % 4 else "") for k, s, n, i in rows]
    at = {"forward": sorted(data, key=lambda r: r[1]), "backward": sorted(data, key=lambda r: -r[1]), "mixed": data}[order]
    schema = "k string, s long, e long, i long, page string"
    batch = spark.createDataFrame(data, schema)
    for n in range(12):
        spark.createDataFrame(at[n * 6 : n * 6 + 6], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    spark.createDataFrame([("z", 10**10, 10**10 + 1, -1, "")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    rows_of = lambda df: sorted(tuple(r) for r in df.where("k <> 'z'").collect())
    want = rows_of(overlap_slices(batch, ["k"], "s", "e", "i").select("k", "slice_from", "slice_to", "n", "ids"))
    assert rows_of(finished(timers.overlap_stream(stream(), "k", "s", "e", "i", "1 day"), partitions=2)) == want
    want = rows_of(rules.delayed_requests(batch, ["k"], "s", "i", 3, 400).select("k", "i", "s", "admitted_at"))
    assert rows_of(finished(timers.rate_limit_stream(stream(), "k", "s", "i", 3, 400, "1 day"), partitions=2)) == want
    assert rows_of(finished(timers.reorder_by_watermark(stream(), "k", "s", 100, "1 day"), partitions=2)) == sorted((k, s) for k, s, *_ in data)
    want = rows_of(jobs.page_cues(batch.dropDuplicates(["k", "s"]), ["k"], "s", "page").where("end is not null").select("k", "start", "end", "page")) if len({(r[0], r[1]) for r in data}) == len(data) else None
    got = rows_of(finished(timers.page_cue_stream(stream(), "k", "s", "page", "1 day"), partitions=2))
    assert want is None or got == want


def test_late_cues_are_clipped_and_late_requests_wait_behind(spark, tmp_path):
    schema = "k string, s long, e long, i long"
    at = str(tmp_path / "in")
    place = str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(schema).parquet(at)
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
    run = lambda: sorted(tuple(r) for r in finished(timers.overlap_stream(stream(), "k", "s", "e", "i", "0 seconds"), place, partitions=2).where("k = 'a'").select("slice_from", "slice_to", "ids").collect())
    put(("a", 0, 100, 1), ("a", 50, 400, 2), ("z", 200, 201, 0))
    assert run() == [(0, 50, "1"), (50, 100, "1,2")]
    put(("a", 10, 300, 3), ("a", 5, 90, 4), ("z", 1000, 1001, 0))  # 3 counts from 100 on, 4 is over
    assert run() == [(0, 50, "1"), (50, 100, "1,2"), (100, 300, "2,3"), (300, 400, "2")]
    limited = lambda: sorted(tuple(r) for r in finished(timers.rate_limit_stream(stream(), "k", "s", "i", 2, 1000, "0 seconds"), place + "2", partitions=2).where("k = 'a'").select("i", "admitted_at").collect())
    put(("z", 9000, 9001, 0))
    assert limited() == [(1, 0), (2, 1005), (3, 1000), (4, 5)]  # 0, 5, 10, 50 with two permits a second
    put(("a", 7, 8, 9), ("z", 20_000, 0, 0))
    assert (9, 2000) in limited()


def test_three_permits_in_400_ms(spark):
    """Four requests at once: the fourth waits for the first to leave the window."""
    df = spark.createDataFrame([("a", 0, i) for i in range(8)], "k string, t long, i long")
    got = [r.admitted_at for r in rules.delayed_requests(df, ["k"], "t", "i", 3, 400).orderBy("i").collect()]
    assert got == [0, 0, 0, 400, 400, 400, 800, 800]


def test_delays_equal_a_queue(spark):
    rng = random.Random(3)
    times = sorted(rng.randrange(3000) for _ in range(200))
    held, want = [], []
    for t in times:
        now = max(t, held[-1] if held else t, held[-4] + 100 if len(held) >= 4 else t)
        held.append(now)
        want.append(now)
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate(times)], "k string, t long, i long")
    assert [r.admitted_at for r in rules.delayed_requests(df, ["k"], "t", "i", 4, 100).orderBy("i").collect()] == want
