"""Closed forms against plain loops, and golden rows."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from tidelane.operators import joins, rules, stateful, timeline


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_merge_waits_within_a_track_and_prefers_the_earlier_track_on_ties(spark):
    random.seed(1)
    tracks = {t: [random.randint(0, 9) for _ in range(random.randint(1, 12))] for t in range(4)}
    data = [(0, t, i, x) for t, xs in tracks.items() for i, x in enumerate(xs)]
    got = rows_of(timeline.merge_timeline(spark.createDataFrame(data, "f int, track int, seq int, time int"), ["f"], "track", "seq", "time").orderBy("pos"), "track", "seq")
    heads, want = dict.fromkeys(tracks, 0), []
    while any(heads[t] < len(tracks[t]) for t in tracks):
        best = min((t for t in tracks if heads[t] < len(tracks[t])), key=lambda t: (tracks[t][heads[t]], t))
        want.append((best, heads[best]))
        heads[best] += 1
    assert got == want


def test_strictly_increasing_and_unwrap_match_loops(spark):
    random.seed(2)
    times = [random.randint(0, 20) for _ in range(60)]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(times)], "k int, i int, t long")
    want, last = [], None
    for t in times:
        last = t if last is None else max(t, last + 1)
        want.append(last)
    assert [r[0] for r in rows_of(timeline.strictly_increasing(df, ["k"], ["i"], "t").orderBy("i"), "fixed")] == want
    true, at = [], 8589934000
    for _ in range(60):
        at += random.randint(0, 1000)
        true.append(at)
    raw = spark.createDataFrame([(0, i, t % (1 << 33)) for i, t in enumerate(true)], "k int, i int, raw long")
    got = [r[0] for r in rows_of(timeline.unwrap_counter(raw, ["k"], "i", "raw", 1 << 33, block=7).orderBy("i"), "unwrapped")]
    assert [x - got[0] for x in got] == [x - true[0] for x in true]


def test_overlap_slices_golden(spark):
    cues = spark.createDataFrame([(0, 1, 0, 10), (0, 2, 5, 15), (0, 3, 20, 25)], "f int, id int, s int, e int")
    got = rows_of(timeline.overlap_slices(cues, ["f"], "s", "e", "id").orderBy("slice_from"), "slice_from", "slice_to", "ids")
    assert got == [(0, 5, "1"), (5, 10, "1,2"), (10, 15, "2"), (15, 20, ""), (20, 25, "3")]


def test_run_length_round_trip(spark):
    data = [(0, i, v) for i, v in enumerate("aabbbacc")]
    runs = timeline.run_length(spark.createDataFrame(data, "k int, i int, v string"), ["k"], ["i"], "v")
    assert rows_of(runs.orderBy("island"), "v", "n") == [("a", 2), ("b", 3), ("a", 1), ("c", 2)]
    assert "".join(r[0] for r in rows_of(timeline.expand_runs(runs, "n").orderBy("island", "i"), "v")) == "aabbbacc"


def test_bounded_reorder_and_closed_form_agree_when_shallow(spark):
    random.seed(3)
    pts = sorted(random.sample(range(1000), 40))
    shuffled = [x for i in range(0, 40, 4) for x in (pts[i], pts[i + 3], pts[i + 1], pts[i + 2])]
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate(shuffled)], "k int, i int, pts long")
    a = rows_of(timeline.reorder_by_presentation(df, ["k"], ["i"], "pts").orderBy("i"), "dts")
    assert a == rows_of(stateful.bounded_reorder(df, ["k"], ["i"], "pts").orderBy("i"), "dts") == [(p,) for p in sorted(pts)]
    heap, out = [], []
    for p in shuffled:
        heapq.heappush(heap, p)
        if len(heap) > 2:
            out.append(heapq.heappop(heap))
    out += [heapq.heappop(heap) for _ in range(len(heap))]
    assert [r[0] for r in rows_of(stateful.bounded_reorder(df, ["k"], ["i"], "pts", depth=2).orderBy("i"), "dts")] == out


def test_greedy_cut_and_snap(spark):
    df = spark.createDataFrame([(0, i, t, 3) for i, t in enumerate([0, 4, 9, 10, 11, 25])], "k int, i int, t long, size int")
    assert [r[0] for r in rows_of(stateful.greedy_cut(df, ["k"], ["i"], "t", 10).orderBy("i"), "chunk")] == [0, 0, 0, 0, 1, 2]
    assert [r[0] for r in rows_of(stateful.greedy_cut(df, ["k"], ["i"], "t", 100, "size", 6).orderBy("i"), "chunk")] == [0, 0, 1, 1, 2, 2]
    assert [r[0] for r in rows_of(stateful.snap_contiguous(df.withColumn("d", F.lit(5)), ["k"], ["i"], "t", "d", 1).orderBy("i"), "snapped")] == [0, 5, 10, 10, 11, 25]


def test_segments_match_loops(spark):
    rng = random.Random(5)
    t = sorted(rng.randrange(3000) for _ in range(400))
    size, track, key = ([rng.randrange(1, 9) for _ in t], [rng.randrange(3) // 2 for _ in t], [rng.random() < 0.2 for _ in t])
    df = spark.createDataFrame([(0, i, *x) for i, x in enumerate(zip(t, size, track, key))], "k int, i int, t long, size long, track int, key boolean").repartition(3)
    chunks, first, total, n = [], None, 0, -1
    for j, x in enumerate(t):
        if first is None or x - first > 40 or total + size[j] > 30 or track[j] != track[j - 1]:
            n, first, total = n + 1, x, 0
        total += size[j]
        chunks.append(n)
    got = stateful.greedy_cut(df, ["k"], ["i"], "t", 40, "size", 30, source="track").orderBy("i")
    assert [r[0] for r in rows_of(got, "chunk")] == chunks
    clusters, first, total, n = [], None, 0, -1
    for j, x in enumerate(t):
        if first is None or x - first >= 60 or total + size[j] > 50 or (key[j] and x - first >= 20):
            n, first, total = n + 1, x, 0
        total += size[j]
        clusters.append(n)
    got = stateful.cluster_cut(df, ["k"], ["i"], "t", "size", "key", max_ms=60, video_ms=20, max_bytes=50).orderBy("i")
    assert [r[0] for r in rows_of(got, "cluster")] == clusters
    snapped, end = [], None
    for x, d in zip(t, size):
        at = end if end is not None and abs(x - end) <= 6 else x
        snapped.append(at)
        end = at + d
    assert [r[0] for r in rows_of(stateful.snap_contiguous(df, ["k"], ["i"], "t", "size", 6).orderBy("i"), "snapped")] == snapped


def test_missing_durations_and_merge_touching(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 10, 5), (0, 20, 0)], "k int, t long, d long")
    assert [r[0] for r in rows_of(timeline.missing_durations(df, ["k"], ["t"], "t", "d", 2000).orderBy("t"), "end_time")] == [10, 15, 2020]
    cues = spark.createDataFrame([("x", 1, 0, 5), ("x", 2, 5, 9), ("x", 3, 10, 12), ("x", 4, 0, 5)], "v string, id int, s int, e int")
    assert sorted(rows_of(timeline.merge_touching(cues, ["v"], "s", "e", "id"), "s", "e", "n")) == [(0, 5, 1), (0, 9, 2), (10, 12, 1)]


def test_picture_reorder(spark):
    df = spark.createDataFrame([(0, i, k) for i, k in enumerate("IPBBPBB")], "f int, i int, kind string")
    assert [r[0] for r in rows_of(timeline.picture_reorder(df, ["f"], "i", "kind").orderBy("i"), "display")] == [1, 4, 2, 3, 7, 5, 6]


def test_asof_region_and_nearest(spark):
    left = spark.createDataFrame([(0, 5), (0, 10), (0, 1)], "k int, t int")
    right = spark.createDataFrame([(0, 5, "a"), (0, 7, "b")], "k int, rt int, v string")
    assert sorted(rows_of(joins.asof_join(left, right, ["k"], "t", "rt", ["v"]), "t", "v"), key=str) == [(1, None), (10, "b"), (5, "a")]
    regions = spark.createDataFrame([(0, 0, 10, "x"), (0, 20, 30, "y")], "k int, s int, e int, v string")
    at = spark.createDataFrame([(0, 0), (0, 9), (0, 10), (0, 15), (0, 29)], "k int, p int")
    assert sorted(rows_of(joins.region_lookup(at, regions, ["k"], "p", "s", "e", ["v"], 7), "p", "v")) == [(0, "x"), (9, "x"), (10, "x"), (15, None), (29, "y")]
    tracks = spark.createDataFrame([(0, 2, "en", "AAC"), (0, 3, "en", "AC-3"), (0, 4, "en", "AAC"), (0, 5, "fr", "AC-3")], "f int, id int, lang string, fmt string")
    got = joins.nearest_preferred(tracks, ["f"], "id", "id", F.col("fmt") == "AC-3", F.col("fmt") == "AAC", "lang")
    assert dict(rows_of(got, "id", "fallback")) == {2: None, 3: 2, 4: None, 5: 4}


def test_rules(spark):
    assert rules.parse_id_list("1, 3-5") == [(1, 1), (3, 5)]
    with pytest.raises(ValueError):
        rules.parse_id_list("5-3")
    tracks = spark.createDataFrame([(0, 1, "audio", "en", False, False, 1), (0, 2, "audio", "fr", True, False, 1), (0, 3, "audio", "fr", False, True, 1)], "f int, pos int, kind string, language string, is_auxiliary boolean, enabled boolean, alt_group int")
    assert rows_of(rules.enable_language(tracks, ["f"], "fr").orderBy("pos"), "enabled") == [(False,), (False,), (True,)]
    with pytest.raises(KeyError):
        rules.require_ids(tracks, "pos", [1, 9])
    queue = spark.createDataFrame([("a", "Working"), ("b", "Completed")], "path string, status string")
    assert rows_of(rules.admit_jobs(spark.createDataFrame([("a",), ("b",)], "path string"), queue), "path") == [("b",)]
    assert sorted(rows_of(rules.restart_jobs(queue), "status")) == [("Completed",), ("Ready",)]
    edits = spark.createDataFrame([(1, 1, "set", "t", "x"), (2, 2, "set", "t", "y"), (3, 2, "undo", None, None)], "seq int, txn int, op string, field string, new string")
    assert rows_of(rules.current_state(edits, ["field"]), "field", "value") == [("t", "x")]


def test_cuts_and_snaps_equal_plain_loops_over_batches(spark):
    """Long and short pieces, times that go back, runs that reach over Arrow batches."""
    import random

    rng = random.Random(8)
    rows, t = [], 0
    for i in range(4000):
        t += rng.choice([0, 1, 2, 3, -2, 40, 900 if i % 97 == 0 else 5])
        rows.append((("a", "b")[i % 50 == 0], i, t, rng.randrange(1, 9), rng.random() < 0.1))
    df = spark.createDataFrame(rows, "k string, i long, t long, d long, key boolean").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        cut = {r.i: r.chunk for r in stateful.greedy_cut(df, ["k"], ["i"], "t", 60, "d", 200).collect()}
        clusters = {r.i: r.cluster for r in stateful.cluster_cut(df, ["k"], ["i"], "t", "d", "key", max_ms=100, video_ms=30, max_bytes=150).collect()}
        snapped = {r.i: r.snapped for r in stateful.snap_contiguous(df, ["k"], ["i"], "t", "d", 25).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for k in "ab":
        start = size = at = base = held = end = None
        chunk = cluster = -1
        for _, i, t, d, key in (r for r in rows if r[0] == k):
            if start is None or t - start > 60 or size + d > 200:
                start, size, chunk = t, 0, chunk + 1
            size += d
            assert cut[i] == chunk
            if base is None or t - base >= 100 or t - base < -(1 << 15) or held + d > 150 or (key and t - base >= 30):
                base, held, cluster = max(t, 0), 0, cluster + 1
            held += d
            assert clusters[i] == cluster
            at = end if end is not None and abs(t - end) <= 25 else t
            end = at + d
            assert snapped[i] == at


def test_deep_reordering_by_a_heap(spark):
    import heapq
    import random

    rng = random.Random(4)
    pts = [rng.randrange(1000) for _ in range(300)]
    heap, want = [], []
    for p in pts:
        heapq.heappush(heap, p)
        if len(heap) > 16:
            want.append(heapq.heappop(heap))
    want += [heapq.heappop(heap) for _ in range(len(heap))]
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate(pts)], "k string, i long, pts long")
    assert [r.dts for r in stateful.bounded_reorder(df, ["k"], ["i"], "pts").orderBy("i").collect()] == want
