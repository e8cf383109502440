"""The packet stream: restarts without loss or repeats, late consumers, files that grow."""

import random

import pytest

from tests.test_ranges import rows_of, stream_of
from tidelane.sources import live, ranges


def read_all(spark, path, place, growing):
    query = (
        spark.readStream.format("tidelane_packets").option("path", path).option("splitBytes", 900).option("growing", growing).load()
        .writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/at").start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted((r.path[-4:], r.packet, r.pid, bytes(r.payload)) for r in spark.read.schema(live.SCHEMA).parquet(f"{place}/rows").collect())


@pytest.mark.parametrize("growing", ["true", "false"])
def test_restarts_and_late_consumers(spark, tmp_path, growing):
    live.register(spark)
    one, two = stream_of(188, random.Random(1)), stream_of(188, random.Random(2), damage=False)
    folder = tmp_path / "in"
    folder.mkdir()
    path, early, late = str(folder), str(tmp_path / "early"), str(tmp_path / "late")
    expected = lambda *files: sorted((n, r[0], r[1], r[7]) for n, data in files for r in rows_of(ranges.ts_packets, data, []))
    if growing == "true":
        for n in (2000, 2001, 4567, len(one)):
            (folder / "a.ts").write_bytes(one[:n])
            got = read_all(spark, path, early, growing)
            want = [r for r in expected(("a.ts", one)) if r[1] < max(0, n - live.HELD_BACK)]
            assert got == want
    else:
        (folder / "a.ts").write_bytes(one)
        assert read_all(spark, path, early, growing) == expected(("a.ts", one))
        assert read_all(spark, path, early, growing) == expected(("a.ts", one))
        (folder / "b.ts").write_bytes(two)
        (folder / ".part").write_bytes(two)
        whole = expected(("a.ts", one), ("b.ts", two))
        assert read_all(spark, path, early, growing) == whole and read_all(spark, path, late, growing) == whole


def test_a_batch_that_runs_again_gives_the_same_rows(tmp_path):
    data = stream_of(188, random.Random(3))
    file = tmp_path / "a.ts"
    file.write_bytes(data[:5000])
    from pyspark.sql.types import StructType

    stream = live.PacketStream(str(file), 700, True, StructType.fromDDL(live.SCHEMA))
    end = stream.latestOffset()
    first = [b.to_pylist() for p in stream.partitions({}, end) for b in stream.read(p)]
    file.write_bytes(data)
    assert [b.to_pylist() for p in stream.partitions({}, end) for b in stream.read(p)] == first
    again = stream.latestOffset()
    rest = [r["packet"] for p in stream.partitions(end, again) for b in stream.read(p) for r in b.to_pylist()]
    both = [r["packet"] for rows in first for r in rows] + rest
    assert both == [r[0] for r in rows_of(ranges.ts_packets, data, []) if r[0] < again[str(file)][0]]
