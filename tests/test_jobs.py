"""Job rules, data sources and exclusive writes."""

import struct

import pytest

from tidelane.operators import jobs
from tidelane.sources import datasource


def test_a_failure_isolates_its_job_and_a_stop_leaves_the_rest():
    done = []

    def process(path):
        if path == "b":
            raise OSError("cannot read")
        done.append(path)

    assert jobs.run_queue(["a", "b", "c"], process) == {"a": "Completed", "b": "Failed", "c": "Completed"}
    assert jobs.run_queue(["a", "d"], process, stop=lambda: "c" in done) == {"a": "Ready", "d": "Ready"}
    assert jobs.guarded("look-up", lambda: 1 / 0, []) == [] and jobs.guarded("look-up", lambda: 5, []) == 5


def test_writes_are_exclusive(spark, tmp_path):
    jobs.write_new(spark.range(3), f"file://{tmp_path}/x")
    with pytest.raises(Exception, match="(?i)exist"):
        jobs.write_new(spark.range(3), f"file://{tmp_path}/x")
    assert spark.read.parquet(f"file://{tmp_path}/x").count() == 3


def test_frames_are_read_and_files_written(spark, tmp_path):
    datasource.register(spark)
    frame = b"\xff\xf1\x50\x80" + bytes([20 >> 3, (20 & 7) << 5 | 0x1F, 0xFC]) + b"x" * 13
    ivf = b"DKIF" + struct.pack("<HH", 0, 32) + b"VP80" + b"\0" * 20 + struct.pack("<Iq", 3, 7) + b"abc"
    rows = [(f"in/{i}.aac", frame * (i + 1)) for i in range(3)] + [("ivf/a.ivf", ivf)]
    files = spark.createDataFrame(rows, "name string, content binary")
    files.write.format("tidelane_files").option("path", str(tmp_path)).mode("append").save()
    got = spark.read.format("tidelane_frames").option("path", f"{tmp_path}/in").option("kind", "adts").load()
    assert sorted((r.path.rsplit("/", 1)[1], r.n, r.position, r.size) for r in got.collect()) == sorted((f"{i}.aac", n, 20 * n, 20) for i in range(3) for n in range(i + 1))
    one = spark.read.format("tidelane_frames").option("path", f"file://{tmp_path}/ivf").option("kind", "ivf").load().first()
    assert (one.position, one.size, one.pts) == (44, 3, 7)
    with pytest.raises(Exception, match="FileExistsError"):
        files.write.format("tidelane_files").option("path", str(tmp_path)).mode("append").save()
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file() and not p.parent.name.startswith(".tidelane-")) == ["0.aac", "1.aac", "2.aac", "a.ivf"]
