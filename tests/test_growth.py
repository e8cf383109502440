"""Work that must grow with the input alone: what tasks hold, how many batches they make, and how often bytes are copied."""

import pyarrow as pa
import pytest

import __spark_entry__ as registry
from tidelane.operators import headers
from tidelane.sources import containers, detect, mkv


class Given:
    """A frame that hands over the function it is to be mapped by."""

    schema, columns = None, ["path", "content", "start", "stop"]

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self

    def groupBy(self, *_):
        raise StopIteration


def small_files(n):
    data = b"\0\0\1\x67ab\0\0\1\x65cd"
    return pa.RecordBatch.from_pydict({"path": [str(i) for i in range(n)], "content": [data] * n, "start": [0] * n, "stop": [len(data)] * n})


def test_first_samples_hand_on_before_they_have_read_all(spark):
    given, read = Given(), []

    def batches():
        for i in range(20):
            read.append(i)
            yield pa.RecordBatch.from_pydict({"track": [i * 10_000 + j for j in range(10_000)], "n": list(range(10_000))})

    with pytest.raises((StopIteration, AttributeError)):
        headers.first_samples(given, ["track"], "n", 3)
    out = given.run(batches())
    first = next(out)
    assert len(read) < 20 and first.num_rows + sum(b.num_rows for b in out) == 200_000


def test_rows_of_small_files_go_on_together(spark):
    given = Given()
    containers.scan(given, containers.annexb_units, containers.ANNEXB_SCHEMA)
    out = list(given.run(iter([small_files(500)])))
    assert len(out) == 1 and out[0].num_rows == 1000 and out[0].column("path")[999].as_py() == "499"


@pytest.mark.parametrize("name", ["q_dts_frames", "q_av1_units", "q_mp4_chapters", "q_fragmented", "q_matroska_chapters", "q_matroska_ranges", "q_tag_items"])
def test_bytes_are_joined_once(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan.replace("Aggregate", "")


def test_contents_do_not_meet_every_sample(spark):
    plan = registry.queries()["q_mp4_chapters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(rows" in plan


def test_bits_are_not_made_anew_for_every_byte(spark):
    plan = registry.queries()["q_codec_headers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "rpad(" not in plan


def test_clusters_are_made_without_a_call_for_each(spark):
    rows = [("a.mkv", 1, n, 1700 * n, n % 2 == 0, "video", "V", None, 16, 16, None, None, b"x") for n in range(9)]
    samples = spark.createDataFrame(rows, "path string, track long, n long, time_ms long, keyframe boolean, kind string, codec string, private binary, width int, height int, rate double, channels int, payload binary")
    made = mkv.mux(samples)
    assert made.count() == 3 + 2 and "GroupsInArrow" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_sidecars_are_dealt_by_the_counted_files(spark, monkeypatch):
    plan = registry.queries()["q_sidecars"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    monkeypatch.setattr(detect, "FOLDER_ROWS", 10, raising=False)
    names = [f"/m/{i}/{n}" for i in range(30) for n in ("b.mkv", "B.en.srt", "b.srt", "c.srt")]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    found = detect.sidecars(files, files.where("path like '%.mkv'"))
    assert ", 12)" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted((f"/m/{i}/b.mkv", f"/m/{i}/{n}", k) for i in range(30) for k, n in ((1, "B.en.srt"), (2, "b.srt")))


def test_a_content_is_read_once_for_all_its_samples(spark):
    plan = registry.queries()["q_mp4_chapters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # a column would be copied out of its row, whole, for each sample
    assert plan.count("substring(lambda ") == 1 and "substring(content" not in plan


@pytest.mark.parametrize("name", ["q_mp4_chapters", "q_fragmented", "q_matroska_chapters"])
def test_contents_are_sent_with_their_first_range_alone(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RepartitionByExpression [path") :].split("\n")[1:3]
    assert any("Filter (start" in line and "= 0)" in line for line in dealt)
