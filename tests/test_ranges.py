"""Split reads give the rows of whole-file reads for every cut point; fragments, program tables and written MP4 files."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_containers import element, packet, pes
from tidelane.sources import containers, mp4, programs, ranges


def content(spark, *files):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(files)], "path string, content binary")


def rows_of(reader, data, cuts):
    source, edges = ranges.Source.of(data), [0, *cuts, len(data)]
    out = []
    for a, b in zip(edges, edges[1:]):
        for columns in reader(source, a, b):
            cells = [c.to_pylist() if hasattr(c, "to_pylist") else c.tolist() for c in columns.values()]
            out += list(zip(*cells))
    return out


def stream_of(stride, rng, damage=True):
    packets = [packet(256 + i % 3, i % 4 == 0, i % 16, pes(i * 900, b"p") if i % 4 == 0 else bytes(rng.choice([0x47, 0, 1, 0x47]) for _ in range(rng.choice([184, 184, 100])))) for i in range(40)]
    pad = {188: (b"", b""), 192: (bytes(4), b""), 204: (b"", bytes(16))}[stride]
    parts = [pad[0] + p + pad[1] for p in packets]
    if damage:
        parts.insert(17, b"\0" * 31)
        parts[29] = b"\xff" + parts[29][1:] if stride != 192 else parts[29][:4] + b"\xff" + parts[29][5:]
    return b"".join(parts)


@pytest.mark.parametrize("stride", [188, 192, 204])
def test_transport_packets_for_every_cut(stride, monkeypatch):
    data = stream_of(stride, random.Random(stride))
    want = rows_of(ranges.ts_packets, data, [])
    assert len(want) == 39 or len(want) == 38
    for cut in range(1, len(data), 13):
        assert rows_of(ranges.ts_packets, data, [cut]) == want
    monkeypatch.setattr(ranges, "READ_BYTES", 500)
    assert rows_of(ranges.ts_packets, data, []) == want
    clean = stream_of(stride, random.Random(1), damage=False)
    plain = [(r[1], r[2], r[4], r[5]) for r in containers.ts_packets(clean)]
    assert [(r[1], r[2], r[5], r[6]) for r in rows_of(ranges.ts_packets, clean, [777])] == plain
    assert rows_of(ranges.ts_packets, b"G" * 100, []) == [] and rows_of(ranges.ts_packets, b"no stream" * 300, []) == []


def film(rng, unknown=False):
    frame = lambda t: element(0xA3, b"\x81" + struct.pack(">hB", t, 0x80) + bytes(rng.randrange(256) for _ in range(rng.randrange(60))) + b"\x1f\x43\xb6\x75\x84\xe7\x81\x05")
    clusters = b"".join(element(0x1F43B675, element(0xE7, bytes([c])) + b"".join(frame(t) for t in range(5)), unknown=unknown and c % 2) for c in range(8))
    return element(0x1A45DFA3, b"x") + element(0x18538067, element(0x1549A966, b"info") + clusters + element(0x1C53BB6B, b"cues"), unknown=True)


@pytest.mark.parametrize("unknown", [False, True])
def test_matroska_frames_for_every_cut(unknown, monkeypatch):
    data = film(random.Random(4), unknown)
    want = rows_of(ranges.matroska_frames, data, [])
    whole = [(r[0], r[4], r[6], r[7]) for r in containers.matroska_frames(data)]
    assert [(r[1], r[4], r[6], r[7]) for r in want] == whole and len(want) == 40
    for cut in range(1, len(data), 7):
        assert rows_of(ranges.matroska_frames, data, [cut]) == want
    monkeypatch.setattr(ranges, "READ_BYTES", 50)
    assert rows_of(ranges.matroska_frames, data, [100, 101, 400]) == want


def test_files_are_read_by_ranges(spark, tmp_path):
    data = stream_of(188, random.Random(2))
    (tmp_path / "a.ts").write_bytes(data)
    (tmp_path / "b.ts").write_bytes(b"")
    files = ranges.listed(spark, str(tmp_path))
    rows = ranges.scan_ranges(ranges.file_ranges(files, 1000, tasks=3), ranges.ts_packets, ranges.PACKET_SCHEMA)
    got = ranges.numbered_over_ranges(rows, ["packet"], "n").orderBy("n").collect()
    want = rows_of(ranges.ts_packets, data, [])
    assert [r.n for r in got] == list(range(len(want))) and [(r.packet, r.pid, bytes(r.payload)) for r in got] == [(w[0], w[1], w[7]) for w in want]
    back = ranges.with_payload(rows.drop("payload")).collect()
    assert {(r.packet, bytes(r.payload)) for r in back} == {(w[0], w[7]) for w in want}


def test_index_boxes_are_found_without_reading_payloads():
    data = mp4.box("ftyp", b"isom") + mp4.box("mdat", bytes(50_000_000)) + mp4.box("moov", mp4.box("mvhd", bytes(4)))
    read = []
    source = ranges.Source(lambda at, n: (read.append(n), data[at : at + n])[1], len(data))
    rows = [c for c in ranges.mp4_index(source, 0, len(data))]
    assert [r["kind"].to_pylist()[0] for r in rows] == ["ftyp", "mdat", "moov"] and sum(read) < 1_000_000
    assert list(ranges.mp4_index(source, 5, 9)) == []


# --- program tables ---


def section(table, extension, version, body):
    head = bytes([table]) + struct.pack(">HHBBB", 0xB000 | (len(body) + 9), extension, 0xC1 | version << 1, 0, 0) + body
    return head + struct.pack(">I", slow_crc(head))


def slow_crc(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def carried(pid, data, counter=0):
    data = b"\0" + data
    return [packet(pid, i == 0, (counter + i // 184) % 16, data[i : i + 184]) for i in range(0, len(data), 184)]


def stream_entry(kind, pid, *descriptors):
    held = b"".join(bytes([t, len(d)]) + d for t, d in descriptors)
    return struct.pack(">BHH", kind, 0xE000 | pid, 0xF000 | len(held)) + held


def test_crc_of_rows():
    rng = random.Random(3)
    rows = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 5, 300, 5, 12)]
    assert programs.mpeg_crc32(rows).tolist() == [slow_crc(r) for r in rows]
    assert programs.mpeg_crc32([section(0, 1, 0, b"abcd")]).tolist() == [0] and programs.mpeg_crc32([]).tolist() == []


def test_programs_over_packets_with_damage(spark):
    """A program map over three packets; one copy of it has a flipped bit, one breaks off; a later version replaces the first."""
    pat = section(0, 1, 0, struct.pack(">HHHHHH", 0, 0xE010, 1, 0xE100, 2, 0xE101))
    many = b"".join(stream_entry(0x1B if i % 2 else 0x0F, 0x200 + i, (0x05, b"AC-3"), (0x0A, b"deu\0"), (0x52, b"x" * 20)) for i in range(10))
    first, second = (section(2, 1, v, struct.pack(">HH", 0xE200, 0xF000) + many[: None if v else 300 + 6]) for v in (0, 1))
    other = section(2, 2, 3, struct.pack(">HH", 0xE300, 0xF003) + b"\x09\x01\x00" + stream_entry(0x24, 0x300) + stream_entry(0x81, 0x301, (0x0A, b"en")))
    bad = bytearray(section(2, 1, 5, struct.pack(">HH", 0xE200, 0xF000) + stream_entry(0x02, 0x250)))
    bad[14] ^= 4
    assert len(second) > 2 * 184
    packets = [*carried(0, pat), *carried(0x101, other), *carried(0x100, second), *carried(0x100, second)[:2], *carried(0, pat), *carried(0x100, second), *carried(0x100, bytes(bad))]
    packets += [packet(0x200, True, 0, pes(5, b"v")), packet(0x100, False, 0, b"stray")]
    data = content(spark, b"".join(packets), b"none")
    rows = ranges.scan_ranges(ranges.file_ranges(data, 400), ranges.ts_packets, ranges.PACKET_SCHEMA)
    found = programs.sections(rows.where("pid = 256"))
    assert [r.whole for r in found.orderBy("first_packet").collect()] == [True, False, True, True]
    assert sorted((r.version, r.crc_ok) for r in programs.parsed(found).collect()) == [(1, True), (5, False)]
    got = sorted((r.program, r.pid, r.stream_type, r.registration, r.language, r.version) for r in programs.programs(rows).collect())
    assert got == sorted([(1, 0x200 + i, 0x1B if i % 2 else 0x0F, "AC-3", "deu", 1) for i in range(10)] + [(2, 0x300, 0x24, None, None, 3), (2, 0x301, 0x81, None, None, 3)])
    assert first != second


def test_units_with_times_and_lengths(spark):
    stamp = lambda mark, t: bytes([mark << 4 | t >> 29 & 0x0E | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, (t & 0x7F) << 1 | 1])
    both = b"\0\0\1\xe0\0\0\x80\xc0\x0a" + stamp(3, (1 << 33) - 1) + stamp(1, 12345)
    told = b"\0\0\1\xbd" + struct.pack(">H", 3 + 5 + 4) + b"\x80\x80\x05" + stamp(2, 77) + b"datarest is stuffing"
    private = b"\0\0\1\xbf\0\x03xyz"
    packets = [packet(9, False, 0, b"early"), packet(9, True, 1, both + b"a" * 100), packet(9, False, 2, b"b" * 184), packet(8, True, 0, told), packet(9, True, 3, private), packet(8, True, 1, b"\0\0\2 no unit"), packet(8, True, 2, pes(1, b""))]
    rows = ranges.scan_ranges(ranges.file_ranges(content(spark, b"".join(packets)), 300), ranges.ts_packets, ranges.PACKET_SCHEMA)
    got = [(r.pid, r.pts, r.dts, r.packets, bytes(r.data)) for r in programs.units(rows).orderBy("pid", "unit").collect()]
    assert got == [(8, 77, None, 1, b"data"), (8, 1, None, 1, b""), (9, (1 << 33) - 1, 12345, 2, b"a" * 100 + b"b" * 184), (9, None, None, 1, b"xyz")]


# --- MP4 ---


def trun(flags, count, *fields, offset=None, first=None, version=0):
    return mp4.full_box("trun", version, flags, struct.pack(">I", count), struct.pack(">i", offset) if offset is not None else b"", struct.pack(">I", first) if first is not None else b"", *[struct.pack(">I", f & 0xFFFFFFFF) for f in fields])


def fragmented():
    trex = mp4.full_box("trex", 0, 0, struct.pack(">IIIII", 1, 1, 10, 100, 0x10000)), mp4.full_box("trex", 0, 0, struct.pack(">IIIII", 2, 1, 20, 7, 0))
    moov = mp4.box("moov", mp4.box("mvex", *trex))
    one = mp4.box("moof", mp4.box("traf", mp4.full_box("tfhd", 0, 0x20000, struct.pack(">I", 1)), trun(0x5, 3, offset=500, first=0), trun(0x200, 2, 30, 40)), mp4.box("traf", mp4.full_box("tfhd", 0, 0x8, struct.pack(">II", 2, 25)), mp4.full_box("tfdt", 1, 0, struct.pack(">Q", 9000)), trun(0xB00, 2, 1, 5, -3, 2, 6, 4, version=1)))
    two = mp4.box("moof", mp4.box("traf", mp4.full_box("tfhd", 0, 0x1, struct.pack(">IQ", 1, 1 << 33)), trun(0x400, 1, 0x10000)), mp4.box("traf", mp4.full_box("tfhd", 0, 0x10, struct.pack(">II", 2, 9)), trun(0x1, 2, offset=4)))
    return moov, one, two


def test_fragments_inherit_and_run_on(spark):
    moov, one, two = fragmented()
    data = mp4.box("ftyp", b"isom") + moov + one + mp4.box("mdat", bytes(99)) + two
    at_one = len(mp4.box("ftyp", b"isom") + moov)
    index = ranges.scan_ranges(ranges.file_ranges(content(spark, data), 64), ranges.mp4_index, ranges.INDEX_SCHEMA)
    begin = spark.createDataFrame([("f0", 1, 1000), ("f0", 2, 5)], "path string, track long, dts long")
    got = mp4.fragment_samples(index, begin).orderBy("track", "n").collect()
    a, end = at_one + 500, at_one + 500 + 370
    assert [(r.position, r["size"], r.dts, r.duration, r.shift, r.sync) for r in got if r.track == 1] == [
        (a, 100, 1000, 10, 0, True), (a + 100, 100, 1010, 10, 0, False), (a + 200, 100, 1020, 10, 0, False), (a + 300, 30, 1030, 10, 0, False), (a + 330, 40, 1040, 10, 0, False), (1 << 33, 100, 1050, 10, 0, False),
    ]
    assert [(r.position, r["size"], r.dts, r.duration, r.shift, r.sync) for r in got if r.track == 2] == [
        (end, 5, 9000, 1, -3, True), (end + 5, 6, 9001, 2, 4, True), ((1 << 33) + 104, 9, 9003, 20, 0, True), ((1 << 33) + 113, 9, 9023, 20, 0, True),
    ]
    with pytest.raises(ValueError):
        list(mp4.moof_samples(mp4.box("moof", mp4.box("traf", mp4.full_box("tfhd", 0, 0, struct.pack(">I", 1)), trun(0x200, 5, 1))), 0, {}))


def test_written_files_come_back(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for path in ("a.mp4", "b.mp4", "c.mp4"):
        for track, handler, codec, scale, n in ((1, "vide", "avc1", 90_000, 40), (2, "soun", "mp4a", 48_000, 90), (3, "text", "tx3g", 1000, 1)):
            for i in range(n if path != "c.mp4" else 1):
                rows.append((path, track, i, 3600 if track == 1 and i % 2 else 1024, (i % 3) * 100 - 100 if track == 1 else 0, track != 1 or i % 8 == 0, scale, handler, codec, b"entry", 640, 360, rng.bytes(int(rng.integers(0, 50)))))
    schema = "path string, track long, n long, duration long, shift long, sync boolean, timescale long, handler string, codec string, entry binary, width int, height int, payload binary"
    files = mp4.written(mp4.mux(spark.createDataFrame(rows, schema).repartition(5)), f"file://{tmp_path}/out", tasks=2)
    assert {r.path: r.bytes for r in files.collect()} == {p.name: p.stat().st_size for p in (tmp_path / "out").iterdir()}
    index = ranges.scan_ranges(ranges.file_ranges(ranges.listed(spark, str(tmp_path / "out"))), ranges.mp4_index, ranges.INDEX_SCHEMA)
    assert [r.kind for r in index.where("path like '%a.mp4'").orderBy("offset").collect()] == ["ftyp", "moov", "mdat"]
    back = ranges.with_payload(mp4.movie_samples(index)).withColumn("path", F.regexp_extract("path", r"[^/]*$", 0))
    got = sorted((r.path, r.track, r.n, r.duration, r.shift, r.sync, r.timescale, r.handler, r.codec, bytes(r.payload)) for r in back.collect())
    assert got == sorted((*r[:9], r[12]) for r in rows)
    sums = {}
    for p, t, n, d, *_ in sorted(rows):
        sums.setdefault((p, t), []).append(sum(sums.get((p, t, "d"), [])))
        sums.setdefault((p, t, "d"), []).append(d)
    assert all(r.dts == sums[r.path, r.track][r.n] for r in back.collect())


def test_offsets_beyond_four_gigabytes():
    track = {"track": 1, "timescale": 1000, "handler": "vide", "codec": "avc1", "entry": b"", "width": 1, "height": 1, "size": np.array([5, 6]), "duration": np.array([1, 1]), "shift": np.array([0, 0]), "sync": np.array([True, False]), "per_chunk": np.array([1, 1]), "chunk_at": np.array([0, 1 << 33])}
    head = mp4.file_head([track], (1 << 33) + 6)
    (name, at, width, size) = next(b for b in containers.mp4_boxes(head) if b[0] == "/moov")
    (found,) = mp4.moov_tracks(head[at : at + size])
    assert found["position"].tolist() == [len(head), len(head) + (1 << 33)] and found["sync"].tolist() == [True, False]
