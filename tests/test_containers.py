"""Container readers over small files built by hand."""

import struct

import pytest
from pyspark.sql import functions as F

from tidelane.operators.media import expand_sample_table
from tidelane.sources import containers as C


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def table(kind: bytes, form: str, rows: list[tuple]) -> bytes:
    return box(kind, bytes(4), struct.pack(">I", len(rows)), *[struct.pack(form, *r) for r in rows])


def mp4_file() -> bytes:
    stbl = box(
        b"stbl",
        box(b"stsd", bytes(4), struct.pack(">I", 1), box(b"avc1", bytes(8))),
        table(b"stts", ">II", [(3, 10), (2, 20)]),
        table(b"ctts", ">Ii", [(5, -1)]),
        table(b"stsc", ">III", [(1, 2, 1), (2, 3, 1)]),
        table(b"stco", ">I", [(100,), (200,)]),
        box(b"stsz", bytes(4), struct.pack(">II", 0, 5), *[struct.pack(">I", 7 + i) for i in range(5)]),
        table(b"stss", ">I", [(1,), (4,)]),
    )
    mdhd = box(b"mdhd", bytes(12), struct.pack(">II", 1000, 70), bytes(4))
    hdlr = box(b"hdlr", bytes(8), b"vide", bytes(12))
    tkhd = box(b"tkhd", bytes(12), struct.pack(">I", 9), bytes(60))
    edts = box(b"edts", table(b"elst", ">IiI", [(5, -1, 0), (70, 0, 0)]))
    return box(b"ftyp", b"isom", bytes(4)) + box(b"moov", box(b"trak", tkhd, edts, box(b"mdia", mdhd, hdlr, box(b"minf", stbl))))


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "path string, content binary")


def test_mp4_tables_expand_to_samples(spark):
    rows = C.scan(files(spark, mp4_file(), None, b"", b"junk"), C.mp4_tables, C.MP4_SCHEMA)
    assert {r.path for r in rows.collect()} == {"f0"}
    one = {r.kind: r for r in rows.where("entry = 0").collect()}
    assert (one["track"].a, one["media"].a, one["media"].b, one["handler"].text, one["codec"].text) == (9, 1000, 70, "vide", "avc1")
    assert (one["edit"].a, one["edit"].b, one["shift"].b) == (5, -1, -1)
    assert [r.a for r in rows.where("kind = 'size'").orderBy("entry").collect()] == [7, 8, 9, 10, 11]
    assert [r.a for r in rows.where("kind = 'sync'").orderBy("entry").collect()] == [1, 4]
    samples = expand_sample_table(*C.mp4_runs(rows), ["path", "track"]).orderBy("seq").collect()
    assert [(r.dts, r.chunk) for r in samples] == [(0, 1), (10, 1), (20, 2), (30, 2), (50, 2)]


def test_mp4_broken_off():
    whole = mp4_file()
    for n in range(0, len(whole), 7):
        assert len(list(C.mp4_tables(whole[:n]))) <= len(list(C.mp4_tables(whole)))
    assert list(C.mp4_tables(box(b"moov", box(b"trak", box(b"tkhd", bytes(8)))))) == []


def element(kind: int, body: bytes, unknown: bool = False) -> bytes:
    head = kind.to_bytes((kind.bit_length() + 7) // 8)
    return head + (b"\x01" + b"\xff" * 7 if unknown else (len(body) | 1 << 56).to_bytes(8)) + body


def test_matroska_frames_and_lacing(spark):
    simple = element(0xA3, b"\x81" + struct.pack(">hB", 5, 0x80) + b"abc")
    xiph = element(0xA0, element(0xA1, b"\x82" + struct.pack(">hB", -2, 0x02) + bytes([2, 1, 2]) + b"xyywww"))
    ebml = element(0xA3, b"\x81" + struct.pack(">hB", 7, 0x06) + bytes([2, 0x81, 0xC0]) + b"xyyzzz")  # sizes 1, 1 + 1, rest
    fixed = element(0xA3, b"\x81" + struct.pack(">hB", 9, 0x04) + bytes([1]) + b"aabb")
    data = element(0x1A45DFA3, b"") + element(0x18538067, element(0x1F43B675, element(0xE7, b"\x03\xe8") + simple + xiph + ebml) + element(0x1F43B675, element(0xE7, b"\x00") + fixed), unknown=True)
    got = C.scan(files(spark, data, None), C.matroska_frames, C.MATROSKA_SCHEMA).orderBy("block", "lace").collect()
    assert [(r.track, r.cluster, r.time, r.keyframe, data[r.position : r.position + r.size]) for r in got] == [
        (1, 0, 1005, True, b"abc"),
        (2, 0, 998, None, b"x"), (2, 0, 998, None, b"yy"), (2, 0, 998, None, b"www"),
        (1, 0, 1007, False, b"x"), (1, 0, 1007, False, b"yy"), (1, 0, 1007, False, b"zzz"),
        (1, 1, 9, False, b"aa"), (1, 1, 9, False, b"bb"),
    ]
    for n in range(len(data)):
        list(C.matroska_frames(data[:n]))


def packet(pid: int, start: bool, counter: int, payload: bytes) -> bytes:
    stuffing = 184 - len(payload)
    field = b"" if stuffing == 0 else bytes([stuffing - 1]) + (b"\0" + b"\xff" * (stuffing - 2) if stuffing > 1 else b"")
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 0xFF, (0x30 if stuffing else 0x10) | counter]) + field + payload


def pes(pts: int, body: bytes) -> bytes:
    stamp = bytes([0x21 | pts >> 30 << 1, pts >> 22 & 0xFF, 1 | (pts >> 15 & 0x7F) << 1, pts >> 7 & 0xFF, 1 | (pts & 0x7F) << 1])
    return b"\0\0\1\xe0\0\0\x80\x80\x05" + stamp + body


@pytest.mark.parametrize("stride", [188, 192, 204])
def test_transport_packets_and_units(spark, stride):
    big = (1 << 33) - 5
    packets = [packet(256, False, 0, b"early"), packet(256, True, 1, pes(big, b"a" * 20)), packet(256, False, 2, b"b" * 184), packet(257, True, 0, pes(7, b"")), packet(256, True, 3, pes(90000, b"c")), packet(257, False, 1, b"d")]
    pad = {188: (b"", b""), 192: (bytes(4), b""), 204: (b"", bytes(16))}[stride]
    data = b"".join(pad[0] + p + pad[1] for p in packets)
    rows = C.scan(files(spark, data, b"no stream"), C.ts_packets, C.TS_SCHEMA)
    units = C.ts_units(rows).orderBy("pid", "unit").collect()
    assert [(r.pid, r.pts, r.packets) for r in units] == [(256, big, 2), (256, 90000, 1), (257, 7, 2)]


def test_transport_resync():
    first, second = (b"".join(packet(256, True, i % 16, pes(i, b"x")) for i in r) for r in (range(6), range(6, 9)))
    assert [r[-1] for r in C.ts_packets(first + b"\0" * 31 + second)] == list(range(9))


def page(serial: int, n: int, flags: int, granule: int, lacing: list[int]) -> bytes:
    return b"OggS\0" + struct.pack("<BqIII", flags, granule, serial, n, 0) + bytes([len(lacing), *lacing]) + b"p" * sum(lacing)


def test_ogg_packets_over_pages(spark):
    data = page(1, 0, 2, 0, [10, 20]) + page(1, 1, 0, -1, [5, 255, 255]) + page(1, 2, 1, -1, [255]) + page(2, 0, 2, 3, [4]) + page(1, 3, 1, 960, [0, 8, 255])
    rows = C.scan(files(spark, data, None), C.ogg_segments, C.OGG_SCHEMA)
    got = C.ogg_packets(rows).orderBy("serial", "packet").collect()
    assert [(r.serial, r.size, r.granule) for r in got] == [(1, 10, -1), (1, 20, 0), (1, 5, -1), (1, 765, -1), (1, 8, 960), (2, 4, 3)]


def test_elementary_frames(spark):
    frame = lambda body: bytes([0xFF, 0xF1, 0x4C, 0x80 | (7 + len(body)) >> 11, (7 + len(body)) >> 3 & 0xFF, ((7 + len(body)) & 7) << 5, 0]) + body
    data = frame(b"abc") + b"??" + frame(b"") + frame(b"z" * 500)
    got = C.scan(files(spark, data, None), C.adts_frames, C.ADTS_SCHEMA).orderBy("n").collect()
    assert [(r.position, r.size, r.rate, r.channels) for r in got] == [(0, 10, 48000, 2), (12, 7, 48000, 2), (19, 507, 48000, 2)]
    assert list(C.annexb_units(b"\0\0\0\1\x67ab\0\0\1\x68\0\0\0\1\x65cd")) == [(0, 4, 3, 0x67), (1, 10, 1, 0x68), (2, 15, 3, 0x65)]
    ivf = b"DKIF\0\0\x20\0AV01" + bytes(20) + struct.pack("<Iq", 3, 0) + b"abc" + struct.pack("<Iq", 2, 40) + b"de"
    frames = C.scan(files(spark, ivf, b"x"), C.ivf_frames, C.IVF_SCHEMA)
    joined = frames.join(files(spark, ivf), "path").select("n", "pts", C.payload(F.col("content"), F.col("position"), F.col("size")).alias("data"))
    assert [(r.pts, bytes(r.data)) for r in joined.orderBy("n").collect()] == [(0, b"abc"), (40, b"de")]
