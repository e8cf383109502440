"""Frames with checks, written Matroska films and tags in bytes."""

import random
import struct

import numpy as np
import pytest

from tests.test_ranges import content
from tidelane.sources import chapters, elementary, mkv, mp4, ranges, tagbytes
from tidelane.sources import containers as C


def slow_crc(data, width, polynomial):
    value = 0
    for bit in "".join(format(b, "08b") for b in data) + "0" * width:
        value = value << 1 | int(bit)
        if value >> width:
            value ^= polynomial | 1 << width
    return value


def test_checks():
    rng = random.Random(1)
    for n in (0, 1, 7, 60):
        data = rng.randbytes(n)
        assert elementary.crc8(data) == slow_crc(data, 8, 0x07) and elementary.crc16(data) == slow_crc(data, 16, 0x8005)


def ac3(rng, rate_code, size_code, mode=7, low=1):
    size = elementary.ac3_size(rate_code, size_code)
    head = bytes([rate_code << 6 | size_code, 8 << 3]) + (mode << 13 | low << (12 - (2 * (mode & 1 and mode != 1) + 2 * bool(mode & 4) + 2 * (mode == 2)))).to_bytes(2)
    body = b"\0\0" + head + b"\x0b\x77" + rng.randbytes(size - 12)
    return b"\x0b\x77" + body + elementary.crc16(body).to_bytes(2)


def eac3(rng, size):
    body = bytes([(size // 2 - 1) >> 8, (size // 2 - 1) & 255, 0 << 6 | 3 << 4 | 7 << 1 | 1, 16 << 3]) + b"\x0b\x77" + rng.randbytes(size - 10)
    return b"\x0b\x77" + body + elementary.crc16(body).to_bytes(2)


def test_ac3_frames_with_false_syncs(spark):
    rng = random.Random(2)
    frames = [ac3(rng, 0, 16), eac3(rng, 300), ac3(rng, 1, 9, mode=2, low=0), ac3(rng, 2, 0, mode=1, low=0)]
    bad = bytearray(ac3(rng, 0, 16))
    bad[100] ^= 1
    data = b"junk\x0b\x77" + frames[0] + frames[1] + bytes(bad) + frames[2] + b"\x0b\x77" + frames[3] + frames[0][:-1]
    got = C.scan(content(spark, data, b"", None), elementary.ac3_frames, elementary.AC3_SCHEMA).orderBy("n").collect()
    assert [(data[r.position : r.position + r["size"]], r.rate, r.channels, r.kbps, r.extended) for r in got] == [(frames[0], 48_000, 6, 128, False), (frames[1], 48_000, 6, 0, True), (frames[2], 44_100, 2, 64, False), (frames[3], 32_000, 1, 32, False)]
    assert [elementary.ac3_size(1, c) for c in (0, 1, 37)] == [138, 140, 2788] and elementary.ac3_size(0, 37) == 2560 and elementary.ac3_size(3, 0) is None


def test_dts_frames_with_false_syncs(spark):
    rng = random.Random(3)
    frame = lambda size: elementary.dts_head(size, 512, 48_000) + elementary.DTS_SYNC + rng.randbytes(size - 14)
    frames = [frame(200), frame(96), frame(1000)]
    data = b"\x7f\xfe\x80\x01" + bytes(20) + b"".join(frames)
    got = C.scan(content(spark, data, data[:-1]), elementary.dts_frames, elementary.DTS_SCHEMA).orderBy("path", "n").collect()
    assert [(data[r.position : r.position + r["size"]], r.samples, r.rate) for r in got if r.path == "f0"] == [(f, 512, 48_000) for f in frames]
    assert len([r for r in got if r.path == "f1"]) == 2


def flac(rng, number, code=12, n=80):
    coded = bytes([number]) if number < 128 else bytes([0xC0 | number >> 6, 0x80 | number & 63]) if number < 2048 else bytes([0xE0 | number >> 12, 0x80 | number >> 6 & 63, 0x80 | number & 63])
    head = b"\xff\xf8" + bytes([code << 4 | 9, 0x18]) + coded + (struct.pack(">H", 999) if code == 7 else b"\x63" if code == 6 else b"")
    body = head + bytes([elementary.crc8(head)]) + b"\xff\xf8\xc9\x18" + rng.randbytes(n)
    return body + elementary.crc16(body).to_bytes(2)


def test_flac_frames_with_false_syncs(spark):
    rng = random.Random(4)
    inner = flac(rng, 3, n=4)[:8]  # a sound header inside a payload
    odd = flac(rng, 5, n=0)[:-2] + inner + rng.randbytes(30)
    frames = [flac(rng, 0), flac(rng, 200, code=7), odd + elementary.crc16(odd).to_bytes(2), flac(rng, 5000, code=6)]
    bad = bytearray(flac(rng, 9))
    bad[40] ^= 8
    head = b"fLaC" + b"\0\0\0\x22" + bytes(34) + b"\x81\0\0\x04" + b"\xff\xf8\xc9\x18"
    data = head + frames[0] + frames[1] + bytes(bad) + frames[2] + frames[3]
    got = C.scan(content(spark, data, b"fLaC", b""), elementary.flac_frames, elementary.FLAC_SCHEMA).orderBy("n").collect()
    assert [(data[r.position : r.position + r["size"]], r.number, r.samples, r.rate) for r in got] == [(f, k, s, 44_100) for f, k, s in zip(frames, (0, 200, 5, 5000), (4096, 1000, 4096, 100), strict=True)]


def test_av1_units(spark):
    leb = lambda n: bytes([n & 0x7F | 0x80, n >> 7 & 0x7F | 0x80, n >> 14]) if n > 127 else bytes([n])
    unit = lambda kind, body, layers=None: bytes([kind << 3 | 2 | (4 if layers is not None else 0)]) + (bytes([layers]) if layers is not None else b"") + leb(len(body)) + body
    data = unit(2, b"") + unit(1, b"seq") + unit(6, b"f" * 300, 0x28) + unit(2, b"") + unit(6, b"x")
    got = C.scan(content(spark, data + bytes([6 << 3]) + b"rest", unit(6, b"abc")[:-1]), elementary.obu_units, elementary.OBU_SCHEMA).orderBy("path", "n").collect()
    assert [(r.unit, r.kind, r.temporal, r.spatial, r["size"]) for r in got] == [(0, 2, 0, 0, 0), (0, 1, 0, 0, 3), (0, 6, 1, 1, 300), (1, 2, 0, 0, 0), (1, 6, 0, 0, 1)]
    assert elementary.leb128(b"\x80" * 9, 0) is None


def test_written_films_come_back(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for path in ("a.mkv", "b.mkv"):
        for track, kind, codec, step, n in ((1, "video", "V_MPEG4/ISO/AVC", 40, 400), (2, "audio", "A_AAC", 21, 700), (3, "subtitle", "S_TEXT/UTF8", 9000, 2)):
            for i in range(n):
                rows.append((path, track, i, i * step + (7 if track == 3 else 0), track != 1 or i % 50 == 0, kind, codec, b"private" if track == 1 else None, 640, 360, 48_000.0, 2, rng.bytes(int(rng.integers(0, 40)))))
    schema = "path string, track long, n long, time_ms long, keyframe boolean, kind string, codec string, private binary, width int, height int, rate double, channels int, payload binary"
    files = mp4.written(mkv.mux(spark.createDataFrame(rows, schema).repartition(4)), f"file://{tmp_path}/out", tasks=2)
    assert {r.path: r.bytes for r in files.collect()} == {p.name: p.stat().st_size for p in (tmp_path / "out").iterdir()}
    frames = ranges.scan_ranges(ranges.file_ranges(ranges.listed(spark, str(tmp_path / "out")), 9000, tasks=4), ranges.matroska_frames, ranges.FRAME_SCHEMA)
    got = sorted((r.path[-5:], r.track, r.time, r.keyframe, bytes(r.payload)) for r in ranges.with_payload(frames).collect())
    assert got == sorted((r[0], r[1], r[3], r[4], r[12]) for r in rows)
    data = (tmp_path / "out" / "a.mkv").read_bytes()
    start = data.index(mkv.SEGMENT.to_bytes(4)) + 12
    tree = list(chapters.ebml_tree(data[start:], {mkv.SEEK_HEAD, mkv.SEEK, mkv.CUES, mkv.CUE, mkv.CUE_PLACES}))
    assert int.from_bytes(data[start - 7 : start]) == len(data) - start
    at = [int.from_bytes(c) for *_, k, c in tree if k in (mkv.SEEK_PLACE, mkv.CUE_CLUSTER)]
    heads = [data[start + p : start + p + 4] for p in at]
    assert heads[:3] == [k.to_bytes(4) for k in (mkv.INFO, mkv.TRACKS, mkv.CUES)] and set(heads[3:]) == {mkv.CLUSTER.to_bytes(4)} and len(heads) == 3 + 3  # the last cluster has no keyframe


def test_item_lists_round_trip(spark):
    rows = [("a", 0, "©nam", 1, "Tïtle".encode()), ("a", 1, "covr", 13, b"\xff\xd8jpeg"), ("a", 2, "----:com.apple.iTunes:iTunEXTC", 1, b"mpaa|PG|200|"), ("a", 3, "trkn", 0, b"\0\0\0\1\0\2\0\0"), ("b", 5, "©ART", 1, None)]
    table = spark.createDataFrame(rows, "path string, pos long, name string, kind int, value binary")
    lists = tagbytes.write_items(table)
    got = tagbytes.read_items(lists.unionByName(spark.createDataFrame([("c", None), ("d", b"\0\0\0\xffjunk")], "path string, content binary"))).collect()
    assert sorted((r.path, r.pos, r.name, r.kind, bytes(r.value)) for r in got) == [("a", 0, "©nam", 1, "Tïtle".encode()), ("a", 1, "covr", 13, b"\xff\xd8jpeg"), ("a", 2, "----:com.apple.iTunes:iTunEXTC", 1, b"mpaa|PG|200|"), ("a", 3, "trkn", 0, b"\0\0\0\1\0\2\0\0"), ("b", 0, "©ART", 1, b"")]
    inner = next(bytes(r.content) for r in lists.collect() if r.path == "a")
    moov = mp4.box("moov", mp4.box("udta", mp4.full_box("meta", 0, 0, mp4.full_box("hdlr", 0, 0, bytes(20)), mp4.box("ilst", inner))))
    index = ranges.scan_ranges(ranges.file_ranges(content(spark, moov, mp4.box("moov", b""))), ranges.mp4_index, ranges.INDEX_SCHEMA)
    assert [bytes(r.content) for r in tagbytes.item_lists(index).collect()] == [inner]


def test_comment_blocks_round_trip(spark):
    rows = [("a", 0, "Title", "Ä = b"), ("a", 1, "ARTIST", "x"), ("a", 2, "artist", None), ("b", 0, "K", "v" * 300)]
    blocks = tagbytes.write_comments(spark.createDataFrame(rows, "path string, pos long, name string, value string"))
    got = sorted(tuple(r) for r in tagbytes.read_comments(blocks).collect())
    assert got == [("a", 0, "TITLE", "Ä = b", "tidelane"), ("a", 1, "ARTIST", "x", "tidelane"), ("a", 2, "ARTIST", "", "tidelane"), ("b", 0, "K", "v" * 300, "tidelane")]
    raw = next(bytes(r.content) for r in blocks.collect() if r.path == "a")
    assert raw[:4] == struct.pack("<I", 8) and len(list(tagbytes.comment_rows(raw[:-2]))) == 2 and list(tagbytes.comment_rows(b"\1")) == []
    assert list(tagbytes.comment_rows(b"\0\0\0\0\1\0\0\0\3\0\0\0abc")) == [(0, "", "abc", "")]


@pytest.mark.parametrize("uid", [7, -3])
def test_matroska_tags_round_trip(spark, uid):
    rows = [("a", 0, 50, None, "TITLE", "Öl", "deu"), ("a", 1, 30, uid, "BPS", "128", None), ("a", 2, 50, None, "DATE", None, "und"), ("b", 0, 70, None, "COLLECTION", "c", "eng")]
    blocks = tagbytes.write_matroska_tags(spark.createDataFrame(rows, "path string, pos long, level int, track_uid long, name string, value string, language string"))
    got = sorted((r.path, r.level, r.track_uid, r.name, r.value, r.language) for r in tagbytes.read_matroska_tags(blocks).collect())
    assert sorted(got, key=str) == sorted([(p, lv, u, n, v, g or "und") for p, _, lv, u, n, v, g in rows], key=str)
    nested = mkv.element(tagbytes.TAG, mkv.element(tagbytes.SIMPLE, mkv.element(tagbytes.NAME, b"ARTIST"), mkv.element(tagbytes.TEXT, b"x"), mkv.element(tagbytes.SIMPLE, mkv.element(tagbytes.NAME, b"URL"), mkv.element(tagbytes.TEXT, b"u"))))
    assert [r[:2] + r[4:6] for r in tagbytes.tag_rows(nested)] == [(0, -1, "ARTIST", "x"), (1, 0, "URL", "u")]
