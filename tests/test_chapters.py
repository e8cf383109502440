"""Chapters in containers: nested atoms, editions, chapter tracks and lists."""

import struct

from pyspark.sql import functions as F

from tests.test_containers import element
from tests.test_ranges import content
from tidelane.sources import chapters, mp4, ranges


def atom(start, title=None, *more, hidden=None, enabled=None):
    shown = element(0x80, element(0x85, title.encode()) + element(0x437C, b"und")) if title is not None else b""
    flags = (element(0x98, bytes([hidden])) if hidden is not None else b"") + (element(0x4598, bytes([enabled])) if enabled is not None else b"")
    return element(0xB6, element(0x73C4, b"\1") + element(0x91, start.to_bytes(8)) + flags + shown + b"".join(more))


def film(*editions, unknown=False):
    parts = element(0x1549A966, b"info") + element(0x1F43B675, element(0xE7, b"\0") + element(0xA3, b"\x81\0\0\x80" + bytes(100)), unknown=unknown) + element(0x1F43B675, element(0xE7, b"\1"))
    return element(0x1A45DFA3, b"x") + element(0x18538067, parts + (element(0x1043A770, b"".join(editions)) if editions else b""), unknown=True)


def test_nested_atoms_of_the_default_edition(spark):
    ms = 1_000_000
    deep = atom(0, "One", atom(20 * ms, "Two", atom(10 * ms, "Three", atom(5 * ms, "hidden", hidden=1)), atom(15 * ms, "off", atom(16 * ms, "below"), enabled=0)))
    other = element(0x45B9, atom(99 * ms, "other"))
    chosen = element(0x45B9, element(0x45DB, b"\1") + deep + atom(7 * ms))
    first = element(0x45B9, element(0x45DB, b"\0") + atom(3 * ms + 999_999, "äß"))
    none = element(0x45B9, atom(1, "gone", hidden=1))
    files = content(spark, film(other, chosen), film(first, other, unknown=True), film(none), film(), b"junk", b"", None, film(chosen)[:-3])
    got = chapters.matroska_chapters(ranges.file_ranges(files, 64)).orderBy("path", "seq").collect()
    assert [(r.path, r.seq, r.start_ms, r.title) for r in got if r.path == "f0"] == [("f0", 1, 0, "One"), ("f0", 2, 7, ""), ("f0", 3, 10, "Three"), ("f0", 4, 16, "below"), ("f0", 5, 20, "Two")]
    assert [(r.start_ms, r.title) for r in got if r.path == "f1"] == [(3, "äß")] and {r.path for r in got} == {"f0", "f1"}


def text_samples(path, titles, edit=0):
    rows = []
    for n, (duration, title) in enumerate(titles):
        raw = title if isinstance(title, bytes) else title.encode()
        rows.append((path, 2, n, duration, 0, True, 1000, "text", "text", b"", 0, 0, struct.pack(">H", len(raw)) + raw + b"tail"))
    return [*rows, *[(path, 1, n, 512, 0, True, 12_800, "vide", "avc1", b"", 64, 64, b"frame") for n in range(30)]]


SCHEMA = "path string, track long, n long, duration long, shift long, sync boolean, timescale long, handler string, codec string, entry binary, width int, height int, payload binary"


def with_reference(data, edit):
    """A chapter reference put into the first track, an empty edit into the second, and a list into the movie."""
    start = data.index(b"moov") - 4
    size = struct.unpack_from(">I", data, start)[0]
    moov, tracks = data[start : start + size], []
    at = 8
    while at < len(moov):
        n = struct.unpack_from(">I", moov, at)[0]
        tracks.append(moov[at : at + n])
        at += n
    tref = mp4.box("tref", mp4.box("chap", struct.pack(">I", 2)))
    tracks[1] = mp4.box("trak", tracks[1][8:], tref)
    if edit:
        tracks[2] = mp4.box("trak", tracks[2][8:], mp4.box("edts", mp4.full_box("elst", 0, 0, struct.pack(">IIiI", 1, edit, -1, 0x10000))))
    chpl = mp4.full_box("chpl", 1, 0, bytes(4), bytes([2]), struct.pack(">QB", 50_000_000, 3), b"two", struct.pack(">QB", 0, 3), b"one")
    new = mp4.box("moov", *tracks, mp4.box("udta", chpl))
    return data[:start] + data[start + size :] + new, start, size


def test_chapter_tracks_and_lists(spark, tmp_path):
    titles = [(1500, "Intro"), (2000, b"\xfe\xff" + "Zwei é".encode("utf-16-be")), (10, b"\xff\xfe" + "Drei".encode("utf-16-le")), (1, "")]
    rows = text_samples("a", titles)
    mp4.written(mp4.mux(spark.createDataFrame(rows, SCHEMA)), f"file://{tmp_path}/out", tasks=1).count()
    data = (tmp_path / "out" / "a").read_bytes()
    index = ranges.scan_ranges(ranges.file_ranges(ranges.listed(spark, str(tmp_path / "out"))), ranges.mp4_index, ranges.INDEX_SCHEMA)
    assert chapters.track_chapters(index).count() == 0  # no track refers to it
    for edit in (0, 250):
        moved, start, size = with_reference(data, edit)
        # the movie went behind the payload, which moved up by its size: fill that gap before the payload
        filled = moved[:start] + mp4.box("free", bytes(size - 8)) + moved[start:]
        files = content(spark, filled)
        index = ranges.scan_ranges(ranges.file_ranges(files, 100), ranges.mp4_index, ranges.INDEX_SCHEMA)
        got = chapters.track_chapters(index, files).collect()
        assert sorted((r.seq, r.start_ms, r.title) for r in got) == [(1, edit, "Intro"), (2, 1500 + edit, "Zwei é"), (3, 3500 + edit, "Drei"), (4, 3510 + edit, "")]
        assert sorted((r.seq, r.start_ms, r.title) for r in chapters.nero_chapters(index).collect()) == [(1, 0, "one"), (2, 5000, "two")]
    assert chapters.track_chapters(index.where(F.lit(False)), files).count() == 0
