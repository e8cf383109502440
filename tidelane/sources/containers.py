"""Binary containers as tables: MP4 sample tables, Matroska frames, transport packets, Ogg pages, elementary frames.

A parser is a generator over one file's bytes that yields rows; ``scan`` maps it over a frame of
(path, content) in Arrow batches, so files are spread over tasks and nothing is shuffled.  What needs
more than one row (packets from pages, units from packets, samples from runs) is left to DataFrame
operators on the result.  ``binaryFile`` hands over whole files, so a file is at most 2 GB.

Defined results: null or empty content and files of another format give no rows (ADTS and Annex B
have no magic, so chance matches count); a file that breaks off gives the rows before the break.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Parser = Callable[[bytes], Iterator[tuple]]
BATCH_ROWS = 20_000


def scan(files: DataFrame, parser: Parser, schema: str) -> DataFrame:
    """Rows of ``parser`` for each file, after its path."""
    full = T.StructType.fromDDL(f"path string, {schema}")
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []  # the rows of many small files go on together
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                for row in parser(content.as_py() or b""):
                    held.append((path, *row))
                    if len(held) == BATCH_ROWS:
                        yield _batch(held, arrow)
                        held = []
            if held:
                yield _batch(held, arrow)

    return files.select("path", "content").mapInArrow(run, full)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


# --- MP4 ---------------------------------------------------------------------------------------

_HOLDERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"moof", b"traf", b"mvex", b"udta"}


def mp4_boxes(data: bytes, at: int = 0, end: int | None = None, parents: str = "") -> Iterator[tuple[str, int, int, int]]:
    """(box path, offset, header size, size) of the box tree; holders before what they hold."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        name = f"{parents}/{kind.decode('latin-1')}"
        yield name, at, head, size
        if kind in _HOLDERS:
            yield from mp4_boxes(data, at + head, at + size, name)
        at += size


def _pairs(data: bytes, at: int, end: int, form: str) -> Iterator[tuple[int, tuple]]:
    """(index, values) of a counted table after version, flags and count."""
    n, width = struct.unpack_from(">I", data, at + 4)[0], struct.calcsize(form)
    for i in range(min(n, (end - at - 8) // width)):
        yield i, struct.unpack_from(form, data, at + 8 + i * width)


def mp4_tables(data: bytes) -> Iterator[tuple]:
    """(track, entry, kind, a, b, text) of every track's tables, in file order.

    Kinds: ``track`` (a track id), ``media`` (a timescale, b duration), ``handler`` (text), ``codec``
    (text), ``duration`` (a samples, b delta), ``shift`` (a samples, b offset), ``chunk_run`` (a first
    chunk, b samples a chunk), ``chunk`` (a offset), ``size`` (a bytes; b samples of that size), ``sync``
    (a sample from 1), ``edit`` (a duration, b media time).
    """
    try:
        yield from _mp4_rows(data)
    except (IndexError, struct.error):  # a box too short for its kind
        return


def _mp4_rows(data: bytes) -> Iterator[tuple]:
    track = -1
    for name, at, head, size in mp4_boxes(data):
        body, leaf = at + head, name[-4:]
        if leaf == "trak":
            track += 1
        if "/trak/" not in name or size < head + 8:
            continue
        long = data[body] == 1
        if leaf == "tkhd":
            yield track, 0, "track", struct.unpack_from(">I", data, body + (20 if long else 12))[0], None, None
        elif leaf == "mdhd":
            yield track, 0, "media", *struct.unpack_from(">IQ" if long else ">II", data, body + (20 if long else 12)), None
        elif leaf == "hdlr":
            yield track, 0, "handler", None, None, data[body + 8 : body + 12].decode("latin-1")
        elif leaf == "stsd" and size >= head + 16:
            yield track, 0, "codec", None, None, data[body + 12 : body + 16].decode("latin-1")
        elif leaf in ("stts", "ctts"):
            kind, form = ("duration", ">II") if leaf == "stts" else ("shift", ">Ii")
            for i, (n, value) in _pairs(data, body, at + size, form):
                yield track, i, kind, n, value, None
        elif leaf == "stsc":
            for i, (first, per_chunk, _) in _pairs(data, body, at + size, ">III"):
                yield track, i, "chunk_run", first, per_chunk, None
        elif leaf in ("stco", "co64"):
            for i, (offset,) in _pairs(data, body, at + size, ">I" if leaf == "stco" else ">Q"):
                yield track, i, "chunk", offset, None, None
        elif leaf == "stsz":
            fixed, n = struct.unpack_from(">II", data, body + 4)
            if fixed:
                yield track, 0, "size", fixed, n, None
            else:
                for i, (each,) in _pairs(data, body + 4, at + size, ">I"):
                    yield track, i, "size", each, 1, None
        elif leaf == "stss":
            for i, (sample,) in _pairs(data, body, at + size, ">I"):
                yield track, i, "sync", sample, None, None
        elif leaf == "elst":
            for i, values in _pairs(data, body, at + size, ">QqI" if long else ">IiI"):
                yield track, i, "edit", values[0], values[1], None


MP4_SCHEMA = "track int, entry long, kind string, a long, b long, text string"


def mp4_runs(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The duration and chunk runs of ``mp4_tables`` in the form that ``expand_sample_table`` takes."""
    runs = tables.where("kind = 'duration'").select("path", "track", F.col("entry").alias("run"), F.col("a").alias("n"), F.col("b").alias("delta"))
    chunks = tables.where("kind = 'chunk_run'").select("path", "track", F.col("a").alias("first_chunk"), F.col("b").alias("per_chunk"))
    return runs, chunks


# --- Matroska ----------------------------------------------------------------------------------

_SEGMENT, _CLUSTER, _GROUP = 0x18538067, 0x1F43B675, 0xA0
_SIMPLE, _BLOCK, _TIME = 0xA3, 0xA1, 0xE7


def ebml_number(data: bytes, at: int, *, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, position after it) of a variable-length number; a size of all ones is None (unknown)."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise IndexError(at)
    value = int.from_bytes(data[at : at + width])
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def _lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first one begins."""
    if not lacing:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            first = at
            raw, at = ebml_number(data, at)
            bias = 0 if i == 0 else (1 << 7 * (at - first) - 1) - 1
            size = (raw if raw is not None else (1 << 7 * (at - first)) - 1) - bias + (sizes[-1] if i else 0)
        sizes.append(size)
    return [*sizes, end - at - sum(sizes)], at


def cluster_frames(data: bytes) -> Iterator[tuple]:
    """(track, block, lace, time, keyframe, position, size) of the frames in a cluster's content; blocks count from 0 here."""
    at, base, block = 0, 0, 0
    try:
        while at < len(data):
            kind, at = ebml_number(data, at, keep_marker=True)
            size, at = ebml_number(data, at)
            if kind == _GROUP:
                continue
            end = len(data) if size is None else at + size
            if end > len(data):
                return
            if kind == _TIME:
                base = int.from_bytes(data[at:end])
            elif kind in (_SIMPLE, _BLOCK):
                track, here = ebml_number(data, at)
                shift, flags = struct.unpack_from(">hB", data, here)
                sizes, here = _lace_sizes(data, here + 3, end, flags >> 1 & 3)
                for lace, each in enumerate(sizes):
                    yield track, block, lace, base + shift, bool(flags & 0x80) if kind == _SIMPLE else None, here, each
                    here += each
                block += 1
            at = end
    except (IndexError, struct.error):
        return


def matroska_frames(data: bytes) -> Iterator[tuple]:
    """(track, cluster, block, lace, time, keyframe, position, size) of all frames; times in the segment's ticks."""
    at, base, cluster, block = 0, 0, -1, 0
    if data[:4] != b"\x1a\x45\xdf\xa3":
        return
    try:
        while at < len(data):
            kind, at = ebml_number(data, at, keep_marker=True)
            size, at = ebml_number(data, at)
            if kind in (_SEGMENT, _CLUSTER, _GROUP):
                cluster += kind == _CLUSTER
                continue  # what they hold comes next
            end = len(data) if size is None else at + size
            if end > len(data):
                return
            if kind == _TIME:
                base = int.from_bytes(data[at:end])
            elif kind in (_SIMPLE, _BLOCK):
                track, here = ebml_number(data, at)
                shift, flags = struct.unpack_from(">hB", data, here)
                sizes, here = _lace_sizes(data, here + 3, end, flags >> 1 & 3)
                for lace, each in enumerate(sizes):
                    yield track, cluster, block, lace, base + shift, bool(flags & 0x80) if kind == _SIMPLE else None, here, each
                    here += each
                block += 1
            at = end
    except (IndexError, struct.error):
        return


MATROSKA_SCHEMA = "track long, cluster long, block long, lace int, time long, keyframe boolean, position long, size long"


# --- transport streams ---------------------------------------------------------------------------


def packet_stride(data: bytes) -> tuple[int, int] | None:
    """(stride, first sync byte) of a transport stream: the first of 188, 192 and 204 bytes that holds five times."""
    for stride in (188, 192, 204):
        for start in range(min(stride, len(data))):
            marks = data[start : start + 5 * stride : stride]
            if marks and marks == b"\x47" * len(marks) and (len(marks) == 5 or start + stride * len(marks) >= len(data) > stride):
                return stride, start
    return None


def ts_packets(data: bytes) -> Iterator[tuple]:
    """(n, pid, unit_start, continuity, position, size, pts) of packets with payload; sync is sought anew after damage."""
    found = packet_stride(data)
    if found is None:
        return
    stride, at, n = *found, 0
    while at + 188 <= len(data):
        if data[at] != 0x47:
            at += 1
            continue
        flags, pid = data[at + 1], (data[at + 1] & 0x1F) << 8 | data[at + 2]
        control = data[at + 3]
        begin = at + 4 + (1 + data[at + 4] if control & 0x20 else 0)
        if control & 0x10 and begin < at + 188 and not flags & 0x80:
            start = bool(flags & 0x40)
            yield n, pid, start, control & 0x0F, begin, at + 188 - begin, _pts(data, begin, at + 188) if start else None
        n, at = n + 1, at + stride


def _pts(data: bytes, at: int, end: int) -> int | None:
    if at + 14 > end or data[at : at + 3] != b"\0\0\1" or not data[at + 7] & 0x80:
        return None
    p = data[at + 9 : at + 14]
    return (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1


TS_SCHEMA = "n long, pid int, unit_start boolean, continuity int, position long, size int, pts long"


def ts_units(packets: DataFrame) -> DataFrame:
    """Units (a packet with unit_start and those after it on its PID) with PTS, size and packet count; packets before the first start go."""
    w = Window.partitionBy("path", "pid").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    numbered = packets.withColumn("unit", F.sum(F.col("unit_start").cast("long")).over(w)).where("unit > 0")
    return numbered.groupBy("path", "pid", "unit").agg(F.max("pts").alias("pts"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("packets"), F.min("position").alias("position"))


# --- Ogg -----------------------------------------------------------------------------------------


def ogg_segments(data: bytes) -> Iterator[tuple]:
    """(serial, page, part, continued, ends, granule, position, size): runs of a packet's segments inside one page.

    ``continued`` says that the packet began on an earlier page, ``ends`` that it ends here; the
    granule is the page's, on the last packet that ends there (-1: none).
    """
    at = data.find(b"OggS")
    while 0 <= at and at + 27 <= len(data):
        flags, granule, serial, page = struct.unpack_from("<xBqII", data, at + 4)
        count = data[at + 26]
        lacing = data[at + 27 : at + 27 + count]
        position, parts, size = at + 27 + count, [], 0
        for value in lacing:
            size += value
            if value < 255:
                parts.append((True, size))
                size = 0
        if count and lacing[-1:] == b"\xff":
            parts.append((False, size))
        if len(lacing) < count or position + sum(lacing) > len(data):
            return
        last = max((i for i, (ends, _) in enumerate(parts) if ends), default=-1)
        for i, (ends, size) in enumerate(parts):
            yield serial, page, i, bool(flags & 1) and i == 0, ends, granule if i == last else -1, position, size
            position += size
        at = data.find(b"OggS", position)


OGG_SCHEMA = "serial long, page long, part int, continued boolean, ends boolean, granule long, position long, size long"


def ogg_packets(segments: DataFrame) -> DataFrame:
    """(path, serial, packet, size, granule, position): a packet's parts over all its pages; unfinished ones go."""
    w = Window.partitionBy("path", "serial").orderBy("page", "part").rowsBetween(Window.unboundedPreceding, 0)
    numbered = segments.withColumn("packet", F.sum((~F.col("continued")).cast("long")).over(w) - 1).where("packet >= 0")
    packets = numbered.groupBy("path", "serial", "packet").agg(F.sum("size").alias("size"), F.max("granule").alias("granule"), F.min_by("position", F.struct("page", "part")).alias("position"), F.max("ends").alias("done"))
    return packets.where("done").drop("done")


# --- elementary streams ----------------------------------------------------------------------------

_ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def adts_frames(data: bytes) -> Iterator[tuple]:
    """(n, position, size, rate, channels) of ADTS frames; bytes between frames are skipped."""
    at, n = 0, 0
    while at + 7 <= len(data):
        size = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
        rate = data[at + 2] >> 2 & 0x0F
        if data[at] != 0xFF or data[at + 1] & 0xF6 != 0xF0 or size < 7 or rate >= len(_ADTS_RATES) or at + size > len(data):
            at += 1
            continue
        yield n, at, size, _ADTS_RATES[rate], (data[at + 2] & 1) << 2 | data[at + 3] >> 6
        n, at = n + 1, at + size


ADTS_SCHEMA = "n long, position long, size int, rate int, channels int"


def annexb_units(data: bytes) -> Iterator[tuple]:
    """(n, position, size, head) of the units between start codes; trailing zero bytes belong to none."""
    at, n = data.find(b"\0\0\1"), 0
    while at >= 0:
        begin = at + 3
        at = data.find(b"\0\0\1", begin)
        unit = data[begin : at if at >= 0 else len(data)].rstrip(b"\0")
        if unit:
            yield n, begin, len(unit), unit[0]
            n += 1


ANNEXB_SCHEMA = "n long, position long, size long, head int"


def ivf_frames(data: bytes) -> Iterator[tuple]:
    """(n, position, size, pts) of IVF frames."""
    if data[:4] != b"DKIF" or len(data) < 32:
        return
    at, n = struct.unpack_from("<H", data, 6)[0], 0
    while at + 12 <= len(data):
        size, pts = struct.unpack_from("<Iq", data, at)
        if at + 12 + size > len(data):
            return
        yield n, at + 12, size, pts
        n, at = n + 1, at + 12 + size


IVF_SCHEMA = "n long, position long, size long, pts long"


def payload(content: Column, position: Column, size: Column) -> Column:
    """The bytes of a row that holds a pointer into its file: fetch them last, for the rows that are written."""
    return F.substring(content, position.cast("int") + 1, size.cast("int"))
