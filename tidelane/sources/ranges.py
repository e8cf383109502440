"""Split reads of large media files: byte ranges as rows, read by position, each by a task of its own.

``file_ranges`` lists files without reading them and cuts each into ranges; ``scan_ranges`` maps a reader over the
ranges.  A reader gives what begins in its range and reads on past the end for what reaches over it, and finds where
things begin by the bytes around them alone, so for all cut points the rows are those of one range over the whole file.
Files are opened by Arrow's file systems (local, s3, gs, hdfs) and read by position; a file's size is not bounded.

Where a file's content is at hand as a column (``content``), ranges read that.  Defined results: null or empty
content and files of another format give no rows; a file that breaks off gives what is whole before the break.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SPLIT_BYTES = 64 << 20
READ_BYTES = 4 << 20
Columns = dict[str, np.ndarray]


class Source:
    """The bytes of a file by position; small reads are served from the block that was read last."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self._read, self.size = read, size
        self._at, self._block = 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not self._at <= at <= at + n <= self._at + len(self._block):
            self._at, self._block = at, self._read(at, min(max(n, 1 << 16), self.size - at))
        return self._block[at - self._at : at - self._at + n]

    @staticmethod
    def of(content: bytes) -> Source:
        return Source(lambda at, n: content[at : at + n], len(content))


def opened(path: str) -> Source:
    from pyarrow import fs

    place = path.replace("file:///", "/", 1) if path.startswith("file:///") else path.replace("file:/", "/", 1)
    files, inner = fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)
    file = files.open_input_file(inner)
    return Source(lambda at, n: file.read_at(n, at), file.size())


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of files; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))


def file_ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES, tasks: int | None = None) -> DataFrame:
    """(path, start, stop) of ranges of ``split_bytes``, dealt over ``tasks``; a column ``content`` goes along."""
    size = F.octet_length("content").cast("long") if "content" in files.columns else F.col("size")
    cut = files.where(size > 0).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), size - 1, F.lit(split_bytes).cast("long"))))
    rows = cut.select(*[c for c in ("path", "content") if c in files.columns], "start", F.least(F.col("start") + split_bytes, size).alias("stop"))
    return rows.repartition(tasks, "path", "start") if tasks else rows.repartition("path", "start")


def first_ranges(ranges: DataFrame) -> DataFrame:
    """The first range of each file, for readers that give all by it; a content at hand is then not sent once for every range."""
    return ranges.where("start = 0")


def joined_batches(batches: Iterator[pa.RecordBatch], rows: int = 4096, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of many small batches in fewer ones of about ``rows`` rows or ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    n = held_bytes = 0
    for batch in batches:
        held.append(batch)
        n, held_bytes = n + batch.num_rows, held_bytes + batch.nbytes
        if n >= rows or held_bytes >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, held_bytes = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def scan_ranges(ranges: DataFrame, reader: Callable[[Source, int, int], Iterator[Columns]], schema: str) -> DataFrame:
    """Rows of ``reader`` for each range, after the path and the range's start."""
    full = T.StructType.fromDDL(f"path string, range long, {schema}")
    arrow = to_arrow_schema(full)
    inline = "content" in ranges.columns

    def batch_of(held: list[tuple[str, int, Columns, int]]) -> pa.RecordBatch:
        """The rows of the pieces held as one batch, made column by column and not piece by piece."""
        n = [h[3] for h in held]
        cells = {"path": pa.array(np.repeat(np.array([h[0] for h in held], object), n), pa.string()), "range": pa.array(np.repeat([h[1] for h in held], n), pa.int64())}
        for f in list(arrow)[2:]:
            parts = [h[2][f.name] for h in held]
            if not all(isinstance(c, pa.Array) for c in parts):
                parts = [pa.array(np.concatenate(parts), f.type)] if all(isinstance(c, np.ndarray) for c in parts) else [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c in parts]
            cells[f.name] = pa.concat_arrays(parts) if len(parts) > 1 else parts[0]
        return pa.RecordBatch.from_arrays([cells[f.name] for f in arrow], schema=arrow)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, Columns, int]] = []
        rows = size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                path, start, stop = (batch.column(c)[i].as_py() for c in ("path", "start", "stop"))
                source = Source.of(batch.column("content")[i].as_py()) if inline else opened(path)
                for columns in reader(source, start, stop):
                    n = len(next(iter(columns.values())))
                    held.append((path, start, columns, n))
                    rows, size = rows + n, size + sum(c.nbytes for c in columns.values())
                    if rows >= 4096 or size >= 8 << 20 or len(held) >= 4096:
                        yield batch_of(held)
                        held, rows, size = [], 0, 0
        if held:
            yield batch_of(held)

    return ranges.mapInArrow(pieces, full)


def numbered_over_ranges(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add ``out``: each row's number in its file from 0, by counts of ranges first (no task sees a whole file)."""
    inside = F.row_number().over(Window.partitionBy("path", "range").orderBy(*order)) - 1
    counts = rows.groupBy("path", "range").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("path", "range", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    return rows.withColumn("__i", inside).join(before, ["path", "range"]).withColumn(out, F.col("__before") + F.col("__i")).drop("__i", "__before")


# --- transport streams -----------------------------------------------------------------------------

STRIDES = (188, 192, 204)
AROUND = 4


def stride_of(head: np.ndarray) -> int | None:
    """The first stride at which five sync bytes (or all that a short file can hold, two at least) stand from some start on."""
    for stride in STRIDES:
        for start in range(min(stride, len(head))):
            marks = head[start::stride][:5]
            full = marks[: max(0, (len(head) - start - 188) // stride + 1)] if len(head) < 5 * stride + start else marks
            if len(full) >= 2 and (full == 0x47).all():
                return stride
    return None


def sync_places(buf: np.ndarray, stride: int, begins: bool, ends: bool) -> np.ndarray:
    """Where packets begin in ``buf``, by the sync bytes within four strides on both sides alone.

    A sync byte counts with four others in a row around it; beyond the file's ends (``begins``, ``ends``) all
    are taken to stand.  Of two within one packet's length the one with more real others wins, then the first.
    """
    mark = buf == 0x47
    at = np.flatnonzero(mark)
    real, run = np.ones(len(at), np.int64), np.ones(len(at), np.int64)
    for side in (-1, 1):
        alive = np.ones(len(at), bool)
        for k in range(1, AROUND + 1):
            to = at + side * k * stride
            inside = (to >= 0) & (to < len(buf))
            hit = np.zeros(len(at), bool)
            hit[inside] = mark[to[inside]]
            alive &= hit | (~inside & (begins if side < 0 else ends))
            run += alive
            real += alive & hit
    good = (run >= 5) & (real >= 2)
    at, real = at[good], real[good]
    keep = np.ones(len(at), bool)
    for shift in range(1, 4):  # real packets lie a stride apart, so few others are that near
        if len(at) <= shift:
            break
        near = at[shift:] - at[:-shift] < 188
        later_wins = real[shift:] > real[:-shift]
        keep[:-shift] &= ~(near & later_wins)
        keep[shift:] &= ~(near & ~later_wins)
    return at[keep]


def ts_packets(source: Source, start: int, stop: int) -> Iterator[Columns]:
    """Packets that begin in the range, in blocks; the columns of ``PACKET_SCHEMA``."""
    stride = stride_of(np.frombuffer(source.read(0, 8 * max(STRIDES)), np.uint8))
    if stride is None:
        return
    margin = (AROUND + 2) * stride
    for at in range(start, stop, READ_BYTES):
        upto = min(at + READ_BYTES, stop)
        low, high = max(0, at - margin), min(source.size, upto + margin)
        buf = np.frombuffer(source.read(low, high - low), np.uint8)
        found = sync_places(buf, stride, low == 0, high == source.size)
        found = found[(found + low >= at) & (found + low < upto) & (found + 188 <= len(buf))]
        head = buf[found[:, None] + np.arange(5)]
        control = head[:, 3]
        begin = found + 4 + np.where(control & 0x20, 1 + head[:, 4].astype(np.int64), 0)
        access = (control & 0x20 > 0) & (head[:, 4] > 0) & (buf[np.minimum(found + 5, len(buf) - 1)] & 0x40 > 0)
        good = (control & 0x10 > 0) & (begin < found + 188) & (head[:, 1] & 0x80 == 0)
        found, head, begin, access = found[good], head[good], begin[good], access[good]
        data = [buf[a:b].tobytes() for a, b in zip(begin.tolist(), (found + 188).tolist(), strict=True)]
        yield {
            "packet": found + low, "pid": (head[:, 1].astype(np.int32) & 0x1F) << 8 | head[:, 2], "unit_start": head[:, 1] & 0x40 > 0, "continuity": head[:, 3].astype(np.int32) & 0x0F,
            "random_access": access, "position": begin + low, "size": (found + 188 - begin).astype(np.int32), "payload": pa.array(data, pa.binary()),
        }


PACKET_SCHEMA = "packet long, pid int, unit_start boolean, continuity int, random_access boolean, position long, size int, payload binary"


# --- Matroska --------------------------------------------------------------------------------------

CLUSTER = b"\x1f\x43\xb6\x75"
#: Ids of elements that may stand where a cluster ends (clusters, cues, tags, chapters, attachments, seek heads, information, tracks, void, CRC-32).
TOP_IDS = (b"\x1f\x43\xb6\x75", b"\x1c\x53\xbb\x6b", b"\x12\x54\xc3\x67", b"\x10\x43\xa7\x70", b"\x19\x41\xa4\x69", b"\x11\x4d\x9b\x74", b"\x15\x49\xa9\x66", b"\x16\x54\xae\x6b", b"\xec", b"\xbf")
UNKNOWN = -1


def ebml_size(head: bytes, at: int) -> tuple[int, int] | None:
    """(size, bytes that it takes) of an element's size; ``UNKNOWN`` for all ones."""
    if at >= len(head) or not head[at]:
        return None
    width = 9 - head[at].bit_length()
    if at + width > len(head):
        return None
    value = int.from_bytes(head[at : at + width]) & (1 << 7 * width) - 1
    return (UNKNOWN if value == (1 << 7 * width) - 1 else value), width


def cluster_at(source: Source, at: int) -> tuple[int, int] | None:
    """(first byte of its content, end) of the cluster at ``at``, if one begins there.

    It holds its time first (behind a CRC or void), and another top-level element or the file's end follows it.  A
    cluster of unknown size ends where the next one begins.
    """
    head = source.read(at, 64)
    found = ebml_size(head, 4) if head[:4] == CLUSTER else None
    if found is None:
        return None
    size, width = found
    first = at + 4 + width
    inner = head[4 + width :]
    if inner[:1] in (b"\xbf", b"\xec"):
        skip = ebml_size(inner, 1)
        inner = inner[1 + skip[1] + skip[0] :] if skip and skip[0] >= 0 else b""
    time = ebml_size(inner, 1) if inner[:1] == b"\xe7" else None
    if time is None or not 0 <= time[0] <= 8:
        return None
    if size == UNKNOWN:
        return first, next_cluster(source, first, source.size) or source.size
    end = first + size
    if end > source.size or (end < source.size and not source.read(end, 4).startswith(TOP_IDS)):
        return None
    return first, end


def next_cluster(source: Source, at: int, stop: int) -> int | None:
    """Where the first cluster at or behind ``at`` and before ``stop`` begins."""
    while at < stop:
        block = source.read(at, min(READ_BYTES, stop - at) + 3)
        place = block.find(CLUSTER)
        while place >= 0 and at + place < stop:
            if cluster_at(source, at + place):
                return at + place
            place = block.find(CLUSTER, place + 1)
        at += max(1, len(block) - 3)
    return None


def matroska_frames(source: Source, start: int, stop: int) -> Iterator[Columns]:
    """Frames of the clusters that begin in the range; the columns of ``FRAME_SCHEMA``."""
    from tidelane.sources.containers import cluster_frames

    if source.read(0, 4) != b"\x1a\x45\xdf\xa3":
        return
    held: list[tuple] = []
    at = next_cluster(source, start, stop)
    while at is not None:
        first, end = cluster_at(source, at)
        held += [(at, track, block, lace, time, key, position + first, size) for track, block, lace, time, key, position, size in cluster_frames(source.read(first, end - first))]
        if len(held) >= 4096:
            yield _frame_columns(held)
            held = []
        at = next_cluster(source, end, stop)
    if held:
        yield _frame_columns(held)


def _frame_columns(rows: list[tuple]) -> Columns:
    cluster, track, block, lace, time, key, position, size = zip(*rows, strict=True)
    return {"cluster": np.array(cluster), "track": np.array(track), "block": np.array(block), "lace": np.array(lace, np.int32), "time": np.array(time), "keyframe": pa.array(key, pa.bool_()), "position": np.array(position), "size": np.array(size)}


FRAME_SCHEMA = "cluster long, track long, block long, lace int, time long, keyframe boolean, position long, size long"


# --- MP4 -------------------------------------------------------------------------------------------


def top_boxes(source: Source, start: int = 0, stop: int | None = None) -> Iterator[tuple[str, int, int, int]]:
    """(kind, offset, header size, size) of a file's top-level boxes, by their headers alone."""
    at, stop = start, source.size if stop is None else stop
    while at + 8 <= stop:
        head = source.read(at, 16)
        size, width = int.from_bytes(head[:4]), 8
        if size == 1 and len(head) == 16:
            size, width = int.from_bytes(head[8:]), 16
        elif size == 0:
            size = source.size - at
        if size < width or at + size > source.size:
            return
        yield head[4:8].decode("latin-1"), at, width, size
        at += size


def mp4_index(source: Source, start: int, stop: int) -> Iterator[Columns]:
    """The top-level boxes of a file, with the bytes of those that index others (moov, moof); one row a box.

    A file's boxes are found one behind the other, so its first range gives them all.
    """
    if start:
        return
    for kind, at, width, size in top_boxes(source):
        body = source.read(at, size) if kind in ("moov", "moof") else None
        yield {"kind": pa.array([kind]), "offset": np.array([at]), "head": np.array([width], np.int32), "size": np.array([size]), "box": pa.array([body], pa.binary())}


INDEX_SCHEMA = "kind string, offset long, head int, size long, box binary"


# --- payloads --------------------------------------------------------------------------------------


def with_payload(rows: DataFrame, out: str = "payload") -> DataFrame:
    """Add the bytes at ``position`` of ``size`` in the file ``path``, read by position; near rows of a task share reads."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, Source] | None = None
        for batch in batches:
            cells = []
            for path, at, n in zip(*(batch.column(c).to_pylist() for c in ("path", "position", "size")), strict=True):
                if held is None or held[0] != path:
                    held = path, opened(path)
                cells.append(held[1].read(at, n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)
