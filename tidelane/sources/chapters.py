"""Chapters inside containers: Matroska editions, MP4 chapter tracks and Nero lists, as (path, seq, start_ms, title).

The small index parts are read by position and flattened to rows by the task that holds them; which edition counts, the
track that holds the titles, their order and their text are left to DataFrame operators.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.sources import mp4, ranges
from tidelane.sources.containers import ebml_number, mp4_boxes

#: Matroska ids of chapters and of the elements that hold others.
CHAPTERS, EDITION, ATOM, DISPLAY = 0x1043A770, 0x45B9, 0xB6, 0x80
DEFAULT, HIDDEN, ENABLED, START, TITLE = 0x45DB, 0x98, 0x4598, 0x91, 0x85
SEGMENT_ID = b"\x18\x53\x80\x67"
CLUSTER_ID = 0x1F43B675


def ebml_tree(data: bytes, holders: set[int], at: int = 0, end: int | None = None, depth: int = 0, parent: int = -1) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(place, parent's place, depth, id, content) of all elements, holders (with no content here) before what they hold."""
    end = len(data) if end is None else end
    while at < end:
        try:
            place = at
            kind, at = ebml_number(data, at, keep_marker=True)
            size, at = ebml_number(data, at)
        except IndexError:
            return
        stop = end if size is None else at + size
        if stop > end:
            return
        yield place, parent, depth, kind, b"" if kind in holders else data[at:stop]
        if kind in holders:
            yield from ebml_tree(data, holders, at, stop, depth + 1, place)
        at = stop


def _top_elements(source: ranges.Source) -> Iterator[tuple[int, int, int]]:
    """(id, content's place, size) of a Matroska file's elements below the segment, by their heads alone."""
    at, inside = 0, False
    while at < source.size:
        head = source.read(at, 12)
        try:
            kind, n = ebml_number(head, 0, keep_marker=True)
            size, n = ebml_number(head, n)
        except IndexError:
            return
        if head[:4] == SEGMENT_ID:
            at, inside = at + n, True
            continue
        if size is None:
            after = ranges.next_cluster(source, at + n, source.size) if kind == CLUSTER_ID else None
            size = (after or source.size) - at - n
        if inside and at + n + size <= source.size:
            yield kind, at + n, size
        at += n + size


def atoms(source: ranges.Source, start: int, stop: int) -> Iterator[ranges.Columns]:
    """All chapter atoms of all editions of a file, by its first range; the columns of ``ATOM_SCHEMA``."""
    if start or source.read(0, 4) != b"\x1a\x45\xdf\xa3":
        return
    number = lambda b: int.from_bytes(b)
    for kind, at, size in _top_elements(source):
        if kind != CHAPTERS:
            continue
        rows: dict[int, list] = {}
        owner, edition, default = {-1: None}, -1, {}
        for place, parent, depth, element, content in ebml_tree(source.read(at, size), {EDITION, ATOM, DISPLAY}):
            owner[place] = owner.get(parent)
            if element == EDITION:
                edition += 1
            elif element == DEFAULT:
                default[edition] = number(content) != 0
            elif element == ATOM:
                owner[place] = place
                rows[place] = [edition, depth, 0, False, True, None]
            elif owner[place] in rows:
                row = rows[owner[place]]
                if element == START:
                    row[2] = number(content)
                elif element == HIDDEN:
                    row[3] = number(content) != 0
                elif element == ENABLED:
                    row[4] = number(content) != 0
                elif element == TITLE and row[5] is None:
                    row[5] = content.rstrip(b"\0").decode("utf-8", "replace")
        if edition >= 0:
            rows = rows or {-1: [0, 0, 0, True, False, None]}
            columns = list(zip(*rows.values(), strict=True))
            yield {"edition": np.array(columns[0], np.int32), "is_default": np.array([default.get(e, False) for e in columns[0]]), "atom": np.array(list(rows)), "depth": np.array(columns[1], np.int32), "start_ns": np.array(columns[2]), "hidden": np.array(columns[3]), "enabled": np.array(columns[4]), "title": pa.array(columns[5], pa.string())}
        return


ATOM_SCHEMA = "edition int, is_default boolean, atom long, depth int, start_ns long, hidden boolean, enabled boolean, title string"


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("path").orderBy(*order)).cast("long")
    return rows.withColumn("seq", seq).select("path", "seq", "start_ms", "title")


def matroska_chapters(files: DataFrame) -> DataFrame:
    """Visible, enabled chapters of each file's default (else first) edition, nested ones with all others, by start.

    ``files``: rows of ``ranges.file_ranges``.
    """
    rows = ranges.scan_ranges(ranges.first_ranges(files), atoms, ATOM_SCHEMA)
    chosen = rows.groupBy("path").agg(F.coalesce(F.min(F.when(F.col("is_default"), F.col("edition"))), F.min("edition")).alias("edition"))
    kept = rows.join(chosen, ["path", "edition"]).where("enabled and not hidden")
    return _numbered(kept.withColumns({"start_ms": F.floor(F.col("start_ns") / 1_000_000), "title": F.coalesce("title", F.lit(""))}), ["start_ns", "atom"])


# --- MP4 -------------------------------------------------------------------------------------------

REFERENCE_SCHEMA = "track long, chapter_track long, movie_scale long, empty_edit long"


def _movie_references(box: bytes) -> Iterator[tuple[int, int]]:
    """(track, chapter track) by the references of tracks."""
    track = 0
    for name, at, head, size in mp4_boxes(box):
        body, leaf = at + head, name[-4:]
        if leaf == "tkhd":
            track = struct.unpack_from(">I", box, body + (20 if box[body] == 1 else 12))[0]
        elif leaf == "tref":
            for kind, place, width, n in mp4_boxes(box, body, at + size):
                if kind == "/chap":
                    for i in range((n - width) // 4):
                        yield track, struct.unpack_from(">I", box, place + width + 4 * i)[0]


def _first_edits(box: bytes) -> dict[int, int]:
    """The length of a track's first edit where that is empty, by track id, in the movie's time."""
    track, found = 0, {}
    for name, at, head, size in mp4_boxes(box):
        body, leaf = at + head, name[-4:]
        if leaf == "tkhd":
            track = struct.unpack_from(">I", box, body + (20 if box[body] == 1 else 12))[0]
        elif leaf == "elst" and size >= head + 8 + (20 if box[body] == 1 else 12) and struct.unpack_from(">I", box, body + 4)[0]:
            duration, media = struct.unpack_from(">Qq" if box[body] == 1 else ">Ii", box, body + 8)
            if media == -1:
                found[track] = duration
    return found


def _movie_scale(box: bytes) -> int:
    for name, at, head, _ in mp4_boxes(box):
        if name == "/moov/mvhd":
            return struct.unpack_from(">I", box, at + head + (20 if box[at + head] == 1 else 12))[0]
    return 0


def references(index: DataFrame) -> DataFrame:
    """(path, track, chapter_track, movie_scale, empty_edit) of a file's references to chapter tracks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, cell in zip(batch.column("path").to_pylist(), batch.column("box"), strict=True):
                box = cell.as_py()
                edits, scale = _first_edits(box), _movie_scale(box)
                rows += [(path, t, c, scale, edits.get(c, 0)) for t, c in _movie_references(box)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=["path", "track", "chapter_track", "movie_scale", "empty_edit"])

    return index.where("kind = 'moov'").select("path", "box").mapInArrow(run, f"path string, {REFERENCE_SCHEMA}")


def sample_title(data: Column) -> Column:
    """The text of a sample behind its length of two bytes: UTF-16 with a byte order mark, else UTF-8."""
    told = F.conv(F.hex(F.substring(data, 1, 2)), 16, 10).cast("int")
    text = F.substring(data, F.lit(3), F.least(told, F.octet_length(data) - 2))
    marked = F.hex(F.substring(text, 1, 2)).isin("FEFF", "FFFE")
    return F.when(F.octet_length(data) >= 2, F.when(marked, F.decode(F.when(marked, text), "UTF-16")).otherwise(F.decode(F.when(~marked, text), "UTF-8")))


def track_chapters(index: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """Chapters of the text tracks that others refer to.

    Titles are read from the files by position, or joined from ``payloads`` (path, content) where contents are at hand.
    """
    refs = references(index).select("path", F.col("chapter_track").alias("track"), "movie_scale", "empty_edit").distinct()
    samples = mp4.movie_samples(index).join(refs, ["path", "track"]).where("size >= 2")
    if payloads is None:
        read = ranges.with_payload(samples)
    else:
        # a file's content meets its samples once and is bound by the outer lambda: a column would be copied whole at each use;
        # no list is empty, and an inner explode would have the join make them all once more to tell
        wanted = samples.groupBy("path").agg(F.collect_list(F.struct(*[c for c in samples.columns if c != "path"])).alias("rows"))
        cut = lambda content, x: F.struct(x.alias("row"), F.substring(content, (x["position"] + 1).cast("int"), x["size"].cast("int")).alias("payload"))
        rows = F.element_at(F.transform(F.array("content"), lambda content: F.transform("rows", lambda x: cut(content, x))), 1)
        read = wanted.join(payloads, "path").select("path", rows.alias("rows")).select("path", F.explode_outer("rows").alias("x")).select("path", "x.row.*", "x.payload")
    late = F.coalesce(F.col("empty_edit") * 1000 / F.nullif(F.col("movie_scale"), F.lit(0)), F.lit(0.0))
    start = F.greatest(F.floor(F.col("dts") * 1000 / F.col("timescale") + late), F.lit(0))
    return _numbered(read.select("path", start.cast("long").alias("start_ms"), sample_title(F.col("payload")).alias("title"), "track", "n"), ["start_ms", "track", "n"])


def nero_chapters(index: DataFrame) -> DataFrame:
    """Chapters of the list in a movie's user data (times of 100 ns, titles of 255 bytes at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, int, int, str]] = []
            for path, cell in zip(batch.column("path").to_pylist(), batch.column("box"), strict=True):
                box = cell.as_py()
                for name, at, head, size in mp4_boxes(box):
                    if name != "/moov/udta/chpl":
                        continue
                    here, end = at + head + (8 if box[at + head] == 1 else 4), at + size
                    for n in range(box[here] if here < end else 0):
                        here += 1 if n == 0 else 0
                        if here + 9 > end or here + 9 + box[here + 8] > end:
                            break
                        size_of = box[here + 8]
                        rows.append((path, n, struct.unpack_from(">Q", box, here)[0] // 10_000, box[here + 9 : here + 9 + size_of].decode("utf-8", "replace")))
                        here += 9 + size_of
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "n", "start_ms", "title"])

    rows = index.where("kind = 'moov'").select("path", "box").mapInArrow(run, "path string, n long, start_ms long, title string")
    return _numbered(rows, ["start_ms", "n"])
