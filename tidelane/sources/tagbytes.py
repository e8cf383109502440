"""Tags as bytes: MP4 item lists, Vorbis comment blocks and Matroska tags, read to rows and written from rows.

Readers are maps over files; writers build a file's block from its rows with byte expressions, ordered by ``pos``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.bits import joined_bytes
from tidelane.sources.chapters import ebml_tree
from tidelane.sources.containers import mp4_boxes

#: Matroska ids of tags.
TAGS, TAG, TARGETS, LEVEL, TRACK_UID, SIMPLE, NAME, TEXT, LANGUAGE = 0x1254C367, 0x7373, 0x63C0, 0x68CA, 0x63C5, 0x67C8, 0x45A3, 0x4487, 0x447A
ITEM_SCHEMA = "pos long, name string, kind int, value binary"
TAG_SCHEMA = "pos long, parent long, level int, track_uid long, name string, value string, language string"


def _mapped(blocks: DataFrame, parser, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *row) for path, cell in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True) for row in parser(cell.as_py() or b"")]
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *types], strict=True)], names=["path", *names])

    return blocks.select("path", "content").mapInArrow(run, f"path string, {schema}")


# --- MP4 item lists --------------------------------------------------------------------------------


def item_rows(data: bytes) -> Iterator[tuple]:
    """(pos, name, kind, value) of an item list's content; a free-form item is named by its domain and name, each value of an item is a row."""
    pos = 0
    for path, at, head, size in mp4_boxes(data):
        name, mean, own = path[1:], "", ""
        for inner, place, width, n in mp4_boxes(data, at + head, at + size):
            body, end = place + width, place + n
            if inner == "/mean":
                mean = data[body + 4 : end].decode("utf-8", "replace")
            elif inner == "/name":
                own = data[body + 4 : end].decode("utf-8", "replace")
            elif inner == "/data" and end - body >= 8:
                yield pos, f"----:{mean}:{own}" if name == "----" else name, struct.unpack_from(">I", data, body)[0] & 0xFFFFFF, data[body + 8 : end]
                pos += 1


def read_items(blocks: DataFrame) -> DataFrame:
    """(path, pos, name, kind, value) of item lists (``content``: what the ilst box holds)."""
    return _mapped(blocks, item_rows, ITEM_SCHEMA)


def item_lists(index: DataFrame) -> DataFrame:
    """(path, content) of the item lists in the moov boxes of ``ranges.mp4_index`` rows."""

    def found(data: bytes) -> bytes | None:
        for name, at, head, size in mp4_boxes(data):
            if name == "/moov/udta":
                for inner, place, width, n in mp4_boxes(data, at + head, at + size):
                    if inner == "/meta":
                        for leaf, p, w, m in mp4_boxes(data, place + width + 4, place + n):
                            if leaf == "/ilst":
                                return data[p + w : p + m]
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([found(b or b"") for b in batch.column("box").to_pylist()], pa.binary())], names=["path", "content"])

    return index.where("kind = 'moov'").select("path", "box").mapInArrow(run, "path string, content binary").where("content is not null")


def _u32(c: Column | int) -> Column:
    return F.unhex(F.lpad(F.hex(F.lit(c) if isinstance(c, int) else c), 8, "0"))


def _box(kind: Column, *parts: Column) -> Column:
    body = F.concat(*parts)
    return F.concat(_u32(8 + F.octet_length(body)), kind, body)


def _joined(df: DataFrame, piece: Column) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("pos", piece.alias("b"))))
    return df.groupBy("path").agg(joined_bytes(F.transform(rows, lambda x: x["b"])).alias("content"), F.count(F.lit(1)).alias("n"))


def write_items(items: DataFrame) -> DataFrame:
    """(path, content) of item lists; names have four characters of Latin-1 or are ``----:domain:name``."""
    free = F.col("name").startswith("----:")
    text = lambda c: F.encode(c, "UTF-8")
    data = _box(F.lit(b"data"), _u32(F.col("kind")), _u32(0), F.coalesce("value", F.lit(b"")))
    mean, own = F.regexp_extract("name", r"^----:([^:]*):(.*)$", 1), F.regexp_extract("name", r"^----:([^:]*):(.*)$", 2)
    named = _box(F.lit(b"----"), _box(F.lit(b"mean"), _u32(0), text(mean)), _box(F.lit(b"name"), _u32(0), text(own)), data)
    return _joined(items, F.when(free, named).otherwise(_box(F.encode(F.when(free, F.lit("----")).otherwise(F.col("name")), "ISO-8859-1"), data))).select("path", "content")


# --- Vorbis comments -------------------------------------------------------------------------------


def comment_rows(data: bytes) -> Iterator[tuple]:
    """(pos, name, value, vendor) of a comment block; names in upper case, a comment without an equals sign has an empty one."""
    at, texts = 0, []
    try:
        (size,) = struct.unpack_from("<I", data, at)
        vendor, at = data[4 : 4 + size].decode("utf-8", "replace"), 4 + size
        (n,) = struct.unpack_from("<I", data, at)
        at += 4
        for pos in range(n):
            (size,) = struct.unpack_from("<I", data, at)
            if at + 4 + size > len(data):
                return
            name, mark, value = data[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
            texts.append((pos, name.upper() if mark else "", value if mark else name, vendor))
            yield texts[-1]
            at += 4 + size
    except struct.error:
        return


def read_comments(blocks: DataFrame) -> DataFrame:
    return _mapped(blocks, comment_rows, "pos long, name string, value string, vendor string")


def _le32(c: Column | int) -> Column:
    h = F.lpad(F.hex(F.lit(c) if isinstance(c, int) else c), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def write_comments(tags: DataFrame, vendor: str = "tidelane") -> DataFrame:
    """(path, content) of comment blocks from (path, pos, name, value)."""
    comment = F.encode(F.concat(F.upper("name"), F.lit("="), F.coalesce("value", F.lit(""))), "UTF-8")
    held = _joined(tags, F.concat(_le32(F.octet_length(comment)), comment))
    return held.select("path", F.concat(_le32(len(vendor.encode())), F.lit(vendor.encode()), _le32(F.col("n")), F.col("content")).alias("content"))


# --- Matroska tags ---------------------------------------------------------------------------------


def tag_rows(data: bytes) -> Iterator[tuple]:
    """(pos, parent, level, track_uid, name, value, language) of a Tags element's content; nested tags name the pos of their parent (-1: none)."""
    rows: dict[int, list] = {}
    owner: dict[int, int] = {-1: -1}
    target: dict[int, list] = {}
    tag = -1
    for place, parent, _, kind, content in ebml_tree(data, {TAG, TARGETS, SIMPLE}):
        owner[place] = owner.get(parent, -1)
        if kind == TAG:
            tag, target[place] = place, [50, None]
        elif kind == LEVEL and tag >= 0:
            target[tag][0] = int.from_bytes(content)
        elif kind == TRACK_UID and tag >= 0:
            target[tag][1] = int.from_bytes(content) - (1 << 64 if content[:1] >= b"\x80" and len(content) == 8 else 0)
        elif kind == SIMPLE:
            rows[place] = [owner[place], tag, "", None, "und"]
            owner[place] = place
        elif owner[place] in rows:
            row = rows[owner[place]]
            text = content.rstrip(b"\0").decode("utf-8", "replace")
            if kind == NAME:
                row[2] = text
            elif kind == TEXT:
                row[3] = text
            elif kind == LANGUAGE:
                row[4] = text
    order = {place: i for i, place in enumerate(rows)}
    for place, (parent, held, name, value, language) in rows.items():
        yield order[place], order.get(parent, -1), *target.get(held, [50, None]), name, value, language


def read_matroska_tags(blocks: DataFrame) -> DataFrame:
    return _mapped(blocks, tag_rows, TAG_SCHEMA)


def _element(kind: int, *parts: Column) -> Column:
    body = F.concat(*parts)
    return F.concat(F.lit(kind.to_bytes((kind.bit_length() + 7) // 8)), F.unhex(F.concat(F.lit("01"), F.lpad(F.hex(F.octet_length(body)), 14, "0"))), body)


def write_matroska_tags(tags: DataFrame) -> DataFrame:
    """(path, content) of Tags elements from (path, pos, level, track_uid, name, value, language): one Tag a target, in order of its first row."""
    text = lambda c: F.encode(F.coalesce(c, F.lit("")), "UTF-8")
    simple = _element(SIMPLE, _element(NAME, text(F.col("name"))), F.when(F.col("value").isNotNull(), _element(TEXT, text(F.col("value")))).otherwise(F.lit(b"")), _element(LANGUAGE, text(F.coalesce("language", F.lit("und")))))
    rows = F.sort_array(F.collect_list(F.struct("pos", simple.alias("b"))))
    grouped = tags.groupBy("path", "level", "track_uid").agg(F.min("pos").alias("pos"), joined_bytes(F.transform(rows, lambda x: x["b"])).alias("simples"))
    uid = F.when(F.col("track_uid").isNotNull(), _element(TRACK_UID, F.unhex(F.lpad(F.hex(F.coalesce("track_uid", F.lit(0).cast("long"))), 16, "0")))).otherwise(F.lit(b""))
    target = _element(TARGETS, _element(LEVEL, F.unhex(F.lpad(F.hex(F.col("level")), 2, "0"))), uid)
    return _joined(grouped, _element(TAG, target, F.col("simples"))).select("path", "content")
