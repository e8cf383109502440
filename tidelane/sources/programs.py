"""Program tables and elementary units of transport streams, from packet rows.

Sections are gathered by windows over a PID's packets and joined by groups, so tables that repeat through a film are
spread over its packets' tasks and made distinct before they are parsed.  Parsing and the MPEG CRC-32 run in numpy over
Arrow batches.  A section that breaks off before the next one begins, or whose check fails, is marked and gives no entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the generator polynomial of the MPEG CRC-32.
MPEG_POLYNOMIAL = 0x04C11DB7


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 24
    for _ in range(8):
        table = (table << np.uint32(1)) ^ np.where(table >> np.uint32(31), np.uint32(MPEG_POLYNOMIAL), np.uint32(0))
    return table


def mpeg_crc32(rows: list[bytes]) -> np.ndarray:
    """The CRC of each row, all rows one byte a step; it is 0 over a whole section with its check."""
    table, crc = _crc_table(), np.full(len(rows), 0xFFFFFFFF, np.uint32)
    lengths = np.array([*map(len, rows)], np.int64)
    order = np.argsort(-lengths, kind="stable")
    width = int(lengths.max(initial=0))
    flat = np.zeros((len(rows), width), np.uint8)
    for i, row in enumerate(rows):
        flat[i, : len(row)] = np.frombuffer(row, np.uint8)
    flat, left = flat[order], lengths[order]
    out = crc[order]
    for k in range(width):
        n = int(np.searchsorted(-left, -k))  # rows longer than k
        out[:n] = (out[:n] << np.uint32(8)) ^ table[(out[:n] >> np.uint32(24)) ^ flat[:n, k]]
    crc[order] = out
    return crc


def _byte(c: Column, i: int) -> Column:
    """Byte i (from 0) as a number; null beyond the end."""
    return F.conv(F.nullif(F.hex(F.substring(c, i + 1, 1)), F.lit("")), 16, 10).cast("int")


def sections(packets: DataFrame) -> DataFrame:
    """(path, pid, first_packet, last_packet, table_id, whole, data) of the sections that packets carry.

    A packet with unit_start holds a pointer to where the next section begins; what a section still lacks then is lost.
    """
    w = Window.partitionBy("path", "pid").orderBy("packet").rowsBetween(Window.unboundedPreceding, 0)
    numbered = packets.withColumn("nth", F.sum(F.col("unit_start").cast("long")).over(w)).where("nth > 0")
    pointer = _byte(F.col("payload"), 0)
    body = F.when(F.col("unit_start"), F.substring("payload", pointer + 2, F.octet_length("payload"))).otherwise(F.col("payload"))
    parts = F.sort_array(F.collect_list(F.struct("packet", body.alias("body"))))
    grouped = numbered.groupBy("path", "pid", "nth").agg(parts.alias("parts"), F.min("packet").alias("first_packet"))
    joined = F.aggregate("parts.body", F.lit(b""), lambda a, x: F.concat(a, x))
    data = grouped.select("path", "pid", "first_packet", joined.alias("all"), F.array_max("parts.packet").alias("last_packet"))
    length = 3 + (_byte(F.col("all"), 1) % 16) * 256 + _byte(F.col("all"), 2)
    whole = F.coalesce(F.octet_length("all") >= length, F.lit(False))
    return data.select("path", "pid", "first_packet", "last_packet", _byte(F.col("all"), 0).alias("table_id"), whole.alias("whole"), F.substring(F.col("all"), F.lit(1), length).alias("data"))


SECTION_ENTRIES = "version int, extension int, crc_ok boolean, entries array<struct<program int, pid int, stream_type int, registration string, language string>>"


def _descriptors(data: bytes) -> dict[int, bytes]:
    found: dict[int, bytes] = {}
    at = 0
    while at + 2 <= len(data) and at + 2 + data[at + 1] <= len(data):
        found.setdefault(data[at], data[at + 2 : at + 2 + data[at + 1]])
        at += 2 + data[at + 1]
    return found


def _entries(data: bytes) -> list[dict]:
    """Programs of an association section, or streams of a program map section."""
    two = lambda i: data[i] << 8 | data[i + 1]
    end, out = len(data) - 4, []
    if data[0] == 0:
        for at in range(8, end - 3, 4):
            if two(at):
                out.append({"program": two(at), "pid": two(at + 2) & 0x1FFF})
    elif data[0] == 2 and len(data) >= 16:
        at = 12 + (two(10) & 0x0FFF)
        while at + 5 <= end:
            size = two(at + 3) & 0x0FFF
            held = _descriptors(data[at + 5 : min(end, at + 5 + size)])
            text = lambda tag, n: held[tag][:n].decode("latin-1").strip("\0 ") if len(held.get(tag, b"")) >= n else None  # noqa: B023, E731
            out.append({"program": two(3), "pid": two(at + 1) & 0x1FFF, "stream_type": data[at], "registration": text(0x05, 4), "language": text(0x0A, 3)})
            at += 5 + size
    return out


def parsed(found: DataFrame) -> DataFrame:
    """Add version, extension, crc_ok and the entries to distinct whole sections (path, pid, data, first_packet)."""
    distinct = found.where("whole and octet_length(data) >= 12").groupBy("path", "pid", "data").agg(F.min("first_packet").alias("first_packet"), F.max("first_packet").alias("latest_packet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("program", pa.int32()), ("pid", pa.int32()), ("stream_type", pa.int32()), ("registration", pa.string()), ("language", pa.string())]))
        for batch in batches:
            rows = batch.column("data").to_pylist()
            good = mpeg_crc32(rows) == 0
            entries = [_entries(r) if ok else [] for r, ok in zip(rows, good.tolist(), strict=True)]
            more = [pa.array([r[5] >> 1 & 31 for r in rows], pa.int32()), pa.array([r[3] << 8 | r[4] for r in rows], pa.int32()), pa.array(good), pa.array(entries, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "version", "extension", "crc_ok", "entries"])

    return distinct.mapInArrow(run, f"path string, pid int, data binary, first_packet long, latest_packet long, {SECTION_ENTRIES}")


def _latest(rows: DataFrame, by: list[str]) -> DataFrame:
    """The section of each table that was sent last."""
    good = rows.where("crc_ok").withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("latest_packet"))))
    return good.where("r = 1")


def programs(packets: DataFrame) -> DataFrame:
    """(path, program, pid, stream_type, registration, language, version) of all elementary streams of a file's programs."""
    association = _latest(parsed(sections(packets.where("pid = 0"))), ["path", "extension"])
    maps = association.select("path", F.explode("entries").alias("e")).select("path", F.col("e.pid").alias("pid"), F.col("e.program").alias("program")).distinct()
    found = _latest(parsed(sections(packets.join(maps.select("path", "pid").distinct(), ["path", "pid"], "left_semi"))), ["path", "pid", "extension"])
    streams = found.join(maps.select("path", "pid", F.col("program").alias("extension")), ["path", "pid", "extension"], "left_semi")
    return streams.select("path", "version", F.explode("entries").alias("e")).select("path", "e.*", "version")


def units(packets: DataFrame) -> DataFrame:
    """(path, pid, unit, pts, dts, random_access, packets, data) of the packetised units on the PIDs given.

    A unit that tells its length ends there; times are of 90 kHz, not unwrapped.
    """
    w = Window.partitionBy("path", "pid").orderBy("packet").rowsBetween(Window.unboundedPreceding, 0)
    numbered = packets.withColumn("unit", F.sum(F.col("unit_start").cast("long")).over(w)).where("unit > 0")
    grouped = numbered.groupBy("path", "pid", "unit").agg(F.sort_array(F.collect_list(F.struct("packet", "payload"))).alias("parts"), F.max(F.col("random_access") & F.col("unit_start")).alias("random_access"), F.count(F.lit(1)).alias("packets"))
    raw = grouped.withColumn("raw", F.aggregate("parts.payload", F.lit(b""), lambda a, x: F.concat(a, x))).drop("parts")
    b = lambda i: _byte(F.col("raw"), i).cast("long")
    told = b(4) * 256 + b(5)
    raw = raw.where(F.hex(F.substring("raw", 1, 3)) == "000001").withColumn("raw", F.when(told > 0, F.substring(F.col("raw"), F.lit(1), (told + 6).cast("int"))).otherwise(F.col("raw")))
    plain = _byte(F.col("raw"), 3).isin(0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)  # these have no further header
    stamp = lambda i: ((b(i) % 16 - b(i) % 2) * (1 << 29)) + b(i + 1) * (1 << 22) + (b(i + 2) - b(i + 2) % 2) * (1 << 14) + b(i + 3) * (1 << 7) + F.floor(b(i + 4) / 2)
    kind = F.floor(b(7) / 64)
    pts, dts = F.when(~plain & (kind >= 2) & (b(8) >= 5), stamp(9)), F.when(~plain & (kind == 3) & (b(8) >= 10), stamp(14))
    begin = F.when(plain, F.lit(7)).otherwise(10 + b(8)).cast("int")
    good = plain | (F.octet_length("raw") >= 9 + b(8))
    return raw.where(good).select("path", "pid", "unit", pts.alias("pts"), dts.alias("dts"), "random_access", "packets", F.substring(F.col("raw"), begin, F.octet_length("raw")).alias("data"))
