"""Codec headers of many tracks at once, and detectors that look at a track's first samples alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.functions.bits import BitRows, without_emulation

FIELDS = ["profile", "tier", "level", "chroma", "bit_depth", "width", "height", "aspect_width", "aspect_height", "full_range", "primaries", "transfer", "matrix", "rate_ticks", "rate_scale"]
HEADER_SCHEMA = ", ".join(f"{f} long" for f in FIELDS) + ", whole boolean"
#: H.264 profiles whose parameter sets tell the chroma format.
CHROMA_PROFILES = [100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135]
#: Sample aspect ratios by index from 1.
ASPECTS = [(1, 1), (12, 11), (10, 11), (16, 11), (40, 33), (24, 11), (20, 11), (32, 11), (80, 33), (18, 11), (15, 11), (64, 33), (160, 99), (4, 3), (3, 2), (2, 1)]


def _scaling_list(b: BitRows, size: int, where: np.ndarray) -> None:
    last, after = np.full(len(where), 8), np.full(len(where), 8)
    for _ in range(size):
        on = where & (after != 0)
        after = np.where(on, (last + b.se(on)) % 256, after)
        last = np.where(after == 0, last, after)


def _usability(b: BitRows, on: np.ndarray, out: dict[str, np.ndarray], hevc: bool) -> None:
    """The video usability part up to the frame rate."""
    shaped = b.flag(on) & on
    index = b.bits(8, shaped)
    table = np.array([(0, 0), *ASPECTS, *[(0, 0)] * 239])
    own = shaped & (index == 255)
    wide, high = b.bits(16, own), b.bits(16, own)
    out["aspect_width"], out["aspect_height"] = np.where(own, wide, table[index, 0]), np.where(own, high, table[index, 1])
    b.flag(b.flag(on) & on)
    signal = b.flag(on) & on
    b.bits(3, signal)
    out["full_range"] = b.bits(1, signal)
    described = b.flag(signal) & signal
    for name in ("primaries", "transfer", "matrix"):
        out[name] = np.where(described, b.bits(8, described), 2)
    placed = b.flag(on) & on
    b.ue(placed), b.ue(placed)
    if hevc:
        b.skip(3, on)
        window = b.flag(on) & on
        for _ in range(4):
            b.ue(window)
    timed = b.flag(on) & on
    ticks = b.bits(32, timed)
    out["rate_scale"], out["rate_ticks"] = b.bits(32, timed), ticks * (1 if hevc else 2)


def h264_parameters(units: list[bytes]) -> dict[str, np.ndarray]:
    """Sequence parameter sets of H.264, behind their unit header of one byte."""
    b = BitRows([without_emulation(u[1:]) for u in units])
    out = {f: np.zeros(len(units), np.int64) for f in FIELDS}
    out["profile"] = b.bits(8)
    b.skip(8)
    out["level"] = b.bits(8)
    b.ue()
    high = np.isin(out["profile"], CHROMA_PROFILES)
    chroma = np.where(high, b.ue(high), 1)
    planes = b.flag(high & (chroma == 3))
    out["bit_depth"] = 8 + b.ue(high)
    b.ue(high), b.skip(1, high)
    scaled = b.flag(high) & high
    for i in range(12):
        on = scaled & ((chroma == 3) | (i < 8))
        _scaling_list(b, 16 if i < 6 else 64, b.flag(on) & on)
    b.ue()
    order = b.ue()
    b.ue(order == 0)
    cycle = order == 1
    b.skip(1, cycle), b.se(cycle), b.se(cycle)
    left = b.ue(cycle)
    while (on := cycle & (left > 0) & ~b.bad).any():
        b.se(on)
        left = left - on
    b.ue(), b.skip(1)
    columns, rows = b.ue() + 1, b.ue() + 1
    frames = b.flag()
    b.skip(1, ~frames), b.skip(1)
    cropped = b.flag()
    sides = [b.ue(cropped) for _ in range(4)]
    step_x = np.where(planes | np.isin(chroma, [0, 3]), 1, 2)
    step_y = np.where(~planes & (chroma == 1), 2, 1) * (2 - frames)
    out["chroma"] = np.where(planes, 0, chroma)
    out["width"], out["height"] = 16 * columns - step_x * (sides[0] + sides[1]), 16 * rows * (2 - frames) - step_y * (sides[2] + sides[3])
    _usability(b, b.flag(), out, hevc=False)
    return {k: np.where(b.bad, 0, v) for k, v in out.items()} | {"whole": ~b.bad}


def _reference_sets(b: BitRows) -> None:
    """Short-term reference picture sets: each tells its pictures, or their change from the set before."""
    n = b.ue()
    b.bad |= n > 64
    before = np.zeros(len(n), np.int64)
    for k in range(int(np.where(b.bad, 0, n).max(initial=0))):
        on = (n > k) & ~b.bad
        changed = b.flag(on) & on if k else np.zeros(len(n), bool)
        b.skip(1, changed), b.ue(changed)
        count = np.zeros(len(n), np.int64)
        for j in range(int(np.where(changed, before, -1).max(initial=-1)) + 1):
            here = changed & (j <= before)
            used = b.flag(here)
            kept = here & (used | b.flag(here & ~used))
            count = count + kept
        own = on & ~changed
        negative, positive = b.ue(own), b.ue(own)
        b.bad |= own & (negative + positive > 32)
        for j in range(int(np.where(own & ~b.bad, negative + positive, 0).max(initial=0))):
            here = own & (j < negative + positive)
            b.ue(here), b.skip(1, here)
        before = np.where(on, np.where(changed, count, negative + positive), before)


def hevc_parameters(units: list[bytes]) -> dict[str, np.ndarray]:
    """Sequence parameter sets of HEVC, behind their unit header of two bytes."""
    b = BitRows([without_emulation(u[2:]) for u in units])
    out = {f: np.zeros(len(units), np.int64) for f in FIELDS}
    b.skip(4)
    layers = b.bits(3)
    b.skip(3)
    out["tier"], out["profile"] = b.bits(1), b.bits(5)
    b.skip(80)
    out["level"] = b.bits(8)
    told = [(b.flag(layers > i) & (layers > i), b.flag(layers > i) & (layers > i)) for i in range(7)]
    b.skip(2 * (8 - layers), layers > 0)
    for profile, level in told:
        b.skip(88, profile), b.skip(8, level)
    b.ue()
    chroma = b.ue()
    planes = b.flag(chroma == 3) & (chroma == 3)
    width, height = b.ue(), b.ue()
    cropped = b.flag()
    sides = [b.ue(cropped) for _ in range(4)]
    step_x, step_y = np.where(~planes & np.isin(chroma, [1, 2]), 2, 1), np.where(~planes & (chroma == 1), 2, 1)
    out["chroma"], out["width"], out["height"] = np.where(planes, 0, chroma), width - step_x * (sides[0] + sides[1]), height - step_y * (sides[2] + sides[3])
    out["bit_depth"] = 8 + b.ue()
    b.ue()
    order_bits = b.ue() + 4
    each = b.flag()
    for i in range(8):
        on = (i <= layers) & (each | (i == layers))
        b.ue(on), b.ue(on), b.ue(on)
    for _ in range(6):
        b.ue()
    lists = b.flag()
    lists = b.flag(lists) & lists
    for size in range(4):
        for _ in range(2 if size == 3 else 6):
            coded = b.flag(lists) & lists
            b.ue(lists & ~coded)
            b.se(coded) if size > 1 else None
            for _ in range(min(64, 1 << (4 + 2 * size))):
                b.se(coded)
    b.skip(2)
    pcm = b.flag()
    b.skip(8, pcm), b.ue(pcm), b.ue(pcm), b.skip(1, pcm)
    _reference_sets(b)
    long = b.flag()
    count = b.ue(long)
    b.bad |= count > 32
    b.skip(np.where(b.bad, 0, count * (order_bits + 1)), long)
    b.skip(2)
    _usability(b, b.flag(), out, hevc=True)
    return {k: np.where(b.bad, 0, v) for k, v in out.items()} | {"whole": ~b.bad}


#: Readers by codec: a new codec's header is added here, or to a copy that is given to ``codec_headers``.
READERS: dict[str, Callable[[list[bytes]], dict[str, np.ndarray]]] = {"h264": h264_parameters, "hevc": hevc_parameters}


def codec_headers(units: DataFrame, codec: str = "codec", data: str = "data", readers: dict[str, Callable[[list[bytes]], dict[str, np.ndarray]]] = READERS) -> DataFrame:
    """Add the fields of ``HEADER_SCHEMA`` from the parameter set in ``data``; a codec without a reader has nulls, a set that breaks off zeros."""
    extra = T.StructType.fromDDL(HEADER_SCHEMA)
    schema = T.StructType([*[f for f in units.schema.fields if f.name not in extra.names], *extra.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codecs, rows = np.array(batch.column(codec).to_pylist(), object), batch.column(data).to_pylist()
            cells = {f: np.zeros(len(rows), np.int64) for f in extra.names}
            known = np.zeros(len(rows), bool)
            for name, reader in readers.items():
                at = np.flatnonzero(codecs == name)
                known[at] = True
                for f, v in reader([rows[i] or b"" for i in at.tolist()]).items() if len(at) else ():
                    cells[f][at] = v
            made = [pa.array(cells[f.name].astype(bool) if f.name == "whole" else cells[f.name], mask=~known) for f in extra.fields]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in schema.fields[: -len(made)]], *made], names=schema.names)

    return units.mapInArrow(run, schema)


# --- first samples ---------------------------------------------------------------------------------


#: Rows that a task holds before it cuts their tracks.
HELD_ROWS = 1 << 16


def first_samples(samples: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The ``n`` rows of each track with the least ``order`` (whole numbers).

    Each task cuts tracks to their ``n`` least whenever it holds ``HELD_ROWS`` rows, and hands on what it holds where half
    of them would stay (many tracks), so its memory does not grow with tracks; groups of what is handed on are cut again.
    No track is sorted, and no window goes over all rows.
    """
    schema = samples.schema

    def cut(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        track = np.zeros(table.num_rows, np.int64)
        for c in by:
            codes = pc.dictionary_encode(table.column(c).combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            track = np.unique(track * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
        rows = np.lexsort((table.column(order).to_numpy(), track))
        first = np.flatnonzero(np.diff(track[rows], prepend=-1))
        nth = np.arange(len(rows)) - np.repeat(first, np.diff(first, append=len(rows)))
        return table.take(pa.array(rows[nth < n])).combine_chunks().to_batches()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= HELD_ROWS:
                held = cut(held)
                count = sum(b.num_rows for b in held)
                if 2 * count > HELD_ROWS:
                    yield from held
                    held, count = [], 0
        if held:
            yield from cut(held)

    few = samples.mapInArrow(partial, schema)
    rest = F.struct(F.col(order).alias("__o"), F.struct("*").alias("row"))
    return few.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(rest), lambda a, b: F.when(a["__o"] < b["__o"], -1).when(a["__o"] > b["__o"], 1).otherwise(0)), 1, n).alias("x")).select(F.explode("x.row").alias("row")).select("row.*")


def _has(data: Column, pattern: str) -> Column:
    """Whether whole bytes in ``data`` match a pattern of hex digits."""
    return F.rlike(F.hex(data), F.lit(f"^(?:..)*?(?:{pattern})"))


#: Detectors by name: (codecs, first samples inspected, what a sample must hold).  Fixed values: the marks of HDR10+ and HDR Vivid
#: messages (ITU-T T.35 country, provider and identifiers), of Dolby Vision units, and of a TrueHD major sync with a 16-channel presentation.
DETECTORS: dict[str, tuple[tuple[str, ...], int, Callable[[Column], Column]]] = {
    "hdr10plus": (("hevc", "h264", "av1"), 48, lambda data: _has(data, "B5003C000104")),
    "hdr_vivid": (("hevc", "h264", "av1"), 48, lambda data: _has(data, "2600040005")),
    "dolby_vision": (("hevc",), 48, lambda data: _has(data, "00000[01]7C01|0000017C01")),
    "atmos": (("truehd",), 64, lambda data: (F.hex(F.substring(data, 5, 4)) == "F8726FBA") & (F.conv(F.hex(F.substring(data, 22, 1)), 16, 10).cast("int") >= 128)),
}


def detect(samples: DataFrame, by: list[str], order: str, codec: str = "codec", data: str = "data", detectors: dict[str, tuple[tuple[str, ...], int, Callable[[Column], Column]]] = DETECTORS) -> DataFrame:
    """One row a track with a flag for each detector that its first samples satisfy."""
    most = max(n for _, n, _ in detectors.values())
    few = first_samples(samples.select(*by, order, codec, data), by, order, most)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    few = few.withColumn("__n", nth)  # of the few rows alone
    flags = [F.coalesce(F.max((F.col("__n") <= n) & F.col(codec).isin(*codecs) & holds(F.col(data))), F.lit(False)).alias(name) for name, (codecs, n, holds) in detectors.items()]
    return few.groupBy(*by).agg(*flags)


# --- access units of lossless audio ----------------------------------------------------------------

#: The mark of a TrueHD major sync, and the sampling rates by their codes.
MAJOR_SYNC = b"\xf8\x72\x6f\xba"
TRUEHD_RATES = {0: 48_000, 1: 96_000, 2: 192_000, 8: 44_100, 9: 88_200, 10: 176_400}


def truehd_units(blocks: DataFrame, by: list[str], order: str, pts: str, timescale: int, data: str = "data") -> DataFrame:
    """(by, unit, position, size, sync, dts, duration, rate) of the access units that the blocks of a track hold, split by their lengths.

    A track begins with its first major sync; its time is that block's, and units follow each other by 1/1200 of a second
    (a rate's forty samples at 48 kHz, and as much at others), so the rounding of containers is left behind.  A block
    that breaks off inside a unit raises ``ValueError``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, nth, position, size, sync, rate = [], [], [], [], [], []
            for row, cell in enumerate(batch.column(data)):
                content, at, n = cell.as_py() or b"", 0, 0
                while at < len(content):
                    length = 2 * (int.from_bytes(content[at : at + 2]) & 0x0FFF)
                    if length < 4 or at + length > len(content):
                        raise ValueError(f"access unit {n} of a block breaks off at byte {at}")
                    major = content[at + 4 : at + 8] == MAJOR_SYNC
                    for held, v in zip((owner, nth, position, size, sync, rate), (row, n, at, length, major, TRUEHD_RATES.get(content[at + 8] >> 4) if major and length > 8 else None), strict=True):
                        held.append(v)
                    at, n = at + length, n + 1
            kept = [batch.column(c).take(pa.array(owner, pa.int64())) for c in [*by, order, pts]]
            made = [pa.array(nth, pa.int64()), pa.array(position, pa.int64()), pa.array(size, pa.int64()), pa.array(sync, pa.bool_()), pa.array(rate, pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*by, order, pts, "i", "position", "size", "sync", "rate"])

    kinds = ", ".join(f"`{c}` {dict(blocks.dtypes)[c]}" for c in [*by, order, pts])
    units = blocks.select(*by, order, pts, data).mapInArrow(run, f"{kinds}, i long, position long, size long, sync boolean, rate long")
    w = Window.partitionBy(*by).orderBy(order, "i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    begun = units.withColumn("__s", F.sum(F.col("sync").cast("long")).over(upto)).where("__s > 0")
    first = lambda c: F.first(c).over(upto)
    timed = begun.withColumns({"unit": F.row_number().over(w).cast("long") - 1, "__rate": first("rate"), "__pts": first(pts), "__i": first("i")})
    duration = F.floor(F.col("__rate") * 40 / F.when(F.col("__rate") % 48_000 == 0, 48_000).otherwise(44_100))
    start = F.bround(F.col("__pts") * F.col("__rate") / timescale).cast("long") + F.col("__i") * duration
    return timed.select(*by, "unit", F.col(order), "position", "size", "sync", (start + F.col("unit") * duration).alias("dts"), duration.alias("duration"), F.col("__rate").alias("rate"))
