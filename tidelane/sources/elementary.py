"""Frames of elementary streams with checks: AC-3, DTS, FLAC and AV1 units, as parsers for ``containers.scan``.

A sync word counts only if what it promises holds: a frame's CRC, or where a format has none for whole frames, another
sync word at its end.  So sync words inside payloads give no frames, and reading goes on behind damage.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

# --- checks ----------------------------------------------------------------------------------------


def crc_table(width: int, polynomial: int) -> np.ndarray:
    """The table of a CRC of ``width`` bits, most significant bit first."""
    top, mask = 1 << width - 1, (1 << width) - 1
    out = []
    for b in range(256):
        v = b << width - 8
        for _ in range(8):
            v = (v << 1 ^ (polynomial if v & top else 0)) & mask
        out.append(v)
    return np.array(out, np.int64)


#: Generator polynomials (FLAC headers; FLAC frames and AC-3).
CRC8, CRC16 = crc_table(8, 0x07).tolist(), crc_table(16, 0x8005).tolist()


def crc8(data: bytes) -> int:
    v = 0
    for b in data:
        v = CRC8[v ^ b]
    return v


def crc16(data: bytes) -> int:
    v = 0
    for b in data:
        v = (v << 8 & 0xFFFF) ^ CRC16[v >> 8 ^ b]
    return v


# --- AC-3 ------------------------------------------------------------------------------------------

AC3_SYNC = b"\x0b\x77"
#: Bit rates in kbit/s and sample rates by their codes.
AC3_KBPS = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)
AC3_RATES = (48_000, 44_100, 32_000)
AC3_CHANNELS = (2, 1, 2, 3, 3, 4, 4, 5)


def ac3_size(rate_code: int, size_code: int) -> int | None:
    """Bytes of an AC-3 frame of 1536 samples; at 44.1 kHz odd codes are one word longer."""
    if rate_code > 2 or size_code >= 2 * len(AC3_KBPS):
        return None
    words = AC3_KBPS[size_code >> 1] * 96_000 // AC3_RATES[rate_code]
    return 2 * (words + (rate_code == 1 and size_code & 1))


def ac3_frames(data: bytes) -> Iterator[tuple]:
    """(n, position, size, rate, channels, kbps, extended) of AC-3 and E-AC-3 frames whose CRC holds."""
    at, n = data.find(AC3_SYNC), 0
    while 0 <= at and at + 7 <= len(data):
        head, size, kbps = data[at : at + 7], None, 0
        stream = head[5] >> 3
        if stream <= 10:
            rate_code, size = head[4] >> 6, ac3_size(head[4] >> 6, head[4] & 63)
            mode, kbps = head[6] >> 5, AC3_KBPS[min(head[4] & 63, 37) >> 1]
            rate = AC3_RATES[rate_code] if size else 0
            shift = (2 if mode & 1 and mode != 1 else 0) + (2 if mode & 4 else 0) + (2 if mode == 2 else 0)
            low = (head[6] << 8 | data[at + 7] if at + 7 < len(data) else head[6] << 8) >> 12 - shift & 1
        elif stream <= 16:
            size = 2 * ((head[2] & 7) << 8 | head[3]) + 2
            code = head[4] >> 6
            rate = AC3_RATES[code] if code < 3 else AC3_RATES[min(head[4] >> 4 & 3, 2)] // 2
            mode, low = head[4] >> 1 & 7, head[4] & 1
        if size and at + size <= len(data) and crc16(data[at + 2 : at + size]) == 0:
            yield n, at, size, rate, AC3_CHANNELS[mode] + low, kbps, stream > 10
            n, at = n + 1, data.find(AC3_SYNC, at + size)
        else:
            at = data.find(AC3_SYNC, at + 1)


AC3_SCHEMA = "n long, position long, size int, rate int, channels int, kbps int, extended boolean"

# --- DTS -------------------------------------------------------------------------------------------

DTS_SYNC = b"\x7f\xfe\x80\x01"
#: Core sample rates by their code (0: none).
DTS_RATES = (0, 8000, 16_000, 32_000, 0, 0, 11_025, 22_050, 44_100, 0, 0, 12_000, 24_000, 48_000, 0, 0)


def dts_frames(data: bytes) -> Iterator[tuple]:
    """(n, position, size, samples, rate) of DTS core frames (16 bits, big-endian) that end where another begins, or with the stream."""
    at, n = data.find(DTS_SYNC), 0
    while 0 <= at and at + 10 <= len(data):
        bits = int.from_bytes(data[at + 4 : at + 10])
        size, blocks = (bits >> 20 & 0x3FFF) + 1, (bits >> 34 & 0x7F) + 1
        rate = DTS_RATES[bits >> 10 & 15]
        end = at + size
        if size >= 96 and blocks >= 6 and rate and (end == len(data) or data[end : end + 4] == DTS_SYNC):
            yield n, at, size, 32 * blocks, rate
            n, at = n + 1, data.find(DTS_SYNC, end)
        else:
            at = data.find(DTS_SYNC, at + 1)


DTS_SCHEMA = "n long, position long, size int, samples int, rate int"

# --- FLAC ------------------------------------------------------------------------------------------

#: Block sizes and sample rates by their codes (0: told elsewhere).
FLAC_RATES = (0, 88_200, 176_400, 192_000, 8000, 16_000, 22_050, 24_000, 32_000, 44_100, 48_000, 96_000, 0, 0, 0, 0)


def _flac_head(data: bytes, at: int) -> tuple[int, int, int, int] | None:
    """(number, samples, rate, bytes) of a frame header whose CRC-8 holds."""
    head = data[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8 or head[3] & 1 or head[2] >> 4 == 0 or head[2] & 15 == 15 or head[3] >> 4 > 10:
        return None
    lead = 8 - (head[4] ^ 0xFF).bit_length()  # leading ones
    width = max(lead, 1)
    if lead == 1 or lead > 7 or len(head) < 4 + width or any(b >> 6 != 2 for b in head[5 : 4 + width]):
        return None
    number = head[4] & (0x7F >> lead)
    for b in head[5 : 4 + width]:
        number = number << 6 | b & 63
    end, code = 4 + width, head[2] >> 4
    extra = (1 if code == 6 else 2 if code == 7 else 0, {12: 1, 13: 2, 14: 2}.get(head[2] & 15, 0))
    if len(head) < end + sum(extra) + 1:
        return None
    samples = 192 if code == 1 else 576 << code - 2 if code < 6 else int.from_bytes(head[end : end + extra[0]]) + 1 if code < 8 else 256 << code - 8
    raw = int.from_bytes(head[end + extra[0] : end + sum(extra)])
    rate = {12: 1000 * raw, 13: raw, 14: 10 * raw}.get(head[2] & 15, FLAC_RATES[head[2] & 15])
    end += sum(extra)
    return (number, samples, rate, end + 1) if crc8(head[:end]) == head[end] else None


def flac_frames(data: bytes) -> Iterator[tuple]:
    """(n, position, size, number, samples, rate) of FLAC frames: from a sound header to the first later one at which the CRC-16 holds."""
    at, n = 0, 0
    if data[:4] == b"fLaC":
        at = 4
        while at + 4 <= len(data):
            last, size = data[at] >> 7, int.from_bytes(data[at + 1 : at + 4])
            at += 4 + size
            if last:
                break
    heads = [i for i in _places(data, at) if _flac_head(data, i)]
    k = 0
    while k < len(heads):
        number, samples, rate, head = _flac_head(data, heads[k])
        step = 1
        for j in range(k + 1, len(heads) + 1):
            end = heads[j] if j < len(heads) else len(data)
            if end - heads[k] >= head + 3 and crc16(data[heads[k] : end - 2]) == int.from_bytes(data[end - 2 : end]):
                yield n, heads[k], end - heads[k], number, samples, rate
                n, step = n + 1, j - k
                break
            if end - heads[k] > 1 << 20:  # larger than any frame that the format's encoders make
                break
        k += step


def _places(data: bytes, at: int) -> list[int]:
    """Where 0xFF and a second sync byte stand."""
    buf = np.frombuffer(data, np.uint8)
    found = np.flatnonzero((buf[at:-1] == 0xFF) & (buf[at + 1 :] & 0xFE == 0xF8)) if len(buf) > at + 1 else np.zeros(0, int)
    return (found + at).tolist()


FLAC_SCHEMA = "n long, position long, size long, number long, samples int, rate int"

# --- AV1 -------------------------------------------------------------------------------------------


def leb128(data: bytes, at: int) -> tuple[int, int] | None:
    """(value, position after it) of a number of seven bits a byte, eight bytes at most."""
    value = 0
    for i in range(8):
        if at + i >= len(data):
            return None
        value |= (data[at + i] & 0x7F) << 7 * i
        if not data[at + i] & 0x80:
            return value, at + i + 1
    return None


def obu_units(data: bytes) -> Iterator[tuple]:
    """(n, unit, kind, temporal, spatial, position, size) of the units of a low-overhead stream; ``unit`` counts temporal units.

    A unit without a size, or one that ends beyond the data, ends the stream.
    """
    at, n, unit = 0, 0, -1
    while at < len(data):
        head = data[at]
        kind, extended = head >> 3 & 15, head >> 2 & 1
        if head & 0x81 or not head & 2 or at + 1 + extended > len(data):
            return
        layers = data[at + 1] if extended and at + 1 < len(data) else 0
        found = leb128(data, at + 1 + extended)
        if found is None or found[1] + found[0] > len(data):
            return
        unit += kind == 2
        yield n, max(unit, 0), kind, layers >> 5, layers >> 3 & 3, found[1], found[0]
        n, at = n + 1, found[1] + found[0]


OBU_SCHEMA = "n long, unit long, kind int, temporal int, spatial int, position long, size long"


def dts_head(size: int, samples: int, rate: int) -> bytes:
    """The first ten bytes of a core frame."""
    bits = 1 << 47 | 31 << 42 | (samples // 32 - 1) << 34 | (size - 1) << 20 | DTS_RATES.index(rate) << 10
    return DTS_SYNC + struct.pack(">Q", bits)[2:]
