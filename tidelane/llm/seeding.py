"""Seeds of texts and their exchange: which keys stand in more than one document.

Map tasks gather (key, document, position) entries in chunks.  Keys that several documents of one
chunk share are settled there; only one flagged entry of each goes on, so a key that a third of all
documents hold arrives once from each chunk.  The others travel as packed sorted blobs, one for each
chunk and shard, and meet their equals in the shard of their key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelane.llm.textkernel import U64, mix64

CHUNK_ENTRIES = 1_000_000
PACKED = "shard int, keys binary, owners binary, docs binary, pos binary, flags binary, partners binary"
PACKED_NAMES = [x.split()[0] for x in PACKED.split(", ")]
PACKED_TYPES = [pa.int32(), *[pa.binary()] * 6]
#: Rows without an id get numbers at or above this one, by their texts.
NAMELESS = 1 << 62


def own_id(doc_id: Column, text: Column) -> Column:
    """The id of a row, or for a row without one a number by its text; so ids are below ``NAMELESS``."""
    return F.coalesce(doc_id.cast("long"), F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2) + F.lit(NAMELESS))


def known_id(number: Column) -> Column:
    """The id that ``own_id`` got, null for a row without one."""
    return F.when(number < F.lit(NAMELESS), number)


def run_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all runs of ``k`` words within one text, in constant time a run for any k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    base = 0xD1342543DE82EF95
    power, inverse = (np.full(len(h) + 1, b, U64) for b in (base, pow(base, -1, 1 << 64)))
    power[0] = inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(h * power[:-1])])
    ends = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + k <= ends)
    return at, mix64((sums[at + k] - sums[at]) * inverse[at])


def minimizers(h: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``w`` successive k-word runs within a text: (its first position, the position of its least run).

    The choice depends on the window's words only, so equal passages choose equal places.
    """
    at, g = run_hashes(h, first, k)
    n = len(at) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    best, place = g[:n].copy(), np.arange(n)
    for j in range(1, w):
        less = g[j : j + n] < best
        best[less] = g[j : j + n][less]
        place[less] = np.flatnonzero(less) + j
    whole = at[w - 1 : w - 1 + n] - at[:n] == w - 1  # no text ends inside
    return at[:n][whole], at[place[whole]]


def _row(**cells: object) -> tuple:
    return tuple(cells.get(k) for k in PACKED_NAMES)


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(PACKED_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PACKED_TYPES)], names=PACKED_NAMES)


def by_bucket(doc: np.ndarray, pos: np.ndarray, partner: np.ndarray, buckets: int) -> list[tuple]:
    """One row a bucket of documents: settled entries with their partner documents."""
    bucket = (mix64(doc.view(U64)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(doc)]]) if len(doc) else np.zeros(1, int)
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = order[a:b]
        rows.append(_row(shard=int(-1 - bucket[at[0]]), docs=doc[at].tobytes(), pos=pos[at].astype(np.uint32).tobytes(), partners=partner[at].astype(np.int64).tobytes()))
    return rows


def bucket_entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, partner) of all entries of a bucket, by document and position."""
    doc, pos, partner = (np.frombuffer(b"".join(x.as_py() for x in table.column(c)), k) for c, k in (("docs", np.int64), ("pos", np.uint32), ("partners", np.int64)))
    order = np.lexsort((partner, pos, doc))
    return doc[order], pos[order].astype(np.int64), partner[order]


def grouped(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order entries by (key, document); returns (order, start of each key's group, least document, least other document)."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    start = np.flatnonzero(new)
    least = d[start]
    group = np.cumsum(new) - 1
    other = d != least[group]
    second = np.full(len(start), np.iinfo(np.int64).max)
    np.minimum.at(second, group[other], d[other])
    return order, start, least, second


def pack_entries(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, flag: np.ndarray, shards: int, cut: int = 16) -> list[tuple]:
    """One row a shard, entries by key; keys lose their last ``cut`` bits and are sent as differences."""
    order = np.argsort(key, kind="stable")
    key, doc, pos, flag = key[order], doc[order], pos[order], flag[order]
    shard = ((key >> U64(32)) * U64(shards)) >> U64(32)
    value = (key >> U64(cut)).astype(np.int64)
    rows = []
    cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:]):
        used, local = np.unique(doc[a:b], return_inverse=True)
        step = np.diff(value[a:b])
        keys = value[a : a + 1].tobytes() + step.astype(np.uint32 if step.max(initial=0) < 1 << 32 and step.min(initial=0) >= 0 else np.int64).tobytes()
        rows.append(_row(shard=int(shard[a]), keys=keys, owners=local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32).tobytes(), docs=used.tobytes(), pos=pos[a:b].astype(np.uint32).tobytes(), flags=np.packbits(flag[a:b]).tobytes()))
    return rows


def unpack_entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, position, flag) of all entries of a shard."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for k, o, d, p, f in zip(*(table.column(c) for c in ("keys", "owners", "docs", "pos", "flags"))):
        k, p, d = k.as_py(), np.frombuffer(p.as_py(), np.uint32), np.frombuffer(d.as_py(), np.int64)
        step = np.frombuffer(k[8:], np.uint32 if len(k) - 8 == 4 * (len(p) - 1) else np.int64)
        out[0].append(np.cumsum(np.concatenate([np.frombuffer(k[:8], np.int64), step.astype(np.int64)])))
        out[1].append(d[np.frombuffer(o.as_py(), np.uint16 if len(d) < 1 << 16 else np.uint32)])
        out[2].append(p.astype(np.int64))
        out[3].append(np.unpackbits(np.frombuffer(f.as_py(), np.uint8), count=len(p)).astype(bool))
    return tuple(np.concatenate(x) for x in out)  # type: ignore[return-value]


def settle_chunk(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, shards: int) -> list[tuple]:
    """Rows of a chunk: settled entries by bucket of documents, the others and one of each settled key by shard."""
    order, start, least, second = grouped(key >> U64(16), doc)
    size = np.diff(np.concatenate([start, [len(order)]]))
    group = np.repeat(np.arange(len(start)), size)
    shared = (second < np.iinfo(np.int64).max)[group]
    k, d, p = key[order], doc[order], pos[order]
    partner = np.where(d == least[group], second[group], least[group])
    send = ~shared
    send[start] = True
    return by_bucket(d[shared], p[shared], partner[shared], shards) + pack_entries(k[send], d[send], p[send], shared[send], shards)


def settle_shard(table: pa.Table, buckets: int) -> pa.Table:
    """Entries of a shard whose key another document holds, by bucket of documents."""
    key, doc, pos, flag = unpack_entries(table)
    order, start, least, second = grouped(key, doc)
    size = np.diff(np.concatenate([start, [len(order)]]))
    group = np.repeat(np.arange(len(start)), size)
    d, p, f = doc[order], pos[order], flag[order]
    shared = (second < np.iinfo(np.int64).max)[group] & ~f
    partner = np.where(d == least[group], second[group], least[group])
    return pa.Table.from_batches([packed_batch(by_bucket(d[shared], p[shared], partner[shared], buckets))])


def chunked(pieces: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], finish: Callable[[np.ndarray, np.ndarray, np.ndarray], list[tuple]]) -> Iterator[pa.RecordBatch]:
    """Gather (key, document, position) pieces into chunks and yield the rows that ``finish`` makes of each."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = finish(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        for i in range(0, len(rows), 2000):
            yield packed_batch(rows[i : i + 2000])

    for piece in pieces:
        if len(piece[0]):
            held.append(piece)
            size += len(piece[0])
        if size >= CHUNK_ENTRIES:
            yield from flush()
            size = 0
    if held:
        yield from flush()
