"""MP4 samples from index boxes (plain and fragmented), and the writer of plain files.

Readers take the rows of ``ranges.mp4_index``: a moov or moof is parsed in numpy by the task that holds it, so a track's
table, not its file, has to fit in memory.  What spans boxes (times that run on from one fragment to the next) is left to a window.

The writer takes sample rows.  Tables are made of their narrow columns first, one group a file; payloads then go to
each file in order of their chunks, as a stream, by one task a file, so no file has to fit in memory.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.sources.containers import mp4_boxes
from tidelane.sources.ranges import joined_batches

SAMPLE_SCHEMA = "track long, n long, position long, size long, dts long, duration long, shift long, sync boolean, timescale long, handler string, codec string"
_TABLES = {"stts": 8, "ctts": 8, "stsc": 12, "stco": 4, "co64": 8, "stss": 4}


def _table(data: bytes, body: int, end: int, width: int) -> np.ndarray:
    """The rows of a counted table as big-endian 32-bit words (one 64-bit word a row for width 8 of co64)."""
    n = min(struct.unpack_from(">I", data, body + 4)[0], (end - body - 8) // width)
    return np.frombuffer(data, ">u4", n * width // 4, body + 8).astype(np.int64).reshape(n, width // 4)


def moov_tracks(data: bytes) -> Iterator[dict]:
    """Each track of a moov box with its sample columns."""
    track: dict = {}
    for name, at, head, size in mp4_boxes(data):
        body, end, leaf = at + head, at + size, name[-4:]
        if leaf == "trak":
            if "sizes" in track:
                yield _expanded(track)
            track = {}
        if "/trak/" not in name or size < head + 8:
            continue
        long = data[body] == 1
        if leaf == "tkhd":
            track["track"] = struct.unpack_from(">I", data, body + (20 if long else 12))[0]
        elif leaf == "mdhd":
            track["timescale"] = struct.unpack_from(">I", data, body + (20 if long else 12))[0]
        elif leaf == "hdlr":
            track["handler"] = data[body + 8 : body + 12].decode("latin-1")
        elif leaf == "stsd" and size >= head + 16:
            track["codec"] = data[body + 12 : body + 16].decode("latin-1")
        elif leaf in _TABLES:
            track["co64" if leaf == "co64" else leaf] = _table(data, body, end, _TABLES[leaf])
        elif leaf == "stsz":
            fixed, n = struct.unpack_from(">II", data, body + 4)
            track["sizes"] = np.full(n, fixed, np.int64) if fixed else _table(data, body + 4, end, 4)[:, 0]
    if "sizes" in track:
        yield _expanded(track)


def _expanded(track: dict) -> dict:
    """Run lengths and chunks of a track written out for each sample that all its tables cover."""
    sizes = track["sizes"]
    chunks = track["stco"][:, 0] if "stco" in track else (track["co64"][:, 0] << 32) + track["co64"][:, 1] if "co64" in track else np.zeros(0, np.int64)
    runs = track.get("stsc", np.zeros((0, 3), np.int64))
    first = np.minimum(runs[:, 0] - 1, len(chunks))
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(first, len(chunks))).clip(0)) if len(runs) else np.zeros(0, np.int64)
    chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)[: len(sizes)]
    deltas = np.repeat(*track.get("stts", np.zeros((0, 2), np.int64)).T[::-1])
    n = min(len(sizes), len(chunk), len(deltas))
    sizes, chunk, deltas = sizes[:n], chunk[:n], deltas[:n]
    before = np.cumsum(sizes) - sizes
    starts = np.searchsorted(chunk, np.arange(len(chunks)))
    shift = np.zeros(n, np.int64)
    if "ctts" in track:
        counts, values = track["ctts"].T
        all_shifts = np.repeat(np.where(values >= 1 << 31, values - (1 << 32), values), counts)[:n]
        shift[: len(all_shifts)] = all_shifts
    sync = np.ones(n, bool)
    if "stss" in track:
        marks = track["stss"][:, 0] - 1
        sync[:] = False
        sync[marks[marks < n]] = True
    position = chunks[chunk] + before - before[np.minimum(starts[chunk], max(n - 1, 0))] if n else np.zeros(0, np.int64)
    return {"track": track.get("track"), "timescale": track.get("timescale"), "handler": track.get("handler"), "codec": track.get("codec"), "size": sizes, "position": position, "dts": np.cumsum(deltas) - deltas, "duration": deltas, "shift": shift, "sync": sync}


def movie_samples(index: DataFrame) -> DataFrame:
    """(path, and the columns of ``SAMPLE_SCHEMA``) of all samples that moov boxes list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, box in zip(batch.column("path").to_pylist(), batch.column("box"), strict=True):
                for t in moov_tracks(box.as_py()):
                    n = len(t["size"])
                    fixed = {c: pa.array([t[c]] * n, k) for c, k in (("track", pa.int64()), ("timescale", pa.int64()), ("handler", pa.string()), ("codec", pa.string()))}
                    cells = {"path": pa.array([path] * n, pa.string()), **fixed, "n": pa.array(np.arange(n))} | {c: pa.array(t[c]) for c in ("position", "size", "dts", "duration", "shift", "sync")}
                    names = ["path", *(x.split()[0] for x in SAMPLE_SCHEMA.split(", "))]
                    yield pa.RecordBatch.from_arrays([cells[c] for c in names], names=names)

    return index.where("kind = 'moov'").select("path", "box").mapInArrow(lambda batches: joined_batches(run(batches)), f"path string, {SAMPLE_SCHEMA}")


# --- fragments -------------------------------------------------------------------------------------


def track_defaults(data: bytes) -> list[tuple[int, int, int, int]]:
    """(track, duration, size, flags) of a moov's trex boxes."""
    return [struct.unpack_from(">4x I 4x III".replace(" ", ""), data, at + head) for name, at, head, size in mp4_boxes(data) if name.endswith("/mvex/trex") and size >= head + 24]


def _optional(data: bytes, at: int, flags: int, *bits: int) -> tuple[list[int | None], int]:
    """The 32-bit fields whose flags are set, one behind the other."""
    out: list[int | None] = []
    for bit in bits:
        out.append(struct.unpack_from(">I", data, at)[0] if flags & bit else None)
        at += 4 * bool(flags & bit)
    return out, at


def moof_samples(data: bytes, offset: int, defaults: dict[int, tuple[int, int, int]]) -> Iterator[dict]:
    """The runs of a movie fragment at ``offset``: sample columns, with ``tfdt`` on a track fragment's first run."""
    previous, base, fragment, run = offset, offset, -1, 0
    moved = offset
    traf: dict = {}
    for name, at, head, size in mp4_boxes(data):
        body, leaf = at + head, name[-4:]
        if leaf == "traf":
            fragment, run, traf = fragment + 1, 0, {}
        elif leaf == "tfhd" and size >= head + 8:
            flags = struct.unpack_from(">I", data, body)[0] & 0xFFFFFF
            (track,), here = struct.unpack_from(">I", data, body + 4), body + 8
            base = offset if flags & 0x20000 or fragment == 0 else previous
            if flags & 1:
                base, here = struct.unpack_from(">Q", data, here)[0], here + 8
            (_, *own), _ = _optional(data, here, flags, 2, 8, 16, 32)
            traf = {"track": track, "defaults": [d if v is None else v for v, d in zip(own, defaults.get(track, (0, 0, 0)), strict=True)], "tfdt": None}
            moved = previous = base
        elif leaf == "tfdt" and traf and size >= head + 8:
            traf["tfdt"] = struct.unpack_from(">Q" if data[body] == 1 else ">I", data, body + 4)[0]
        elif leaf == "trun" and traf and size >= head + 8:
            flags, n = struct.unpack_from(">II", data, body)
            here = body + 8
            if flags & 1:
                moved, here = base + struct.unpack_from(">i", data, here)[0], here + 4
            (first_flags,), here = _optional(data, here, flags, 4)
            fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
            if here + 4 * n * len(fields) > at + size:
                raise ValueError(f"the track run at byte {offset + at} breaks off")
            table = dict(zip(fields, np.frombuffer(data, ">u4", n * len(fields), here).astype(np.int64).reshape(n, len(fields)).T, strict=True)) if fields else {}
            duration, sizes, marks = (table.get(bit, np.full(n, d, np.int64)) for bit, d in zip((0x100, 0x200, 0x400), traf["defaults"], strict=True))
            if first_flags is not None and n and 0x400 not in table:
                marks = np.r_[first_flags, marks[1:]]
            shift = table.get(0x800, np.zeros(n, np.int64))
            shift = np.minimum(shift, (1 << 31) - 1) if data[body] == 0 else np.where(shift >= 1 << 31, shift - (1 << 32), shift)
            ends = moved + np.cumsum(sizes)
            yield {"track": traf["track"], "fragment": fragment, "run": run, "tfdt": traf["tfdt"] if run == 0 else None, "position": ends - sizes, "size": sizes, "duration": duration, "shift": shift, "sync": (marks >> 16 & 1) == 0}
            moved = previous = int(ends[-1]) if n else moved
            run += 1


FRAGMENT_SCHEMA = "moof long, track long, fragment int, run int, i long, tfdt long, position long, size long, duration long, shift long, sync boolean"


def fragment_samples(index: DataFrame, start_dts: DataFrame | None = None) -> DataFrame:
    """(path, track, n, position, size, dts, duration, shift, sync) of all samples in movie fragments.

    A field comes from its run, else its track fragment, else the movie.  Times run on over fragments unless one tells its own;
    they begin at ``start_dts`` (path, track, dts), the end of the track's samples outside fragments, else at 0.
    """

    def defaults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[list(d) for d in track_defaults(box.as_py())] for box in batch.column("box")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(rows, pa.list_(pa.list_(pa.int64())))], names=["path", "trex"])

    def batch_of(held: list[tuple[str, int, dict]]) -> pa.RecordBatch:
        """The samples of the runs held, made column by column and not run by run."""
        n = np.array([len(r["size"]) for _, _, r in held])
        first = np.cumsum(n) - n
        told = np.full(int(n.sum()), None, object)
        for at, (_, _, r) in zip(first.tolist(), held, strict=True):
            if len(r["size"]):
                told[at] = r["tfdt"]
        cells = {"path": pa.array(np.repeat(np.array([p for p, _, _ in held], object), n), pa.string()), "moof": pa.array(np.repeat([at for _, at, _ in held], n), pa.int64())}
        cells |= {c: pa.array(np.repeat([r[c] for _, _, r in held], n), pa.int64() if c == "track" else pa.int32()) for c in ("track", "fragment", "run")}
        cells |= {"i": pa.array(np.arange(len(told)) - np.repeat(first, n)), "tfdt": pa.array(told, pa.int64())}
        cells |= {c: pa.array(np.concatenate([r[c] for _, _, r in held])) for c in ("position", "size", "duration", "shift", "sync")}
        return pa.RecordBatch.from_arrays(list(cells.values()), names=list(cells))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, dict]] = []
        rows = 0
        for batch in batches:
            for path, at, box, trex in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "box", "trex")), strict=True):
                for r in moof_samples(box, at, {t: tuple(rest) for t, *rest in trex or []}):
                    held.append((path, at, r))
                    rows += len(r["size"])
                    if rows >= 8192 or len(held) >= 8192:
                        yield batch_of(held)
                        held, rows = [], 0
        if held:
            yield batch_of(held)

    trex = index.where("kind = 'moov'").select("path", "box").mapInArrow(defaults, "path string, trex array<array<bigint>>")
    moofs = index.where("kind = 'moof'").select("path", "offset", "box").join(trex, "path", "left")
    rows = moofs.select("path", "offset", "box", "trex").mapInArrow(runs, f"path string, {FRAGMENT_SCHEMA}")
    order = ["moof", "fragment", "run", "i"]
    w = Window.partitionBy("path", "track").orderBy(*order)
    rows = rows.withColumns({"n": F.row_number().over(w).cast("long") - 1, "told": F.count("tfdt").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    if start_dts is not None:
        rows = rows.join(start_dts.select("path", "track", F.col("dts").alias("begin")), ["path", "track"], "left")
    else:
        rows = rows.withColumn("begin", F.lit(None).cast("long"))
    since = Window.partitionBy("path", "track", "told").orderBy(*order)
    base = F.coalesce(F.first("tfdt").over(since), F.when(F.col("told") == 0, F.col("begin")), F.lit(0))
    dts = base + F.sum("duration").over(since.rowsBetween(Window.unboundedPreceding, 0)) - F.col("duration")
    return rows.withColumn("dts", dts).select("path", "track", "n", "position", "size", "dts", "duration", "shift", "sync")


# --- writer ----------------------------------------------------------------------------------------

UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
MEDIA_HEADERS = {"vide": ("vmhd", 1, bytes(8)), "soun": ("smhd", 0, bytes(4))}
CHUNK_MS = 500


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind.encode("latin-1")) + body


def full_box(kind: str, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def run_lengths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    return np.diff(np.r_[first, len(values)]), values[first]


def _counted(kind: str, columns: list[np.ndarray], version: int = 0, form: str = ">u4") -> bytes:
    table = np.stack(columns, 1) if columns else np.zeros((0, 1))
    return full_box(kind, version, 0, struct.pack(">I", len(table)), (table & 0xFFFFFFFF if form == ">u4" else table).astype(form).tobytes())


def _track_box(t: dict, offsets: np.ndarray, movie_scale: int) -> bytes:
    duration = int(t["duration"].sum())
    shown = duration * movie_scale // t["timescale"]
    name, flags, body = MEDIA_HEADERS.get(t["handler"], ("nmhd", 0, b""))
    first_chunk, per_chunk = np.flatnonzero(np.r_[True, np.diff(t["per_chunk"]) != 0][: len(t["per_chunk"])]), t["per_chunk"]
    tables = [
        full_box("stsd", 0, 0, struct.pack(">I", 1), box(t["codec"], bytes(6), struct.pack(">H", 1), t["entry"])),
        _counted("stts", list(run_lengths(t["duration"]))),
        *([_counted("ctts", list(run_lengths(t["shift"])), version=1)] if t["shift"].any() else []),
        *([_counted("stss", [np.flatnonzero(t["sync"]) + 1])] if not t["sync"].all() else []),
        _counted("stsc", [first_chunk + 1, per_chunk[first_chunk], np.ones(len(first_chunk), np.int64)]),
        full_box("stsz", 0, 0, struct.pack(">II", 0, len(t["size"])), t["size"].astype(">u4").tobytes()),
        _counted("co64", [offsets], form=">u8") if len(offsets) and offsets.max() >= 1 << 32 else _counted("stco", [offsets]),
    ]
    tkhd = full_box("tkhd", 1, 7, struct.pack(">QQIIQ", 0, 0, t["track"], 0, shown), bytes(8), struct.pack(">HHHH", 0, 0, 0x100 if t["handler"] == "soun" else 0, 0), UNITY, struct.pack(">II", t["width"] << 16, t["height"] << 16))
    mdhd = full_box("mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, t["timescale"], duration, 0x55C4, 0))
    hdlr = full_box("hdlr", 0, 0, bytes(4), t["handler"].encode("latin-1"), bytes(12), b"\0")
    dinf = box("dinf", full_box("dref", 0, 0, struct.pack(">I", 1), full_box("url ", 0, 1)))
    return box("trak", tkhd, box("mdia", mdhd, hdlr, box("minf", full_box(name, 0, flags, body), dinf, box("stbl", *tables))))


def file_head(tracks: list[dict], payload_bytes: int, movie_scale: int = 1000) -> bytes:
    """ftyp, moov and the head of mdat; ``chunk_at`` of each track has its chunks' places in the payload.

    Chunk offsets count from the file's start, so they depend on the moov's size, and this on the offsets only by their
    width: the moov is built again until its size stays.
    """
    ftyp = box("ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + payload_bytes) if payload_bytes + 8 >= 1 << 32 else struct.pack(">I4s", 8 + payload_bytes, b"mdat")
    longest = max((int(t["duration"].sum()) * movie_scale // t["timescale"] for t in tracks), default=0)
    mvhd = full_box("mvhd", 1, 0, struct.pack(">QQIQ", 0, 0, movie_scale, longest), struct.pack(">IH10x", 0x10000, 0x100), UNITY, bytes(24), struct.pack(">I", max((t["track"] for t in tracks), default=0) + 1))
    size = 0
    while True:
        base = len(ftyp) + size + len(mdat)
        moov = box("moov", mvhd, *[_track_box(t, t["chunk_at"] + base, movie_scale) for t in tracks])
        if len(moov) == size:
            return ftyp + moov + mdat
        size = len(moov)


def _heads(table: pa.Table) -> pa.Table:
    """(path, head) of a file, from its narrow sample rows in payload order."""
    rows = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("track", "n", "size", "duration", "shift", "sync", "timescale", "chunk")}
    order = np.lexsort((rows["n"], rows["track"], rows["chunk"]))
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(rows["size"][order]) - rows["size"][order]
    tracks = []
    for track in np.unique(rows["track"]).tolist():
        mine = np.flatnonzero(rows["track"] == track)
        mine = mine[np.argsort(rows["n"][mine], kind="stable")]
        _, first, count = np.unique(rows["chunk"][mine], return_index=True, return_counts=True)
        k = int(mine[0])
        text = {c: table.column(c)[k].as_py() for c in ("handler", "codec", "entry", "width", "height")}
        tracks.append({"track": track, "timescale": int(rows["timescale"][k]), **text, **{c: rows[c][mine] for c in ("size", "duration", "shift", "sync")}, "per_chunk": count, "chunk_at": at[mine[first]]})
        tracks[-1]["entry"] = tracks[-1]["entry"] or b""
    return pa.table({"path": table.column("path").slice(0, 1), "head": pa.array([file_head(tracks, int(rows["size"].sum()))], pa.binary())})


def mux(samples: DataFrame, payload: str = "payload") -> DataFrame:
    """(path, part, content) of MP4 files: the head of each (part -1) and the payloads in file order.

    ``samples``: path, track, n, duration, shift, sync, timescale, handler (vide, soun, text ...), codec, entry (the sample
    entry's bytes behind its reference index), width, height and the payload.  Chunks hold half a second of a track.
    """
    w = Window.partitionBy("path", "track").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    dts = F.coalesce(F.sum("duration").over(w), F.lit(0))
    placed = samples.withColumns({"size": F.octet_length(payload).cast("long"), "chunk": F.floor(dts * 1000 / F.col("timescale") / CHUNK_MS)})
    narrow = placed.select("path", "track", "n", "size", "duration", "shift", "sync", "timescale", "chunk", "handler", "codec", "entry", "width", "height")
    heads = narrow.groupBy("path").applyInArrow(_heads, "path string, head binary")
    key = F.struct(F.col("chunk"), F.col("track"), F.col("n"))
    none = F.struct(F.lit(-1).cast("long").alias("chunk"), F.lit(-1).cast("long").alias("track"), F.lit(-1).cast("long").alias("n"))
    return placed.select("path", key.alias("part"), F.col(payload).alias("content")).unionByName(heads.select("path", none.alias("part"), F.col("head").alias("content")))


def written(parts: DataFrame, folder: str, tasks: int = 200) -> DataFrame:
    """(path, bytes) of files written below ``folder``, each streamed by one task in the order of its parts.

    A file gets its name when it is whole, so a task that is tried again leaves no part of a file in place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        place = folder.replace("file:///", "/", 1) if folder.startswith("file:///") else folder
        files, root = fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)
        files.create_dir(root, recursive=True)
        path, stream, staged, size = None, None, "", 0

        def close() -> pa.RecordBatch:
            stream.close()
            files.move(staged, f"{root}/{path}")
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size])], names=["path", "bytes"])

        for batch in batches:
            for name, cell in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if name != path:
                    if stream is not None:
                        yield close()
                    path, size, staged = name, 0, f"{root}/.{uuid.uuid4().hex}"
                    stream = files.open_output_stream(staged)
                content = cell.as_py() or b""
                stream.write(content)
                size += len(content)
        if stream is not None:
            yield close()

    return parts.repartition(tasks, "path").sortWithinPartitions("path", "part").mapInArrow(run, "path string, bytes long")
