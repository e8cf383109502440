"""The Matroska writer: clusters are made by groups of five seconds, their places by prefix sums of sizes, and files by ``mp4.written``.

Sizes and places are written in eight bytes, so no part's length depends on another's place and nothing is built twice.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.bits import joined_bytes

CLUSTER_MS = 5000
#: Ids of the elements that are written.
HEADER, SEGMENT, SEEK_HEAD, SEEK, SEEK_ID, SEEK_PLACE = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
INFO, SCALE, DURATION, MUXER, WRITER = 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, ENTRY, NUMBER, UID, KIND, LACING, CODEC, PRIVATE = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x63A2
VIDEO, WIDTH, HEIGHT, AUDIO, RATE, CHANNELS = 0xE0, 0xB0, 0xBA, 0xE1, 0xB5, 0x9F
CLUSTER, TIME, SIMPLE = 0x1F43B675, 0xE7, 0xA3
CUES, CUE, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TRACK_KINDS = {"video": 1, "audio": 2, "subtitle": 17}


def element(kind: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return kind.to_bytes((kind.bit_length() + 7) // 8) + (len(body) | 1 << 56).to_bytes(8) + body


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(8))


def _column_element(kind: int, *parts: Column) -> Column:
    """``element`` as a Column expression."""
    body = F.concat(*parts)
    return F.concat(F.lit(kind.to_bytes((kind.bit_length() + 7) // 8)), F.unhex(F.lpad(F.hex(F.octet_length(body).cast("long") + (1 << 56)), 16, "0")), body)


def _clusters(frames: DataFrame) -> DataFrame:
    """(path, cluster, content, cue_time, cue_track, last_ms): the frames of each cluster in order of time, its first key frame and last time."""
    base = F.col("cluster") * CLUSTER_MS
    place = F.unhex(F.concat(F.lpad(F.hex(F.col("track").bitwiseOR(0x80)), 2, "0"), F.lpad(F.hex(F.col("time_ms") - base), 4, "0"), F.when(F.col("keyframe"), "80").otherwise("00")))
    block = _column_element(SIMPLE, place, F.coalesce("payload", F.lit(b"")))
    order = [F.col(c) for c in ("time_ms", "track", "n")]
    made = frames.groupBy("path", "cluster").agg(F.sort_array(F.collect_list(F.struct(*order, block.alias("b")))).alias("rows"), F.min(F.when(F.col("keyframe"), F.struct(*order))).alias("cue"), F.max("time_ms").alias("last_ms"))
    made = made.withColumn("blocks", joined_bytes(F.col("rows.b")))
    time = _column_element(TIME, F.unhex(F.lpad(F.hex(base), 16, "0")))
    return made.select("path", "cluster", _column_element(CLUSTER, time, F.col("blocks")).alias("content"), F.col("cue.time_ms").alias("cue_time"), F.col("cue.track").alias("cue_track"), "last_ms")


def _ends(clusters: list[dict], shapes: list[dict]) -> tuple[bytes, bytes]:
    """A file's head and tail, from the sizes of its clusters and its tracks."""
    clusters = sorted(clusters, key=lambda c: c["cluster"])
    sizes = np.array([c["size"] for c in clusters])
    tracks = []
    for t in sorted(shapes, key=lambda t: t["track"]):
        shape = element(VIDEO, number(WIDTH, t["width"] or 0), number(HEIGHT, t["height"] or 0)) if t["kind"] == "video" else element(AUDIO, element(RATE, struct.pack(">d", t["rate"] or 0)), number(CHANNELS, t["channels"] or 0)) if t["kind"] == "audio" else b""
        private = element(PRIVATE, t["private"]) if t["private"] else b""
        tracks.append(element(ENTRY, number(NUMBER, t["track"]), number(UID, t["track"]), number(KIND, TRACK_KINDS[t["kind"]]), number(LACING, 0), element(CODEC, t["codec"].encode()), private, shape))
    longest = max(c["last_ms"] for c in clusters)
    info = element(INFO, number(SCALE, 1_000_000), element(DURATION, struct.pack(">d", float(longest))), element(MUXER, b"tidelane"), element(WRITER, b"tidelane"))
    held = element(TRACKS, *tracks)
    seeks = lambda *at: element(SEEK_HEAD, *[element(SEEK, element(SEEK_ID, k.to_bytes(4)), number(SEEK_PLACE, p)) for k, p in zip((INFO, TRACKS, CUES), at, strict=True)])
    first = len(seeks(0, 0, 0))
    begin = first + len(info) + len(held)
    places = begin + np.cumsum(sizes) - sizes
    cues = [element(CUE, number(CUE_TIME, t), element(CUE_PLACES, number(CUE_TRACK, k), number(CUE_CLUSTER, p))) for t, k, p in zip([c["cue_time"] for c in clusters], [c["cue_track"] for c in clusters], places.tolist(), strict=True) if t is not None]
    tail = element(CUES, *cues)
    header = element(HEADER, number(0x4286, 1), number(0x42F7, 1), number(0x42F2, 4), number(0x42F3, 8), element(0x4282, b"matroska"), number(0x4287, 4), number(0x4285, 2))
    size = begin + int(sizes.sum()) + len(tail)
    head = header + SEGMENT.to_bytes(4) + (size | 1 << 56).to_bytes(8) + seeks(first, first + len(info), begin + int(sizes.sum())) + info + held
    return head, tail


def _end_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [_ends(clusters.as_py(), shapes.as_py()) for clusters, shapes in zip(batch.column("clusters"), batch.column("tracks"), strict=True)]
        for part, i in ((-1, 0), (1 << 62, 1)):
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([part] * len(made), pa.int64()), pa.array([m[i] for m in made], pa.binary())], names=["path", "part", "content"])


def mux(samples: DataFrame, payload: str = "payload") -> DataFrame:
    """(path, part, content) of Matroska files for ``mp4.written``.

    ``samples``: path, track (1 to 126), n, time_ms, keyframe, kind (video, audio, subtitle), codec, private, width, height, rate,
    channels and the payload.
    """
    frames = samples.withColumn("cluster", F.floor(F.col("time_ms") / CLUSTER_MS)).select("path", "cluster", "track", "n", "time_ms", "keyframe", F.col(payload).alias("payload"))
    clusters = _clusters(frames)
    shape = ["track", "kind", "codec", "private", "width", "height", "rate", "channels"]
    tracks = samples.groupBy("path", "track").agg(*[F.first(c, True).alias(c) for c in shape[1:]]).groupBy("path").agg(F.collect_list(F.struct(*shape)).alias("tracks"))
    narrow = clusters.select("path", "cluster", F.octet_length("content").cast("long").alias("size"), "cue_time", "cue_track", "last_ms")
    files = narrow.groupBy("path").agg(F.collect_list(F.struct("cluster", "size", "cue_time", "cue_track", "last_ms")).alias("clusters")).join(tracks, "path")
    ends = files.select("path", "clusters", "tracks").mapInArrow(_end_parts, "path string, part long, content binary")
    return clusters.select("path", F.col("cluster").alias("part"), "content").unionByName(ends)
