"""Transport packets of a folder as a stream that can be read again from any offset.

``register(spark)`` adds the format ``tidelane_packets`` for ``readStream`` (options ``path``, ``splitBytes`` and ``growing``).  An offset
says for each file up to which byte its packets were given and how large the file was then, so a batch that is run
again reads the same bytes with the same surroundings, and gives the same rows, however much the files have grown since.  One
query's progress is no other's: each keeps its offsets in its checkpoint, and one that starts late begins with
the first byte of all files.

With ``growing``, the last few packets of a file wait until more follow them, as where packets begin is told by their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidelane.sources import ranges
from tidelane.sources.datasource import opened

HELD_BACK = (ranges.AROUND + 2) * max(ranges.STRIDES)
SCHEMA = f"path string, {ranges.PACKET_SCHEMA}"


@dataclass
class Span(InputPartition):
    path: str
    start: int
    stop: int
    size: int


class PacketStream(DataSourceStreamReader):
    def __init__(self, path: str, split_bytes: int, growing: bool, schema: StructType):
        self.path, self.split_bytes, self.growing, self.schema = path, split_bytes, growing, schema

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = opened(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == arrow_fs.FileType.File else files.get_file_info(arrow_fs.FileSelector(root, recursive=True, allow_not_found=True))
        known = {f.path: f.size for f in found if f.type == arrow_fs.FileType.File and not f.base_name.startswith((".", "_"))}
        return {p: [max(0, n - HELD_BACK) if self.growing else n, n] for p, n in sorted(known.items())}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        spans = []
        for path, (stop, size) in end.items():
            at = start.get(path, [0, 0])[0]
            while at < stop:
                spans.append(Span(path, at, min(at + self.split_bytes, stop), size))
                at += self.split_bytes
        return spans

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        file, arrow = files.open_input_file(partition.path), to_arrow_schema(self.schema)
        source = ranges.Source(lambda at, n: file.read_at(n, at), partition.size)
        for columns in ranges.ts_packets(source, partition.start, partition.stop):
            n = len(columns["packet"])
            cells = {"path": pa.array([partition.path] * n, pa.string()), **columns}
            yield pa.RecordBatch.from_arrays([c if isinstance(c := cells[f.name], pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow)

    def commit(self, end: dict) -> None:
        pass


class PacketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelane_packets"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> PacketStream:
        return PacketStream(self.options["path"], int(self.options.get("splitBytes", ranges.SPLIT_BYTES)), self.options.get("growing", "false").lower() == "true", schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PacketSource)
