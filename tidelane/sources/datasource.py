"""Python data sources: frames of media files as a reader, and whole files as a sink that commits at the end.

``register(spark)`` adds the formats ``tidelane_frames`` (options ``path`` and ``kind``) and ``tidelane_files`` (option ``path``;
columns name and content).  Paths are local, ``file://`` or anything else that Arrow's file systems open.
"""

from __future__ import annotations

import itertools
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidelane.sources import containers

#: Frame parsers and their columns by kind: the registry that a new format is added to.
KINDS = {
    "adts": (containers.adts_frames, containers.ADTS_SCHEMA),
    "annexb": (containers.annexb_units, containers.ANNEXB_SCHEMA),
    "ivf": (containers.ivf_frames, containers.IVF_SCHEMA),
    "mp4": (containers.mp4_tables, containers.MP4_SCHEMA),
}


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


@dataclass
class FilePartition(InputPartition):
    path: str


class FrameReader(DataSourceReader):
    """One partition a file."""

    def __init__(self, path: str, kind: str, schema: StructType):
        self.path, self.kind, self.schema = path, kind, schema

    def partitions(self) -> list[FilePartition]:
        files, root = opened(self.path)
        info = files.get_file_info(root)
        if info.type == arrow_fs.FileType.File:
            return [FilePartition(root)]
        found = files.get_file_info(arrow_fs.FileSelector(root, recursive=True))
        return [FilePartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == arrow_fs.FileType.File]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        with files.open_input_stream(partition.path) as stream:
            data = stream.read()
        schema = to_arrow_schema(self.schema)
        rows = ((partition.path, *row) for row in KINDS[self.kind][0](data))
        while held := list(itertools.islice(rows, containers.BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelane_frames"

    def schema(self) -> str:
        return f"path string, {KINDS[self.options['kind']][1]}"

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options["path"], self.options["kind"], schema)


@dataclass
class WrittenFiles(WriterCommitMessage):
    pairs: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """Writes rows to a folder of the job below the target; files take their places at the commit, and none after a failure.

    A task that outlives a failed job may leave its part in that folder, never in a file's place.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staging = path, overwrite, f".tidelane-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WrittenFiles:
        files, root = opened(self.path)
        files.create_dir(posixpath.join(root, self.staging), recursive=True)
        pairs: list[tuple[str, str]] = []
        for row in iterator:
            target = posixpath.join(root, row.name)
            if not self.overwrite and files.get_file_info(target).type != arrow_fs.FileType.NotFound:
                raise FileExistsError(target)
            pairs.append((posixpath.join(root, self.staging, uuid.uuid4().hex), target))
            with files.open_output_stream(pairs[-1][0]) as stream:
                stream.write(bytes(row.content or b""))
        return WrittenFiles(pairs)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _ = opened(self.path)
        for message in messages:
            for staged, target in message.pairs if message else ():
                files.create_dir(posixpath.dirname(target), recursive=True)
                files.move(staged, target)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = opened(self.path)
        place = posixpath.join(root, self.staging)
        if files.get_file_info(place).type != arrow_fs.FileType.NotFound:
            files.delete_dir(place)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelane_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    for source in (FrameSource, FileSink):
        spark.dataSource.register(source)
