"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it again, so a
lost executor never loses an intermediate result.  A session with neither that setting nor a checkpoint
folder uses a folder of our own in local mode (tests, a notebook), and raises on a cluster.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one of our own in local mode only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    held = spark._jsc.sc().getCheckpointDir()
    if named or held.isDefined():
        return (named or held.get()).rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tidelane-"))
        atexit.register(_forget)
    return "file://" + _OWN[0]


def _forget() -> None:
    import shutil

    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """Named tables of one operator call; ``drop`` removes those that are no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a frame that reads the written table."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))  # known: no job to look for it

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now, not when the driver next collects garbage."""
        gc.collect()
        give_back()
        self.spark._jvm.System.gc()


class arrow_rows:
    """Within the block, jobs hand at most ``n`` rows to Python at once (wide rows: keep batches small)."""

    KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n = spark, n

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.KEY)
        self.spark.conf.set(self.KEY, str(self.n))

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(self.KEY, self.before)


def memory_returned(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that gives freed memory back to the system at its end.

    Python workers outlive their tasks, and what the C library keeps for them counts against the executor.
    """

    @functools.wraps(run)
    def kept_small(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return kept_small


def give_back(at_once: int = 0) -> None:
    """Return freed memory to the system, and from now on blocks of ``at_once`` bytes as soon as they are freed (glibc; nothing elsewhere)."""
    try:
        library = ctypes.CDLL(None)
        if at_once:
            library.mallopt(-3, at_once)  # M_MMAP_THRESHOLD
        else:
            library.malloc_trim(0)
            pa.default_memory_pool().release_unused()
    except (AttributeError, OSError):
        pass


def has_files(df: DataFrame) -> bool:
    """Whether ``df`` is a plain scan of files, so that rows stay in their file splits."""
    try:
        df.select("_metadata.file_path")
        return True
    except AnalysisException:
        return False


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shard_count(docs: DataFrame, text: str = "text", shard_bytes: int = 32 << 20) -> int:
    """Shards for an exchange of the texts: two for each shuffle partition, more where their bytes ask for it."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(2 * shuffle_partitions(docs.sparkSession), -(-int(size) // shard_bytes))
