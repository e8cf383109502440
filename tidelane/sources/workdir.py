"""A folder that driver and executors share, for files that a job writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own in local mode only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    held = spark._jsc.sc().getCheckpointDir()
    if named or held.isDefined():
        return (named or held.get()).rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tidelane-"))
        atexit.register(lambda: [shutil.rmtree(p, ignore_errors=True) for p in _OWN])
    return "file://" + _OWN[0]


def new_place(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
