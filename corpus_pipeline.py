"""A corpus pipeline over ``documents``: five stages of the operators in ``tidelane.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run``
writes every stage's result as Parquet in the shared folder and reads it again for the next one.
All stages but the last return the columns of ``documents``; the last adds shard and slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.decontamination import decontaminate
from tidelane.llm.jaccard_join import keep_one_of_each
from tidelane.llm.mixing import label_weights, repeat_rows
from tidelane.llm.sharding import external_shuffle, text_crc32
from tidelane.llm.storage import Scratch
from tidelane.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity model rejects."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources come near their target weights."""
    return repeat_rows(docs, quality=label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal all rows into shards in a seeded random order; adds shard and slot."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    return external_shuffle(docs, size, text_crc=text_crc32(F.col("text")))


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The toxicity model is not expressible in SQL; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
