"""Sharding by a two-pass external shuffle.

Pass one scatters rows into buckets by a seeded hash; the number of buckets follows the table's
bytes.  Equal rows that would fill a bucket by themselves are numbered, and the number is hashed as
well, so a bucket fits in one task's memory (beyond one single row's size).  Pass two puts each bucket in
a canonical order and applies a seeded Fisher-Yates shuffle.  A bucket's offset plus the position inside it
is the row's rank in a global random order; equal stretches of ranks are the shards, so row counts
differ by one at most (law ``rows``) and slots are gapless.  ``write_shards`` writes a bucket as one file
in each shard that it reaches, one or two, without a further shuffle.

Defined results: a null text has size 8 and the checksum of empty bytes; repeated rows get ranks of
their own, in any order among themselves; a null id sorts below all others; very long texts travel
whole; an empty table gives no rows; extra columns travel with their row, but columns
``shard`` and ``slot`` are replaced.  The order is the same in every run, however the table is partitioned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.prefix import numbered, running_offsets
from tidelane.llm.storage import Scratch, give_back

SHARDS = 24
BUCKET_BYTES = 16 << 20
BUCKET_ROWS = 20_000
#: Groups of equal rows (24 bytes each) that are broadcast at most; beyond, rows meet them by shuffle.
BROADCAST_GROUPS = 1_000_000


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A seeded Fisher-Yates permutation of range(n)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = np.arange(n)
    picks = rng.integers(0, np.arange(n, 0, -1))  # for i = n-1 .. 0: j uniform in 0..i
    for i, j in zip(range(n - 1, 0, -1), picks[: n - 1]):
        order[i], order[j] = order[j], order[i]
    return order


def _shuffler(seed: int, shards: int, rows: int) -> Callable[[pa.Table], pa.Table]:
    def shuffle(table: pa.Table) -> pa.Table:
        ids, crc, tie = (table.column(c).to_numpy(zero_copy_only=False) for c in ("__id", "__crc", "__tie"))
        canonical = np.lexsort((tie, crc, ids))
        bucket, offset = table.column("__bucket")[0].as_py(), table.column("__offset")[0].as_py()
        rank = offset + np.arange(table.num_rows)
        shard = rank * shards // rows
        taken = table.take(pa.array(canonical[fisher_yates(table.num_rows, seed * 1_000_003 + bucket)]))
        taken = taken.drop_columns(["__bucket", "__offset", "__id", "__crc", "__tie"])
        give_back()  # of the buckets before
        return taken.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(rank - -(-shard * rows // shards)))

    return shuffle


def external_shuffle(df: DataFrame, row_bytes: Column, *, shards: int = SHARDS, seed: int = 17, id_col: str = "doc_id", text_crc: Column | None = None, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Deal all rows into ``shards`` shards in a seeded random order; adds ``shard`` and ``slot``."""
    df = df.drop("shard", "slot")
    scratch = Scratch(df.sparkSession, "shuffle")
    crc = text_crc if text_crc is not None else F.lit(0).cast("long")
    rest = [c for c, kind in df.dtypes if c != id_col and not kind.startswith(("map", "variant"))]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0).cast("long")
    same = ["__id", "__crc", "__tie"]
    keys = [row_bytes.alias("__bytes"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62))).alias("__id"), crc.alias("__crc"), tie.alias("__tie")]
    keyed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], *keys)  # the input's names are free
    groups = keyed.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.sum("__bytes").alias("size"))
    n, size = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    hot = scratch.keep(groups.where((F.col("n") > 1) & ((F.col("n") > bucket_rows // 4) | (F.col("size") > bucket_bytes // 4))).select(*same), "hot")
    buckets = max(1, -(-int(size) // bucket_bytes), -(-n // bucket_rows))
    at = lambda *keys: F.pmod(F.xxhash64(F.lit(seed), *same, *keys), F.lit(buckets))
    n_hot = hot.count()
    if not n_hot:
        keyed = keyed.withColumn("__bucket", at())
    else:
        few = F.broadcast(hot) if n_hot <= BROADCAST_GROUPS else hot
        dealt = numbered(keyed.join(few, same, "left_semi"), same, "__nth", scratch, "equal").withColumn("__bucket", at("__nth")).drop("__nth")
        keyed = keyed.join(few, same, "left_anti").withColumn("__bucket", at()).unionByName(dealt)
    keyed = keyed.drop("__bytes")
    counts = scratch.keep(keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    offsets = running_offsets(counts, "__bucket", F.col("n"), "__offset").drop("n")
    placed = keyed.join(offsets, "__bucket")
    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(df.schema.fields)], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return placed.groupBy("__bucket").applyInArrow(_shuffler(seed, shards, n), schema).toDF(*df.columns, "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> DataFrame:
    """Write each shard as a folder of files in slot order, and return the rows as read from there."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path).select(*sharded.columns)


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("long")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents into 24 shards under the law ``rows``; the result is read from the shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    dealt = external_shuffle(docs.select("doc_id", "text"), size, text_crc=text_crc32(F.col("text")))
    rows = write_shards(dealt, Scratch(spark, "shards").path("documents"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), text_crc32(F.col("text")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
