"""Run a stream over what is there now and read its result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelane.sources.workdir import new_place

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"


def finished(stream: DataFrame, place: str | None = None, *, checkpoint: str | None = None, partitions: int | None = None) -> DataFrame:
    """All rows that ``stream`` gives for the input of now, written below ``place`` (a new folder by default).

    The same place and checkpoint go on where the last run ended.  State is kept in RocksDB, in ``partitions`` parts.
    """
    spark: SparkSession = stream.sparkSession
    place = place or new_place(spark, "stream")
    before = {k: spark.conf.get(k, None) for k in (PROVIDER, PARTITIONS)}
    spark.conf.set(PROVIDER, ROCKS)
    if partitions:
        spark.conf.set(PARTITIONS, str(partitions))
    try:
        run = stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", checkpoint or f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")
