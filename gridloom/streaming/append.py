"""Streaming ingest and counters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import shared_folder


def append_new(spark: SparkSession, source: DataFrame, library: str, key: str, checkpoint: str) -> None:
    """Appends a stream's rows with unseen keys to a Parquet library, batch by batch, until the source has no more.

    Each micro-batch is reduced to one row per key, the least by its other columns, and set against the keys stored by other
    batches. A batch writes to its own folder (batch_id=n), so a batch that is run again after a failure replaces what it
    wrote. Null keys are left out.
    """

    def add(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        fresh = batch.where(F.col(key).isNotNull())
        fresh = fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*").select(*batch.columns) if rest else fresh.distinct()
        place = s.sparkContext._jvm.org.apache.hadoop.fs.Path(library)
        if place.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).exists(place):
            schema = T.StructType([f for f in batch.schema.fields] + [T.StructField("batch_id", T.LongType())])
            known = s.read.schema(schema).parquet(library).where(F.col("batch_id") != number).select(key)
            fresh = fresh.join(known, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{library}/batch_id={number}")

    source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_counts(spark: SparkSession, source: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and first and last times per key of a stream, kept as state between batches; the final table."""
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    counts = source.groupBy(*keys).agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")
        keep.last = number

    query = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out/{keep.last}")
