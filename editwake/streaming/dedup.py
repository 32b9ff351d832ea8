"""Repeated deliveries dropped from a stream: the batch operator's dictionary and bitmaps, one batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editwake.functions.columns import uuid_key
from editwake.operators.dedup import SeenStore


class FirstDeliveries:
    """foreachBatch target that appends each batch's first deliveries to <path>/rows/batch=<n>.

    The store's steps are the batches taken; a batch delivered again is written again from the result of its step and not
    taken twice. Results of the last two steps are kept. Unlike a fixed window of recent identifiers it forgets nothing.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 64, identifier: str = "event_id", order: str = "seq") -> None:
        self.path, self.identifier, self.order = path.rstrip("/"), identifier, order
        self.store = SeenStore(spark, f"{self.path}/seen", shards)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        keyed = rows.withColumn("_ew_id", uuid_key(F.col(self.identifier)))
        named = keyed.where(F.col("_ew_id").isNotNull() & F.col(self.order).isNotNull())
        step = batch + 1
        if self.store.steps < step:
            self.store.take(named.select(F.col("_ew_id").alias("id"), F.col(self.order).cast("bigint").alias("arrival")), keep_results=2)
        first = self.store.kept(step).withColumnRenamed("arrival", self.order)
        kept = named.join(first, self.order, "left_semi").unionByName(keyed.where(F.col("_ew_id").isNull() | F.col(self.order).isNull()))
        kept.drop("_ew_id").write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")

    def rows(self) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.path}/rows")


def within_watermark(stream: DataFrame, time: str, delay: str, identifier: str = "event_id") -> DataFrame:
    """Built-in bounded memory instead: an identifier is forgotten once the watermark passes it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([identifier])


