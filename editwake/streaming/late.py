"""Counts per period that late rows correct, kept by a stream of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editwake.functions.columns import bucket
from editwake.operators import late
from editwake.streaming.state import VersionedState


class LateCounts:
    """foreachBatch target: keyed state (keys, period) -> count, upserts per batch, late rows diverted.

    The watermark is the highest time of all rows before a row, in order of the arrival number, less the lateness; the
    clock goes from batch to batch with the state, so it makes no difference how the rows are cut into batches. Batches
    have rising arrival numbers, as a file or log source delivers them. A period whose last second lies below the
    watermark can't change any more: it leaves the state for the finished counts, so the state holds the open periods
    only. `updates`, `diverted` and `finished` are appended per batch, again where a batch is delivered again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], time: str = "ts", order: str = "seq", period: int = late.PERIOD, lateness: int = late.LATENESS) -> None:
        self.spark, self.path, self.keys, self.time, self.order, self.period, self.lateness = spark, path.rstrip("/"), keys, time, order, period, lateness
        self.state = VersionedState(spark, f"{self.path}/state")

    def _schema(self, rows: DataFrame) -> str:
        kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in self.keys)
        return f"{kinds}, period_start bigint, version bigint, edits bigint"

    def __call__(self, rows: DataFrame, batch: int) -> None:
        if not self.state.has(batch):
            self._take(rows, batch)
        self.state.append(batch, {name: f"{self.path}/{name}" for name in ("updates", "diverted", "finished")})

    def _take(self, rows: DataFrame, batch: int) -> None:
        clock = self.state.meta.get("clock")
        marked = late.with_lateness(rows, self.time, self.order, self.lateness, clock_from=clock)
        top = rows.where(F.col(self.order).isNotNull()).agg(F.max(self.time)).first()[0]
        clock = max((x for x in (clock, top) if x is not None), default=None)
        got = marked.where("not late").groupBy(*self.keys, (bucket(F.col(self.time), self.period) * self.period).alias("period_start")).agg(F.count(F.lit(1)).alias("got"))
        old = self.state.table("counts", self._schema(rows)).withColumn("fresh", F.lit(0)).withColumn("got", F.lit(0).cast("bigint"))
        new = got.withColumn("version", F.lit(0).cast("bigint")).withColumn("edits", F.lit(0).cast("bigint")).withColumn("fresh", F.lit(1))
        merged = old.unionByName(new).groupBy(*self.keys, "period_start").agg(
            (F.max("version") + F.max("fresh")).alias("version"), (F.sum("edits") + F.sum("got")).alias("edits"), F.max("fresh").alias("fresh")
        )
        done = F.lit(False) if clock is None else F.col("period_start") + (self.period - 1) < F.lit(clock - self.lateness)
        tables = {
            "counts": merged.where(~done).drop("fresh"), "finished": merged.where(done).drop("fresh"), "updates": merged.where("fresh = 1").drop("fresh"),
            "diverted": marked.where("late or late is null"),
        }
        self.state.commit(batch, tables, clock=clock)

    def counts(self) -> DataFrame:
        """All periods: the finished ones, and those that can still change."""
        return self.spark.read.parquet(self.state.folder("counts")).unionByName(self.spark.read.parquet(f"{self.path}/finished").drop("batch"))

    def diverted(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/diverted")

    def updates(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/updates")


def run(stream: DataFrame, target, checkpoint: str) -> None:
    """Feeds all that a stream has at present to a foreachBatch target, in micro-batches."""
    query = stream.writeStream.foreachBatch(target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
