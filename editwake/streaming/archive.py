"""The live archive: events of a feed, filtered and written by hour of their stream time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from editwake.config import DEFAULT, Filters
from editwake.operators.edits import captured


def archive_rows(messages: DataFrame, filters: Filters = DEFAULT.filters, text: str = "data", unknown_hour: str | None = None) -> DataFrame:
    """(hour, value) of messages worth keeping; without a readable stream time the present hour is taken, or unknown_hour."""
    rows = captured(messages.select(F.col(text).alias("text")), filters)
    missing = F.lit(unknown_hour) if unknown_hour else F.date_format(F.current_timestamp(), "yyyy-MM-dd-HH")
    return rows.select(F.coalesce("hour", missing).alias("hour"), F.col("text").alias("value"))


def archive(messages: DataFrame, folder: str, checkpoint: str, filters: Filters = DEFAULT.filters, once: bool = True, unknown_hour: str | None = None) -> StreamingQuery:
    """Writes gzip text files under <folder>/hour=<yyyy-MM-dd-HH>/. The file sink's log and the checkpoint make each event appear once."""
    writer = archive_rows(messages, filters, unknown_hour=unknown_hour).writeStream.format("text").partitionBy("hour").option("compression", "gzip")
    writer = writer.option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def hourly_counts(events: DataFrame, time: str = "stream_dt", delay: str = "6 hours") -> DataFrame:
    """Events per edition and hour of a typed stream by built-in windows, for output mode update."""
    return events.withWatermark(time, delay).groupBy(F.window(time, "1 hour"), "wiki").agg(F.count(F.lit(1)).alias("edits"))
