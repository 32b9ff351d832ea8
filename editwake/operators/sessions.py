"""Activity split into sessions by gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editwake.functions.columns import bucket, free_name

GAP = 1_800


def sessions(df: DataFrame, user: str = "qid", time: str = "ts", gap: int = GAP) -> DataFrame:
    """One row per session of each user: session_start, session_end, duration_seconds, events.

    Time is cut into chunks of `gap` seconds. All rows of a user within one chunk lie within one session, so the local
    session of a chunk is a partial aggregate (first, last, rows) combined before the shuffle, however many rows the chunk
    has. Neighbouring local sessions are then merged where the gap at their boundary is at most `gap`; a user has at most
    one local session per chunk of time, so even one user with a third of all rows stays small. Exactly `gap` seconds do
    not split. Rows with a NULL user or time belong to no session. Order of arrival doesn't matter; repeated rows count.
    """
    if gap < 1:
        raise ValueError("gap must be at least 1 second")
    chunk, first, last, rows, number = (free_name(df, n) for n in ("chunk", "first", "last", "rows", "number"))
    placed = df.where(F.col(user).isNotNull() & F.col(time).isNotNull())
    local = placed.groupBy(F.col(user), bucket(F.col(time), gap).alias(chunk)).agg(
        F.min(time).alias(first), F.max(time).alias(last), F.count(F.lit(1)).alias(rows)
    )
    by_time = Window.partitionBy(user).orderBy(chunk)
    starts = F.coalesce(F.col(first) - F.lag(last).over(by_time) > gap, F.lit(True))
    numbered = local.withColumn("_ew_starts", starts.cast("int")).withColumn(
        number, F.sum("_ew_starts").over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(user, number).agg(
        F.min(first).alias("session_start"), F.max(last).alias("session_end"),
        (F.max(last) - F.min(first)).alias("duration_seconds"), F.sum(rows).alias("events"),
    ).drop(number)
