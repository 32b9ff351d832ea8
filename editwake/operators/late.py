"""Late and out-of-order rows: event-time periods that late rows correct, up to a cut-off."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editwake.functions.columns import bucket, free_name
from editwake.operators.progress import running

LATENESS = 21_600
PERIOD = 3_600


def with_lateness(df: DataFrame, time: str = "ts", order: str = "seq", lateness: int = LATENESS, clock_from: int | None = None) -> DataFrame:
    """Adds clock (the watermark's base: highest time of all rows before this one) and late (beyond the allowed lateness).

    clock_from is the clock that an earlier micro-batch left behind. Exactly `lateness` seconds below the clock is in time.
    A row without a time or an arrival number has late = NULL: it can neither count in a period nor be measured against
    the clock. An empty table gives an empty table. The first rows have no clock and are in time.
    """
    out = running(df, order, time, "clock")
    if clock_from is not None:
        out = out.withColumn("clock", F.greatest("clock", F.lit(clock_from).cast("bigint")))
    known = F.col(time).isNotNull() & F.col(order).isNotNull()
    return out.withColumn("late", F.when(known, F.coalesce(F.col(time) < F.col("clock") - F.lit(lateness), F.lit(False))))


def split_late(df: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Rows that count, and rows diverted: too late, or without a time or arrival number (late is NULL there)."""
    marked = with_lateness(df, **how)
    return marked.where("not late").drop("late", "clock"), marked.where("late or late is null")


def period_updates(
    df: DataFrame, keys: list[str], time: str = "ts", order: str = "seq", batch: str = "batch_id", period: int = PERIOD, lateness: int = LATENESS
) -> DataFrame:
    """The upserts of a keyed state, one row per key, period and batch that changed it.

    State per (keys, period) is a count; each delivered batch adds its in-time rows and emits the new value with its
    version, 1 upwards. The last version of a key is its corrected result. Rows are summed per batch before they are
    shuffled; a key's versions are bounded by the batches within the lateness, not by its rows. NULL keys form a group of
    their own, a NULL batch comes first.
    """
    on_time = with_lateness(df, time, order, lateness).where("not late")
    start, got = free_name(df, "start"), free_name(df, "got")
    part = on_time.groupBy(*keys, (bucket(F.col(time), period) * period).alias(start), F.col(batch)).agg(F.count(F.lit(1)).alias(got))
    by_key = Window.partitionBy(*keys, start).orderBy(F.col(batch).asc_nulls_first())
    return part.select(
        *keys, F.col(start).alias("period_start"), F.col(batch),
        F.row_number().over(by_key).alias("version"),
        F.sum(got).over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias("edits"),
    )


def apply_upserts(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The state after all upserts: per key and period the row of the highest version."""
    others = [c for c in updates.columns if c not in {*keys, "period_start", "version"}]
    last = updates.groupBy(*keys, "period_start").agg(F.max(F.struct("version", *others)).alias("last"))
    return last.select(*keys, "period_start", "last.*")


def late_report(df: DataFrame, keys: list[str], time: str = "ts", order: str = "seq", period: int = PERIOD, lateness: int = LATENESS) -> DataFrame:
    """Diverted rows per key and period, with the greatest lateness; rows without time or arrival number apart."""
    cut = with_lateness(df, time, order, lateness).where("late or late is null")
    return cut.groupBy(*keys, (bucket(F.col(time), period) * period).alias("period_start")).agg(
        F.count(F.when(F.col("late"), 1)).alias("too_late"),
        F.count(F.when(F.col("late").isNull(), 1)).alias("unplaced"),
        F.max(F.when(F.col("late"), F.col("clock") - F.col(time))).alias("most_seconds_late"),
    )
