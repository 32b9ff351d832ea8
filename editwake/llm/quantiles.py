"""Percentiles of very large columns by distributed multi-select."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editwake import session

#: Distinct values that a block of a group holds on average. A block is a node of the selection: one sorted array.
BLOCK_VALUES = 512
BROADCAST_ROWS = 100_000


def summary(df: DataFrame, groups: list[str], value: str, part: str | None = None, relative_error: float = 0.0) -> DataFrame:
    """The mergeable form of a part (a day, a partition): distinct values per group with their counts (_ew_v, _ew_n, _ew_part).

    With relative_error 0 nothing is lost. With e > 0 a value v is replaced by the middle of its logarithmic cell, within
    e * |v| of it, so that a group holds about log(range) / e values per part, however many rows it has; zero stays zero.
    Parts merge by union. NULL and NaN values are left out; a NULL group is a group.
    """
    v = F.col(value)
    if relative_error:
        base = (1 + relative_error) / (1 - relative_error)
        cell = F.ceil(F.log(F.abs(v.cast("double"))) / F.log(F.lit(base)))
        v = F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v.cast("double")) * 2 * F.pow(F.lit(base), cell) / (base + 1))
    rows = df.select(*groups, v.alias("_ew_v"), (F.col(part) if part else F.lit(None)).cast("string").alias("_ew_part"))
    kept = rows.where(F.col("_ew_v").isNotNull() & (~F.isnan(F.col("_ew_v").cast("double"))))
    return kept.groupBy(*groups, "_ew_part", "_ew_v").agg(F.count(F.lit(1)).alias("_ew_n"))


def _rank(percent: float) -> Column:
    """The rank sought: the least r with r / n >= percent / 100, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.col("n") * round(percent * 1000) / 100_000)).cast("bigint")


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast only where it was counted and is small; else the ordinary join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _match(groups: list[str], left: DataFrame, right: DataFrame) -> tuple[Column, DataFrame]:
    for g in groups:
        right = right.withColumnRenamed(g, f"_ew_{g}")
    on = F.lit(True)
    for g in groups:
        on = on & left[g].eqNullSafe(F.col(f"_ew_{g}"))
    return on, right


def _as_number(kind: T.DataType) -> tuple[str, int]:
    """How values are held in a block (bigint or double), and the decimal places of an exact decimal."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint", 0
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double", 0
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return "bigint", kind.scale
    raise TypeError(f"percentiles of {kind.simpleString()}: only whole numbers, floating point and decimals of up to 18 digits")


def _median(values: np.ndarray, upto: np.ndarray, start: int, end: int) -> tuple[object, int]:
    """Weighted median of values[start:end], upto being the running counts with a 0 in front, and their weight."""
    weight = int(upto[end] - upto[start])
    if not weight:
        return None, 0
    at = int(np.searchsorted(upto[1:], upto[start] + (weight + 1) // 2, "left"))
    return values[at].item(), weight


def _blocks(parts: DataFrame, groups: list[str], kind: str) -> DataFrame:
    """One row per block: its group's values sorted, with their counts. Values are spread over a group's blocks by hash."""
    sizes = parts.groupBy(*groups, "_ew_part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VALUES).cast("int").alias("_ew_blocks"))
    on, sizes = _match([*groups, "_ew_part"], parts, _small(sizes))
    spread = parts.join(sizes, on).withColumn("_ew_block", F.pmod(F.xxhash64("_ew_v"), F.col("_ew_blocks")))
    pairs = F.array_sort(F.collect_list(F.struct("_ew_v", "_ew_n")))
    held = spread.groupBy(*groups, "_ew_part", "_ew_block").agg(pairs.alias("x"))
    return held.select(*groups, F.col("x._ew_v").cast(f"array<{kind}>").alias("_ew_values"), F.col("x._ew_n").alias("_ew_counts"))


def _ask(kind: str):
    """What every block answers about each range in question: three counts around the pivot, and a median on either side."""
    number = pa.int64() if kind == "bigint" else pa.float64()
    asked_for = [("percent", pa.float64()), ("n", pa.int64()), ("rank", pa.int64()), ("low", number), ("high", number), ("pivot", number), ("rounds", pa.int32())]
    answers = [("below", pa.int64()), ("at", pa.int64()), ("above", pa.int64()), ("m_below", number), ("m_above", number)]
    out = pa.list_(pa.struct(asked_for + answers))

    def answer(values: np.ndarray, counts: np.ndarray, asked: list[dict]) -> list[dict]:
        upto = np.concatenate([[0], np.cumsum(counts)])
        told = []
        for q in asked:
            start = 0 if q["low"] is None else int(np.searchsorted(values, q["low"], "right"))
            end = len(values) if q["high"] is None else int(np.searchsorted(values, q["high"], "left"))
            if start >= end:
                continue
            if q["pivot"] is None:  # the first proposals: everything lies "above"
                left = right = start
            else:
                left, right = int(np.searchsorted(values, q["pivot"], "left")), int(np.searchsorted(values, q["pivot"], "right"))
            m_below, below = _median(values, upto, start, left)
            m_above, above = _median(values, upto, right, end)
            told.append(q | {"below": below, "at": int(upto[right] - upto[left]), "above": above, "m_below": m_below, "m_above": m_above})
        return told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts, asked = (batch.column(batch.schema.get_field_index(n)) for n in ("_ew_values", "_ew_counts", "asked"))
            flat_v, flat_n = values.flatten().to_numpy(), counts.flatten().to_numpy()
            ends = np.cumsum(np.asarray(values.value_lengths()))
            told = []
            start = 0
            for end, q in zip(ends.tolist(), asked.to_pylist(), strict=True):
                told.append(answer(flat_v[start:end], flat_n[start:end], q))
                start = end
            kept = [batch.column(i) for i, f in enumerate(batch.schema) if f.name.startswith("_ew_g")]
            names = [f.name for f in batch.schema if f.name.startswith("_ew_g")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(told, out)], names=[*names, "told"])

    return run


def select_percentiles(parts: DataFrame, groups: list[str], percents: list[float]) -> DataFrame:
    """Exact percentiles of merged summaries: (groups, percent, value, n, rounds).

    A group's distinct values lie in blocks (by part and hash), each one sorted array with counts. Every block proposes the
    weighted median of its values still in question; the weighted median of the proposals, each weighing as much as the
    rows it stands for, is the pivot; every block counts its rows below, at and above it; the ranges that can't hold the
    rank are discarded, the pivot with them unless it is the value sought. At least a quarter of the rows in question,
    about half as a rule, goes each round. All groups and percentiles take each round together, in one pass over the
    blocks: with its counts a block already sends the median of either side, so the next pivot needs no pass of its own.
    Rounds go on until every value is found. A block's answer takes a binary search, so a round costs little beyond
    reading the blocks of the groups still open. Nothing but row counts comes to the driver. Ties are values with counts.
    A group of any size is spread over its blocks; proposals per group are one per block.
    """
    spark = parts.sparkSession
    session.ship(spark)
    named, groups = groups, [f"_ew_g{i}" for i in range(len(groups))]
    merged = parts.select(*[F.col(g).alias(x) for g, x in zip(named, groups, strict=True)], "_ew_v", "_ew_n", "_ew_part")
    value_type = merged.schema["_ew_v"].dataType
    kind, places = _as_number(value_type)
    exact = F.col("_ew_v") if not places else (F.col("_ew_v") * F.lit(10**places).cast("decimal(19,0)")).cast("bigint")
    merged = session.stage(merged.withColumn("_ew_v", exact.cast(kind)), "multiselect")
    blocks = session.stage(_blocks(merged, groups, kind), "multiselect-blocks")
    totals = merged.groupBy(*groups).agg(F.sum("_ew_n").alias("n"))
    nothing = F.lit(None).cast(kind)
    start = [F.struct(
        F.lit(float(p)).alias("percent"), "n", _rank(p).alias("rank"), nothing.alias("low"), nothing.alias("high"), nothing.alias("pivot"), F.lit(0).alias("rounds"), F.lit(False).alias("found")
    ) for p in percents]
    state = session.stage(totals.where("n is not null").select(*groups, F.array(*start).alias("asked")), "multiselect-state")
    few = state.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # a row per group still open: it only gets fewer
    key = [*groups, "percent"]
    asked_type = f"percent:double,n:bigint,rank:bigint,low:{kind},high:{kind},pivot:{kind},rounds:int"
    told_type = f"array<struct<{asked_type},below:bigint,at:bigint,above:bigint,m_below:{kind},m_above:{kind}>>"
    keep = ", ".join(f"{g} {blocks.schema[g].dataType.simpleString()}" for g in groups)
    whole = Window.partitionBy(*key)
    by_median = whole.orderBy("median").rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.filter("asked", lambda q: ~q["found"])
    done = []
    while True:
        left_open = state.select(*groups, F.transform(open_, lambda q: q.dropFields("found")).alias("asked")).where(F.size("asked") > 0)
        on, asked = _match(groups, blocks, F.broadcast(left_open) if few else left_open)
        heard = blocks.join(asked, on).select(*groups, "_ew_values", "_ew_counts", "asked").mapInArrow(_ask(kind), f"{keep + ', ' if keep else ''}told {told_type}")
        told = heard.select(*groups, F.explode("told").alias("t")).select(*groups, "t.*")
        told = told.repartition(*groups) if groups else told.coalesce(1)  # all that follows goes by group: one shuffle
        sums = told.select("*", *[F.sum(c).over(whole).alias(f"all_{c}") for c in ("below", "at")])
        left = F.col("pivot").isNotNull() & (F.col("rank") <= F.col("all_below"))
        found = F.col("pivot").isNotNull() & ~left & (F.col("rank") <= F.col("all_below") + F.col("all_at"))
        sums = sums.select(
            *key, "n", "rank", "low", "high", "pivot", "rounds", "all_below", "all_at", left.alias("left"), found.alias("found"),
            F.when(left, F.col("m_below")).otherwise(F.col("m_above")).alias("median"), F.when(left, F.col("below")).otherwise(F.col("above")).alias("weight"),
        )
        sums = sums.withColumn("upto", F.sum("weight").over(by_median)).withColumn("all", F.sum("weight").over(whole))
        first = lambda c: F.first(c).alias(c)
        stepped = sums.groupBy(*key).agg(
            *[first(c) for c in ("n", "rank", "low", "high", "pivot", "rounds", "all_below", "all_at", "left", "found")],
            F.min(F.when((F.col("weight") > 0) & (F.col("upto") * 2 >= F.col("all")), F.col("median"))).alias("next"),
        ).select(
            *key, "n", F.when(F.col("pivot").isNull() | F.col("left"), F.col("rank")).otherwise(F.col("rank") - F.col("all_below") - F.col("all_at")).alias("rank"),
            F.when(F.col("left"), F.col("low")).otherwise(F.coalesce("pivot", "low")).alias("low"),
            F.when(F.col("left"), F.col("pivot")).otherwise(F.col("high")).alias("high"),
            F.when(F.col("found"), F.col("pivot")).otherwise(F.col("next")).alias("pivot"), (F.col("rounds") + 1).alias("rounds"), "found",
        )
        entry = F.struct("percent", "n", "rank", "low", "high", "pivot", "rounds", "found")
        state = session.stage(stepped.groupBy(*groups).agg(F.collect_list(entry).alias("asked")), "multiselect-state")
        done.append(state.select(*groups, F.explode(F.filter("asked", lambda q: q["found"])).alias("q")).select(*groups, "q.*"))
        if state.where(F.size(open_) > 0).isEmpty():
            break
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    value = F.col("pivot") if not places else (F.col("pivot").cast("decimal(18,0)") / F.lit(10**places).cast("decimal(19,0)"))
    return ends.select(*[F.col(x).alias(g) for g, x in zip(named, groups, strict=True)], "percent", value.cast(value_type).alias("value"), "n", "rounds")


def percentiles(df: DataFrame, groups: list[str], value: str, percents: list[float], relative_error: float = 0.0) -> DataFrame:
    """Percentiles of a column per group, each within relative_error of the exact one (0: exact). Groups without values are left out."""
    return select_percentiles(summary(df, groups, value, relative_error=relative_error), groups, percents)
