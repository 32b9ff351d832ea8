"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editwake import session
from editwake.functions.columns import free_name

SHARE = 0.05
BROADCAST_ROWS = 200_000


def _thin(counts: dict, room: int) -> dict:
    """Keeps at most room counters, by subtracting the first one left out from all."""
    if len(counts) <= room:
        return counts
    cut = sorted(counts.values(), reverse=True)[room]
    return {k: n - cut for k, n in counts.items() if n > cut}


def frequent_sketch(df: DataFrame, key: str, room: int) -> DataFrame:
    """A summary of each partition: (key_value, low), at most room rows with counts at most rows / (room + 1) too low.

    Summaries merge by adding counts; the error of the sum is at most all rows / (room + 1). Memory per task is room
    counters and one Arrow batch. NULL keys are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0).drop_null()).to_pylist():
                counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
            counts = _thin(counts, room)
        kind = pa.string()
        yield pa.RecordBatch.from_arrays(
            [pa.array([str(k) for k in counts], kind), pa.array(list(counts.values()), pa.int64())], names=["key_value", "low"]
        )

    session.ship(df.sparkSession)
    return df.select(F.col(key).cast("string")).mapInArrow(run, "key_value string, low bigint")


def heavy_keys(df: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """Keys that hold at least `share` of all rows, NULL keys' rows included in all: (key_value STRING, n BIGINT).

    A sketch of 8 / share counters per partition proposes at most 2 / share keys, all true ones among them; their rows are
    then counted exactly. Fewer than 1 / share keys come out, so the result may be collected or broadcast. An empty table
    gives no key.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    total = df.count()
    low = frequent_sketch(df, key, int(8 / share)).groupBy("key_value").agg(F.sum("low").alias("low"))
    proposed = [r[0] for r in low.where(F.col("low") >= F.lit(total * share * 7 / 8 - 1)).collect()]
    exact = df.where(F.col(key).cast("string").isin(proposed)).groupBy(F.col(key).cast("string").alias("key_value"))
    return exact.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.lit(total * share))


def split_by_weight(df: DataFrame, key: str, share: float = SHARE) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows of heavy keys (by a broadcast join with the list, which has fewer than 1 / share rows), all other rows, the list."""
    heavy = [r[0] for r in heavy_keys(df, key, share).collect()]
    listed = df.sparkSession.createDataFrame([(k,) for k in heavy], "_ew_heavy string")
    same = F.col(key).cast("string") == F.col("_ew_heavy")
    return df.join(F.broadcast(listed), same, "left_semi"), df.join(F.broadcast(listed), same, "left_anti"), heavy


def key_counts(df: DataFrame, key: str, aggs: dict[str, tuple[str, str]], share: float = SHARE, salts: int = 64) -> DataFrame:
    """Decomposable figures per key: aggs maps a name to (how, SQL expression) with how among count, sum, min, max.

    Heavy keys' rows are combined per key and salt (the value's hash) and then per key; the others take an ordinary
    shuffle; both are united. A NULL key is a key. Repeated rows count.
    """
    again = {"count": "sum", "sum": "sum", "min": "min", "max": "max"}
    salt = free_name(df, "salt")
    heavy, light, names = split_by_weight(df, key, share)
    figures = lambda: [getattr(F, how)(F.expr(e)).alias(name) for name, (how, e) in aggs.items()]
    part = heavy.withColumn(salt, F.pmod(F.xxhash64(*[F.expr(e) for _, e in aggs.values()], F.spark_partition_id()), F.lit(salts))).groupBy(key, salt).agg(*figures())
    whole = part.groupBy(key).agg(*[getattr(F, again[how])(name).alias(name) for name, (how, _) in aggs.items()])
    lights = light.groupBy(key).agg(*figures())
    return whole.unionByName(lights) if names else lights


def keys_by_share(df: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """(key_value STRING, n): keys that hold at least `share` of all rows, NULL keys' rows included in all.

    All keys are counted as in key_counts(): the heavy ones found by the sketch apart, by broadcast of their list, the
    others by an ordinary shuffle, both united. What reaches the share is then exact, whatever the sketch proposed.
    """
    counted = key_counts(df.select(key), key, {"n": ("count", "1")}, share).where(F.col(key).isNotNull())
    return counted.where(F.col("n") >= F.lit(share * df.count())).select(F.col(key).cast("string").alias("key_value"), "n")


def _ranks(percents: list[int]) -> list:
    """Position of each percentile: the least r with r / n >= p / 100, at least 1."""
    return [F.greatest(F.lit(1), F.ceil(F.col("_ew_all") * p / 100).cast("bigint")).alias(f"_ew_r{p}") for p in percents]


def key_percentiles(df: DataFrame, key: str, value: str, percents: list[int], share: float = SHARE, ranges: int | None = None) -> DataFrame:
    """Exact figures per key: n (non-NULL values), low, high, p<percent> (the least value with that share of values at or below).

    Rows are first combined per (key, value), spread by both. Light keys are then resolved by one window per key. The
    values of heavy keys are sorted into `ranges` ranges (default: the shuffle partitions) that hold about equally many
    distinct values, whatever their distribution, by a sampled range partitioning; prefix sums over the ranges find the
    one of each percentile, and only those ranges are searched, each by itself. Keys without any value are left out.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    heavy, light, _ = split_by_weight(df.select(key, value).where(F.col(value).isNotNull()), key, share)
    # Rows without a key may be many too: they are treated as a heavy key.
    heavy, light = heavy.unionByName(light.where(F.col(key).isNull())), light.where(F.col(key).isNotNull())
    per_value = lambda rows: rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_ew_n"))
    picked = lambda: [F.min(F.when(F.col("_ew_upto") >= F.col(f"_ew_r{p}"), F.col(value))).alias(f"p{p}") for p in percents]
    upto = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    lights = per_value(light).withColumn("_ew_upto", F.sum("_ew_n").over(upto)).withColumn("_ew_all", F.sum("_ew_n").over(Window.partitionBy(key)))
    lights = lights.select("*", *_ranks(percents)).groupBy(key).agg(
        F.max("_ew_all").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), *picked()
    )
    # The partition number is written down: a range stays what it was if a task runs again.
    ranged = session.stage(per_value(heavy).repartitionByRange(ranges, key, value).withColumn("_ew_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(key, "_ew_range").agg(F.sum("_ew_n").alias("_ew_sum"), F.min(value).alias("low"), F.max(value).alias("high"))
    of_key = Window.partitionBy(key)
    before = F.sum("_ew_sum").over(of_key.orderBy("_ew_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(
        F.col(key).alias("_ew_key"), F.col("_ew_range").alias("_ew_which"), "_ew_sum", F.coalesce(before, F.lit(0)).alias("_ew_before"),
        F.sum("_ew_sum").over(of_key).alias("_ew_all"), F.min("low").over(of_key).alias("low"), F.max("high").over(of_key).alias("high"),
    ).select("*", *_ranks(percents))
    holds = [(F.col("_ew_before") < F.col(f"_ew_r{p}")) & (F.col(f"_ew_r{p}") <= F.col("_ew_before") + F.col("_ew_sum")) for p in percents]
    wanted = sums.where(F.array_contains(F.array(*holds), True)).drop("_ew_sum")  # at most a range per heavy key and percentile
    inside = Window.partitionBy(key, "_ew_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.join(F.broadcast(wanted), F.col(key).eqNullSafe(F.col("_ew_key")) & (F.col("_ew_range") == F.col("_ew_which")))
    found = found.withColumn("_ew_upto", F.col("_ew_before") + F.sum("_ew_n").over(inside))
    heavies = found.groupBy(key).agg(F.max("_ew_all").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"), *picked())
    return heavies.unionByName(lights)


def skew_join(big: DataFrame, side: DataFrame, key: str, share: float = SHARE, how: str = "left") -> DataFrame:
    """big joined with side on a key: heavy keys by broadcast of their side rows, the rest by an ordinary join.

    Where side has a row per key, fewer than 1 / share rows are broadcast; they are counted, and beyond BROADCAST_ROWS
    (side repeats a heavy key very often) heavy keys take an ordinary join too. Left or inner; NULL keys match nothing; a
    key that side repeats repeats the row. Clashing columns of side are renamed with a trailing underscore.
    """
    if how not in {"left", "inner"}:
        raise ValueError("how must be left or inner")
    taken = {c.lower() for c in big.columns} - {key.lower()}
    for c in side.columns:
        if c.lower() in taken:
            side = side.withColumnRenamed(c, f"{c}_")
    heavy, light, names = split_by_weight(big, key, share)
    rest = light.where(F.col(key).isNotNull()).join(side, key, how)
    if how == "left":  # rows without a key meet nothing and needn't be brought together
        rest = rest.unionByName(light.where(F.col(key).isNull()), allowMissingColumns=True)
    if not names:
        return rest
    few = side.where(F.col(key).cast("string").isin(names))
    counted = few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return heavy.join(F.broadcast(few) if counted else few, key, how).unionByName(rest)
