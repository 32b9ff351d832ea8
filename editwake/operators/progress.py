"""Running extremes over a global order, without a single-task window over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editwake.functions.columns import bucket, free_name

BLOCK = 1 << 16
SUPER = 1 << 12


def running(df: DataFrame, order: str, value: str, out: str, how: str = "max", inclusive: bool = False, block: int = BLOCK) -> DataFrame:
    """Adds out: max, min or sum (how) of value over all rows with a smaller order, or an equal one if inclusive.

    Rows go to blocks of `block` consecutive order numbers. A block's figure comes from a partial aggregate; prefixes run
    over blocks within groups of 4096 blocks, then over those groups, so only 1 in 2**28 order numbers meets in one task.
    Within its block a row looks at the rows before it. Ties in order see neither each other nor themselves unless
    inclusive. NULL values are passed over; rows whose order is NULL take no part and get NULL. Nothing before: NULL.
    """
    pick = {"max": F.max, "min": F.min, "sum": F.sum}[how]
    meet = {"max": F.greatest, "min": F.least, "sum": _plus}[how]
    blk, sup, own, before = (free_name(df, n) for n in ("block", "super", "own", "before"))
    known = df.where(F.col(order).isNotNull()).withColumn(blk, bucket(F.col(order), block))
    blocks = known.groupBy(blk).agg(pick(value).alias(own)).withColumn(sup, bucket(F.col(blk), SUPER))
    supers = blocks.groupBy(sup).agg(pick(own).alias(own))
    earlier = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select(sup, pick(own).over(earlier().orderBy(sup)).alias(before))
    prefix = blocks.join(supers, sup).select(blk, meet(F.col(before), pick(own).over(earlier(sup).orderBy(blk))).alias(before))
    frame = Window.partitionBy(blk).orderBy(order).rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = known.join(prefix, blk, "left").withColumn(out, meet(F.col(before), pick(value).over(frame)))
    keep: list[Column] = [F.col(f"`{c}`") for c in df.columns] + [F.col(out)]
    result = joined.select(*keep)
    if not df.schema[order].nullable:
        return result
    unknown = df.where(F.col(order).isNull()).withColumn(out, F.lit(None).cast(result.schema[out].dataType))
    return result.unionByName(unknown.select(*keep))


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def next_at_or_after(points: DataFrame, point: str, probes: DataFrame, probe: str, out: str) -> DataFrame:
    """probes (distinct values of one column) with out: the least point at or after the probe, NULL where there is none.

    Both are cut into the same blocks of values as in running(), from the top down; nothing is joined by range.
    """
    both = points.select((-F.col(point)).alias("_ew_at"), F.col(point).alias("_ew_point")).unionByName(
        probes.select((-F.col(probe)).alias("_ew_at"), F.lit(None).cast("bigint").alias("_ew_point"))
    )
    return (
        running(both, "_ew_at", "_ew_point", out, "min", inclusive=True)
        .where("_ew_point is null and _ew_at is not null")
        .select((-F.col("_ew_at")).alias(probe), out)
    )


#: Seconds in a row of the clock's bitmap, and the longest span of seconds that is broadcast as one (32 MB, 8 years).
BITS, LONGEST = 1 << 15, 1 << 28


class Clock:
    """The seconds at which the clock stood, as a bitmap, and the next of them at or after a bound."""

    def __init__(self, first: int, bits: np.ndarray) -> None:
        self.first, self.bits = first, bits
        filled = np.where(bits != 0, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
        self.next_byte = np.r_[np.minimum.accumulate(filled[::-1])[::-1], np.int32(len(bits)), np.int32(len(bits))]
        self.last = first + len(bits) * 8

    def at_or_after(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next second of the clock per bound, and whether there is none."""
        offset = np.clip(bounds - self.first, 0, len(self.bits) * 8)
        at = offset >> 3
        padded = np.r_[self.bits, np.zeros(2, np.uint8)]
        here = padded[at] & (np.uint8(0xFF) << (offset & 7).astype(np.uint8))
        after = self.next_byte[np.minimum(at + 1, len(self.bits))]
        byte = np.where(here != 0, at, after)
        value = np.where(here != 0, here, padded[byte]).astype(np.int64)
        lowest = np.log2(np.maximum(value & -value, 1)).astype(np.int64)
        return self.first + byte * 8 + lowest, value == 0


def clock_of(ordered: DataFrame) -> Clock | None:
    """The bitmap of all clock seconds: its size is the time that the stream covers, not its edits. None beyond LONGEST."""
    low, high = ordered.agg(F.min("upto"), F.max("upto")).first()
    if low is None or high - low > LONGEST:
        return None
    rows = ordered.groupBy(bucket(F.col("upto"), BITS).alias("k")).agg(F.bitmap_construct_agg(F.pmod("upto", F.lit(BITS))).alias("b")).collect()
    first, size = low // BITS, BITS // 8
    bits = np.zeros((high // BITS - first + 1) * size, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.b), np.uint8)
        bits[(r.k - first) * size : (r.k - first) * size + len(part)] = part
    return Clock(first * BITS, bits)


OPENER = "qid string, released bigint, ts bigint, seq bigint, upto bigint, bound bigint, closed_at bigint"


def hops(horizon: int, clock: Clock | None = None):
    """Over rows sorted by (qid, upto): those that open a window, from one opener to the next by a search.

    A task holds an Arrow batch and, from batch to batch, the item and the time from which its next edit opens a window.
    closed_at is looked up in the clock if it is given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, free_from = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if clock is not None:
                closed, never = clock.at_or_after(batch.column(5).to_numpy())
                batch = pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(closed, pa.int64(), mask=never)], names=batch.schema.names)
            names = batch.column(0)
            codes = names.dictionary_encode().indices.to_numpy()
            upto = batch.column(4).to_numpy()
            open_ended = batch.column(6).is_null().to_numpy(zero_copy_only=False)
            frees = batch.column(6).fill_null(0).to_numpy() + horizon  # from here on, the next edit opens a window
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            ends = np.r_[starts[1:], n]
            chosen = np.zeros(n, bool)
            chosen[starts] = True
            first_name = names[0].as_py()
            again = (~open_ended[starts] & (upto[ends - 1] >= frees[starts])).tolist()
            if first_name == carried:
                chosen[0], again[0] = False, True
            for s, e, more in zip(starts.tolist(), ends.tolist(), again, strict=True):
                if not more:
                    continue
                if s == 0 and first_name == carried:
                    at = e if free_from is None else int(np.searchsorted(upto[:e], free_from))
                else:
                    at = s
                while at < e:
                    chosen[at] = True
                    if open_ended[at]:
                        break
                    at += 1 + int(np.searchsorted(upto[at + 1 : e], frees[at]))
            last = np.flatnonzero(chosen[starts[-1] :])
            if len(last):
                k = int(starts[-1] + last[-1])
                free_from = None if open_ended[k] else int(frees[k])
            carried = names[n - 1].as_py()
            yield batch.filter(pa.array(chosen))

    return run
