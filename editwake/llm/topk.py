"""Most frequent values by three-phase threshold top-k."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwake import session

FLUSH = 200_000
BROADCAST_ROWS = 100_000
#: Rows of a value that a node must have, on average over the nodes, for the value to be sent in the second phase.
LEAST_SHARE = 4


def local_counts(df: DataFrame, column: str, leaders: int) -> DataFrame:
    """What the nodes hold: (value, n, leader), where a node is a stretch of an input partition, counted in place.

    A node ends with its partition or at FLUSH distinct values, so that memory is bounded whatever the data; leader marks
    its `leaders` most frequent values. No row is shuffled. NULL values are left out.
    """

    def emit(counts: dict, node: str) -> Iterator[pa.RecordBatch]:
        values, ns = list(counts), list(counts.values())
        cut = sorted(ns, reverse=True)[leaders - 1] if len(ns) >= leaders else 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(values, pa.string()), pa.array(ns, pa.int64()), pa.array([n >= cut for n in ns]), pa.array([node] * len(ns), pa.string())],
            names=["value", "n", "leader", "node"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        counts: dict = {}
        part = 0
        for batch in batches:
            for x in pc.value_counts(batch.column(0).drop_null()).to_pylist():
                counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
            if len(counts) >= FLUSH:
                yield from emit(counts, f"{task.partitionId()}-{part}")
                counts, part = {}, part + 1
        if counts:
            yield from emit(counts, f"{task.partitionId()}-{part}")

    session.ship(df.sparkSession)
    return df.select(F.col(column).cast("string")).mapInArrow(run, "value string, n bigint, leader boolean, node string")


def frequent(df: DataFrame, column: str, k: int = 100, at_least: int = 0) -> DataFrame:
    """The k most frequent values (ties with the k-th included) and, if at_least is given, only those with that many rows.

    1. Each node sends its k leaders; the k-th largest sum of what was sent is a lower bound of the k-th true count.
    2. A value that reaches the bound has at least bound / nodes rows on some node: each node sends those. Where that
       share would be under LEAST_SHARE, nodes are merged first, so that it isn't.
    3. The counts of the values sent are looked up on all nodes and added up exactly.
    With at_least the bound is the larger of the two, so fewer values are sent. Values that are NULL don't count. An
    empty table gives no row. Returns (value STRING, n BIGINT).
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    nodes = session.stage(local_counts(df, column, k), "nodes")
    count = nodes.agg(F.countDistinct("node")).first()[0]
    leaders = nodes.where("leader").groupBy("value").agg(F.sum("n").alias("n"))
    kth = leaders.orderBy(F.desc("n")).limit(k).agg(F.min("n"), F.count(F.lit(1))).first()
    bound = max(kth[0] if kth[1] == k else 1, at_least, 1)
    if count > 1 and bound < LEAST_SHARE * count:
        # So many nodes that a node's share would fall to nearly nothing: they are merged into fewer, each value summed.
        count = max(1, bound // LEAST_SHARE)
        merged = F.pmod(F.xxhash64("node"), F.lit(count)).cast("int")
        nodes = session.stage(nodes.groupBy("value", merged.alias("node")).agg(F.sum("n").alias("n")), "nodes-merged")
    share = max(1, -(-bound // max(1, count)))
    sent = session.stage(nodes.where(F.col("n") >= share).select("value").distinct(), "sent")
    small = sent.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    exact = nodes.select("value", "n").join(F.broadcast(sent) if small else sent, "value", "left_semi").groupBy("value").agg(F.sum("n").alias("n"))
    reach = exact.where(F.col("n") >= bound)
    if at_least:
        return reach
    last = reach.orderBy(F.desc("n")).limit(k).agg(F.min("n")).first()[0]
    return reach.where(F.col("n") >= F.lit(last if last is not None else 1))


def frequent_share(df: DataFrame, column: str, share: float) -> DataFrame:
    """Values that hold at least `share` of all rows, rows with NULL included in all; at most 1 / share of them."""
    least = share * df.count()
    n = int(least) if least == int(least) else int(least) + 1
    return frequent(df, column, k=int(1 / share) + 1, at_least=max(1, n))
