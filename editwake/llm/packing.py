"""Items of varying length in containers of fixed capacity."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwake import session

#: Items that one best-fit run places. Fixed, so that memory and time per task don't depend on the data.
BLOCK_ITEMS = 16_384


def best_fit(sizes: list[int], clusters: list[int], sources: list[int], capacity: int) -> list[int]:
    """A bin number for each item, by conflict-constrained best fit: items of the largest clusters first, then the largest.

    Bins are ordered by what room they have left. Each carries a bitmap of its sources and one of its duplicate clusters
    (bit numbers are given; -1: in no cluster). Copies come first because each needs a bin of its own, which the other items
    then fill; placed last, they would find the bins full. An item looks up the least room that holds it and goes on to the successor
    until it meets the tightest bin that doesn't hold its cluster; among bins of equal room it prefers one without its
    source. Equal items of one cluster go on where the one before stopped, since all bins before hold the cluster.
    """
    copies = Counter(c for c in clusters if c >= 0)
    order = sorted(range(len(sizes)), key=lambda i: (-copies[clusters[i]], -sizes[i], clusters[i], sources[i]))
    rooms: list[int] = []  # rooms that some bin has, ascending
    by_room: dict[int, list[int]] = {}
    has_cluster: list[int] = []
    has_source: list[int] = []
    where = [0] * len(sizes)
    last: tuple[int, int] | None = None
    start = 0
    for i in order:
        size, cluster, source = sizes[i], clusters[i], 1 << sources[i]
        bit = 1 << cluster if cluster >= 0 else 0
        least = start if bit and last == (size, cluster) else size
        k, chosen = bisect_left(rooms, least), -1
        while k < len(rooms):
            second = -1
            for b in reversed(by_room[rooms[k]]):
                if not has_cluster[b] & bit:
                    if not has_source[b] & source:
                        chosen = b
                        break
                    second = b if second < 0 else second
                    if not bit:
                        break
            chosen = chosen if chosen >= 0 else second
            if chosen >= 0:
                break
            k += 1
        if chosen < 0:
            room = capacity
            chosen = len(has_cluster)
            has_cluster.append(0)
            has_source.append(0)
        else:
            room = rooms[k]
            same = by_room[room]
            same.remove(chosen)
            if not same:
                del by_room[room]
                rooms.pop(k)
        start, last = room, (size, cluster)
        has_cluster[chosen] |= bit
        has_source[chosen] |= source
        where[i] = chosen
        left = room - size
        if left:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(chosen)
    return where


def pieces(items: DataFrame, capacity: str, size: str = "tokens") -> DataFrame:
    """Items cut only where they exceed the capacity: piece, start and the piece's size replace the size."""
    full = F.ceil(F.col(size) / F.col(capacity)).cast("int") - 1
    cut = items.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(full, F.lit(0)))))
    start = F.col("piece").cast("bigint") * F.col(capacity)
    return cut.withColumn("start", start).withColumn(size, F.least(F.col(size) - start, F.col(capacity)))


def pack(items: DataFrame, capacities: DataFrame, item: str = "doc_id", size: str = "tokens", cluster: str = "cluster", source: str = "source") -> DataFrame:
    """Places every item in a container of each capacity: (pack_name, capacity_tokens, bin, item, piece, start, tokens).

    capacities is a small fixed list (pack_name, capacity_tokens). Items without tokens (empty or NULL text) need no room
    and aren't placed. An item larger than the capacity is cut into full containers and a rest. Two items of the same
    cluster never share a container; NULL clusters conflict with nothing. Items are spread at random, by the hash of their
    id, over blocks of about BLOCK_ITEMS, which are packed independently; every block can leave one container or so partly
    empty, a share that doesn't grow. A cluster of any size is spread over all blocks. Repeated ids are items each.
    """
    spark = items.sparkSession
    session.ship(spark)
    sizes = [tuple(r) for r in capacities.select("pack_name", "capacity_tokens").where("capacity_tokens > 0").distinct().collect()]
    if not sizes:
        raise ValueError("no capacity is given")
    table = spark.createDataFrame(sizes, "pack_name string, capacity_tokens int")
    kept = items.where(F.col(size) > 0).select(
        F.col(item).cast("bigint").alias("item"), F.col(size).cast("bigint").alias("tokens"), F.col(cluster).cast("bigint").alias("cluster"),
        F.col(source).cast("string").alias("source"),
    )
    kept = session.stage(kept, "pack")  # read twice, measured once
    blocks = max(1, -(-kept.count() // BLOCK_ITEMS))
    cut = pieces(kept.crossJoin(F.broadcast(table)), "capacity_tokens", "tokens")  # the fixed list of capacities
    block = F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)).cast("int")
    spread = cut.withColumn("block", block)

    def run(rows: pa.Table) -> pa.Table:
        name, capacity, number = (rows.column(c)[0].as_py() for c in ("pack_name", "capacity_tokens", "block"))
        clusters = rows.column("cluster").to_numpy()  # NULL is NaN here
        codes = np.full(len(clusters), -1)
        there = clusters == clusters
        # Only clusters met twice in the block can conflict; the others need no bit.
        ids, inverse, often = np.unique(rows.column("cluster").drop_null().to_numpy(), return_inverse=True, return_counts=True)
        bits = np.where(often > 1, np.cumsum(often > 1) - 1, -1)
        if len(ids):
            codes[there] = bits[inverse]
        kinds = rows.column("source").combine_chunks().dictionary_encode()
        sources = [len(kinds.dictionary) if x is None else x for x in kinds.indices.to_pylist()]
        bins = best_fit(rows.column("tokens").to_pylist(), codes.tolist(), sources, capacity)
        full = pa.array(np.asarray(bins, np.int64) + number * (1 << 32))
        return pa.table({
            "pack_name": pa.array([name] * rows.num_rows, pa.string()), "capacity_tokens": pa.array([capacity] * rows.num_rows, pa.int32()),
            "bin": full, "item": rows.column("item"), "piece": rows.column("piece"), "start": rows.column("start"), "tokens": rows.column("tokens"),
            "cluster": rows.column("cluster"), "source": rows.column("source"),
        })

    packed = spread.groupBy("pack_name", "capacity_tokens", "block").applyInArrow(
        run, "pack_name string, capacity_tokens int, bin bigint, item bigint, piece int, start bigint, tokens bigint, cluster bigint, source string"
    )
    return packed.withColumnRenamed("item", item).withColumnRenamed("tokens", size)


def fill(packed: DataFrame, size: str = "tokens") -> DataFrame:
    """Per capacity: containers, tokens, share filled, the fewest containers possible by size alone, and clashes (always 0)."""
    bins = packed.groupBy("pack_name", "capacity_tokens", "bin").agg(
        F.sum(size).alias("used"), F.count(F.lit(1)).alias("items"), (F.count("cluster") - F.countDistinct("cluster")).alias("clash"),
        F.countDistinct("source").alias("sources"),
    )
    return bins.groupBy("pack_name", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"),
        F.ceil(F.sum("used") / F.col("capacity_tokens")).alias("fewest"),
        (F.sum("used") / (F.count(F.lit(1)) * F.col("capacity_tokens"))).alias("filled"),
        F.count(F.when(F.col("used") > F.col("capacity_tokens"), 1)).alias("overfull"), F.sum("clash").alias("clashes"),
        F.avg("sources").alias("sources_per_container"),
    )


def checked(packed: DataFrame, items: DataFrame, capacities: DataFrame, item: str = "doc_id", size: str = "tokens") -> DataFrame:
    """Per capacity: items placed, and how often a rule is broken, which should be never.

    lost: items with tokens whose pieces don't add up to all of them; torn: items cut although they fit a container;
    overfull: containers above the capacity; clashes: copies that share a container.
    """
    keys = ["pack_name", "capacity_tokens"]
    placed = packed.groupBy(*keys, item).agg(F.sum(size).alias("_ew_placed"), F.count(F.lit(1)).alias("_ew_pieces"), F.countDistinct("start").alias("_ew_starts"))
    needed = items.where(F.col(size) > 0).groupBy(item).agg(F.sum(size).alias("_ew_needed"), F.count(F.lit(1)).alias("_ew_times"), F.max(size).alias("_ew_largest"))
    sizes = capacities.select(*keys).where("capacity_tokens > 0").distinct()
    wanted = needed.crossJoin(F.broadcast(sizes)).join(placed, [*keys, item], "left")  # the fixed list of capacities
    n = lambda c: F.count(F.when(c, 1))
    whole = F.coalesce(F.col("_ew_placed") == F.col("_ew_needed"), F.lit(False))
    per = wanted.groupBy(*keys).agg(
        n(whole).alias("placed"), n(~whole).alias("lost"), n((F.col("_ew_largest") <= F.col("capacity_tokens")) & (F.col("_ew_pieces") > F.col("_ew_times"))).alias("torn")
    )
    return per.join(fill(packed, size).select(*keys, "overfull", "clashes"), keys)
