"""Pages resolved to items by a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwake import session
from editwake.config import DEFAULT, Resolution
from editwake.functions.columns import bucket, rate
from editwake.operators.progress import running
from editwake.sources.lookup import look_up

PAGE = ["wiki", "title"]


def resolved(edits: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Every edit with qid and found: found and NULL means known to have no item, not found means unknown.

    snapshot is unique on (wiki, title) and grows with the pages, so the join is an ordinary one, which adaptive execution
    splits where a page is hot. A NULL wiki or title is never found.
    """
    known = snapshot.select(*PAGE, "qid", F.lit(True).alias("found"))
    return edits.drop("qid", "found").join(known, PAGE, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def unresolved(edits: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Pages of edits that the snapshot doesn't know, once each, with their edits: what a client would have to look up."""
    pages = edits.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("edits"))
    return pages.join(snapshot.select(*PAGE), PAGE, "left_anti")


def upsert(snapshot: DataFrame, new: DataFrame) -> DataFrame:
    """The snapshot after new rows (wiki, title, qid[, version]): the highest version of a page wins, any new row over an old one."""
    version = F.col("version").cast("bigint") if "version" in new.columns else F.lit(0).cast("bigint")
    rows = snapshot.select(*PAGE, "qid", F.lit(-1).cast("bigint").alias("version")).unionByName(new.select(*PAGE, "qid", version.alias("version")))
    last = rows.groupBy(*PAGE).agg(F.max(F.struct("version", "qid")).alias("last"))
    return last.select(*PAGE, "last.qid")


SNAPSHOT = "wiki string, title string, qid string"


def online(edits: DataFrame, snapshot: DataFrame, make_client, settings: Resolution = DEFAULT.resolution) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edits resolved, the snapshot after it, and what was looked up: pages that the snapshot doesn't know are asked for once.

    Answers (an item, or none) go into the snapshot; pages whose lookup failed for good don't, so they are asked for again
    next time and stay unknown for now. A page without wiki or title is never asked for.
    """
    answers = session.stage(look_up(unresolved(edits, snapshot), make_client, settings), "answers")
    after = session.stage(upsert(snapshot, answers), "snapshot")
    return resolved(edits, after), after, answers


def counters(edits: DataFrame, snapshot: DataFrame, block: int = DEFAULT.resolution.block) -> DataFrame:
    """One row: how a cache in front of the snapshot would have been used, had the edits come in blocks in order of seq.

    A page's first reference reads the snapshot; further ones in its block are coalesced; later blocks hit the cache. A page
    the snapshot doesn't know isn't cached, so each block asks again. No cache entry is taken to have been evicted.
    """
    numbered = running(edits.where("seq is not null").select(*PAGE, "seq").withColumn("one", F.lit(1)), "seq", "one", "before", "sum")
    per = numbered.withColumn("block", bucket(F.coalesce("before", F.lit(0)), block)).groupBy(*PAGE, "block").agg(F.count(F.lit(1)).alias("n"))
    firsts = per.groupBy(*PAGE).agg(F.min("block").alias("first"))
    full = resolved(per.join(firsts, PAGE), snapshot)
    known, is_first = F.col("found"), F.col("block") == F.col("first")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    out = full.agg(
        total("n").alias("references"), total(F.when(known & ~is_first, F.col("n"))).alias("cache_hits"),
        total(F.when(known & ~is_first & F.col("qid").isNull(), F.col("n"))).alias("negative_cache_hits"),
        total(F.when(~known | is_first, F.col("n") - 1)).alias("coalesced"), total(F.when(known & is_first, 1)).alias("store_hits"),
        total(F.when(~known, 1)).alias("offline_unresolved"), total(F.when(known & is_first & F.col("qid").isNotNull(), 1)).alias("keys_with_item"),
        total(F.when(known & is_first & F.col("qid").isNull(), 1)).alias("keys_without_item"),
    )
    return out.withColumn("cache_hit_rate", F.coalesce(rate(F.col("cache_hits"), F.col("references")), F.lit(0.0)))


def with_item_rate(edits: DataFrame) -> DataFrame:
    """One row: edits, edits with an item, their share."""
    out = edits.agg(F.count(F.lit(1)).alias("edits"), F.count("qid").alias("with_item"))
    return out.withColumn("rate", rate(F.col("with_item"), F.col("edits")))
