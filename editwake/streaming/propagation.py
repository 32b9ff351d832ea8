"""Propagation over a stream of micro-batches that is sorted by time, equal to the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editwake import session
from editwake.config import DEFAULT, Propagation
from editwake.operators import propagation as G
from editwake.operators.progress import next_at_or_after
from editwake.streaming.state import VersionedState

_AT = "struct<released:bigint,ts:bigint,seq:bigint>"
_OPEN = f"qid string, at {_AT}, upto bigint, bound bigint, closed_at bigint"
_CELL = (
    "qid string, window bigint, opened_at bigint, wiki string, first struct<released:bigint,ts:bigint,seq:bigint,title:string,user_name:string>, "
    "human_edits bigint, bot_edits bigint, late_human_edits bigint"
)
_CELLS = ["qid", "window", "opened_at", "wiki", "first", "human_edits", "bot_edits", "late_human_edits"]
_CLOSED = "qid string, window bigint, closed_at bigint"


class PropagationStream:
    """foreachBatch target. State: each item's last window, the cells of the windows not yet forgotten, and when they closed.

    A window is forgotten once the clock is `horizon` past its closing: an edit of its item opens a new one then, so its
    cells are final. They are appended to <path>/finished, per batch, and leave the state.
    A batch's rows come after all earlier ones in order of (ts, seq), which a reordering source ahead of it guarantees; an
    edit older than the clock is refused rather than counted wrongly. The clock values of a batch close the windows that
    were open before it; then each touched item's fold goes on from its last window.
    """

    def __init__(self, spark: SparkSession, path: str, p: Propagation = DEFAULT.propagation) -> None:
        self.spark, self.p = spark, p
        self.path = path.rstrip("/")
        self.state = VersionedState(spark, f"{self.path}/state")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        if not self.state.has(batch):
            self._take(rows, batch)
        self.state.append(batch, {"finished": f"{self.path}/finished"})

    def _take(self, rows: DataFrame, batch: int) -> None:
        p, ordered = self.p, G.in_time_order(G.with_item(rows))
        clock_before = self.state.meta.get("clock")
        low, high = ordered.agg(F.min("ts"), F.max("ts")).first()
        if low is not None and clock_before is not None and low < clock_before:
            raise ValueError(f"an edit of {low} came after the clock had reached {clock_before}")
        clock = ordered.select("upto").distinct()
        last = self.state.table("last", _OPEN)
        due = last.where("closed_at is null")
        reached = next_at_or_after(clock, "upto", due.select("bound").distinct(), "bound", "now_closed")
        last = last.join(reached, "bound", "left").withColumn("closed_at", F.coalesce("closed_at", "now_closed")).drop("now_closed")
        closed = self.state.table("closed", _CLOSED).unionByName(
            due.join(reached.where("now_closed is not null"), "bound").select("qid", F.col("at.seq").alias("window"), F.col("now_closed").alias("closed_at"))
        )
        firsts = ordered.groupBy("qid", "upto").agg(F.min(G._position()).alias("at")).withColumn("bound", F.col("at.ts") + p.watermark)
        firsts = firsts.join(next_at_or_after(clock, "upto", firsts.select("bound").distinct(), "bound", "closed_at"), "bound", "left")
        item = F.struct("at", "upto", "bound", "closed_at")
        seen = firsts.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("seen"))
        held = seen.join(last.select("qid", F.array(item).alias("had")), "qid", "full")
        folded = F.aggregate(
            F.coalesce("seen", F.expr(f"cast(array() as array<struct<at:{_AT},upto:bigint,bound:bigint,closed_at:bigint>>)")),
            F.coalesce("had", F.expr(f"cast(array() as array<struct<at:{_AT},upto:bigint,bound:bigint,closed_at:bigint>>)")),
            lambda acc, x: F.when((F.size(acc) == 0) | (x["upto"] >= F.element_at(acc, F.lit(-1))["closed_at"] + p.horizon), F.concat(acc, F.array(x))).otherwise(acc),
        )
        openers = held.select("qid", folded.alias("openers"), F.coalesce(F.size("had"), F.lit(0)).alias("old"))
        new_closed = openers.select("qid", F.explode(F.expr("slice(openers, greatest(old, 0) + 1, size(openers))")).alias("w")).where("w.closed_at is not null")
        closed = closed.unionByName(new_closed.select("qid", F.col("w.at.seq").alias("window"), F.col("w.closed_at").alias("closed_at")))
        mine = F.element_at(F.filter("openers", lambda o: o["at"] <= G._position()), -1)
        joined = ordered.join(openers.select("qid", "openers"), "qid").withColumn("w", mine).drop("openers")
        assigned = joined.select(
            *ordered.columns, F.col("w.at.ts").alias("opened_at"), F.col("w.at.seq").alias("window"), F.lit(None).cast("bigint").alias("closed_at"), (F.col("upto") >= F.col("w.bound")).alias("late")
        )
        fresh = G.cells(assigned).drop("closed_at")
        cells = self.state.table("cells", _CELL).unionByName(fresh).groupBy("qid", "window", "opened_at", "wiki").agg(
            F.min("first").alias("first"), *[F.sum(c).alias(c) for c in ("human_edits", "bot_edits", "late_human_edits")]
        )
        now_last = openers.select("qid", F.element_at("openers", -1).alias("w")).select("qid", "w.*")
        start = self.state.meta.get("start")
        start = low if start is None else min(x for x in (start, low if low is not None else start))
        clock_now = high if high is not None else clock_before
        forgotten = F.coalesce(F.col("closed_at") + p.horizon <= F.lit(clock_now), F.lit(False))
        all_cells = session.stage(cells.join(closed, ["qid", "window"], "left"), "stream-cells")
        tables = {
            "last": now_last.where(~forgotten).select("qid", "at", "upto", "bound", "closed_at"), "closed": closed.where(~forgotten),
            "cells": all_cells.where(~forgotten).select(*_CELLS), "finished": all_cells.where(forgotten).select(*_CELLS, "closed_at"),
        }
        self.state.commit(batch, tables, clock=clock_now, start=start)

    def cells(self) -> DataFrame:
        """Cells as the batch operator gives them, for records(), windows(), statistics() and the rest."""
        warm = self.state.meta["start"] + self.p.warmup
        closed = self.state.table("closed", _CLOSED)
        still = self.state.table("cells", _CELL).join(closed, ["qid", "window"], "left").select(*_CELLS, "closed_at")
        done = self.spark.read.parquet(f"{self.path}/finished").select(*_CELLS, "closed_at")
        return still.unionByName(done).withColumn("in_warmup", F.col("opened_at") < F.lit(warm))
