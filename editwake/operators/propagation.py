"""How edits to an item spread between editions: windows anchored at an item's first edit.

The stream is described as one pass over the edits with an item, in processing order. `upto` is the highest edit time
processed so far. A window opened at time o is closed by the first edit whose upto reaches o + watermark; it is then
remembered until upto reaches the closing time + horizon, and the item's next edit after that opens a new one. Edits
between the two are late. Here all of that is worked out from sets:

* the processing order of a reordering buffer has a closed form (`processing_order`);
* the closing time is the next clock value at or after a bound, looked up in a bitmap of the clock's seconds;
* an item's openers are found in its distinct clock values, not in its edits, by hops from one opener to the next;
* edits find their window by item and stretch of time, and all figures come from sums per item, window and edition.

An item's distinct seconds pass one task as a sorted stream; nothing else brings an item together, however many its edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editwake import session
from editwake.config import DEFAULT, Propagation
from editwake.functions.columns import bucket, nearest_rank_of, rate
from editwake.operators.progress import OPENER, clock_of, hops, next_at_or_after, running

COLUMNS = ["qid", "wiki", "title", "ts", "bot", "user_name", "seq"]


def with_item(edits: DataFrame) -> DataFrame:
    """Edits that take part: with an item, a time and an arrival number."""
    return edits.where("qid is not null and ts is not null and seq is not null").select(*COLUMNS)


def processing_order(edits: DataFrame, reorder: int = DEFAULT.propagation.reorder) -> DataFrame:
    """Adds released (the arrival number at which a buffer of `reorder` seconds lets the edit go) and upto.

    An edit goes as soon as the clock, the highest time that arrived, is `reorder` seconds past it: at its own arrival or
    at the first later arrival that moves the clock that far; after the last arrival if none does. Edits released together
    go in order of time and arrival. upto is the highest time processed, this edit's included.
    """
    clocked = session.stage(running(edits, "seq", "ts", "clock"), "clocked")
    steps = clocked.where("clock is null or ts > clock").groupBy("ts").agg(F.min("seq").alias("seq"))
    due = clocked.select((F.col("ts") + reorder).alias("due")).distinct()
    reached = next_at_or_after(steps, "ts", due, "due", "reached").join(
        steps.select(F.col("ts").alias("reached"), F.col("seq").alias("at")), "reached", "left"
    )
    end = clocked.agg((F.max("seq") + 1).alias("end"))
    timed = clocked.withColumn("due", F.col("ts") + reorder).join(reached.select("due", "at"), "due", "left").crossJoin(F.broadcast(end))  # one row
    timed = timed.withColumn("released", F.greatest(F.col("seq"), F.coalesce("at", "end"))).select(*edits.columns, "released")
    timed = session.stage(timed, "released")
    before = running(timed, "released", "ts", "processed")
    return session.stage(before.withColumn("upto", F.greatest("ts", "processed")).drop("processed"), "ordered")


def in_time_order(edits: DataFrame) -> DataFrame:
    """The order of a replay that is sorted by time: nothing is late to the clock."""
    return edits.withColumn("released", F.col("ts")).withColumn("upto", F.col("ts"))


_POSITION = ["released", "ts", "seq"]


def _position() -> Column:
    return F.struct(*_POSITION)


def _openers(ordered: DataFrame, p: Propagation, held_back: DataFrame | None, seconds) -> DataFrame:
    """A row per window: position of the opener, its upto, bound (closing needs upto >= bound) and closed_at.

    An item's distinct clock seconds, not its edits, are sorted in one task, which goes through them as a stream: its
    memory doesn't depend on the item.
    """
    session.ship(ordered.sparkSession)
    firsts = ordered.groupBy("qid", "upto").agg(F.min(_position()).alias("at"))
    held = F.col("at.ts")
    if held_back is not None:
        firsts = firsts.join(held_back, F.col("at.seq") == F.col("held_seq"), "left").drop("held_seq")
        held = F.greatest(F.col("at.ts"), F.col("held"))
    firsts = firsts.withColumn("bound", held + p.watermark)
    if seconds is None:
        closing = next_at_or_after(ordered.select("upto").distinct(), "upto", firsts.select("bound").distinct(), "bound", "closed_at")
        firsts = firsts.join(closing, "bound", "left")
    else:
        firsts = firsts.withColumn("closed_at", F.lit(None).cast("bigint"))
    known = firsts.select("qid", "at.released", "at.ts", "at.seq", "upto", "bound", "closed_at")
    return known.repartition("qid").sortWithinPartitions("qid", "upto").mapInArrow(hops(p.horizon, seconds), OPENER)


def assign(ordered: DataFrame, p: Propagation = DEFAULT.propagation) -> DataFrame:
    """Each edit with its window: opened_at, window (arrival number of the opener), bound, closed_at, and late.

    A window whose opener came out of order waits for the windows opened before it, so its bound depends on the openers
    before it. That is settled by finding the openers again with those of the round before until they stay the same;
    every round settles at least one more watermark of time, and a stream without such openers needs no repetition.

    Edits meet windows by item and stretch of time, so that an item with very many edits is spread over many tasks: a
    window belongs to the few stretches from its opening until it is forgotten, and no two of an item overlap.
    """
    seconds = clock_of(ordered)
    openers = session.stage(_openers(ordered, p, None, seconds), "openers")
    behind = ordered.where("ts < upto")
    while not behind.isEmpty():
        flat = openers.select("released", "ts", "seq", F.col("ts").alias("opened"), F.lit(None).cast("bigint").alias("held_seq"))
        both = flat.unionByName(behind.select(*_POSITION, F.lit(None).cast("bigint").alias("opened"), F.col("seq").alias("held_seq")))
        # Openers released together are in order of time, so those before in the same release matter only up to the edit's own time.
        held_back = running(both, "released", "opened", "held").where("held_seq is not null").select("held_seq", "held")
        again = session.stage(_openers(ordered, p, held_back, seconds), "openers")
        same = again.exceptAll(openers).isEmpty() and openers.exceptAll(again).isEmpty()
        openers = again
        if same:
            break
    stretch = (p.watermark + p.horizon + 1) // 2
    last = ordered.agg(F.max("upto").alias("_ew_last"))
    until = F.greatest(F.coalesce(F.col("closed_at") + p.horizon, F.col("_ew_last") + 1), F.col("o_upto") + 1)
    spans = openers.select(
        F.col("qid").alias("o_qid"), F.col("upto").alias("o_upto"), F.col("ts").alias("opened_at"), F.col("seq").alias("window"), "bound", "closed_at"
    ).crossJoin(F.broadcast(last)).withColumn("until", until)  # one row
    spans = spans.withColumn("o_stretch", F.explode(F.sequence(bucket(F.col("o_upto"), stretch), bucket(F.col("until") - 1, stretch)))).drop("_ew_last")
    placed = ordered.withColumn("stretch", bucket(F.col("upto"), stretch))
    mine = (F.col("qid") == F.col("o_qid")) & (F.col("stretch") == F.col("o_stretch")) & (F.col("upto") >= F.col("o_upto")) & (F.col("upto") < F.col("until"))
    return placed.join(spans, mine).select(*ordered.columns, "opened_at", "window", "bound", "closed_at", (F.col("upto") >= F.col("bound")).alias("late"))


def cells(assigned: DataFrame) -> DataFrame:
    """Figures per item, window and edition; all other results come from these few rows."""
    human, on_time = ~F.coalesce("bot", F.lit(False)), ~F.col("late")
    first = F.struct(*_POSITION, "title", "user_name")
    return assigned.groupBy("qid", "window", "opened_at", "closed_at", "wiki").agg(
        F.min(F.when(human & on_time, first)).alias("first"),
        F.count(F.when(human & on_time, 1)).alias("human_edits"), F.count(F.when(~human & on_time, 1)).alias("bot_edits"),
        F.count(F.when(human & ~on_time, 1)).alias("late_human_edits"),
    )


def propagation_cells(edits: DataFrame, p: Propagation = DEFAULT.propagation, in_order: bool = True) -> DataFrame:
    """Cells of a replay sorted by time, or (in_order False) of the arrival order through the reordering buffer.

    Staged, with the warm-up flag. Edits without an item, time or arrival number take no part.
    """
    used = session.stage(with_item(edits), "edits")  # read several times
    ordered = in_time_order(used) if in_order else processing_order(used, p.reorder)
    found = cells(assign(ordered, p))
    if in_order:
        start = used.agg(F.min("ts").alias("start"))
        warm = found.crossJoin(F.broadcast(start))  # one row
    else:
        found = session.stage(found, "cells-found")
        warm = found.join(_start_known(ordered, found), "window")
    return session.stage(warm.withColumn("in_warmup", F.col("opened_at") < F.col("start") + p.warmup).drop("start"), "cells")


def _start_known(ordered: DataFrame, found: DataFrame) -> DataFrame:
    """(window, start): the earliest time that had arrived when a window was opened."""
    lows = running(ordered.select("seq", "ts"), "seq", "ts", "low", "min").where("low is null or ts < low")
    openers = found.select("window").distinct().join(ordered.select(F.col("seq").alias("window"), "released"), "window")
    both = lows.select(F.col("seq").alias("at"), F.col("ts").alias("low"), F.lit(None).cast("bigint").alias("window")).unionByName(
        openers.select(F.col("released").alias("at"), F.lit(None).cast("bigint").alias("low"), "window")
    )
    return running(both, "at", "low", "start", "min", inclusive=True).where("window is not null").select("window", "start")


def arrivals(cell: DataFrame) -> DataFrame:
    """Editions of a window in order of their first human edit: rank, lag to the leader, number of editions."""
    by_order = Window.partitionBy("qid", "window").orderBy("first.released", "first.ts", "first.seq")
    lead = F.first("first").over(by_order)
    return cell.where("first is not null").select(
        "qid", "window", "opened_at", "closed_at", "in_warmup", "wiki", "first", F.row_number().over(by_order).alias("rank"),
        F.count(F.lit(1)).over(Window.partitionBy("qid", "window")).alias("editions"), F.first("wiki").over(by_order).alias("leader_wiki"),
        lead["title"].alias("leader_title"), lead["ts"].alias("leader_timestamp"),
    )


def records(cell: DataFrame, p: Propagation = DEFAULT.propagation) -> DataFrame:
    """A record for the edition that comes at each of the ranks, in windows after the warm-up, closed or still open."""
    return arrivals(cell).where(F.col("rank").isin(*p.ranks) & ~F.col("in_warmup")).select(
        "qid", "rank", "leader_wiki", "leader_title", "leader_timestamp", F.col("wiki").alias("follower_wiki"),
        F.col("first.title").alias("follower_title"), F.col("first.ts").alias("follower_timestamp"), F.col("first.user_name").alias("follower_user"),
        (F.col("first.ts") - F.col("leader_timestamp")).alias("lag_seconds"),
    )


def windows(cell: DataFrame) -> DataFrame:
    """One row per window: its editions (all, human), edits on time, late new editions' edits."""
    on_time = F.col("human_edits") + F.col("bot_edits") > 0
    new_late = F.col("first").isNull() & (F.col("late_human_edits") > 0)
    return cell.groupBy("qid", "window", "opened_at", "closed_at", "in_warmup").agg(
        F.count(F.when(on_time, 1)).alias("all_editions"), F.count("first").alias("human_editions"), F.sum("human_edits").alias("human_edits"),
        F.sum("bot_edits").alias("bot_edits"), F.coalesce(F.sum(F.when(new_late, F.col("late_human_edits"))), F.lit(0)).alias("late_followup_edits"),
    )


def statistics(window: DataFrame) -> DataFrame:
    """One row of counters over all windows.

    The late follow-up rate divides all items followed up late by the closed, non-warm-up windows with a human edit, and may
    exceed 1; corrected_late_followup_rate counts only the latter above as well.
    """
    closed = F.col("closed_at").isNotNull()
    rated = closed & ~F.col("in_warmup") & (F.col("human_editions") > 0)
    cross = closed & (F.col("all_editions") >= 2)
    late = F.col("late_followup_edits") > 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n = lambda c: F.count(F.when(c, 1))
    return window.agg(
        F.count(F.lit(1)).alias("windows_opened"), n(F.col("in_warmup")).alias("warmup_windows"), n(closed).alias("windows_closed"),
        n(~closed).alias("windows_open_at_end"), n(rated).alias("closed_with_human_edit"), n(cross).alias("cross_edition_items"),
        total(F.when(cross, F.col("human_edits"))).alias("cross_edition_human_edits"), total(F.when(cross, F.col("bot_edits"))).alias("cross_edition_bot_edits"),
        n(late).alias("late_followup_items"), total("late_followup_edits").alias("late_followup_edits"), n(rated & late).alias("rated_late_items"),
        n(rated & (F.col("human_editions") >= 2)).alias("reached_second"),
    ).select(
        "*", rate(F.col("cross_edition_bot_edits"), F.col("cross_edition_bot_edits") + F.col("cross_edition_human_edits")).alias("bot_share"),
        rate(F.col("late_followup_items"), F.col("closed_with_human_edit")).alias("late_followup_rate"),
        rate(F.col("rated_late_items"), F.col("closed_with_human_edit")).alias("corrected_late_followup_rate"),
        rate(F.col("closed_with_human_edit") - F.col("reached_second"), F.col("closed_with_human_edit")).alias("never_propagated"),
    )


def reached_rank(window: DataFrame, p: Propagation = DEFAULT.propagation) -> DataFrame:
    """Closed windows after the warm-up with at least each rank of human editions; ranks nobody reached have 0."""
    rated = window.where("closed_at is not null and not in_warmup")
    counts = rated.agg(*[F.count(F.when(F.col("human_editions") >= r, 1)).alias(str(r)) for r in p.ranks])
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(f"`{r}`").alias("windows")) for r in p.ranks])).alias("x")
    return counts.select(pairs).select("x.rank", "x.windows")


def peaks(cell: DataFrame, ordered: DataFrame, p: Propagation = DEFAULT.propagation) -> DataFrame:
    """The most windows open at once and the most closed ones remembered at once, from sums per second of the clock."""
    win = cell.join(ordered.select(F.col("seq").alias("window"), F.col("upto").alias("opened_upto")), "window").select("qid", "window", "opened_upto", "closed_at").distinct()
    win = session.stage(win, "windows")
    forgotten = next_at_or_after(
        ordered.select("upto").distinct(), "upto", win.where("closed_at is not null").select((F.col("closed_at") + p.horizon).alias("due")).distinct(), "due", "forgotten_at"
    )
    win = win.withColumn("due", F.col("closed_at") + p.horizon).join(forgotten, "due", "left")
    moves = win.select(F.explode(F.array(
        F.struct(F.col("opened_upto").alias("s"), F.lit(1).alias("o"), F.lit(0).alias("c")),
        F.struct(F.col("closed_at").alias("s"), F.lit(-1).alias("o"), F.lit(1).alias("c")),
        F.struct((F.col("forgotten_at") + 1).alias("s"), F.lit(0).alias("o"), F.lit(-1).alias("c")),
    )).alias("m")).select("m.*").where("s is not null").groupBy("s").agg(F.sum("o").alias("o"), F.sum("c").alias("c"))
    moves = session.stage(moves, "moves")
    both = running(running(moves, "s", "o", "open_windows", "sum", inclusive=True), "s", "c", "closed_remembered", "sum", inclusive=True)
    return both.agg(F.max("open_windows").alias("peak_open_windows"), F.max("closed_remembered").alias("peak_closed_remembered"))


def peak_buffer(ordered: DataFrame) -> DataFrame:
    """The most edits that the reordering buffer held at once, counted just after an arrival."""
    gone = ordered.groupBy("released").agg(F.count(F.lit(1)).alias("n"))
    moves = ordered.select(F.col("seq").alias("s"), F.lit(1).alias("m")).unionByName(gone.select((F.col("released") + 1).alias("s"), (-F.col("n")).alias("m")))
    sums = moves.groupBy("s").agg(F.sum("m").alias("m"))
    return running(sums, "s", "m", "held", "sum", inclusive=True).agg(F.max("held").alias("peak_reorder_buffer"))


def lags(values: Column) -> list[Column]:
    return [nearest_rank_of(values, 0.5).alias("median_seconds"), nearest_rank_of(values, 0.95).alias("p95_seconds")]


def _ranked_lags(record: DataFrame, keys: list[str]) -> DataFrame:
    """n, median and p95 by nearest rank per group, from counts per distinct lag."""
    per = record.where("lag_seconds is not null").groupBy(*keys, "lag_seconds").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*keys).orderBy("lag_seconds").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    at = lambda f: F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.lit(f) * F.col("n"), 0).cast("bigint")))
    return per.groupBy(*keys).agg(
        F.max("n").alias("n"), F.min(F.when(F.col("upto") >= at(0.5), F.col("lag_seconds"))).alias("median_seconds"),
        F.min(F.when(F.col("upto") >= at(0.95), F.col("lag_seconds"))).alias("p95_seconds"),
    )


def lag_by_rank(record: DataFrame) -> DataFrame:
    return _ranked_lags(record, ["rank"])


def lag_by_pair(record: DataFrame, p: Propagation = DEFAULT.propagation) -> DataFrame:
    """Pairs of leader and follower with at least min_samples records."""
    return _ranked_lags(record, ["leader_wiki", "follower_wiki"]).where(F.col("n") >= p.min_samples)


def leadership(cell: DataFrame, p: Propagation = DEFAULT.propagation) -> DataFrame:
    """Per edition: how often it leads closed windows of at least two human editions, against what its presence lets expect."""
    seen = arrivals(cell).where("closed_at is not null and not in_warmup and editions >= 2")
    seen = seen.withColumn("lag", F.when(F.col("rank") > 1, F.col("first.ts") - F.col("leader_timestamp")))
    exact = "decimal(38,18)"  # sums that don't depend on the order of rows
    base = seen.groupBy("wiki").agg(
        F.count(F.lit(1)).alias("windows"), F.count(F.when(F.col("rank") == 1, 1)).alias("leads"),
        F.sum((F.lit(1.0) / F.col("editions")).cast(exact)).cast("double").alias("expected"),
        F.sum(((F.col("rank") - 1) / (F.col("editions") - 1)).cast(exact)).cast("double").alias("position"),
    ).where(F.col("windows") >= p.min_samples)
    follow = _ranked_lags(seen.select("wiki", F.col("lag").alias("lag_seconds")), ["wiki"]).select("wiki", F.col("median_seconds").alias("median_follow_lag_seconds"))
    return base.join(follow, "wiki", "left").select(
        "wiki", "windows", "leads", F.bround(F.col("leads") / F.col("windows"), 4).alias("lead_rate"),
        F.bround(F.col("expected") / F.col("windows"), 4).alias("expected_lead_rate"), F.bround(F.col("leads") / F.col("expected"), 3).alias("lead_lift"),
        F.bround(F.col("position") / F.col("windows"), 4).alias("mean_position"), "median_follow_lag_seconds",
    )
