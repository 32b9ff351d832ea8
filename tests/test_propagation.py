import random

import numpy as np
import pytest
from editwake.config import Propagation
from editwake.operators import progress
from editwake.operators import propagation as G
from pyspark.sql import functions as F
from simulator import simulate

SCHEMA = "qid string, wiki string, title string, ts bigint, bot boolean, user_name string, seq bigint"


def table(spark, edits):
    return spark.createDataFrame(edits, SCHEMA)


def e(text, seq):
    """wiki@ts:item, b for a bot."""
    wiki, rest = text.split("@")
    ts, _, item = rest.partition(":")
    bot = ts.endswith("b")
    return (item or "Q1", wiki, f"{wiki} page", int(ts.rstrip("b")), bot, "u", seq)


def edits_of(text):
    return [e(x, i) for i, x in enumerate(text.split(), 1)]


P = Propagation(watermark=100, reorder=10, warmup=0, horizon=1_000, ranks=(2, 3, 5), min_samples=1)


def run(spark, edits, p=P, in_order=False):
    cells = G.propagation_cells(table(spark, edits), p, in_order)
    return cells, G.records(cells, p), G.windows(cells)


def as_records(df):
    return sorted(tuple(r) for r in df.collect())


def as_windows(df):
    return sorted((r.qid, r.opened_at, r.closed_at or -1, r.in_warmup, r.all_editions, r.human_editions, r.human_edits, r.bot_edits, r.late_followup_edits) for r in df.collect())


def sim_windows(wins):
    return sorted((w.qid, w.o, w.closed or -1, w.warm, len(w.every), len(w.humans), w.n_human, w.n_bot, w.late) for w in wins)


def same_as_simulator(spark, edits, p):
    records, wins, ooo, peaks = simulate(edits, p.watermark, p.reorder, p.warmup, p.horizon, p.ranks)
    cells, found, windows = run(spark, edits, p)
    assert as_records(found) == sorted(records)
    assert as_windows(windows) == sim_windows(wins)
    used = table(spark, [x for x in edits if x[0] is not None])
    ordered = G.processing_order(used, p.reorder)
    assert ordered.where("ts < upto").count() == ooo
    assert G.peak_buffer(ordered).first()[0] == peaks[2]
    return cells, ordered, peaks


@pytest.mark.parametrize("seed", [0, 3, 5])
def test_disordered_streams_equal_the_simulator(spark, seed):
    rng = random.Random(seed)
    p = Propagation(watermark=60, reorder=rng.choice([0, 5, 20]), warmup=rng.choice([0, 40]), horizon=rng.choice([0, 50, 200]), ranks=(2, 3, 5), min_samples=1)
    edits, t = [], 1_000
    for seq in range(1, 260):
        t += rng.choice([0, 0, 1, 3, 9])
        late = rng.choice([0, 0, 0, 0, rng.randrange(12), rng.randrange(90)])
        edits.append((rng.choice([None, "Q1", "Q1", "Q2", "Q3", f"Q{rng.randrange(4, 30)}"]), rng.choice("abcdef"), f"t{seq % 7}", t - late, rng.random() < 0.2, rng.choice([None, "", "u"]), seq * 3))
    same_as_simulator(spark, edits, p)


@pytest.mark.parametrize("seed", [0, 2])
def test_sorted_streams_equal_the_simulator(spark, seed):
    rng = random.Random(100 + seed)
    p = Propagation(watermark=60, reorder=0, warmup=50, horizon=120, ranks=(2, 3, 5), min_samples=1)
    times = sorted(rng.randrange(1_000, 2_500) for _ in range(300))
    edits = [(rng.choice([None, "Q1", "Q2", f"Q{rng.randrange(3, 20)}"]), rng.choice("abcde"), "t", t, rng.random() < 0.3, "u", i) for i, t in enumerate(times)]
    cells, ordered, peaks = same_as_simulator(spark, edits, p)
    records, wins, _, _ = simulate(edits, p.watermark, 0, p.warmup, p.horizon, p.ranks)
    fast = G.propagation_cells(table(spark, edits), p)
    assert as_records(G.records(fast, p)) == sorted(records) and as_windows(G.windows(fast)) == sim_windows(wins)
    assert tuple(G.peaks(fast, G.in_time_order(table(spark, [x for x in edits if x[0]])), p).first()) == peaks[:2]


def lags(records):
    return [(r.rank, r.lag_seconds, r.leader_wiki) for r in records.orderBy("rank").collect()]


def test_ranks_leader_and_repeats(spark):
    assert lags(run(spark, edits_of("a@0 b@10 c@20 d@30 e@40 f@50"))[1]) == [(2, 10, "a"), (3, 20, "a"), (5, 40, "a")]
    assert lags(run(spark, edits_of("en@0 en@5 de@9"))[1]) == [(2, 9, "en")]


def test_reordering_and_ties(spark):
    assert lags(run(spark, edits_of("de@105 en@100"))[1]) == [(2, 5, "en")]
    assert lags(run(spark, edits_of("ja@50 en@50"))[1]) == [(2, 0, "ja")]
    order = G.processing_order(table(spark, edits_of("en@100:Q1 de@150:Q2 fr@90:Q3")), 10)
    assert order.where("ts < upto").count() == 1


def test_late_edits_never_reopen(spark):
    _, records, windows = run(spark, edits_of("en@0:Q1 fr@50:Q2 de@150:Q1 ja@160:Q1"))
    s = G.statistics(windows).first()
    assert records.count() == 0
    assert (s.late_followup_items, s.late_followup_edits, s.windows_closed, s.late_followup_rate) == (1, 2, 2, 0.5)


def test_bots_lead_nothing_but_are_counted(spark):
    _, records, windows = run(spark, edits_of("de@0b en@10 fr@20 sv@30b en@500:Q9"))
    s = G.statistics(windows).first()
    assert lags(records) == [(2, 10, "en")] and (s.cross_edition_items, s.bot_share) == (1, 0.5)


def test_warm_up_and_open_windows(spark):
    p = Propagation(watermark=100, reorder=10, warmup=50, horizon=1_000, min_samples=1)
    _, records, windows = run(spark, edits_of("en@0:Q1 de@5:Q1 en@60:Q2 de@70:Q2 en@400:Q3"), p)
    s = G.statistics(windows).first()
    assert [r.qid for r in records.collect()] == ["Q2"] and (s.warmup_windows, s.closed_with_human_edit) == (1, 1)
    s = G.statistics(run(spark, edits_of("en@0"))[2]).first()
    assert (s.windows_open_at_end, s.windows_closed, s.late_followup_rate) == (1, 0, None)


def test_bounds_of_watermark_and_horizon(spark):
    late = run(spark, edits_of("en@0:Q1 fr@50:Q2 de@100:Q1"))[2].where("qid = 'Q1'").first()
    assert (late.closed_at, late.late_followup_edits) == (100, 1)
    again = run(spark, edits_of("en@0:Q1 fr@100:Q2 de@1099:Q1 ja@1100:Q1"))[2].where("qid = 'Q1'")
    assert sorted((r.opened_at, r.late_followup_edits) for r in again.collect()) == [(0, 1), (1100, 0)]


def test_reached_ranks_and_leadership(spark):
    windows = run(spark, edits_of("en@0 de@1 fr@2 en@3:Q2 en@500:Q3"))[2]
    assert {r.rank: r.windows for r in G.reached_rank(windows).collect()} == {2: 1, 3: 1, 5: 0}
    text = " ".join(f"en@{1000 * i}:Q{i} de@{1000 * i + 10}:Q{i}" for i in range(4)) + " en@10000:Q9"
    rows = {r.wiki: r for r in G.leadership(run(spark, edits_of(text))[0], P).collect()}
    assert (rows["en"].lead_rate, rows["en"].expected_lead_rate, rows["en"].lead_lift) == (1.0, 0.5, 2.0)
    assert (rows["de"].median_follow_lag_seconds, rows["en"].median_follow_lag_seconds) == (10, None)


def test_empty_stream(spark):
    for in_order in (True, False):
        cells, records, windows = run(spark, [], in_order=in_order)
        assert records.count() == windows.count() == 0
        assert G.statistics(windows).first().windows_opened == 0


def golden(spark, sf):
    ev = spark.read.parquet(f"/root/testdata/{sf}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.when(F.col("user_id") % 20 != 0, F.concat(F.lit("Q"), "user_id")).alias("qid"), F.col("event_type").alias("wiki"), F.concat_ws(":", "event_type", k.cast("string")).alias("title"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), (k % 5 == 0).alias("bot"), F.lit("u").alias("user_name"), F.col("event_id").alias("seq"),
    )


def test_golden_numbers(spark):
    cells = G.propagation_cells(golden(spark, "sf0.01"))
    s = G.statistics(G.windows(cells)).first()
    assert (s.windows_opened, s.warmup_windows, s.windows_closed, s.windows_open_at_end) == (2543, 67, 2518, 25)
    assert (s.closed_with_human_edit, s.late_followup_items, s.late_followup_edits) == (2111, 1848, 3414)
    assert (s.cross_edition_items, s.cross_edition_human_edits, s.cross_edition_bot_edits) == (895, 1694, 416)
    assert sorted(tuple(r) for r in G.lag_by_rank(G.records(cells)).collect()) == [(2, 622, 10543, 20275), (3, 84, 15088, 20907)]
    assert {r.rank: r.windows for r in G.reached_rank(G.windows(cells)).collect()} == {2: 618, 3: 84, 5: 0}


def test_result_does_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for n in ("1", "3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            r = G.records(G.propagation_cells(golden(spark, "sf0.001")))
            seen.add(r.agg(F.count("*"), F.sum(F.xxhash64(*[c for c in r.columns if c != "follower_user"]).cast("decimal(38,0)"))).first())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1 and next(iter(seen))[0] > 0


def test_clock_bitmap_equals_a_search(spark):
    rng = np.random.default_rng(2)
    times = np.unique(np.r_[rng.integers(1_609_400_000, 1_609_600_000, 300), 1_609_459_200, 1_609_459_207])
    df = spark.createDataFrame([(int(t),) for t in times], "upto bigint")
    clock = progress.clock_of(df)
    bounds = np.r_[rng.integers(1_609_300_000, 1_609_700_000, 5_000), times, times + 1, times - 1]
    got, none = clock.at_or_after(bounds)
    k = np.searchsorted(times, bounds)
    assert (none == (k == len(times))).all() and (got[~none] == times[k[~none]]).all()
    assert progress.clock_of(df.limit(0)) is None


def test_long_spans_and_hot_items(spark, monkeypatch):
    """Beyond the longest span the closing times come by a join; small Arrow batches cut an item into many pieces."""
    rng = np.random.default_rng(3)
    data = [("Q1" if rng.random() < 0.5 else f"Q{rng.integers(2, 9)}", f"{'abcd'[rng.integers(4)]}wiki", "T", int(t), False, "u", i) for i, t in enumerate(np.sort(rng.integers(0, 3_000_000, 900)))]
    edits = spark.createDataFrame(data, "qid string, wiki string, title string, ts bigint, bot boolean, user_name string, seq bigint")
    want = sorted(map(tuple, G.records(G.propagation_cells(edits)).collect()))
    monkeypatch.setattr(progress, "LONGEST", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, G.records(G.propagation_cells(edits)).collect())) == want and len(want) > 50
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
