import random

import pytest
from editwake.operators import late
from editwake.operators.progress import next_at_or_after, running


@pytest.mark.parametrize("how", ["max", "min", "sum"])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_equals_brute_force(spark, how, inclusive):
    rng = random.Random(1)
    data = [(rng.randrange(-50, 400), rng.choice([None, rng.randrange(100)]), "x") for _ in range(300)]
    got = {}
    for r in running(spark.createDataFrame(data, "o bigint, v bigint, block string"), "o", "v", "out", how, inclusive, block=7).collect():
        got.setdefault((r.o, r.v), r.out)
    for o, v, _ in data:
        before = [x for p, x, _ in data if x is not None and (p < o or inclusive and p == o)]
        assert got[o, v] == ({"max": max, "min": min, "sum": sum}[how](before) if before else None)


def test_running_over_more_than_one_group_of_blocks(spark):
    data = [(i * 5_000, i % 7) for i in range(3_000)]
    out = running(spark.createDataFrame(data, "o bigint, v bigint"), "o", "v", "s", "sum", block=2).collect()
    total = 0
    for r in sorted(out, key=lambda r: r.o):
        assert r.s == (total if r.o else None)
        total += r.v


def test_next_at_or_after(spark):
    points, probes = spark.createDataFrame([(3,), (10,), (10,)], "p bigint"), spark.createDataFrame([(-1,), (3,), (4,), (10,), (11,)], "q bigint")
    got = {r.q: r.at for r in next_at_or_after(points, "p", probes, "q", "at").collect()}
    assert got == {-1: 3, 3: 3, 4: 10, 10: 10, 11: None}


EDITS = "wiki string, ts bigint, seq bigint, batch_id bigint, clock string"


def brute(data, lateness=100):
    clock, late_seqs = None, set()
    for w, ts, seq, *_ in sorted((x for x in data if x[2] is not None), key=lambda x: x[2]):
        if ts is not None:
            if clock is not None and ts < clock - lateness:
                late_seqs.add(seq)
            clock = ts if clock is None else max(clock, ts)
    return late_seqs


def test_late_rows_and_upserts(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), 10_000 + i + rng.choice([0, 0, -90, -100, -101, -400]), i, i // 40, "own") for i in range(1, 500)]
    data += [("a", None, 900, 1, "own"), (None, 10_400, 901, 12, "own"), ("b", 5, None, 1, "own")]
    df = spark.createDataFrame(data, EDITS).drop("clock")
    expected = brute(data)
    on_time, diverted = late.split_late(df, lateness=100)
    assert {r.seq for r in diverted.where("late").collect()} == expected
    assert diverted.where("late is null").count() == 2
    assert on_time.count() + diverted.count() == len(data)
    updates = late.period_updates(df, ["wiki"], period=60, lateness=100)
    final = {(r.wiki, r.period_start): r.edits for r in late.apply_upserts(updates, ["wiki"]).collect()}
    count = {}
    for w, ts, seq, *_ in data:
        if ts is not None and seq is not None and seq not in expected:
            count[w, ts - ts % 60] = count.get((w, ts - ts % 60), 0) + 1
    assert final == count
    versions = {}
    for r in updates.orderBy("batch_id").collect():
        versions.setdefault((r.wiki, r.period_start), []).append((r.version, r.edits))
    assert all([v for v, _ in x] == list(range(1, len(x) + 1)) and [e for _, e in x] == sorted(e for _, e in x) for x in versions.values())


def test_exactly_the_lateness_is_in_time(spark):
    df = spark.createDataFrame([("a", 30_000, 1), ("a", 8_400, 2), ("a", 8_399, 3)], "wiki string, ts bigint, seq bigint")
    assert [r.seq for r in late.with_lateness(df).where("late").collect()] == [3]


def test_empty_table(spark):
    df = spark.createDataFrame([], "wiki string, ts bigint, seq bigint, batch_id bigint")
    assert late.with_lateness(df).count() == late.period_updates(df, ["wiki"]).count() == late.late_report(df, ["wiki"]).count() == 0


def test_clock_carried_on_and_ties_in_order(spark):
    df = spark.createDataFrame([("a", 100, 1), ("a", 500, 2), ("a", 10, 2)], "wiki string, ts bigint, seq bigint")
    assert late.with_lateness(df, lateness=50).where("late").count() == 1
    assert late.with_lateness(df, lateness=50, clock_from=1_000).where("late").count() == 3
