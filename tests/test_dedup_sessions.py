import random

import numpy as np
import pyarrow as pa
import pytest
from editwake import session
from editwake.operators import dedup, sessions
from editwake.session import scratch
from hypothesis import given, settings
from hypothesis import strategies as st

A = "0F3c2a1e-9b7d-4c55-8a10-3f2e1d0c9b8a"


def forms(u):
    return [u, u.upper(), u.lower(), "{" + u + "}", f" {u}", f"{u}\t", u.replace("-", ""), f"urn:uuid:{u}"]


def test_one_uuid_however_written(spark, rows):
    data = [(f, i, "x") for i, f in enumerate(forms(A), 10)] + [(A[:-1] + "b", 99, "y"), ("free text", 5, "z"), (" free text ", 4, "z"), ("FREE TEXT", 6, "z")]
    df = spark.createDataFrame(data, "event_id string, seq bigint, id string")
    kept = dedup.deduplicated(df)
    assert {r.seq for r in kept.collect()} == {10, 99, 4, 6}
    assert kept.columns == df.columns
    assert {r.seq for r in dedup.surplus(df).collect()} == set(range(11, 18)) | {5}


def test_rows_without_identity_all_stay(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("  ", 3), (A, None), (A, 7), (A, 8)], "event_id string, seq bigint")
    assert dedup.deduplicated(df).count() == 5
    assert [r.seq for r in dedup.surplus(df).collect()] == [8]


def test_empty_table(spark):
    df = spark.createDataFrame([], "event_id string, seq bigint")
    assert dedup.deduplicated(df).count() == dedup.surplus(df).count() == 0


def test_hot_identifier_over_many_steps(spark):
    rng = random.Random(5)
    data = [(A if rng.random() < 0.4 else f"{rng.randrange(200):032x}", i) for i in range(1, 1_001)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "event_id string, seq bigint").repartition(5)
    first = {}
    for e, s in sorted(data, key=lambda x: x[1]):
        first.setdefault(e.lower().replace("-", ""), s)
    for steps in (1, 2, 5):
        assert {r.seq for r in dedup.first_arrivals(df, batches=steps).collect()} == set(first.values())


def _batch(spark):
    return lambda *x: spark.createDataFrame([(bytes(k, "ascii"), a) for k, a in x], "id binary, arrival bigint")


def test_store_survives_and_counts_each_identifier_once(spark):
    path, batch = scratch(spark, "store"), _batch(spark)
    store = dedup.SeenStore(spark, path, 3)
    store.take(batch(("a", 1), ("b", 2), ("a", 3)))
    again = dedup.SeenStore(spark, path, 99)
    assert (again.steps, again.shards) == (1, 3)
    again.take(batch(("a", 4), ("c", 5), ("b", 6)))
    assert [r.arrival for r in again.kept().collect()] == [5]
    assert sorted(r.arrival for r in again.kept(1).collect()) == [1, 2]
    assert sorted((bytes(r.id), r.arrival) for r in again.repeated().collect()) == [(b"a", None), (b"b", None)]
    assert [(bytes(r.id), r.arrival, r.n) for r in again.repeated(1).collect()] == [(b"a", 1, 2)]


@pytest.mark.parametrize("mark", [1, 2])
def test_store_killed_before_either_mark_loses_nothing(spark, monkeypatch, mark):
    path, batch = scratch(spark, "store"), _batch(spark)
    dedup.SeenStore(spark, path, 2).take(batch(("a", 1), ("b", 2)))
    real, calls = session.rename, []

    def dies(*args):
        calls.append(1)
        if len(calls) == mark:
            raise KeyboardInterrupt
        real(*args)

    monkeypatch.setattr(session, "rename", dies)
    with pytest.raises(KeyboardInterrupt):
        dedup.SeenStore(spark, path, 2).take(batch(("b", 3), ("c", 4)))
    monkeypatch.setattr(session, "rename", real)
    after = dedup.SeenStore(spark, path, 2)
    known = {(bytes(r.id), r.seen) for r in after.identifiers().collect()}
    # Between the marks c is known and not seen: the bit says more than the dictionary.
    assert known == {(b"a", True), (b"b", True)} | ({(b"c", False)} if mark == 2 else set())
    after.take(batch(("b", 3), ("c", 4)))
    assert [r.arrival for r in after.kept().collect()] == [4]
    assert {(bytes(r.id), r.seen) for r in after.identifiers().collect()} == {(b"a", True), (b"b", True), (b"c", True)}


def test_parts_are_merged_and_shards_split(spark, monkeypatch):
    monkeypatch.setattr(dedup, "MERGE_PARTS", 3)
    monkeypatch.setattr(dedup, "SHARD_IDS", 4)
    path, batch, seen = scratch(spark, "store"), _batch(spark), set()
    rng = random.Random(1)
    for k in range(9):
        store = dedup.SeenStore(spark, path, 1)
        ids = [str(rng.randrange(30)) for _ in range(5)]
        store.take(batch(*[(i, 10 * k + j) for j, i in enumerate(ids)]), keep_results=2)
        first = {}
        for j, i in enumerate(ids):
            first.setdefault(i, 10 * k + j)
        assert sorted(r.arrival for r in store.kept().collect()) == sorted(a for i, a in first.items() if i not in seen)
        seen |= set(ids)
    assert store.shards >= 8 and len(store.meta["dict"]) < 9 and len(store.meta["results"]) == 2
    folders = [x for x in session.listing(spark, path) if x.startswith("v")]
    assert sum(session.exists(spark, f"{path}/{x}/kind=dict") for x in folders) <= len(store.meta["dict"]) + 3


def test_many_repeated_identifiers_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", 0)
    data = [(f"{(i % 50 if i % 3 else 7):032x}", i) for i in range(400)] + [(None, 500), (f"{1:032x}", None)]
    df = spark.createDataFrame(data, "event_id string, seq bigint")
    first = {}
    for e, s in data:
        if e and s is not None:
            first.setdefault(e, s)
    assert {r.seq for r in dedup.deduplicated(df).collect()} == set(first.values()) | {500, None}
    assert dedup.surplus(df).count() == len(data) - 2 - len(first)


def test_bitmaps_and_dictionary_round_trip():
    bits = np.random.default_rng(1).random(10_001) < 0.3
    assert (dedup.unpack_bits(dedup.pack_bits(bits)) == bits).all()
    assert len(dedup.unpack_bits(dedup.pack_bits(bits[:0]))) == 0
    ids = pa.array([b"x", b"", b"long" * 50], pa.binary())
    assert dedup.unpack_ids(dedup.pack_ids(ids)).equals(ids)
    codes, known = dedup.encode(pa.array([b"n", b"x", b"n"], pa.binary()), ids)
    assert codes.tolist() == [3, 0, 3] and len(known) == 4


def sessions_of(data, gap):
    out = []
    for user in {u for u, _ in data if u is not None}:
        times = sorted(t for u, t in data if u == user and t is not None)
        for t in times:
            if out and out[-1][0] == user and t - out[-1][2] <= gap:
                out[-1][2], out[-1][3] = t, out[-1][3] + 1
            else:
                out.append([user, t, t, 1])
    return sorted((u, a, b, b - a, n) for u, a, b, n in out)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-60, 200))), max_size=60), st.integers(1, 20))
def test_sessions_equal_brute_force(spark, data, gap):
    df = spark.createDataFrame([(u, t, 7) for u, t in data], "qid string, ts bigint, chunk int")
    got = sessions.sessions(df, gap=gap)
    assert sorted(tuple(r) for r in got.select("qid", "session_start", "session_end", "duration_seconds", "events").collect()) == sessions_of(data, gap)


def test_session_limits(spark, rows):
    df = spark.createDataFrame([("q", 0), ("q", 1_800), ("q", 3_601), ("q", 3_601)], "qid string, ts bigint")
    assert rows(sessions.sessions(df), "session_start", "session_end", "events") == [(0, 1_800, 2), (3_601, 3_601, 2)]
