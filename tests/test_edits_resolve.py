import json

import pytest
from editwake.operators import edits as E
from editwake.operators import resolve as R

GOOD = {"meta": {"id": "i1", "dt": "2021-01-04T10:05:07.5Z"}, "wiki": "enwiki", "title": "T", "namespace": 0, "type": "edit", "timestamp": 1_609_754_700, "user": "U", "bot": False}


def lines(spark, *events):
    data = [("2021-01-04-10.jsonl.gz", 0, i, x if isinstance(x, str) else json.dumps(x, ensure_ascii=False), False) for i, x in enumerate(events, 1)]
    return spark.createDataFrame(data, "file string, member int, line_no bigint, text string, damaged boolean")


def without(key):
    return {k: v for k, v in GOOD.items() if k != key}


def reasons(spark, *events):
    return {r.line_no: r.reason for r in E.typed(lines(spark, *events)).collect()}


def test_first_failing_reason(spark):
    got = reasons(spark, GOOD, GOOD | {"wiki": "xxwiki", "namespace": 4}, GOOD | {"namespace": 1}, GOOD | {"type": "log"}, {"meta": {}}, without("title"), GOOD | {"title": None}, GOOD | {"type": None})
    assert got == {1: None, 2: "wiki", 3: "namespace", 4: "type:log", 5: "malformed", 6: "malformed", 7: None, 8: "type:None"}


def test_times_flags_and_odd_values(spark):
    rows = E.typed(lines(spark, GOOD | {"timestamp": " 1_609 "}, GOOD | {"timestamp": 7.9}, GOOD | {"timestamp": True}, GOOD | {"timestamp": "7.9"}, GOOD | {"timestamp": None}, GOOD | {"timestamp": []})).orderBy("line_no").collect()
    assert [(r.ts, r.reason) for r in rows] == [(1609, None), (7, None), (1, None), (None, "malformed"), (None, "malformed"), (None, "malformed")]
    bots = E.typed(lines(spark, *[GOOD | {"bot": b} for b in (True, False, None, "false", "", 0, 2, [], [0], {}, {"a": 1})], without("bot"))).orderBy("line_no").collect()
    assert [r.bot for r in bots] == [True, False, False, True, False, False, True, False, True, False, True, False]


def test_objects_text_and_numbers_that_are_not_json(spark):
    got = reasons(spark, "[1]", '"x"', "5", json.dumps(GOOD).replace("1609754700", "NaN"), GOOD | {"revision": 7}, GOOD | {"revision": {}}, "{truncated", "", json.dumps(GOOD) + "x", json.dumps(GOOD) + "]")
    assert got == {1: "malformed", 2: "malformed", 3: "malformed", 4: "malformed", 5: "malformed", 6: None}


def test_fields_of_a_kept_edit(spark):
    row = E.kept(lines(spark, GOOD | {"revision": {"new": 5}, "title": "日本 ’", "user": None}, without("user"))).orderBy("line_no").collect()
    assert (row[0].event_id, row[0].title, row[0].revision, row[0].user_name, row[1].user_name) == ("i1", "日本 ’", 5, None, "")


def test_accounting_adds_up(spark):
    df = lines(spark, GOOD, GOOD, GOOD | {"meta": {"id": None}}, GOOD | {"meta": {"id": None}}, GOOD | {"wiki": "x"}, "{", {"meta": {}})
    assert {r.outcome: r.events for r in E.accounting(df).collect()} == {"undecodable": 1, "malformed": 1, "wiki": 1, "kept": 3, "duplicate": 1}


def test_unique_keeps_the_first(spark, rows):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), (None, 4, "n"), (None, 5, "n")], "event_id string, seq bigint, o string")
    assert rows(E.unique(df, ["seq"]), "seq") == [(1,), (2,), (4,), (5,)]


def test_coverage_and_gaps(spark):
    minutes = [GOOD | {"meta": {"dt": f"2021-01-04T10:{m:02d}:30Z"}} for m in (0, 1, 5, 6, 9)]
    df = lines(spark, *minutes, "{cut", GOOD | {"meta": {"dt": "soon"}})
    stats = E.coverage(df).first()
    assert (stats.events, stats.undecodable, stats.undecodable_rate) == (6, 1, 0.142857)
    assert (stats.first_event, stats.last_event) == ("2021-01-04T10:00:00+00:00", "2021-01-04T10:09:00+00:00")
    start = 1_609_754_400
    assert [tuple(r) for r in E.minute_gaps(df).orderBy("gap_start").collect()] == [(start + 120, start + 240, 3), (start + 420, start + 480, 2)]
    empty = E.coverage(lines(spark, GOOD).limit(0)).first()
    assert (empty.events, empty.undecodable_rate, empty.first_event) == (0, 0.0, None)


def test_captured_keeps_bots_and_names_the_hour(spark, rows):
    df = lines(spark, GOOD | {"bot": True}, GOOD | {"namespace": 2}, GOOD | {"wiki": "q"}, without("meta"))
    assert rows(E.captured(df), "line_no", "hour") == [(1, "2021-01-04-10"), (4, None)]


def pages(spark, *data):
    return spark.createDataFrame(list(data), "wiki string, title string, qid string")


def test_resolution_tells_no_item_from_unknown(spark, rows):
    snap = pages(spark, ("en", "A", "Q1"), ("en", "B", None), ("de", "A", "Q9"))
    edits = spark.createDataFrame([("en", "A", 1, "old"), ("en", "B", 2, "old"), ("en", "C", 3, "old"), (None, "A", 4, "old")], "wiki string, title string, seq bigint, qid string")
    assert rows(R.resolved(edits, snap), "seq", "qid", "found") == [(1, "Q1", True), (2, None, True), (3, None, False), (4, None, False)]
    assert rows(R.unresolved(edits, snap), "wiki", "title") == sorted([("en", "C"), (None, "A")], key=repr)


def test_upsert_takes_the_latest(spark, rows):
    new = spark.createDataFrame([("en", "A", "Q3", 2), ("en", "A", "Q2", 1), ("fr", "Z", None, 1)], "wiki string, title string, qid string, version bigint")
    assert rows(R.upsert(pages(spark, ("en", "A", "Q1"), ("de", "A", "Q9")), new), "wiki", "title", "qid") == [("de", "A", "Q9"), ("en", "A", "Q3"), ("fr", "Z", None)]


def test_counters_equal_a_cache_kept_by_hand(spark):
    import random

    rng = random.Random(4)
    snap = {("en", f"t{i}"): None if i % 3 == 0 else f"Q{i}" for i in range(20)}
    keys = [("en", f"t{rng.randrange(30)}") for _ in range(400)]
    cache, want = {}, dict.fromkeys(("references", "cache_hits", "negative_cache_hits", "coalesced", "store_hits", "offline_unresolved"), 0)
    for start in range(0, 400, 25):
        pending = []
        for k in keys[start : start + 25]:
            want["references"] += 1
            if k in pending:
                want["coalesced"] += 1
            elif k in cache:
                want["cache_hits"] += 1
                want["negative_cache_hits"] += cache[k] is None
            else:
                pending.append(k)
        for k in pending:
            want["store_hits" if k in snap else "offline_unresolved"] += 1
            if k in snap:
                cache[k] = snap[k]
    edits = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "wiki string, title string, seq bigint")
    row = R.counters(edits, pages(spark, *[(*k, q) for k, q in snap.items()]), block=25).first().asDict()
    assert {k: row[k] for k in want} == want
    assert R.counters(edits.limit(0), pages(spark, ("a", "b", "c"))).first().cache_hit_rate == 0.0


def recent(ids, capacity):
    held, kept = [], []
    for i, x in enumerate(ids):
        if x in held:
            continue
        held.append(x)
        if len(held) > capacity:
            held.pop(0)
        kept.append(i)
    return kept


@pytest.mark.parametrize("ids,capacity", [("abcac", 2), ("aaaa", 1), ("abababab", 1), ("abcabcabcabc", 2), ("abc" * 20 + "xa" * 9 + "cb" * 11, 3)])
def test_bounded_memory_of_identifiers(spark, ids, capacity):
    df = spark.createDataFrame([(x, i, "own") for i, x in enumerate(ids)] + [(None, 900, "n"), ("a", None, "n")], "event_id string, seq bigint, gone string")
    got = sorted(r.seq for r in E.unique_recent(df, "seq", capacity).where("gone = 'own'").collect())
    assert got == recent(ids, capacity)
    assert E.unique_recent(df, "seq", capacity).where("gone = 'n'").count() == 2
    assert E.unique_recent(df.limit(0), "seq", capacity).count() == 0


def test_bounded_memory_at_random(spark):
    import random

    rng = random.Random(8)
    for capacity in (3, 12):
        ids = [f"i{rng.randrange(30)}" for _ in range(400)]
        df = spark.createDataFrame(list(zip(ids, range(400), strict=True)), "event_id string, seq bigint").repartition(3)
        assert sorted(r.seq for r in E.unique_recent(df, "seq", capacity).collect()) == recent(ids, capacity)
