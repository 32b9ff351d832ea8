import json
import math
import random

import pytest
from editwake.sources import gzip_lines
from editwake.operators import badrows, skew


def data(n=3_000, seed=2):
    rng = random.Random(seed)
    return [(rng.choices(["hot", "warm", None, f"k{rng.randrange(300)}"], [35, 8, 5, 52])[0], rng.choice([None, rng.randrange(-50, 400)]), i) for i in range(n)]


def test_heavy_keys_are_exact(spark, rows):
    d = data()
    df = spark.createDataFrame(d, "k string, v bigint, n int").repartition(7)
    count = {}
    for k, *_ in d:
        count[k] = count.get(k, 0) + 1
    for share in (0.05, 0.3, 1.0):
        expected = sorted((k, c) for k, c in count.items() if k is not None and c >= share * len(d))
        assert rows(skew.heavy_keys(df, "k", share)) == expected
    assert skew.heavy_keys(df.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        skew.heavy_keys(df, "k", 0)


def test_counts_and_percentiles(spark):
    d = data()
    df = spark.createDataFrame(d, "k string, v bigint, n int").repartition(5)
    got = {r.k: r for r in skew.key_counts(df, "k", {"n": ("count", "1"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}).collect()}
    by = {}
    for k, v, _ in d:
        by.setdefault(k, []).append(v)
    for k, values in by.items():
        real = [v for v in values if v is not None]
        assert (got[k].n, got[k].s, got[k].lo, got[k].hi) == (len(values), sum(real) if real else None, min(real, default=None), max(real, default=None))
    figures = {r.k: r for r in skew.key_percentiles(df, "k", "v", [0, 50, 95, 100], ranges=8).collect()}
    assert set(figures) == {k for k, v in by.items() if any(x is not None for x in v)}
    for k, r in figures.items():
        s = sorted(v for v in by[k] if v is not None)
        for p in (0, 50, 95, 100):
            assert r[f"p{p}"] == s[max(1, math.ceil(p * len(s) / 100)) - 1]
        assert (r.n, r.low, r.high) == (len(s), s[0], s[-1])


def test_one_value_only_and_empty(spark):
    df = spark.createDataFrame([("a", 1.5)] * 50, "k string, v double")
    assert tuple(skew.key_percentiles(df, "k", "v", [50]).first()) == ("a", 50, 1.5, 1.5, 1.5)
    assert skew.key_percentiles(df.limit(0), "k", "v", [50]).count() == skew.key_counts(df.limit(0), "k", {"n": ("count", "1")}).count() == 0


def test_outliers_dont_fill_one_range(spark):
    """A heavy key whose values are bunched together but for a few far outliers is still spread over the ranges."""
    data = [("hot", i % 997) for i in range(5_000)] + [("hot", 10**15), ("hot", -(10**15))] + [(f"k{i}", i) for i in range(300)] + [(None, 3), ("hot", None)]
    df = spark.createDataFrame(data, "qid string, lag_seconds bigint")
    got = {r.qid: r for r in skew.key_percentiles(df, "qid", "lag_seconds", [50, 95, 100], ranges=8).collect()}
    hot = sorted(v for q, v in data if q == "hot" and v is not None)
    assert (got["hot"].n, got["hot"].low, got["hot"].high) == (len(hot), hot[0], hot[-1])
    assert [got["hot"][f"p{p}"] for p in (50, 95, 100)] == [hot[max(1, -(-p * len(hot) // 100)) - 1] for p in (50, 95, 100)]
    assert len(got) == 302 and got["k7"].p50 == 7 and got[None].n == 1


def test_keys_by_share_counts_all_keys(spark, rows):
    data = [("a",)] * 50 + [("b",)] * 5 + [(None,)] * 40 + [("c",)] * 4 + [("d",)]
    df = spark.createDataFrame(data, "wiki string")
    assert rows(skew.keys_by_share(df, "wiki")) == [("a", 50), ("b", 5)]
    assert rows(skew.keys_by_share(df.limit(0), "wiki")) == []


def test_join_with_a_side_that_repeats_keys(spark, rows, monkeypatch):
    big = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 1), (None, 2)], "qid string, x int")
    side = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "qid string, x int")
    want = rows(big.join(side.withColumnRenamed("x", "x_"), "qid", "left"))
    assert rows(skew.skew_join(big, side, "qid")) == want
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)
    assert rows(skew.skew_join(big, side, "qid")) == want


def test_skew_join_equals_a_plain_join(spark, rows):
    big = spark.createDataFrame(data(), "k string, v bigint, n int")
    side = spark.createDataFrame([("hot", "H", 1), ("k3", "T", 2), (None, "N", 3), ("unused", "U", 4)], "k string, name string, v int")
    for how in ("left", "inner"):
        plain = big.join(side.withColumnRenamed("v", "v_"), "k", how)
        assert rows(skew.skew_join(big, side, "k", how=how), *plain.columns) == rows(plain)


GOOD = {"meta": {"id": "x"}, "wiki": "enwiki", "title": "T", "type": "edit", "timestamp": 1_610_000_000}


def event(**changes):
    e = GOOD | changes
    return json.dumps({k: v for k, v in e.items() if v != "drop"})


@pytest.mark.parametrize("line", [
    event(), "  " + event() + "\r\n", event(timestamp="1610000000"), event(timestamp=978_307_200), event(timestamp=2_082_758_399), event(bot="yes", user=5),
    event().replace('"T"', '"\\ud83d"'), event(extra=[{"a": [1, 2.5e3, None]}]), event(revision=7),
    event(timestamp="0" * 60 + "1610000000"), event(extra=1).replace("1}", "9" * 6_000 + "}"), event(extra="DEEP").replace('"DEEP"', "[" * 20_000 + "]" * 20_000),
    event(extra="DEEP").replace('"DEEP"', '{"a": [1, {"b": ' * 20_000 + '"\\ud800"' + "}]}" * 20_000), event(timestamp="0" * 5_000 + "1610000000"),
])
def test_valid_events(line):
    assert badrows.parse_event(line)["wiki"] == "enwiki"


@pytest.mark.parametrize("line", [
    "", "null", "[]", "{", event() + "x", event() + event(), event(timestamp=True), event(timestamp=1.61e9), event(timestamp=None), event(timestamp="drop"),
    event(timestamp=978_307_199), event(timestamp=2_082_758_400), event(timestamp="2021-01-09T18:25:47Z"), event(timestamp=" 1610000000"), event(timestamp="١٦١٠٠٠٠٠٠٠"),
    event(timestamp="-1610000000"), event(wiki=""), event(title=None), event(type=3), event(meta=[]), event(meta={"id": ""}), event(meta="x"),
    event().replace("1610000000", "NaN"), event(extra=1).replace("1}", "01}"), "{'a': 1}", event().replace('"T"', '"a\tb"'), "﻿" + event(), "[" * 100_000,
    event(timestamp="9" * 5_000), event().replace("1610000000", "9" * 5_000),
])
def test_faulty_events(line):
    with pytest.raises(badrows.Fault):
        badrows.parse_event(line)


REC = "Q1,2,enwiki,Title,1610000000,dewiki,Titel,1610000060,Ann,60"


@pytest.mark.parametrize("line", [
    REC, REC + "\r\n", REC.replace("Ann", '"Ann, ""B"""'), REC.replace("Title", '"two\nlines"'), REC.replace("Ann", ""), REC.replace(",60", ",-60"), ",".join(f'"{x}"' for x in REC.split(",")),
    REC.replace(",60", "," + "9" * 30), REC.replace(",60", ",-" + "9" * 5_000), REC.replace("1610000000", "0" * 30 + "1610000000"), REC.replace("Title", '"a\r\n,""b"'),
])
def test_valid_records(line):
    assert badrows.parse_record(line)["rank"] == 2


@pytest.mark.parametrize("line", [
    "", REC + "," + REC, REC.rsplit(",", 1)[0], REC.replace("Title", 'Ti"tle'), REC.replace("Title", '"Title'), REC.replace("Title", '"Tit"le'), REC.replace(",", "\t"), REC.replace("Q1", "q1"),
    REC.replace(",2,", ",1,"), REC.replace(",2,", ",II,"), REC.replace(",2,", ",2.0,"), REC.replace("enwiki", ""), REC.replace("1610000000", "1610000000000"), REC.replace(",60", ","), REC.replace(",60", ",nan"),
    REC + "\n" + REC, REC.replace("Title", "Ti\rtle"), " " + REC, REC + " ", REC.replace(",60", ",60,"), REC + "\r", REC.replace("Title", 'T"it"le'), REC.replace(",2,", ",-" + "9" * 30 + ","), REC.replace("1610000000", "9" * 5_000),
])
def test_faulty_records(line):
    with pytest.raises(badrows.Fault):
        badrows.parse_record(line)


def test_numbers_beyond_their_type_load_as_text():
    row = badrows.parse_record(REC.replace(",2,", ",3000000000,").replace(",60", "," + "7" * 5_000))
    assert (row["rank"], row["lag_seconds"], row["beyond"]) == (None, None, "rank=3000000000,lag_seconds=" + "7" * 5_000)


@pytest.mark.parametrize("value", [
    '{"a":[1,-2.5e3,{"b":null},true,""],"a":"x\\n\\u00e9","c":{}}', "[]", " [ ] ", "[[],{}]", '"s"', "1e5", "-0", "[1 ,2]",
    "[1,]", '{"a":1,}', "{,}", "[1 2]", '{"a" 1}', "[", "]", "{]", "1 2", "[1]]", '{1:2}', "nul", "01", "[.5]", '["\t"]', "[NaN]", "", '{"a":}', ",", "[:]", '"a', "[1}",
])
def test_reader_of_any_depth_agrees_with_the_usual_one(value):
    try:
        want = badrows.decode_json(value)
    except badrows.Fault:
        with pytest.raises(badrows.Fault):
            badrows.decode_deep(value)
    else:
        assert badrows.decode_deep(value) == want


@pytest.mark.parametrize("tail", ["]", "", "1"])
def test_deep_faults(tail):
    with pytest.raises(badrows.Fault):
        badrows.parse_event(event(extra="DEEP").replace('"DEEP"', "[" * 20_000 + "]" * 19_999 + "}") + tail)


def test_records_of_files_go_over_several_lines(spark, tmp_path):
    import gzip

    texts = [REC, REC.replace("Title", '"two\n\nlines, ""quoted"""'), "", REC.replace("Title", '"open'), REC]
    whole = gzip.compress(("\r\n".join(texts[:3]) + "\n").encode())
    (tmp_path / "records-1.csv.gz").write_bytes(whole + gzip.compress(("\n".join(texts[3:]) + "\n").encode()))
    lines = gzip_lines.read_archive(spark, str(tmp_path), "*.csv.gz")
    assert [r.text for r in lines.orderBy("line_no").collect()] == [texts[0], texts[1], "\n".join(texts[3:])]
    assert [r.leader_title for r in badrows.records(lines).orderBy("line_no").collect()] == ["Title", 'two\n\nlines, "quoted"']
    assert badrows.faulty(lines).count() == 1


def test_records_assembled_over_lines():
    lines = ["a,b", 'c,"d', "", 'e""",f', "g", '"open', "end"]
    assert list(badrows.assemble(lines)) == ["a,b", 'c,"d\n\ne""",f', "g", '"open\nend']


def test_table_is_split_without_loss(spark, rows):
    lines = [("a.jsonl.gz", 1, event()), ("a.jsonl.gz", 2, "{"), ("r.csv.gz", 1, REC), ("r.csv.gz", 2, None), ("x.txt", 1, "?"), (None, 5, event()), ("a.jsonl.gz", None, event()), ("a.jsonl.gz", 2, "{")]
    df = spark.createDataFrame([(*x, "own", 1) for x in lines], "file string, line_no bigint, text string, reason string, event int")
    bad = badrows.faulty(df)
    assert rows(bad, "file", "line_no") == sorted([("a.jsonl.gz", 2), ("a.jsonl.gz", 2), ("r.csv.gz", 2), ("x.txt", 1), (None, 5)], key=repr)
    assert bad.count() + badrows.events(df).count() + badrows.records(df).count() == len(lines)
    assert badrows.parsed(df.limit(0)).count() == badrows.reasons(df.limit(0)).count() == 0


def test_very_long_line(spark):
    long = event(comment="ж" * 2_000_000)
    df = spark.createDataFrame([("a.jsonl", 1, long)], "file string, line_no bigint, text string")
    assert len(badrows.events(df).first().edit_comment) == 2_000_000
