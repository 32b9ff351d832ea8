import gzip
import json

import pytest
from editwake import benchmark, config, logs, report, session, sinks
from editwake.__main__ import main
from editwake.functions import text as X
from editwake.operators import late
from editwake.session import scratch
from editwake.sources import gzip_lines as Z
from editwake.sources import lookup as L
from editwake.sources import sse
from editwake.streaming.dedup import FirstDeliveries
from editwake.streaming.late import LateCounts, run
from editwake.streaming.state import VersionedState


def member(lines, cut=0):
    data = gzip.compress("".join(f"{x}\n" for x in lines).encode())
    return data[: len(data) - cut] if cut else data


def flushed(lines):
    """A member whose writer was killed after a flush."""
    import zlib

    c = zlib.compressobj(wbits=31)
    return c.compress("".join(f"{x}\n" for x in lines).encode()) + c.flush(zlib.Z_SYNC_FLUSH)


def test_members_whole_killed_and_mixed():
    assert [x[2:] for x in Z.lines(member("ab") + member("c"))] == [("a", False), ("b", False), ("c", False)]
    assert [x[2:] for x in Z.lines(flushed("ab"))] == [("a", True), ("b", True)]
    many = [str(i) for i in range(600)]
    got = list(Z.lines(flushed(many[:200]) + flushed(many[200:400]) + member(many[400:])))
    assert [x[2] for x in got] == many and [x[1] for x in got] == list(range(1, 601))
    assert {(x[0], x[3]) for x in got} == {(0, True), (1, True), (2, False)}
    assert list(Z.lines(b"")) == [] and list(Z.lines(b"no gzip at all")) == []


def test_truncated_tail_and_bad_bytes():
    got = [x[2] for x in Z.lines(member(["whole line", "x" * 5_000 + "tail"], cut=9))]
    assert got[0] == "whole line"
    broken = bytearray(flushed([f"line {i} {'y' * (i % 50)}" for i in range(5_000)]))
    broken[len(broken) // 2] ^= 0xFF
    texts = [x[2] for x in Z.lines(bytes(broken) + member(["last"]))]
    assert texts[0] == "line 0" and texts[-1] == "last"
    assert [x[2] for x in Z.lines(gzip.compress(b"a\n\n  \r\nb\xff\n no end"))] == ["a", "b�", "no end"]


def test_archive_is_read_by_name_order(spark, tmp_path):
    (tmp_path / "2021-01-04-11.jsonl.gz").write_bytes(member(["3"]))
    (tmp_path / "2021-01-04-10.jsonl.gz").write_bytes(member(["1"]) + flushed(["2"]))
    (tmp_path / "other.txt").write_text("no")
    rows = Z.read_archive(spark, str(tmp_path)).orderBy("file", "line_no").collect()
    assert [(r.member, r.line_no, r.text, r.damaged) for r in rows] == [(0, 1, "1", False), (1, 2, "2", True), (0, 1, "3", False)]
    assert Z.partitions(spark, str(tmp_path)).count() == 2


FEED = ["event: message", "id: 1", "data: a", "data:  b", "", ":ok", "data: c", "", "event: other", "data", "", "id: 3", "", "data: cut"]
WANT = [("1", "message", "a\n b"), ("1", "message", "c"), ("1", "other", "")]


def test_frames(spark):
    assert list(sse.frames(FEED)) == WANT
    df = spark.createDataFrame([("c", i, x) for i, x in enumerate(FEED)], "conn string, line_no int, line string")
    assert [tuple(r) for r in sse.frames_of(df, ["conn"]).orderBy("block").select("id", "event", "data").collect()] == WANT


def test_reconnecting_resumes_and_waits_longer():
    waits, asked = [], []
    answers = [OSError("down"), OSError("down"), ["id: 1", "data: x", ""], OSError("down"), ["id: 2", "data: y", ""]]

    def opened(url, resume, timeout):
        asked.append(resume)
        a = answers.pop(0)
        if isinstance(a, OSError):
            raise a
        return iter(a)

    got = sse.received("u", "0", most=2, opened=opened, sleep=waits.append, clock=lambda: 0.0)
    assert [g[2] for g in got] == ["x", "y"] and asked == ["0", "0", "0", "1", "1"] and waits == [1.0, 2.0, 1.0, 1.0]


def test_event_feed_source(spark, tmp_path):
    feed = tmp_path / "feed.txt"
    feed.write_text("".join(f"id: {i}\ndata: {i}\n\n" for i in range(1, 8)))
    spark.dataSource.register(sse.EventFeed)
    df = spark.readStream.format("event_feed").option("file", str(feed)).option("most", 3).load()
    q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    for _ in range(60):
        q.processAllAvailable()
        if spark.read.schema(sse.SCHEMA).parquet(str(tmp_path / "out")).count() >= 7:
            break
    q.stop()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [str(i) for i in range(1, 8)]


class Fake:
    def __init__(self, bad=(), fail=0):
        self.bad, self.fail, self.asked = set(bad), fail, []

    def lookup(self, site, titles):
        self.asked.append(len(titles))
        if self.fail:
            self.fail -= 1
            raise L.TryAgain("busy", 7.0 if self.fail % 2 else None)
        if self.bad & set(titles):
            raise L.Refused("bad title")
        return {t: f"Q{t}" for t in titles}


def test_lookups_batch_retry_and_halve():
    waits, fake = [], Fake(bad=["5"])
    got = L.Lookups(fake, sleep=waits.append)
    out = got.site("en", [str(i) for i in range(120)])
    assert len(out) == 120 and out["5"] is None and out["6"] == "Q6" and got.refused == 1 and fake.asked[0] == 50
    busy = Fake(fail=2)
    assert L.Lookups(busy, sleep=waits.append).site("en", ["a"]) == {"a": "Qa"} and waits == [7.0, 2.0]
    gone = L.Lookups(Fake(fail=99), sleep=lambda s: None)
    assert gone.site("en", ["a", "b"]) == {} and gone.failed == 2 and gone.retries == 6


def test_answers_matched(spark, rows):
    body = {"entities": {"-1": {"site": "en", "title": "X", "missing": ""}, "Q1": {"id": "Q1", "sitelinks": {"en": {"title": "A"}}}, "Q2": {"id": "Q2", "sitelinks": {"de": {"title": "B"}}}}}
    assert L.matched(body, "en", ["A", "a", "X", "B"]) == {"A": "Q1", "a": None, "X": None, "B": None}
    answers, wanted = spark.createDataFrame([("en", json.dumps(body))], "site string, body string"), spark.createDataFrame([("en", t) for t in ("A", "a", "X", "B")], "site string, title string")
    assert rows(L.matched_table(answers, wanted), "title", "qid") == sorted([("A", "Q1"), ("a", None), ("X", None), ("B", None)], key=repr)


def edits(spark, n=300):
    data = [("ab"[i % 2], 10_000 + i * 7 - (900 if i % 11 == 0 else 0), i, f"{i % 250:032x}") for i in range(1, n)]
    return spark.createDataFrame(data, "wiki string, ts bigint, seq bigint, event_id string")


def fed(spark, df, path, pieces=4):
    high = df.agg({"seq": "max"}).first()[0]
    for k in range(pieces):
        df.where(f"seq > {high * k // pieces} and seq <= {high * (k + 1) // pieces}").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streamed_counts_equal_batch_and_redelivery_counts_once(spark, rows):
    df = edits(spark)
    target = LateCounts(spark, scratch(spark, "t"), ["wiki"], period=60, lateness=500)
    run(fed(spark, df, scratch(spark, "feed")), target, scratch(spark, "cp"))
    on_time, diverted = late.split_late(df, lateness=500)
    want = on_time.groupBy("wiki", ((on_time.ts - on_time.ts % 60)).alias("p")).count()
    assert rows(target.counts(), "wiki", "period_start", "edits") == rows(want)
    assert rows(target.diverted(), "seq") == rows(diverted, "seq") and diverted.count() > 0
    before = rows(target.counts())
    again = LateCounts(spark, target.path, ["wiki"], period=60, lateness=500)
    again(df, 0)
    assert rows(again.counts()) == before
    assert target.updates().count() > target.counts().count()


def test_batch_killed_between_commit_and_copy_loses_nothing(spark, rows, monkeypatch):
    df = edits(spark)
    whole, cut = (LateCounts(spark, scratch(spark, "t"), ["wiki"], period=60, lateness=500) for _ in range(2))
    pieces = [df.where("seq <= 150"), df.where("seq > 150")]
    for k, rows_of in enumerate(pieces):
        whole(rows_of, k)

    def dies(*args):
        raise KeyboardInterrupt

    for k, rows_of in enumerate(pieces):
        monkeypatch.setattr(VersionedState, "append", dies)
        with pytest.raises(KeyboardInterrupt):
            cut(rows_of, k)
        monkeypatch.undo()
        cut = LateCounts(spark, cut.path, ["wiki"], period=60, lateness=500)
        cut(rows_of, k)
    for name in ("counts", "diverted", "updates"):
        assert rows(getattr(cut, name)()) == rows(getattr(whole, name)()), name
    assert spark.read.parquet(cut.state.folder("counts")).count() < cut.counts().count()


def test_state_survives_a_kill_before_its_mark(spark, rows, monkeypatch):
    path = scratch(spark, "state")
    state = VersionedState(spark, path)
    state.commit(0, {"t": spark.range(3)}, clock=5)
    for name in ("rename", "write_text"):
        monkeypatch.setattr(session, name, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            VersionedState(spark, path).commit(1, {"t": spark.range(9)})
        monkeypatch.undo()
        after = VersionedState(spark, path)
        assert after.meta["batch"] == 0 and after.meta["clock"] == 5 and after.table("t", "id bigint").count() == 3
    after.commit(1, {"t": spark.range(9)})
    assert VersionedState(spark, path).table("t", "id bigint").count() == 9
    with pytest.raises(OSError):
        session.publish(spark, path, 2, "another writer")


def test_streamed_first_deliveries(spark, rows):
    df = edits(spark)
    target = FirstDeliveries(spark, scratch(spark, "t"), shards=3)
    run(fed(spark, df, scratch(spark, "feed")), target, scratch(spark, "cp"))
    assert rows(target.rows(), "seq") == [(i,) for i in sorted(range(1, 251), key=lambda i: repr((i,)))]


def test_settings(tmp_path, monkeypatch):
    path = tmp_path / "c.toml"
    path.write_text('[propagation]\nranks = [5, 2]\nwatermark = 7\n[filters]\neditions = ["enwiki"]\n')
    monkeypatch.setenv("EDITWAKE_CONFIG", str(path))
    c = config.load()
    assert (c.propagation.ranks, c.propagation.watermark, c.propagation.horizon, c.filters.editions) == ((2, 5), 7, 86_400, ("enwiki",))
    path.write_text("[propagation]\nwatermrk = 7\n")
    with pytest.raises(KeyError, match="watermrk"):
        config.load()


def test_texts():
    assert [X.duration(s) for s in (None, 45, 89, 90, 685, 5_399, 5_400, 21_600, -120)] == ["-", "45s", "89s", "1m 30s", "11m 25s", "89m 59s", "1h 30m", "6h 00m", "-2m 00s"]
    assert [X.ordinal(n) for n in (1, 2, 3, 4, 11, 22, 113)] == ["1st", "2nd", "3rd", "4th", "11th", "22nd", "113th"]
    assert (X.number(12345), X.number(None), X.percent(0.1234), X.counted(1, "gap"), X.counted(2, "gap")) == ("12,345", "-", "12.3%", "1 gap", "2 gaps")
    assert X.table(["a"], [["x|y"]]).endswith("| x\\|y |") and X.table(["a"], []) == "_pending_"


def test_report_spliced_between_marks(tmp_path):
    body = report.render({})
    assert body.count("_pending_") == 6
    readme = tmp_path / "R.md"
    readme.write_text(f"top\n{report.BEGIN}\nold\n{report.END}\nend\n")
    assert report.splice(str(readme), body) and not report.splice(str(readme), body)
    assert readme.read_text().startswith("top") and readme.read_text().endswith("end\n") and "old" not in readme.read_text()
    readme.write_text("no marks")
    with pytest.raises(ValueError):
        report.splice(str(readme), body)
    runs = {"runs": [{"stage": "full", "workers": 1, "events_per_second": 10, "speed_up": 1, "efficiency": 1}]}
    assert "| full | 1 | 10 |" in report.performance_section(runs, runs)
    with pytest.raises(ValueError):
        report.performance_section({"runs": []}, runs)


def test_runs_are_measured_and_profiled(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.5)], "x int, y string, z double")
    got = benchmark.measured(spark, lambda: df, 100, repeats=1)
    assert got["rows"] == 2 and got["events_per_second"] > 0 and got["digest"] == benchmark.digest(df.repartition(3))[1]
    assert benchmark.digest(df)[1] != benchmark.digest(df.withColumn("y", df.x.cast("string")))[1] and benchmark.digest(df.limit(0)) == (0, "0")
    seen = iter((df, df.limit(1)))
    with pytest.raises(RuntimeError):
        benchmark.measured(spark, lambda: next(seen), 100, repeats=1)
    told = benchmark.profiled(spark, lambda: df.groupBy("y").count().collect())
    assert told["stages"] >= 1 and abs(sum(s["own_share"] for s in told["top"]) - 1) < 0.01


def test_scaling_runs_are_compared(monkeypatch):
    from types import SimpleNamespace

    made = iter([("full", 8.0, "d"), ("full", 4.0, "d"), ("full", 4.0, "d"), ("full", 3.0, "e")])
    fake = lambda *a, **k: SimpleNamespace(stdout="x\n" + json.dumps(dict(zip(("stage", "seconds", "digest"), next(made), strict=True))) + "\n")
    monkeypatch.setattr(benchmark.subprocess, "run", fake)
    runs = benchmark.scaled(["x"], ("full",), (1, 2))["runs"]
    assert [(r["speed_up"], r["efficiency"]) for r in runs] == [(1.0, 1.0), (2.0, 1.0)]
    with pytest.raises(RuntimeError):
        benchmark.scaled(["x"], ("full",), (1, 2))


def test_log_lines_are_json(capsys):
    import logging

    run_id = logs.configure()
    logging.getLogger("editwake.x").info("hello", extra={"n": 3})
    line = json.loads(capsys.readouterr().err.strip().splitlines()[-1])
    assert (line["event"], line["n"], line["run_id"], line["level"]) == ("hello", 3, run_id, "info")


def test_command_line_from_archive_to_report(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    base = 1_609_754_400
    events = []
    for i in range(40):
        for k, w in enumerate(("enwiki", "dewiki", "frwiki")):
            events.append({"meta": {"id": f"{i}-{w}", "dt": "2021-01-04T10:05:07Z"}, "wiki": w, "title": f"T{i}", "namespace": 0, "type": "edit", "timestamp": base + i * 3_000 + k * 60, "user": w})
    events.sort(key=lambda x: x["timestamp"])
    (raw / "2021-01-04-10.jsonl.gz").write_bytes(member([json.dumps(x) for x in events] + ["{cut"]))
    spark.createDataFrame([(w, f"T{i}", f"Q{i}") for i in range(40) for w in ("enwiki", "dewiki", "frwiki")], "wiki string, title string, qid string").write.parquet(str(tmp_path / "snap"))
    readme = tmp_path / "README.md"
    readme.write_text(f"{report.BEGIN}\n{report.END}\n")
    args = ["--archive", str(raw), "--snapshot", str(tmp_path / "snap"), "--records", str(tmp_path / "rec"), "--results", str(tmp_path / "res"), "--labels", str(tmp_path / "lab")]
    for step in (["stats"], ["resolve"], ["join"], ["pairs", "sample"], ["failures", "sample"]):
        main([*args, *step], spark)
    with pytest.raises(sinks.WouldOverwrite):
        main([*args, "pairs", "sample"], spark)
    for name in ("pairs", "failures"):
        sheet = tmp_path / "lab" / f"{name}.csv"
        assert sheet.read_text().count("\n") > 10
    main([*args, "pairs", "evaluate"], spark)
    main([*args, "failures", "summarise"], spark)
    main([*args, "report", "--readme", str(readme)], spark)
    found = sinks.load_results(str(tmp_path / "res"))
    assert found["archive"]["undecodable"] == 1 and found["resolve"]["with_item"] == 120
    assert {x["rank"]: x["median_seconds"] for x in found["propagation"]["lag_by_rank"]} == {2: 60, 3: 120}
    assert "60s" in readme.read_text() and "_pending_" in readme.read_text()
