"""Queries for problems 1, 2, 4, 5 and 6, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editwake.operators import badrows, dedup, late, sessions, skew

PERCENTS = [50, 95]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark, d):
    edits = table(spark, d, "edits").select("seq", "ts")
    return late.with_lateness(edits).where("late").select("seq")


def p1_updates(spark, d):
    return late.period_updates(table(spark, d, "edits").select("wiki", "ts", "seq", "batch_id"), ["wiki"])


def p1_hourly(spark, d):
    return late.apply_upserts(p1_updates(spark, d), ["wiki"])


def p1_late_report(spark, d):
    return late.late_report(table(spark, d, "edits").select("wiki", "ts", "seq"), ["wiki"])


def p2_found(spark, d):
    return dedup.surplus(table(spark, d, "edits").select("event_id", "seq")).select("seq")


def p2_kept(spark, d):
    return dedup.deduplicated(table(spark, d, "edits"))


def p4_found(spark, d):
    return sessions.sessions(table(spark, d, "edits").select("qid", "ts")).select("qid", "session_start", "session_end")


def p4_sessions(spark, d):
    return sessions.sessions(table(spark, d, "edits").select("qid", "ts"))


def p5_found(spark, d):
    found = [
        skew.keys_by_share(table(spark, d, name).select(key), key).select(F.lit(key).alias("field"), "key_value")
        for name, key in (("edits", "wiki"), ("propagation_records", "qid"))
    ]
    return found[0].unionByName(found[1])


def p5_wiki_counts(spark, d):
    return skew.key_counts(
        table(spark, d, "edits").select("wiki", "bot", "ts"), "wiki",
        {"edits": ("count", "1"), "bot_edits": ("sum", "cast(bot as bigint)"), "first_ts": ("min", "ts"), "last_ts": ("max", "ts")},
    )


def p5_item_lags(spark, d):
    return skew.key_percentiles(table(spark, d, "propagation_records"), "qid", "lag_seconds", PERCENTS)


def p5_records_with_windows(spark, d):
    windows = table(spark, d, "item_windows").distinct().groupBy("qid").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("human_edits").alias("human_edits")
    )
    records = table(spark, d, "propagation_records").select("qid", "rank", "leader_wiki", "follower_wiki", "leader_timestamp", "lag_seconds")
    return skew.skew_join(records, windows, "qid")


def p6_found(spark, d):
    return badrows.faulty(table(spark, d, "raw_lines")).select("file", "line_no")


def p6_reasons(spark, d):
    return badrows.reasons(table(spark, d, "raw_lines"))


def p6_events(spark, d):
    return badrows.events(table(spark, d, "raw_lines"))


def p6_records(spark, d):
    return badrows.records(table(spark, d, "raw_lines"))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_updates, p1_hourly, p1_late_report, p2_found, p2_kept, p4_found, p4_sessions, p5_found, p5_wiki_counts, p5_item_lags,
    p5_records_with_windows, p6_found, p6_reasons, p6_events, p6_records,
)}

CLOCKED = """with c as (select *, max(ts) over (order by seq rows between unbounded preceding and 1 preceding) as clock from edits),
l as (select *, coalesce(ts < clock - 21600, false) as late from c)"""
ID = r"regexp_replace(regexp_replace(lower(trim(event_id)), '^(urn:uuid:)?\{?|\}$', '', 'g'), '-', '', 'g')"
SESSIONS = """with g as (select qid, ts, coalesce(ts - lag(ts) over (partition by qid order by ts) > 1800, true) as starts from edits where qid is not null),
s as (select *, sum(starts::int) over (partition by qid order by ts rows unbounded preceding) as k from g),
r as (select qid, min(ts) as session_start, max(ts) as session_end, max(ts) - min(ts) as duration_seconds, count(*) as events from s group by qid, k)"""
_F = r'("(?:[^"]|"")*"|[^",\r\n]*)'
_FIELDS = badrows.RECORD_FIELDS
_WHOLE = "^[+-]?[0-9]+$"
_VALUE = "(case when starts_with({0}, '\"') then replace(substring({0}, 2, length({0}) - 2), '\"\"', '\"') else {0} end)"
# Lines split and typed by patterns. A number beyond 38 digits doesn't occur in the tables; the tests have it.
_LINES = rf"""with l as (select file, line_no, text, file like '%.csv.gz' as is_csv, file like '%.jsonl.gz' as is_json from raw_lines),
cx as (select *, regexp_extract(regexp_replace(text, '\r?\n$', ''), '^{",".join([_F] * 9)},(.*)$', {[*_FIELDS[:9], "rest"]!r}, 's') as x,
 regexp_full_match(regexp_replace(text, '\r?\n$', ''), '{_F}(,{_F}){{9}}') as ten from l where is_csv),
cy as (select *, {", ".join(f"{_VALUE.format('x.' + ('rest' if f == 'lag_seconds' else f))} as {f}" for f in _FIELDS)} from cx),
cz as (select *, try_cast(leader_timestamp as hugeint) as l_at, try_cast(follower_timestamp as hugeint) as f_at, try_cast(rank as hugeint) as rk from cy),
c as (select *, case when not ten then 'csv' when not regexp_full_match(qid, 'Q[0-9]+') then 'qid' when not regexp_matches(rank, '{_WHOLE}') then 'rank'
 when not regexp_matches(leader_timestamp, '{_WHOLE}') then 'leader_timestamp' when not regexp_matches(follower_timestamp, '{_WHOLE}') then 'follower_timestamp'
 when not regexp_matches(lag_seconds, '{_WHOLE}') then 'lag_seconds' when rk < 2 then 'rank' when leader_wiki = '' then 'leader_wiki' when follower_wiki = '' then 'follower_wiki'
 when not coalesce(l_at between 978307200 and 2082758399, false) then 'leader_timestamp' when not coalesce(f_at between 978307200 and 2082758399, false) then 'follower_timestamp' end as reason from cz),
jx as (select *, case when json_valid(text) and not regexp_matches(regexp_replace(text, '"(\\.|[^"\\])*"', '""', 'g'), ',\s*[}}\]]')
 and not regexp_matches(regexp_replace(regexp_replace(text, '"(\\.|[^"\\])*"', '""', 'g'), 'true|false|null', '', 'g'), '[A-DF-Za-df-z]') then text::json end as j from l where is_json),
jy as (select *, json_type(j, '$.meta') as mt, json_type(j, '$.timestamp') as tt, j->>'$.timestamp' as tx from jx),
js as (select *, case when tt in ('UBIGINT', 'BIGINT', 'HUGEINT') or tt = 'VARCHAR' and regexp_full_match(tx, '[0-9]+') then try_cast(tx as hugeint) end as ts from jy),
j as (select *, case when j is null or json_type(j) <> 'OBJECT' then 'json' when mt is distinct from 'OBJECT' then 'meta'
 when json_type(j, '$.meta.id') is distinct from 'VARCHAR' or (j->>'$.meta.id') = '' then 'event_id' when json_type(j, '$.wiki') is distinct from 'VARCHAR' or (j->>'$.wiki') = '' then 'wiki'
 when json_type(j, '$.title') is distinct from 'VARCHAR' or (j->>'$.title') = '' then 'title' when json_type(j, '$.type') is distinct from 'VARCHAR' or (j->>'$.type') = '' then 'change_type'
 when not coalesce(ts between 978307200 and 2082758399, false) then 'timestamp' end as reason from js),
f as (select file, line_no, 'records' as kind, reason from c union all select file, line_no, 'events', reason from j union all select file, line_no, 'other', 'file' from l where not is_csv and not is_json)"""
_TEXT = "case when json_type(j, '{0}') = 'VARCHAR' then j->>'{0}' end"
_BIG = "case when json_type(j, '{0}') in ('UBIGINT', 'BIGINT') then try_cast(j->>'{0}' as bigint) end"
ORACLE = {
    "p1_found": f"{CLOCKED} select seq from l where late",
    "p1_updates": f"""{CLOCKED}, p as (select wiki, ts - ts % 3600 as period_start, batch_id, count(*) as n from l where not late group by all)
select wiki, period_start, batch_id, cast(row_number() over w as integer) as version, cast(sum(n) over w as bigint) as edits from p
window w as (partition by wiki, period_start order by batch_id)""",
    "p1_hourly": f"""{CLOCKED} select wiki, ts - ts % 3600 as period_start, max(batch_id) as batch_id, cast(count(distinct batch_id) as integer) as version,
count(*) as edits from l where not late group by 1, 2""",
    "p1_late_report": f"""{CLOCKED} select wiki, ts - ts % 3600 as period_start, count(*) as too_late, 0::bigint as unplaced,
max(clock - ts) as most_seconds_late from l where late group by 1, 2""",
    "p2_found": f"select seq from (select seq, row_number() over (partition by {ID} order by seq) as k from edits) where k > 1",
    "p2_kept": f"select * exclude (k) from (select *, row_number() over (partition by {ID} order by seq) as k from edits) where k = 1",
    "p4_found": f"{SESSIONS} select qid, session_start, session_end from r",
    "p4_sessions": f"{SESSIONS} select * from r",
    "p5_found": """select 'wiki' as field, wiki as key_value from edits group by wiki having count(*) >= 0.05 * (select count(*) from edits)
union all select 'qid', qid from propagation_records group by qid having count(*) >= 0.05 * (select count(*) from propagation_records)""",
    "p5_wiki_counts": """select wiki, count(*) as edits, cast(sum(bot::bigint) as bigint) as bot_edits, min(ts) as first_ts, max(ts) as last_ts
from edits group by wiki""",
    "p5_item_lags": """with o as (select qid, lag_seconds as v, row_number() over (partition by qid order by lag_seconds) as k,
count(*) over (partition by qid) as n from propagation_records where lag_seconds is not null)
select qid, max(n) as n, min(v) as low, max(v) as high, min(v) filter (k * 100 >= n * 50) as p50, min(v) filter (k * 100 >= n * 95) as p95
from o group by qid""",
    "p6_found": f"{_LINES} select file, line_no from f where reason is not null",
    "p6_reasons": f"{_LINES} select kind, reason, count(*) as lines from f group by 1, 2",
    "p6_records": f"""{_LINES} select file, line_no, qid, cast(rank as integer) as rank, leader_wiki, leader_title, cast(l_at as bigint) as leader_timestamp, follower_wiki, follower_title,
cast(f_at as bigint) as follower_timestamp, follower_user, cast(lag_seconds as bigint) as lag_seconds, cast(null as varchar) as beyond from c where reason is null""",
    "p6_events": f"""{_LINES} select file, line_no, j->>'$.meta.id' as event_id, j->>'$.wiki' as wiki, j->>'$.title' as title, j->>'$.type' as change_type, cast(ts as bigint) as ts,
{_BIG.format("$.namespace")} as namespace, coalesce(json_type(j, '$.bot') = 'BOOLEAN' and (j->>'$.bot') = 'true', false) as bot, {_TEXT.format("$.user")} as user_name,
{_TEXT.format("$.comment")} as edit_comment, {_BIG.format("$.revision.new")} as revision, {_BIG.format("$.length.old")} as length_old, {_BIG.format("$.length.new")} as length_new,
{_TEXT.format("$.meta.dt")} as stream_dt from j where reason is null""",
    "p5_records_with_windows": """select r.qid, r.rank, r.leader_wiki, r.follower_wiki, r.leader_timestamp, r.lag_seconds, w.windows, w.human_edits
from propagation_records r left join (select qid, count(*) as windows, cast(sum(human_edits) as bigint) as human_edits
from (select distinct * from item_windows) group by qid) w on r.qid = w.qid""",
}
