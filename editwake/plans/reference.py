"""Queries of the edit-propagation pipeline, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from editwake import config, session
from editwake.operators import edits as E
from editwake.operators import pairs as P
from editwake.operators import propagation as G
from editwake.operators import resolve as R
from editwake.operators import triage as T
from editwake.plans.problems import table


DIGESTED = ["qid", "rank", "leader_wiki", "leader_title", "leader_timestamp", "follower_wiki", "follower_title", "follower_timestamp", "follower_user", "lag_seconds"]


def _unique(spark, d):
    return E.unique(table(spark, d, "edits"), ["seq"])


def _cells(spark, d):
    return G.propagation_cells(_unique(spark, d))


def propagation_records(spark, d):
    return G.records(_cells(spark, d))


def propagation_windows(spark, d):
    return G.windows(_cells(spark, d)).drop("window")


def propagation_statistics(spark, d):
    return G.statistics(G.windows(_cells(spark, d)))


def reached_rank(spark, d):
    return G.reached_rank(G.windows(_cells(spark, d)))


def late_followups(spark, d):
    return G.windows(_cells(spark, d)).where("late_followup_edits > 0").select("qid", "opened_at", "late_followup_edits")


def lag_by_rank(spark, d):
    return G.lag_by_rank(G.records(_cells(spark, d)))


def lag_by_pair(spark, d):
    return G.lag_by_pair(G.records(_cells(spark, d)))


def edition_leadership(spark, d):
    return G.leadership(_cells(spark, d))


def join_peaks(spark, d):
    used = session.stage(G.with_item(_unique(spark, d)), "edits")
    return G.peaks(G.propagation_cells(used), G.in_time_order(used))


def processing_order(spark, d):
    return G.processing_order(G.with_item(_unique(spark, d))).select("seq", "ts", "released", "upto")


def out_of_order_count(spark, d):
    out = G.processing_order(G.with_item(_unique(spark, d)))
    return out.agg(F.count(F.when(F.col("ts") < F.col("upto"), 1)).alias("out_of_order"), F.count(F.lit(1)).alias("edits"))


def peak_reorder_buffer(spark, d):
    return G.peak_buffer(G.processing_order(G.with_item(_unique(spark, d))))


def propagation_as_arrived(spark, d):
    """Records of the stream as it arrived, through the reordering buffer, with all its disorder."""
    return G.records(G.propagation_cells(_unique(spark, d), in_order=False))


def statistics_as_arrived(spark, d):
    return G.statistics(G.windows(G.propagation_cells(_unique(spark, d), in_order=False)))


def run_digest(spark, d):
    """What must be the same whatever the cores and partitions: the number of records and the sum of their row hashes."""
    found = G.records(_cells(spark, d))
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in DIGESTED])
    number = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(20,0)")
    return found.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"))


def _event_lines(spark, d):
    return table(spark, d, "raw_lines").where(F.col("file").endswith(".jsonl.gz"))


def edits_typed(spark, d):
    return E.typed(_event_lines(spark, d)).where("reason is null").drop("reason")


def edits_drop_reasons(spark, d):
    return E.typed(_event_lines(spark, d)).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("events"))


def event_accounting(spark, d):
    return E.accounting(_event_lines(spark, d))


def edits_dedup(spark, d):
    return _unique(spark, d)


def edits_dedup_recent(spark, d):
    """Repeats dropped by a memory of the last kept identifiers, as wide as the settings say."""
    return E.unique_recent(table(spark, d, "edits")).select("event_id", "wiki", "title", "ts", "seq")


def capture_filter(spark, d):
    return E.captured(_event_lines(spark, d)).drop("text")


def hourly_buckets(spark, d):
    return E.hourly(_event_lines(spark, d))


def archive_stats(spark, d):
    return E.coverage(_event_lines(spark, d))


def minute_gaps(spark, d):
    return E.minute_gaps(_event_lines(spark, d))


def partition_union_ordered(spark, d):
    """Lines of all files with their place in the replay, files in order of name."""
    return P.positioned(table(spark, d, "raw_lines").select("file", "line_no"), ["file", "line_no"])


def resolve_left(spark, d):
    edits = table(spark, d, "edits").select("seq", "wiki", "title")
    return R.resolved(edits, table(spark, d, "resolutions"))


def resolve_unresolved(spark, d):
    return R.unresolved(table(spark, d, "edits"), table(spark, d, "resolutions"))


def resolver_counters(spark, d):
    return R.counters(_unique(spark, d), table(spark, d, "resolutions"))


def edits_with_item(spark, d):
    return R.with_item_rate(_unique(spark, d))


def resolution_upsert(spark, d):
    seen = table(spark, d, "edits").where("qid is not null").groupBy("wiki", "title").agg(F.max(F.struct("seq", "qid")).alias("x"))
    return R.upsert(table(spark, d, "resolutions"), seen.select("wiki", "title", "x.qid", F.col("x.seq").alias("version")))


def snapshot_size(spark, d):
    return table(spark, d, "resolutions").agg(F.count(F.lit(1)).alias("pages"), F.count("qid").alias("with_item"))


def page_universe(spark, d):
    return P.pages(table(spark, d, "edits"))


def naive_pairs(spark, d):
    return P.naive_pairs(page_universe(spark, d))


def item_pairs(spark, d):
    return P.item_pairs(page_universe(spark, d))


def pair_strata(spark, d):
    return P.stratified(page_universe(spark, d))


def pair_strata_sizes(spark, d):
    return P.strata_sizes(page_universe(spark, d))


def pair_allocation(spark, d):
    return P.allocation(page_universe(spark, d))


def stratified_sample(spark, d):
    return P.labelling_sample(page_universe(spark, d))


def page_urls(spark, d):
    return page_universe(spark, d).select("wiki", "title", P.page_url(F.col("wiki"), F.col("title")).alias("url"))


def label_evaluation(spark, d):
    """Scores from labels given to every pair by a fixed rule on the length of its first title."""
    pairs = P.stratified(page_universe(spark, d)).withColumn("pair_id", F.concat_ws("|", *P.PAIR))
    word = F.element_at(F.array(F.lit("yes"), F.lit(" N "), F.lit("")), (F.length("title_a") % 3 + 1).cast("int"))
    return P.evaluation(pairs.select("pair_id", word.alias("same_subject")), pairs.select("pair_id", "stratum"), P.strata_sizes(page_universe(spark, d)))


def _evidence(spark, d):
    return T.first_evidence(table(spark, d, "edit_evidence"), T.EVIDENCE)


def _judged(spark, d):
    return T.suggested(T.with_evidence(table(spark, d, "propagation_records"), _evidence(spark, d)))


def evidence_lookup(spark, d):
    out = T.with_evidence(table(spark, d, "propagation_records"), _evidence(spark, d))
    return out.select(
        "qid", "rank", "leader_timestamp", "follower_timestamp", F.col("leader.user_name").alias("leader_user"), F.col("leader.bytes_changed").alias("leader_bytes"),
        F.coalesce("follower.user_name", "follower_user").alias("follower_user"), F.col("follower.bytes_changed").alias("follower_bytes"),
    )


def evidence_of_lines(spark, d):
    lines = T.evidence_of_lines(_event_lines(spark, d))
    return T.first_evidence(lines, ["file", "line_no"])


def triage_category(spark, d):
    return _judged(spark, d).select("qid", "rank", "leader_timestamp", "follower_timestamp", "suggested_category", "evidence")


def triage_of_run(spark, d):
    """Suggestions for the records that this run found in the edits, whose evidence is there for a fifth of them."""
    found = T.suggested(T.with_evidence(propagation_records(spark, d), _evidence(spark, d)))
    return found.select("qid", "rank", "leader_timestamp", "follower_timestamp", "suggested_category", "evidence")


def triage_counts(spark, d):
    return _judged(spark, d).groupBy("suggested_category").agg(F.count(F.lit(1)).alias("records"))


def review_sample(spark, d):
    return T.review_sheet(T.review_sample(table(spark, d, "propagation_records")), _evidence(spark, d))


def _answered(sheet):
    wrong = F.element_at(F.array(F.lit("y"), F.lit("no"), F.lit("")), (F.pmod(F.coalesce("lag_seconds", F.lit(0)), F.lit(3)) + 1).cast("int"))
    own = F.when(F.pmod(F.coalesce("lag_seconds", F.lit(0)), F.lit(6)) == 0, " same_editor ").otherwise("")
    return sheet.withColumn("confirmed_wrong", wrong).withColumn("category", own)


def review_summary(spark, d):
    """Summary of the drawn sheet, its answers filled in by a fixed rule."""
    return T.review_summary(_answered(review_sample(spark, d)))


def review_agreement(spark, d):
    return T.review_agreement(_answered(_judged(spark, d)))


_NAMED = (
    propagation_records, propagation_windows, propagation_statistics, reached_rank, late_followups, lag_by_rank, lag_by_pair, edition_leadership,
    join_peaks, processing_order, out_of_order_count, peak_reorder_buffer, propagation_as_arrived, statistics_as_arrived, run_digest, edits_typed,
    edits_drop_reasons, event_accounting, edits_dedup, edits_dedup_recent, capture_filter, hourly_buckets, archive_stats, minute_gaps, partition_union_ordered, resolve_left,
    resolve_unresolved, resolver_counters, edits_with_item, resolution_upsert, snapshot_size, page_universe, naive_pairs, item_pairs, pair_strata,
    pair_strata_sizes, pair_allocation, stratified_sample, page_urls, label_evaluation, evidence_lookup, evidence_of_lines, triage_category,
    triage_of_run, triage_counts, review_sample, review_summary, review_agreement,
)
QUERIES = {f.__name__: f for f in _NAMED}

# --- SQL ------------------------------------------------------------------------------------------------------------

_U = "u as (select * exclude (k) from (select *, row_number() over (partition by event_id order by seq) as k from edits) where k = 1)"
_FOLD = f"""with recursive {_U},
e as (select qid as q, wiki as w, title, ts as t, bot, user_name, seq from u where qid is not null), gt as (select distinct t from e),
c as (select e.*, gt.t as close_at from e asof left join gt on e.t + 21600 <= gt.t),
m as (select q, t, min(seq) as seq from e group by all),
n as (select c.*, m.seq as nxt from c asof left join m on c.q = m.q and c.close_at + 86400 <= m.t),
f as (select q, arg_min(seq, (t, seq)) as seq from e group by 1),
o as (select n.* from n join f using (q, seq) union all select n.* from o join n on o.nxt = n.seq),
a as (select e.*, o.t as o, o.close_at, e.t >= o.t + 21600 as late from e asof join o on e.q = o.q and e.t >= o.t),
h as (select *, row_number() over (partition by q, o, w order by t, seq) as k from a where not late and not bot),
r as (select q, o, w, t, title, user_name, close_at, row_number() over x as rnk, first_value(w) over x as lw, first_value(title) over x as lt, first_value(t) over x as l,
 count(*) over (partition by q, o) as eds from h where k = 1 window x as (partition by q, o order by t, seq)),
s as (select min(t) + 21600 as warm from e),
rec as (select q as qid, cast(rnk as integer) as rank, lw as leader_wiki, lt as leader_title, l as leader_timestamp, w as follower_wiki, title as follower_title, t as follower_timestamp,
 user_name as follower_user, t - l as lag_seconds from r, s where rnk in (2, 3, 5) and o >= warm),
lt as (select q, o, count(*) as n from a where late and not bot and not exists (select 1 from h where h.q = a.q and h.o = a.o and h.w = a.w) group by all),
win as (select a.q as qid, a.o as opened_at, any_value(a.close_at) as closed_at, a.o < any_value(warm) as in_warmup, count(distinct w) filter (not late) as all_editions,
 count(distinct w) filter (not late and not bot) as human_editions, count(*) filter (not late and not bot) as human_edits, count(*) filter (not late and bot) as bot_edits,
 coalesce(any_value(lt.n), 0) as late_followup_edits from a cross join s left join lt on a.q = lt.q and a.o = lt.o group by a.q, a.o),
rated as (select * from win where closed_at is not null and not in_warmup and human_editions > 0)"""


def _nearest(keys: str, source: str, value: str = "lag_seconds") -> str:
    at = lambda f: f"list_extract(list_sort(list({value})), cast(greatest(1, least(count({value}), round_even({f}::double * count({value}), 0))) as integer))"
    return f"select {keys}, count({value}) as n, {at(0.5)} as median_seconds, {at(0.95)} as p95_seconds from {source} where {value} is not null group by {keys}"


_JSON = r"""with j as (select file, line_no, member, damaged, text, case when json_valid(text)
 and not regexp_matches(regexp_replace(text, '"(\\.|[^"\\])*"', '""', 'g'), ',\s*[}\]]') then text::json end as j from raw_lines where file like '%.jsonl.gz'),
x as (select *, json_type(j, '$.timestamp') as tt, trim(j->>'$.timestamp') as tx, json_type(j, '$.bot') as bt, json_type(j, '$.revision') as rt from j where j is not null),
t as (select *, case when tt = 'VARCHAR' then case when regexp_full_match(tx, '[+-]?[0-9]+(_[0-9]+)*') then try_cast(replace(tx, '_', '') as bigint) end
 when tt = 'BOOLEAN' then (tx = 'true')::bigint when tt in ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') then try_cast(trunc(try_cast(tx as double)) as bigint) end as ts,
 case when bt = 'BOOLEAN' then (j->>'$.bot') = 'true' when bt = 'VARCHAR' then length(j->>'$.bot') > 0 when bt in ('UBIGINT', 'BIGINT', 'DOUBLE') then (j->>'$.bot')::double <> 0
 when bt in ('OBJECT', 'ARRAY') then (j->>'$.bot') not in ('{}', '[]') else false end as bot from x),
y as (select *, case when json_type(j, '$.meta.id') is null or json_type(j, '$.wiki') is null or json_type(j, '$.title') is null or json_type(j, '$.type') is null or ts is null then 'malformed'
 when (j->>'$.wiki') is null or (j->>'$.wiki') not in (select unnest(__EDITIONS__)) then 'wiki'
 when coalesce(try_cast(j->>'$.namespace' as double), -1) <> 0 then 'namespace' when coalesce(j->>'$.type', 'None') not in ('edit', 'new') then 'type:' || coalesce(j->>'$.type', 'None') end as reason from t)""".replace("__EDITIONS__", str(list(config.EDITIONS)))
_DT = "try_cast(j->>'$.meta.dt' as timestamptz) at time zone 'UTC'"
_PAGES = """with p as (select wiki, title, arg_max(q, seq).q as qid from (select wiki, title, seq, {'q': qid} as q from edits where not bot) group by 1, 2),
np as (select a.wiki as wiki_a, a.title as title_a, b.wiki as wiki_b, b.title as title_b from p a join p b on a.title = b.title and a.wiki < b.wiki),
ip as (select a.wiki as wiki_a, a.title as title_a, b.wiki as wiki_b, b.title as title_b from p a join p b on a.qid = b.qid and a.wiki < b.wiki),
st as (select *, 'both' as stratum from (select * from np intersect select * from ip) union all select *, 'naive_only' from (select * from np except select * from ip)
 union all select *, 'wikidata_only' from (select * from ip except select * from np)),
sz as (select stratum, count(st.wiki_a) as pairs from (select unnest(['both', 'naive_only', 'wikidata_only']) as stratum) left join st using (stratum) group by 1)"""
_EV = """ev as (select * exclude (k) from (select *, row_number() over (partition by wiki, title, ts order by user_name nulls first, edit_comment nulls first, bytes_changed nulls first,
 bot nulls first, stream_skew_seconds nulls first) as k from edit_evidence) where k = 1),
jr as (select r.*, l.user_name as lu, l.edit_comment as lc, l.bytes_changed as lb, l.bot as lbot, l.stream_skew_seconds as ls, l.wiki is not null as lf,
 f.user_name as fu, f.edit_comment as fc, f.bytes_changed as fb, f.bot as fbot, f.stream_skew_seconds as fs, f.wiki is not null as ff from propagation_records r
 left join ev l on l.wiki = leader_wiki and l.title = leader_title and l.ts = leader_timestamp left join ev f on f.wiki = follower_wiki and f.title = follower_title and f.ts = follower_timestamp)"""
_REVERT = r"(?i)\brevert|\bundid\b|\brv\b|rückgängig|annul|отмен|deshecha|revertid|取り消し|撤销|되돌림"
_MARKS = "['(disambiguation)', '(desambiguación)', '(homonymie)', '(Begriffsklärung)', '(disambigua)', '(значения)', '(曖昧さ回避)', '(消歧义)']"


def _repr(x: str) -> str:
    return f"""(case when contains({x}, '''') and not contains({x}, '"') then '"' || replace({x}, '\\', '\\\\') || '"' else '''' || replace(replace({x}, '\\', '\\\\'), '''', '\\''') || '''' end)"""


_RULES = [
    ("bot_slipped_filter", "lf and not coalesce(lbot, false) and regexp_matches(coalesce(lu, ''), '(?i)bot\\b')", f"'leader user ' || {_repr('lu')}"),
    ("bot_slipped_filter", "ff and not coalesce(fbot, false) and regexp_matches(coalesce(fu, ''), '(?i)bot\\b')", f"'follower user ' || {_repr('fu')}"),
    ("revert_or_vandalism", f"lf and regexp_matches(coalesce(lc, ''), '{_REVERT}')", f"'leader comment ' || {_repr('substring(lc, 1, 80)')}"),
    ("revert_or_vandalism", f"ff and regexp_matches(coalesce(fc, ''), '{_REVERT}')", f"'follower comment ' || {_repr('substring(fc, 1, 80)')}"),
    ("disambiguation", f"list_bool_or(list_transform({_MARKS}, lambda m: contains(leader_title, m)))", f"'leader title ' || {_repr('leader_title')}"),
    ("disambiguation", f"list_bool_or(list_transform({_MARKS}, lambda m: contains(follower_title, m)))", f"'follower title ' || {_repr('follower_title')}"),
    ("trivial_maintenance", "abs(lb) <= 10 and abs(fb) <= 10", "'size changes ' || format('{:+d} / {:+d} bytes', lb, fb)"),
    ("out_of_order", "abs(ls) > 120", "'leader stream skew ' || cast(round_even(ls, 0) as bigint) || 's'"),
    ("out_of_order", "abs(fs) > 120", "'follower stream skew ' || cast(round_even(fs, 0) as bigint) || 's'"),
    ("same_editor", "lf and ff and lu <> '' and lu = fu", f"'user ' || {_repr('lu')} || ' made both edits'"),
]
_SUGGEST = (
    "tr as (select *, case " + " ".join(f"when {c} then '{n}'" for n, c, _ in _RULES) + " else 'needs_review' end as suggested_category, case "
    + " ".join(f"when {c} then {w}" for _, c, w in _RULES) + " else '' end as evidence from jr)"
)
_CLOCK = f"""with {_U}, e as (select seq, ts from u where qid is not null),
k as (select *, max(ts) over (order by seq rows between unbounded preceding and 1 preceding) as before from e),
steps as (select ts, min(seq) as at from k where before is null or ts > before group by ts),
z as (select e.seq, e.ts, greatest(e.seq, coalesce(steps.at, (select max(seq) + 1 from e))) as released from e asof left join steps on e.ts + 120 <= steps.ts),
po as (select *, max(ts) over (order by released, ts, seq rows unbounded preceding) as upto from z)"""

ORACLE = {
    "propagation_records": f"{_FOLD} select * from rec",
    "propagation_windows": f"{_FOLD} select * from win",
    "propagation_statistics": f"""{_FOLD}, b as (select count(*) as windows_opened, count(*) filter (in_warmup) as warmup_windows, count(closed_at) as windows_closed,
 count(*) - count(closed_at) as windows_open_at_end, (select count(*) from rated) as closed_with_human_edit, count(*) filter (closed_at is not null and all_editions >= 2) as cross_edition_items,
 cast(coalesce(sum(human_edits) filter (closed_at is not null and all_editions >= 2), 0) as bigint) as cross_edition_human_edits,
 cast(coalesce(sum(bot_edits) filter (closed_at is not null and all_editions >= 2), 0) as bigint) as cross_edition_bot_edits,
 count(*) filter (late_followup_edits > 0) as late_followup_items, cast(sum(late_followup_edits) as bigint) as late_followup_edits,
 (select count(*) from rated where late_followup_edits > 0) as rated_late_items, (select count(*) from rated where human_editions >= 2) as reached_second from win)
select *, round_even(cross_edition_bot_edits / nullif(cross_edition_bot_edits + cross_edition_human_edits, 0), 4) as bot_share,
 round_even(late_followup_items / nullif(closed_with_human_edit, 0), 4) as late_followup_rate, round_even(rated_late_items / nullif(closed_with_human_edit, 0), 4) as corrected_late_followup_rate,
 round_even((closed_with_human_edit - reached_second) / nullif(closed_with_human_edit, 0), 4) as never_propagated from b""",
    "reached_rank": f"""{_FOLD} select cast(rank as integer) as rank, (select count(*) from win where closed_at is not null and not in_warmup and human_editions >= rank) as windows
from (select unnest([2, 3, 5]) as rank)""",
    "late_followups": f"{_FOLD} select qid, opened_at, late_followup_edits from win where late_followup_edits > 0",
    "lag_by_rank": f"{_FOLD} {_nearest('rank', 'rec')}",
    "lag_by_pair": f"{_FOLD} {_nearest('leader_wiki, follower_wiki', 'rec')} having count(*) >= 20",
    "edition_leadership": f"""{_FOLD}, v as (select w as wiki, rnk, eds, case when rnk > 1 then t - l end as lag from r, s where close_at is not null and o >= warm and eds >= 2),
b as (select wiki, count(*) as windows, count(*) filter (rnk = 1) as leads, sum((1.0::double / eds)::decimal(38, 18))::double as expected,
 sum(((rnk - 1)::double / (eds - 1))::decimal(38, 18))::double as position from v group by 1 having count(*) >= 20), g as ({_nearest('wiki', 'v', 'lag')})
select wiki, windows, leads, round_even(leads / windows, 4) as lead_rate, round_even(expected / windows, 4) as expected_lead_rate, round_even(leads / expected, 3) as lead_lift,
 round_even(position / windows, 4) as mean_position, median_seconds as median_follow_lag_seconds from b left join g using (wiki)""",
    "join_peaks": f"""{_FOLD}, w2 as (select win.*, gt.t as gone from win asof left join gt on win.closed_at + 86400 <= gt.t),
mv as (select opened_at as s, 1 as x, 0 as y from w2 union all select closed_at, -1, 1 from w2 where closed_at is not null union all select gone + 1, 0, -1 from w2 where gone is not null),
cm as (select sum(sum(x)) over (order by s) as x, sum(sum(y)) over (order by s) as y from mv group by s)
select cast(max(x) as bigint) as peak_open_windows, cast(max(y) as bigint) as peak_closed_remembered from cm""",
    "processing_order": f"{_CLOCK} select * from po",
    "out_of_order_count": f"{_CLOCK} select count(*) filter (ts < upto) as out_of_order, count(*) as edits from po",
    "peak_reorder_buffer": f"""{_CLOCK}, mv as (select seq as s, 1 as m from po union all select released + 1, -1 from po),
c as (select sum(sum(m)) over (order by s) as held from mv group by s) select cast(max(held) as bigint) as peak_reorder_buffer from c""",
    "run_digest": f"""{_FOLD} select count(*) as records, cast(coalesce(sum(('0x' || md5(concat_ws('|', {", ".join(f"coalesce(cast({c} as varchar), '-')" for c in DIGESTED)}))[1:15])::bigint), 0) as varchar) as digest from rec""",
    "edits_dedup_recent": f"""with recursive o as (select event_id, seq, row_number() over (order by seq) - 1 as b from edits where event_id is not null),
r as (select *, row_number() over (order by seq) as k from o where event_id in (select event_id from o group by 1 having count(*) > 1)),
s as (select cast(0 as bigint) as k, cast(0 as bigint) as gone, cast(null as bigint) as seq, false as again, cast(map([], []) as map(varchar, bigint)) as m
 union all select x.k, x.gone + x.again::bigint, x.seq, x.again, case when x.again then x.m else map_concat(x.m, map([x.event_id], [x.n + 1])) end from
 (select r.k, s.gone, r.seq, r.event_id, s.m, r.b - s.gone as n, coalesce(r.b - s.gone - s.m[r.event_id] < {config.DEFAULT.filters.dedupe_window}, false) as again from s join r on r.k = s.k + 1) x)
select event_id, wiki, title, ts, seq from edits where seq not in (select seq from s where again)""",
    "edits_typed": f"""{_JSON} select file, line_no, j->>'$.meta.id' as event_id, j->>'$.wiki' as wiki, j->>'$.title' as title, ts, bot, j->>'$.type' as change_type,
case when json_type(j, '$.user') is null then '' else j->>'$.user' end as user_name, try_cast(j->>'$.revision.new' as bigint) as revision from y where reason is null""",
    "edits_drop_reasons": f"{_JSON} select reason, count(*) as events from y where reason is not null group by 1",
    "event_accounting": f"""{_JSON}, kp as (select count(distinct j->>'$.meta.id') as d, count(*) as n, count(j->>'$.meta.id') as m from y where reason is null)
select 'undecodable' as outcome, count(*) as events from j where j is null union all select reason, count(*) from y where reason is not null group by 1
union all select 'kept', d + n - m from kp union all select 'duplicate', m - d from kp""",
    "edits_dedup": f"with {_U} select * from u",
    "capture_filter": f"""{_JSON} select file, line_no, strftime({_DT}, '%Y-%m-%d-%H') as hour from y where coalesce(try_cast(j->>'$.namespace' as double), -1) = 0
and (j->>'$.wiki') in (select distinct wiki from edits)""",
    "hourly_buckets": f"""{_JSON} select strftime({_DT}, '%Y-%m-%d-%H') as hour, count(*) as events from y where coalesce(try_cast(j->>'$.namespace' as double), -1) = 0
and (j->>'$.wiki') in (select distinct wiki from edits) group by 1""",
    "archive_stats": f"""{_JSON}, m as (select date_trunc('minute', {_DT}) as m, * from j)
select count(distinct file) as files, count(j) as events, count(*) - count(j) as undecodable, coalesce(round_even((count(*) - count(j)) / nullif(count(*), 0), 6), 0.0) as undecodable_rate,
count(distinct (file, member)) filter (damaged) as damaged_members, strftime(min(m), '%Y-%m-%dT%H:%M:%S') || '+00:00' as first_event, strftime(max(m), '%Y-%m-%dT%H:%M:%S') || '+00:00' as last_event from m""",
    "minute_gaps": f"""{_JSON}, m as (select distinct cast(epoch(date_trunc('minute', {_DT})) as bigint) as m from j where j is not null), g as (select m, lag(m) over (order by m) as p from m where m is not null)
select p + 60 as gap_start, m - 60 as gap_end, (m - p) // 60 - 1 as minutes from g where m - p > 60""",
    "partition_union_ordered": "select file, line_no, row_number() over (order by file, line_no) - 1 as position from raw_lines",
    "resolve_left": "select e.seq, e.wiki, e.title, r.qid, r.wiki is not null as found from edits e left join resolutions r on e.wiki = r.wiki and e.title = r.title",
    "resolve_unresolved": """select wiki, title, count(*) as edits from edits e where not exists (select 1 from resolutions r where r.wiki = e.wiki and r.title = e.title) group by 1, 2""",
    "resolver_counters": f"""with {_U}, b as (select wiki, title, (row_number() over (order by seq) - 1) // 5000 as block from u),
p as (select wiki, title, block, count(*) as n, min(block) over (partition by wiki, title) as first from b group by 1, 2, 3),
k as (select p.*, r.wiki is not null as known, r.qid from p left join resolutions r on p.wiki = r.wiki and p.title = r.title)
select cast(sum(n) as bigint) as "references", cast(coalesce(sum(n) filter (known and block > first), 0) as bigint) as cache_hits,
cast(coalesce(sum(n) filter (known and block > first and qid is null), 0) as bigint) as negative_cache_hits, cast(coalesce(sum(n - 1) filter (not known or block = first), 0) as bigint) as coalesced,
count(*) filter (known and block = first) as store_hits, count(*) filter (not known) as offline_unresolved, count(*) filter (known and block = first and qid is not null) as keys_with_item,
count(*) filter (known and block = first and qid is null) as keys_without_item, round_even(coalesce(sum(n) filter (known and block > first), 0) / sum(n), 4) as cache_hit_rate from k""",
    "edits_with_item": f"with {_U} select count(*) as edits, count(qid) as with_item, round_even(count(qid) / count(*), 4) as rate from u",
    "resolution_upsert": """with n as (select wiki, title, arg_max(qid, seq) as qid from edits where qid is not null group by 1, 2)
select coalesce(n.wiki, r.wiki) as wiki, coalesce(n.title, r.title) as title, case when n.wiki is not null then n.qid else r.qid end as qid from resolutions r full join n on n.wiki = r.wiki and n.title = r.title""",
    "snapshot_size": "select count(*) as pages, count(qid) as with_item from resolutions",
    "page_universe": f"{_PAGES} select * from p",
    "naive_pairs": f"{_PAGES} select * from np",
    "item_pairs": f"{_PAGES} select * from ip",
    "pair_strata": f"{_PAGES} select * from st",
    "pair_strata_sizes": f"{_PAGES} select * from sz",
    "pair_allocation": f"""{_PAGES}, o as (select *, row_number() over (order by pairs, stratum) as k from sz),
a1 as (select greatest(0, min(pairs) filter (k = 1)) as s1, min(pairs) filter (k = 2) as s2, min(pairs) filter (k = 3) as s3, count(*) filter (pairs > 0) as c from o),
t1 as (select *, case when s1 > 0 then least(s1, 200 // c) else 0 end as x1 from a1), t2 as (select *, case when s2 > 0 then least(s2, (200 - x1) // 2) else 0 end as x2 from t1),
t3 as (select *, least(s3, 200 - x1 - x2) as x3 from t2)
select stratum, pairs, cast(case k when 1 then x1 when 2 then x2 else x3 end as bigint) as sampled from o, t3""",
    "page_urls": rf"""{_PAGES} select wiki, title, 'https://' || replace(regexp_replace(wiki, 'wiki$', ''), '_', '-') || '.wikipedia.org/wiki/' ||
replace(url_encode(replace(title, ' ', '_')), '%2F', '/') as url from p""",
    "label_evaluation": f"""{_PAGES}, lb as (select stratum, case length(title_a) % 3 when 0 then true when 1 then false end as label from st),
g as (select count(label) as labelled, count(*) - count(label) as unlabelled, {", ".join(f"count(label) filter (stratum = '{s}') as labelled_{s}" for s in P.STRATA)},
 {", ".join(f"count(*) filter (label and stratum = '{s}') as true_{s}" for s in P.STRATA)}, {", ".join(f"(select pairs from sz where stratum = '{s}') as size_{s}" for s in P.STRATA)} from lb),
q as (select *, {", ".join(f"true_{s} / nullif(labelled_{s}, 0) * size_{s} as e_{s}" for s in P.STRATA)} from g), z as (select *, e_both + e_naive_only + e_wikidata_only as pooled from q)
select labelled, unlabelled, {", ".join(f"labelled_{s}, true_{s}, round_even(e_{s}, 1) as estimated_{s}" for s in P.STRATA)},
 {", ".join(f'''case when pooled is not null then size_both + size_{s} end as {n}_pairs, case when pooled is not null then round_even(e_both + e_{s}, 1) end as {n}_true_pairs,
 case when pooled is not null then round_even((e_both + e_{s}) / nullif(size_both + size_{s}, 0), 4) end as {n}_precision, round_even((e_both + e_{s}) / nullif(pooled, 0), 4) as {n}_recall'''
 for n, s in (("naive", "naive_only"), ("wikidata", "wikidata_only")))},
 round_even(e_wikidata_only, 1) as missed_by_naive, round_even(e_wikidata_only / nullif(pooled, 0), 4) as share_missed_by_naive from z""",
    "evidence_lookup": f"""with {_EV} select qid, rank, leader_timestamp, follower_timestamp, lu as leader_user, lb as leader_bytes, coalesce(fu, follower_user) as follower_user, fb as follower_bytes from jr""",
    "evidence_of_lines": f"""{_JSON}, e as (select file, line_no, j->>'$.wiki' as wiki, j->>'$.title' as title, ts, coalesce(j->>'$.user', '') as user_name,
coalesce(j->>'$.comment', '') as edit_comment, try_cast(j->>'$.length.old' as bigint) as a, try_cast(j->>'$.length.new' as bigint) as b, bot,
epoch_us(try_cast(j->>'$.meta.dt' as timestamptz)) / 1e6::double - ts as stream_skew_seconds from t where json_type(j, '$.wiki') is not null and json_type(j, '$.title') is not null and ts is not null)
select wiki, title, ts, user_name, edit_comment, case when b is not null then case when coalesce(a, 0) <> 0 then b - a else b end end as bytes_changed, bot, stream_skew_seconds
from (select *, row_number() over (partition by wiki, title, ts order by file, line_no) as k from e) where k = 1""",
    "triage_category": f"with {_EV}, {_SUGGEST} select qid, rank, leader_timestamp, follower_timestamp, suggested_category, evidence from tr",
    "triage_of_run": f"""{_FOLD}, {_EV.replace('propagation_records', 'rec')}, {_SUGGEST} select qid, rank, leader_timestamp, follower_timestamp, suggested_category, evidence from tr""",
    "triage_counts": f"with {_EV}, {_SUGGEST} select suggested_category, count(*) as records from tr group by 1",
    "review_agreement": f"""with {_EV}, {_SUGGEST}, an as (select suggested_category, ((coalesce(lag_seconds, 0) % 3) + 3) % 3 as w, (((coalesce(lag_seconds, 0) % 6) + 6) % 6) = 0 as own from tr)
select count(*) as candidates, count(*) filter (w < 2) as reviewed, count(*) filter (w = 0) as confirmed_wrong,
round_even(count(*) filter (w = 0 and (not own or suggested_category = 'same_editor')) / nullif(count(*) filter (w = 0), 0), 4) as heuristic_agreement from an""",
}
