"""Queries for problems 3, 7, 8, 9 and 10, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from editwake import session
from editwake.llm import leftovers, mixing, packing, quantiles, tokens, topk

PERCENTS = [5, 25, 50, 75, 95, 99]
GROUPS = ["leader_wiki", "follower_wiki", "rank"]
SHARE = 0.006


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _day():
    return F.date_format(F.timestamp_seconds("leader_timestamp"), "yyyy-MM-dd").alias("day")


def _lags(spark, d):
    return _table(spark, d, "propagation_records").select(*GROUPS, "lag_seconds", _day())


def p3_percentiles(spark, d):
    return quantiles.percentiles(_lags(spark, d), GROUPS, "lag_seconds", PERCENTS).drop("rounds")


def p3_daily(spark, d):
    return quantiles.percentiles(_lags(spark, d), [*GROUPS, "day"], "lag_seconds", PERCENTS).drop("rounds")


def p3_combined(spark, d):
    """All days from the mergeable summaries of single days."""
    parts = quantiles.summary(_lags(spark, d), GROUPS, "lag_seconds", part="day")
    return quantiles.select_percentiles(parts, GROUPS, PERCENTS).drop("rounds")


def p3_within_one_percent(spark, d):
    """Percentiles from summaries of bounded size, each held against the exact one: within_bound says it lies within 1 %."""
    parts = quantiles.summary(_lags(spark, d), GROUPS, "lag_seconds", part="day", relative_error=0.01)
    near = quantiles.select_percentiles(parts, GROUPS, PERCENTS).select(*[F.col(c).alias(f"_{c}") for c in GROUPS], F.col("percent").alias("_percent"), F.col("value").alias("near"), F.col("n").alias("near_n"))
    exact = p3_percentiles(spark, d)
    on = F.lit(True)
    for c in [*GROUPS, "percent"]:
        on = on & exact[c].eqNullSafe(F.col(f"_{c}"))
    within = (F.abs(F.col("near") - F.col("value")) <= 0.01 * F.abs("value") + 1e-9) & (F.col("n") == F.col("near_n"))
    return exact.join(near, on, "left").select(*GROUPS, "percent", "n", "value", F.coalesce(within, F.lit(False)).alias("within_bound"))


def p7_found(spark, d):
    found = [
        topk.frequent_share(_table(spark, d, name).select(column), column, SHARE).select(F.lit(column).alias("field"), F.col("value").alias("key_value"))
        for name, column in (("edits", "title"), ("propagation_records", "qid"))
    ]
    return found[0].unionByName(found[1])


def p7_top_titles(spark, d):
    return topk.frequent(_table(spark, d, "edits").select("title"), "title", 100)


def p7_top_items(spark, d):
    return topk.frequent(_table(spark, d, "propagation_records").select("qid"), "qid", 100)


def _sized(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "source", F.xxhash64("text").alias("cluster"), "text")
    return tokens.with_tokens(docs)


def p8_packed(spark, d):
    return packing.pack(_sized(spark, d), _table(spark, d, "pack_sizes"))


def p8_fill(spark, d):
    return packing.fill(p8_packed(spark, d))


def p8_checked(spark, d):
    """Every text placed whole, none cut without need, no container overfull, no copies together."""
    items = session.stage(_sized(spark, d), "sized")
    sizes = _table(spark, d, "pack_sizes")
    return packing.checked(session.stage(packing.pack(items, sizes), "packed"), items, sizes)


def _rows(spark, d):
    docs = tokens.with_tokens(_table(spark, d, "documents").select("doc_id", "source", "text"))
    return mixing.used_rows(docs, _table(spark, d, "mix_targets"))


def p9_mixed(spark, d):
    rows = _rows(spark, d)
    return mixing.mix(rows, mixing.budgets(rows, _table(spark, d, "mix_targets")))


def _shares(spark, d, exact):
    rows, targets = _rows(spark, d), _table(spark, d, "mix_targets")
    budget = mixing.budgets(rows, targets, exact=exact)
    return mixing.shares(mixing.mix(rows, budget), targets, budget)


def p9_shares(spark, d):
    return _shares(spark, d, True)


def p9_tempered(spark, d):
    """What one exponent on the token shares gives, bisected to the entropy of the targets, without correction."""
    return _shares(spark, d, False)


def p9_checked(spark, d):
    """Budgets met to less than a document, repeats within their limits."""
    return p9_shares(spark, d).select("source", "target_share", "max_repeats", "met", "within_repeats")


def _judged(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "wiki", "qid", "text")
    titles = _table(spark, d, "resolutions").select(F.col("wiki").alias("host"), F.col("qid").alias("page"), "title")
    return leftovers.judged(docs, page="qid", titles=titles)


def p10_found(spark, d):
    return _judged(spark, d).where("leftover").select("doc_id")


def p10_kinds(spark, d):
    """Documents per kind of leftover; a document with several kinds counts for each."""
    return _judged(spark, d).where("leftover").select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("documents"))


def p10_kept(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "wiki", "qid", "source", "lang", "text")
    titles = _table(spark, d, "resolutions").select(F.col("wiki").alias("host"), F.col("qid").alias("page"), "title")
    return leftovers.without_leftovers(docs, page="qid", titles=titles)


QUERIES = {f.__name__: f for f in (
    p3_percentiles, p3_daily, p3_combined, p3_within_one_percent, p7_found, p7_top_titles, p7_top_items, p8_packed, p8_fill, p8_checked, p9_mixed, p9_shares, p9_tempered, p9_checked,
    p10_found, p10_kinds, p10_kept,
)}


def _percentile_sql(groups: str) -> str:
    return f"""with o as (select *, strftime(make_timestamp(leader_timestamp * 1000000), '%Y-%m-%d') as day from propagation_records where lag_seconds is not null),
k as (select {groups}, lag_seconds, row_number() over w as r, count(*) over (partition by {groups}) as n from o window w as (partition by {groups} order by lag_seconds))
select {groups}, p::double as percent, min(lag_seconds) filter (r * 100 >= p * n) as value, max(n) as n
from k, (select unnest([5, 25, 50, 75, 95, 99]) as p) group by {groups}, p"""


_ALL = ", ".join(GROUPS)
_TOP = """with c as (select {0} as value, count(*) as n from {1} where {0} is not null group by 1)
select value, n from c where n >= (select min(n) from (select n from c order by n desc limit 100))"""
ORACLE = {
    "p3_percentiles": _percentile_sql(_ALL),
    "p3_daily": _percentile_sql(_ALL + ", day"),
    "p3_combined": _percentile_sql(_ALL),
    "p3_within_one_percent": f"select *, true as within_bound from ({_percentile_sql(_ALL)})",
    "p8_checked": """select pack_name, capacity_tokens, count(distinct doc_id) as placed, cast(0 as bigint) as lost, cast(0 as bigint) as torn, cast(0 as bigint) as overfull,
cast(0 as bigint) as clashes from documents, pack_sizes where text <> '' group by 1, 2""",
    "p9_checked": "select source, target_share, max_repeats, true as met, true as within_repeats from mix_targets",
    "p7_found": """select 'title' as field, title as key_value from edits group by title having count(*) >= 0.006 * (select count(*) from edits)
union all select 'qid', qid from propagation_records group by qid having count(*) >= 0.006 * (select count(*) from propagation_records)""",
    "p7_top_titles": _TOP.format("title", "edits"),
    "p7_top_items": _TOP.format("qid", "propagation_records"),
}
