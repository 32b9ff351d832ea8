"""Typed, filtered and counted edits from raw event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editwake import session
from editwake.config import DEFAULT, Filters
from editwake.operators.progress import OPENER, hops, running

_END = "_ew_end_of_line"
_BARE = r"([:,\[]\s*)-?(?:NaN|Infinity)(?=\s*[,}\]])"


def decoded(lines: DataFrame, text: str = "text") -> DataFrame:
    """Adds v, the line as VARIANT, NULL where it is no JSON.

    The bare numbers NaN and Infinity, which strict parsers refuse, become null; they never make a valid field. A line with
    a repeated key is refused.
    """

    # The parser stops after one value; a mark behind it shows that nothing else followed. explode() of one value keeps
    # the optimizer from parsing the line again for every field taken from it.
    marked = lambda c: f"""try_parse_json(concat('[', {c}, ', "{_END}"]'))"""
    mended = f"case when `{text}` rlike 'NaN|Infinity' then {marked(f"regexp_replace(`{text}`, r'{_BARE}', '$1null')")} end"
    once = session.widened(lines).select("*", F.expr(f"explode(array(coalesce({marked(f'`{text}`')}, {mended})))").alias("_ew_both"))
    value = f"case when coalesce(try_variant_get(_ew_both, '$[1]', 'string') = '{_END}', false) then try_variant_get(_ew_both, '$[0]', 'variant') end"
    return once.select("*", F.expr(f"explode(array({value}))").alias("v")).drop("_ew_both")


def _at(path: str, kind: str = "variant") -> str:
    return f"try_variant_get(v, '{path}', '{kind}')"


def _kind_at(path: str) -> str:
    return f"schema_of_variant({_at(path)})"


_NUMERIC = "rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'"


def _truthy_at(path: str) -> str:
    k = _kind_at(path)
    return (
        f"coalesce(case when {k} = 'BOOLEAN' then {_at(path, 'boolean')} when {k} = 'STRING' then length({_at(path, 'string')}) > 0 when {k} {_NUMERIC} then {_at(path, 'double')} <> 0 "
        f"when {k} rlike '^(OBJECT|ARRAY)' then {k} not in ('OBJECT<>', 'ARRAY<VOID>') end, false)"
    )


def _seconds_at(path: str) -> str:
    k, text = _kind_at(path), f"trim({_at(path, 'string')})"
    return (
        f"case when {k} = 'STRING' then case when {text} rlike '^[+-]?[0-9]+(_[0-9]+)*$' then try_cast(replace({text}, '_', '') as bigint) end "
        f"when {k} = 'BOOLEAN' then cast({_at(path, 'boolean')} as bigint) when {k} {_NUMERIC} then cast({_at(path, 'double')} as bigint) end"
    )


def _listed(values) -> str:
    return ", ".join("'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'" for x in values) or "null"


def _path(path: str, kind: str = "variant") -> Column:
    return F.expr(_at(path, kind))


def _there(path: str) -> Column:
    return F.expr(f"{_at(path)} is not null")


def whole_seconds(path: str = "$.timestamp") -> Column:
    """A whole number from a number (cut towards zero), a flag, or digits in a text; NULL otherwise."""
    return F.expr(_seconds_at(path))


def truthy(path: str) -> Column:
    """Whether a value counts as true: any number but 0, any text, list or object that isn't empty. Missing and null: no."""
    return F.expr(_truthy_at(path))


def typed(lines: DataFrame, filters: Filters = DEFAULT.filters) -> DataFrame:
    """Decodable lines with the fields of an edit and reason: NULL (kept), malformed, wiki, namespace or type:<t>.

    malformed: no object; meta.id, wiki, title, timestamp or type missing; timestamp no whole number; a revision that is
    neither empty nor an object. An explicit null isn't missing. The first failing reason counts. user_name is '' where
    the key is missing. Lines that are no JSON are left out; see undecodable(). The fields are written as SQL text, since
    building hundreds of column objects takes longer than parsing thousands of lines.
    """
    rows = decoded(lines).where("v is not null")
    missing = " or ".join(f"{_at(p)} is null" for p in ("$.meta.id", "$.wiki", "$.title", "$.type"))
    wiki, change = _at("$.wiki", "string"), _at("$.type", "string")
    spaces = ", ".join(f"{float(n)}d" for n in filters.namespaces) or "null"
    reason = (
        f"case when {missing} or {_seconds_at('$.timestamp')} is null or not coalesce({_kind_at('$.revision')} like 'OBJECT%' or not {_truthy_at('$.revision')}, true) then 'malformed' "
        f"when not coalesce({wiki} in ({_listed(filters.editions)}), false) then 'wiki' when not coalesce({_at('$.namespace', 'double')} in ({spaces}), false) then 'namespace' "
        f"when not coalesce({change} in ({_listed(filters.change_types)}), false) then concat('type:', coalesce({change}, 'None')) end"
    )
    return rows.selectExpr(
        *[c for c in ("file", "line_no") if c in lines.columns], f"{_at('$.meta.id', 'string')} as event_id", f"{wiki} as wiki", f"{_at('$.title', 'string')} as title",
        f"{_seconds_at('$.timestamp')} as ts", f"{_truthy_at('$.bot')} as bot", f"{change} as change_type",
        f"case when {_at('$.user')} is not null then {_at('$.user', 'string')} else '' end as user_name", f"{_at('$.revision.new', 'bigint')} as revision", f"{reason} as reason",
    )


def kept(lines: DataFrame, filters: Filters = DEFAULT.filters) -> DataFrame:
    return typed(lines, filters).where("reason is null").drop("reason")


def unique(edits: DataFrame, order: list[str], identifier: str = "event_id") -> DataFrame:
    """The first edit of each identifier as written, in the order given. Rows without identifier all stay.

    Firsts are found by a partial aggregate and met again by their order, so an identifier that repeats without end puts
    no load on one task.
    """
    firsts = edits.where(F.col(identifier).isNotNull()).groupBy(identifier).agg(F.min(F.struct(*order)).alias("o")).select("o.*")
    named = edits.where(F.col(identifier).isNotNull()).join(firsts, order, "left_semi").select(edits.columns)
    return named.unionByName(edits.where(F.col(identifier).isNull()))


def unique_recent(edits: DataFrame, order: str = "seq", capacity: int = DEFAULT.filters.dedupe_window, identifier: str = "event_id") -> DataFrame:
    """Edits without repeats, by a bounded memory: an identifier is forgotten once `capacity` others were kept after it.

    A hit doesn't refresh the memory; an edit whose identifier was forgotten is kept and remembered anew. How many were kept
    before a row depends on the rows before it, so flags are worked out again until they stay the same, starting from an
    unbounded memory; a round settles the first flag that was wrong at least, and only identifiers that repeat take part.
    An identifier's repeats pass one task as a sorted stream. `order` is unique; rows without identifier or order stay.
    """
    known = F.col(identifier).isNotNull() & F.col(order).isNotNull()
    rows = session.stage(edits.where(known).select(F.col(identifier).cast("string").alias("id"), F.col(order).cast("bigint").alias("seq")), "recent")
    often = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    ranked = running(rows.withColumn("one", F.lit(1).cast("bigint")), "seq", "one", "rank", "sum").withColumn("rank", F.coalesce("rank", F.lit(0)))
    again = session.stage(ranked.join(often, "id", "left_semi").select("id", "seq", "rank"), "recent-again")
    nothing = F.lit(None).cast("bigint")
    gone = again.join(again.groupBy("id").agg(F.min("seq").alias("seq")), ["id", "seq"], "left_anti").select("seq")
    gone = session.stage(gone, "recent-gone")
    while not gone.isEmpty():
        marked = again.join(gone.withColumn("gone", F.lit(1).cast("bigint")), "seq", "left").withColumn("gone", F.coalesce("gone", F.lit(0)))
        counted = running(marked, "seq", "gone", "before", "sum").withColumn("kept", F.col("rank") - F.coalesce("before", F.lit(0)))
        asked = counted.select(F.col("id").alias("qid"), nothing.alias("released"), nothing.alias("ts"), "seq", F.col("kept").alias("upto"), nothing.alias("bound"), F.col("kept").alias("closed_at"))
        kept = asked.repartition("qid").sortWithinPartitions("qid", "upto", "seq").mapInArrow(hops(capacity + 1), OPENER)
        now = session.stage(again.join(kept.select("seq"), "seq", "left_anti").select("seq"), "recent-gone")
        same = now.exceptAll(gone).isEmpty() and gone.exceptAll(now).isEmpty()
        gone = now
        if same:
            break
    return edits.where(known).join(gone.select(F.col("seq").alias(order)), order, "left_anti").select(edits.columns).unionByName(edits.where(~known))


def accounting(lines: DataFrame, filters: Filters = DEFAULT.filters) -> DataFrame:
    """(outcome, events): undecodable, malformed, wiki, namespace, type:<t>, duplicate, kept."""
    rows = decoded(lines).agg(F.count(F.when(F.col("v").isNull(), 1)).alias("events")).select(F.lit("undecodable").alias("outcome"), "events")
    out = typed(lines, filters)
    dropped = out.where("reason is not null").groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("events"))
    ids = out.where("reason is null").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    both = ids.agg(
        F.coalesce(F.sum(F.when(F.col("event_id").isNull(), F.col("n")).otherwise(1)), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(F.col("event_id").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicate"),
    )
    split = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("outcome"), F.col(c).alias("events")) for c in ("kept", "duplicate")])).alias("x")).select("x.*")
    return rows.unionByName(dropped).unionByName(split)


def captured(lines: DataFrame, filters: Filters = DEFAULT.filters) -> DataFrame:
    """Events worth archiving: of a listed edition and namespace, bots included, with the archive's hour by stream time.

    Where the stream time is missing or unreadable the hour is NULL; a live writer puts the present hour there.
    """
    rows = decoded(lines).where("v is not null")
    keep = _path("$.wiki", "string").isin(*filters.editions) & _path("$.namespace", "double").isin(*[float(n) for n in filters.namespaces])
    hour = F.date_format(stream_time(), "yyyy-MM-dd-HH")
    return rows.where(keep).select(*[c for c in ("file", "line_no") if c in lines.columns], "text", hour.alias("hour"))


def stream_time(path: str = "$.meta.dt") -> Column:
    return F.try_to_timestamp(_path(path, "string"))


def hourly(lines: DataFrame, filters: Filters = DEFAULT.filters) -> DataFrame:
    return captured(lines, filters).groupBy("hour").agg(F.count(F.lit(1)).alias("events"))


def coverage(lines: DataFrame) -> DataFrame:
    """One row: files, events, undecodable, undecodable_rate (0.0 where empty), damaged_members, first and last minute."""
    minute = F.date_trunc("minute", stream_time())
    stats = decoded(lines).agg(
        F.countDistinct("file").alias("files"), F.count("v").alias("events"), F.count(F.when(F.col("v").isNull(), 1)).alias("undecodable"),
        F.countDistinct(F.when(F.col("damaged"), F.struct("file", "member"))).alias("damaged_members"), F.min(minute).alias("a"), F.max(minute).alias("b"),
    )
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    share = F.coalesce(F.try_divide(F.col("undecodable").cast("double"), (F.col("events") + F.col("undecodable")).cast("double")), F.lit(0.0))
    return stats.select("files", "events", "undecodable", F.bround(share, 6).alias("undecodable_rate"), "damaged_members", iso("a").alias("first_event"), iso("b").alias("last_event"))


def minute_gaps(lines: DataFrame) -> DataFrame:
    """Whole minutes without any event between two that have some: (gap_start, gap_end, minutes), seconds since 1970.

    The minute before is a running maximum over distinct minutes, whatever the number of events.
    """
    seconds = F.unix_timestamp(F.date_trunc("minute", stream_time()))
    minutes = decoded(lines).select(seconds.alias("m")).where("m is not null").distinct()
    return running(minutes, "m", "m", "p", "max").where("m - p > 60").select(
        (F.col("p") + 60).alias("gap_start"), (F.col("m") - 60).alias("gap_end"), (((F.col("m") - F.col("p")) / 60).cast("bigint") - 1).alias("minutes")
    )
