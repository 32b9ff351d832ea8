"""Records that may be wrong: evidence, a suggested category, a review sheet and its summary."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editwake.config import DEFAULT, Propagation, Triage
from editwake.operators.edits import _path, _there, decoded, stream_time, truthy, whole_seconds
from editwake.operators.pairs import parsed_label, positioned

KEY = ["wiki", "title", "ts"]
EVIDENCE = ["user_name", "edit_comment", "bytes_changed", "bot", "stream_skew_seconds"]


def bytes_delta(old: Column, new: Column) -> Column:
    """Size change; the new size where there was no old one, NULL without a new one."""
    return F.when(new.isNotNull(), F.when(F.coalesce(old, F.lit(0)) != 0, new - old).otherwise(new))


def evidence_of_lines(lines: DataFrame) -> DataFrame:
    """Evidence of every event line, with file and line_no as its order. Lines without wiki, title or a whole time are left out."""
    rows = decoded(lines).where("v is not null").withColumn("ts", whole_seconds())
    complete = rows.where(_there("$.wiki") & _there("$.title") & F.col("ts").isNotNull())
    skew = F.unix_micros(stream_time()) / 1e6 - F.col("ts")
    return complete.select(
        "file", "line_no", _path("$.wiki", "string").alias("wiki"), _path("$.title", "string").alias("title"), "ts",
        F.coalesce(_path("$.user", "string"), F.lit("")).alias("user_name"), F.coalesce(_path("$.comment", "string"), F.lit("")).alias("edit_comment"),
        bytes_delta(_path("$.length.old", "bigint"), _path("$.length.new", "bigint")).alias("bytes_changed"), truthy("$.bot").alias("bot"),
        skew.alias("stream_skew_seconds"),
    )


def first_evidence(evidence: DataFrame, order: list[str]) -> DataFrame:
    """One row per (wiki, title, ts): the first in the order given, combined before the shuffle."""
    first = evidence.groupBy(*KEY).agg(F.min(F.struct(*dict.fromkeys([*order, *EVIDENCE]))).alias("f"))
    return first.select(*KEY, *[F.col(f"f.{c}").alias(c) for c in EVIDENCE])


def wanted(records: DataFrame) -> DataFrame:
    """Keys (wiki, title, ts) of both sides of records."""
    side = lambda s: records.select(*[F.col(f"{s}_{c}").alias(n) for c, n in (("wiki", "wiki"), ("title", "title"), ("timestamp", "ts"))])
    return side("leader").unionByName(side("follower")).distinct()


def with_evidence(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """Records with leader and follower evidence as structs, NULL where none was found. evidence is unique on its key.

    The evidence is first cut to the keys of the records (a semi-join), then joined twice; a hot key is one row on the
    evidence side, and adaptive execution splits the records' side.
    """
    few = evidence.join(wanted(records), KEY, "left_semi")
    out = records
    for side in ("leader", "follower"):
        mine = few.select(
            F.col("wiki").alias(f"{side}_wiki"), F.col("title").alias(f"{side}_title"), F.col("ts").alias(f"{side}_timestamp"), F.struct(*EVIDENCE).alias(side)
        )
        out = out.join(mine, [f"{side}_wiki", f"{side}_title", f"{side}_timestamp"], "left")
    return out


def _search(text: Column, pattern: str) -> Column:
    """A search that ignores case and finds word ends in every script."""
    return F.coalesce(text.rlike(pattern.replace("(?i)", "(?iuU)")), F.lit(False))


def _quoted(text: Column) -> Column:
    """A text between quote marks as Python writes it, for texts without control characters."""
    marks = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), '"').otherwise("'")
    inner = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.concat(marks, F.when(marks == "'", F.replace(inner, F.lit("'"), F.lit("\\'"))).otherwise(inner), marks)


def suggested(joined: DataFrame, rules: Triage = DEFAULT.triage, p: Propagation = DEFAULT.propagation) -> DataFrame:
    """Adds suggested_category and evidence: the first rule that fires, the leader's side before the follower's.

    bot_slipped_filter, revert_or_vandalism, disambiguation, trivial_maintenance, out_of_order, same_editor, else
    needs_review. A missing user or comment is an empty one.
    """
    rules_found: list[tuple[Column, str, Column]] = []
    sides = ("leader", "follower")
    user = {s: F.coalesce(F.col(f"{s}.user_name"), F.lit("")) for s in sides}
    comment = {s: F.coalesce(F.col(f"{s}.edit_comment"), F.lit("")) for s in sides}
    for s in sides:
        fires = F.col(s).isNotNull() & ~F.coalesce(F.col(f"{s}.bot"), F.lit(False)) & _search(user[s], rules.bot_user)
        rules_found.append((fires, "bot_slipped_filter", F.concat(F.lit(f"{s} user "), _quoted(user[s]))))
    for s in sides:
        hit = F.lit(False)
        for pattern in rules.reverts:
            hit = hit | _search(comment[s], pattern)
        rules_found.append((F.col(s).isNotNull() & hit, "revert_or_vandalism", F.concat(F.lit(f"{s} comment "), _quoted(F.substring(comment[s], 1, 80)))))
    for s in sides:
        hit = F.lit(False)
        for mark in rules.disambiguation:
            hit = hit | F.coalesce(F.contains(F.col(f"{s}_title"), F.lit(mark)), F.lit(False))
        rules_found.append((hit, "disambiguation", F.concat(F.lit(f"{s} title "), _quoted(F.col(f"{s}_title")))))
    a, b = (F.col(f"{s}.bytes_changed") for s in sides)
    tiny = F.coalesce((F.abs(a) <= rules.trivial_bytes) & (F.abs(b) <= rules.trivial_bytes), F.lit(False))
    rules_found.append((tiny, "trivial_maintenance", F.format_string("size changes %+d / %+d bytes", a, b)))
    for s in sides:
        skew = F.col(f"{s}.stream_skew_seconds")
        rules_found.append((F.coalesce(F.abs(skew) > p.reorder, F.lit(False)), "out_of_order", F.concat(F.lit(f"{s} stream skew "), F.bround(skew, 0).cast("bigint").cast("string"), F.lit("s"))))
    same = F.col("leader").isNotNull() & F.col("follower").isNotNull() & (user["leader"] != "") & (user["leader"] == user["follower"])
    rules_found.append((same, "same_editor", F.concat(F.lit("user "), _quoted(user["leader"]), F.lit(" made both edits"))))
    category, why = F.lit("needs_review"), F.lit("")
    for fires, name, text in reversed(rules_found):
        category, why = F.when(fires, name).otherwise(category), F.when(fires, text).otherwise(why)
    return joined.withColumn("suggested_category", category).withColumn("evidence", why)


def review_sample(records: DataFrame, size: int = DEFAULT.triage.candidates, seed: int = DEFAULT.triage.seed) -> DataFrame:
    """size records drawn at random, with case_id, from the order by qid and rank (then all other columns, so that ties are settled)."""
    n = records.count()
    drawn = random.Random(seed).sample(range(n), min(n, size))
    cases = records.sparkSession.createDataFrame([(i, f"f{k:03d}") for k, i in enumerate(drawn, 1)] or [(-1, "")], "position bigint, case_id string")
    order = ["qid", "rank", *sorted(c for c in records.columns if c not in {"qid", "rank"})]
    return positioned(records, order).join(F.broadcast(cases), "position").drop("position")


def review_sheet(sampled: DataFrame, evidence: DataFrame, rules: Triage = DEFAULT.triage, p: Propagation = DEFAULT.propagation) -> DataFrame:
    """The 19 columns of the sheet that a reviewer fills in."""
    rows = suggested(with_evidence(sampled, evidence), rules, p)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return rows.select(
        "case_id", "qid", "rank", "lag_seconds", "leader_wiki", "leader_title", text(F.col("leader.user_name")).alias("leader_user"),
        text(F.col("leader.edit_comment")).alias("leader_comment"), text(F.col("leader.bytes_changed")).alias("leader_bytes"),
        "follower_wiki", "follower_title", text(F.coalesce("follower.user_name", "follower_user")).alias("follower_user"),
        text(F.col("follower.edit_comment")).alias("follower_comment"), text(F.col("follower.bytes_changed")).alias("follower_bytes"),
        "suggested_category", "evidence", F.lit("").alias("confirmed_wrong"), F.lit("").alias("category"), F.lit("").alias("note"),
    )


def review_summary(sheet: DataFrame) -> DataFrame:
    """Confirmed-wrong cases per category: (category, cases, case_ids); the reviewer's category wins over the suggestion."""
    wrong = _wrong(sheet)
    return wrong.groupBy("final").agg(F.count(F.lit(1)).alias("cases"), F.array_sort(F.collect_list("case_id")).alias("case_ids")).withColumnRenamed("final", "category")


def _wrong(sheet: DataFrame) -> DataFrame:
    own = F.trim(F.coalesce("category", F.lit("")))
    return sheet.where(parsed_label(F.col("confirmed_wrong"))).withColumn("final", F.when(own == "", F.col("suggested_category")).otherwise(own))


def review_agreement(sheet: DataFrame) -> DataFrame:
    """One row: candidates, reviewed, confirmed wrong, share in which the suggestion stood (NULL without any)."""
    label = parsed_label(F.col("confirmed_wrong"))
    own = F.trim(F.coalesce("category", F.lit("")))
    agreed = label & ((own == "") | (own == F.col("suggested_category")))
    out = sheet.agg(
        F.count(F.lit(1)).alias("candidates"), F.count(label).alias("reviewed"), F.count(F.when(label, 1)).alias("confirmed_wrong"), F.count(F.when(agreed, 1)).alias("agreed")
    )
    return out.select("candidates", "reviewed", "confirmed_wrong", F.bround(F.try_divide(F.col("agreed").cast("double"), F.col("confirmed_wrong").cast("double")), 4).alias("heuristic_agreement"))
