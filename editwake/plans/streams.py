"""Streaming forms of the queries, run over the same tables in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editwake import session
from editwake.functions.columns import bucket
from editwake.operators import edits as E
from editwake.operators import propagation as G
from editwake.operators import resolve as R
from editwake.plans import problems, reference
from editwake.plans.problems import table
from editwake.sources.gzip_lines import lines_of
from editwake.sources.lookup import Refused, TryAgain, look_up, matched_table
from editwake.sources.sse import frames_of
from editwake.streaming import archive
from editwake.streaming.late import LateCounts, run
from editwake.streaming.propagation import PropagationStream


def _fed(spark: SparkSession, rows: DataFrame, order: list[str], pieces: int, name: str) -> DataFrame:
    """rows as a stream of `pieces` files, each a range of the order; one file is one micro-batch."""
    path = session.scratch(spark, name)
    ranged = session.stage(rows.repartitionByRange(pieces, *order), f"{name}-rows")
    bounds = [r[0] for r in ranged.groupBy(F.input_file_name()).agg(F.min(F.struct(*order)).alias("o")).select("o").orderBy("o").collect()]  # a row per piece
    for k, bound in enumerate(bounds):
        at = lambda b: F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, b, strict=True)])
        keep = F.struct(*order) >= at(bound)
        if k + 1 < len(bounds):
            keep = keep & (F.struct(*order) < at(bounds[k + 1]))
        ranged.where(keep).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def streaming_late_counts(spark, d):
    rows = table(spark, d, "edits").select("wiki", "ts", "seq")
    target = LateCounts(spark, session.scratch(spark, "late"), ["wiki"])
    run(_fed(spark, rows, ["seq"], 3, "late-feed"), target, session.scratch(spark, "late-checkpoint"))
    return target.counts().drop("version")


def streaming_late_rows(spark, d):
    rows = table(spark, d, "edits").select("wiki", "ts", "seq")
    target = LateCounts(spark, session.scratch(spark, "late"), ["wiki"])
    run(_fed(spark, rows, ["seq"], 3, "late-feed"), target, session.scratch(spark, "late-checkpoint"))
    return target.diverted().select("seq")


def streaming_propagation(spark, d):
    rows = G.with_item(E.unique(table(spark, d, "edits"), ["seq"]))
    target = PropagationStream(spark, session.scratch(spark, "propagation"))
    run(_fed(spark, rows, ["ts", "seq"], 3, "propagation-feed"), target, session.scratch(spark, "propagation-checkpoint"))
    return G.records(target.cells())


def streaming_archive(spark, d):
    """Lines per hour after a pass through the archive's writer."""
    lines = table(spark, d, "raw_lines").where(F.col("file").endswith(".jsonl.gz")).select(F.col("text").alias("data"))
    feed = session.scratch(spark, "feed")
    lines.write.parquet(feed)
    folder = session.scratch(spark, "archive")
    archive.archive(spark.readStream.schema(lines.schema).parquet(feed), folder, session.scratch(spark, "archive-checkpoint"), unknown_hour="unknown").awaitTermination()
    return spark.read.text(folder).groupBy(F.col("hour").cast("string").alias("hour")).agg(F.count(F.lit(1)).alias("events"))


def gzip_salvage(spark, d):
    """Lines per file after the archive was written as gzip, in stretches of 10,000 lines each a file of two members, the
    second one cut short, and read back by the salvaging scan. The whole table goes through; a text with a line break
    comes out as several lines."""
    import gzip

    import pyarrow as pa

    session.ship(spark)

    def written(rows: pa.Table) -> pa.Table:
        texts = rows.sort_by("line_no").column("text").to_pylist()
        half = len(texts) // 2
        whole = gzip.compress("".join(f"{t}\n" for t in texts[:half]).encode())
        cut = gzip.compress("".join(f"{t}\n" for t in texts[half:]).encode())[:-8]  # all data, but no end mark
        name = rows.column("file")[0].as_py().replace(".csv.gz", ".csv.lines.gz")  # lines, not records
        return pa.table({"path": [f"{rows.column('stretch')[0].as_py()}/{name}"], "content": pa.array([whole + cut], pa.binary())})

    lines = table(spark, d, "raw_lines").where("text is not null").select("file", bucket(F.col("line_no"), 10_000).alias("stretch"), "line_no", "text")
    files = session.stage(lines.groupBy("file", "stretch").applyInArrow(written, "path string, content binary"), "gzip")
    back = lines_of(files).withColumn("file", F.replace("file", F.lit(".csv.lines.gz"), F.lit(".csv.gz")))
    return back.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("damaged"), 1)).alias("damaged"), F.sum(F.length("text")).alias("characters"), F.max("member").alias("last_member"),
    )


def sse_frames(spark, d):
    """The archive's event lines as a feed would send them, decoded again; an id is sent with every third event only."""
    rows = table(spark, d, "raw_lines").where(F.col("file").endswith(".jsonl.gz")).select("file", "line_no", "text")
    data = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("data: "), x))
    sent = F.concat(F.array(F.lit(":ok")), F.when(F.col("line_no") % 3 == 0, F.array(F.concat(F.lit("id: "), F.col("line_no")))).otherwise(F.array()), data, F.array(F.lit("")))
    lines = rows.select("file", F.col("line_no").alias("n"), F.posexplode(sent).alias("k", "line")).select("file", F.struct("n", "k").alias("line_no"), "line")
    return frames_of(lines, ["file"]).drop("block")


def api_response_match(spark, d):
    """The snapshot's pages from answers of the lookup service as they would come, in batches of about 50 titles a site."""
    pages = table(spark, d, "resolutions").select(F.col("wiki").alias("site"), "title", "qid")
    batches = max(1, pages.count() // 50)
    link = F.map_from_arrays(F.array("site"), F.array(F.struct("title")))
    entity = F.when(F.col("qid").isNotNull(), F.to_json(F.struct(F.col("qid").alias("id"), link.alias("sitelinks")))).otherwise(
        F.to_json(F.struct("site", "title", F.lit("").alias("missing")))
    )
    key = F.coalesce("qid", F.concat(F.lit("-"), F.xxhash64("title").cast("string")))
    part = pages.select("site", F.pmod(F.xxhash64("title"), F.lit(batches)).alias("batch"), F.concat(F.lit('"'), key, F.lit('":'), entity).alias("member"))
    answers = part.groupBy("site", "batch").agg(F.concat(F.lit('{"entities":{'), F.array_join(F.collect_list("member"), ","), F.lit("}}")).alias("body"))
    return matched_table(answers, pages.select("site", "title"))


class RuleClient:
    """A stand-in for the service: refuses any batch that holds a title of a length divisible by 17, fails once in passing."""

    def __init__(self) -> None:
        self.calls = 0

    def lookup(self, site, titles):
        self.calls += 1
        if self.calls == 1:
            raise TryAgain("busy", after=0.0)
        if any(len(t) % 17 == 0 for t in titles):
            raise Refused("no such title")
        return {t: f"Q{len(t)}" for t in titles}


def retry_bisect(spark, d):
    """Pages the snapshot doesn't know, looked up at the stand-in service: refused titles come out without an item."""
    return look_up(R.unresolved(table(spark, d, "edits"), table(spark, d, "resolutions")), RuleClient)


def resolve_online(spark, d):
    """Edits resolved by the snapshot and, where it doesn't know the page, by the stand-in service; the snapshot keeps the answers."""
    edits = table(spark, d, "edits").select("seq", "wiki", "title")
    return R.online(edits, table(spark, d, "resolutions"), RuleClient)[0]


def snapshot_after_online(spark, d):
    return R.online(table(spark, d, "edits").select("seq", "wiki", "title"), table(spark, d, "resolutions"), RuleClient)[1]


QUERIES = {f.__name__: f for f in (
    streaming_late_counts, streaming_late_rows, streaming_propagation, streaming_archive, gzip_salvage, sse_frames, api_response_match, retry_bisect,
    resolve_online, snapshot_after_online,
)}


def _oracle() -> dict[str, str]:
    clocked = problems.CLOCKED
    return {
        "streaming_late_counts": f"{clocked} select wiki, ts - ts % 3600 as period_start, count(*) as edits from l where not late group by 1, 2",
        "streaming_late_rows": f"{clocked} select seq from l where late",
        "streaming_propagation": reference.ORACLE["propagation_records"],
        "streaming_archive": f"select coalesce(hour, 'unknown') as hour, events from ({reference.ORACLE['hourly_buckets']})",
        "gzip_salvage": """with p as (select file, line_no // 10000 as st, text, row_number() over (partition by file, line_no // 10000 order by line_no) as k,
count(*) over (partition by file, line_no // 10000) as n from raw_lines where text is not null),
l as (select file, k > n // 2 as late, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) as t from p)
select file, count(*) as lines, count(*) filter (late) as damaged, cast(sum(length(t)) as bigint) as characters, cast(1 as integer) as last_member from l where t <> '' group by 1""",
        "sse_frames": """select file, cast(last_value(case when line_no % 3 = 0 then line_no end ignore nulls) over (partition by file order by line_no) as varchar) as id,
'message' as event, text as data from raw_lines where file like '%.jsonl.gz'""",
        "api_response_match": "select wiki as site, title, qid from resolutions",
        "resolve_online": """select e.seq, e.wiki, e.title, case when r.wiki is not null then r.qid when length(e.title) % 17 <> 0 then 'Q' || length(e.title) end as qid, true as found
from edits e left join resolutions r on e.wiki = r.wiki and e.title = r.title""",
        "snapshot_after_online": """select wiki, title, qid from resolutions union all select wiki, title, case when length(title) % 17 <> 0 then 'Q' || length(title) end from (select distinct wiki, title
from edits e where not exists (select 1 from resolutions r where r.wiki = e.wiki and r.title = e.title))""",
        "retry_bisect": """select wiki, title, case when length(title) % 17 <> 0 then 'Q' || length(title) end as qid from (select distinct wiki, title from edits e
where not exists (select 1 from resolutions r where r.wiki = e.wiki and r.title = e.title))""",
    }


ORACLE = _oracle()
