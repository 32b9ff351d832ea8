"""The command line: archive, stats, resolve, join, profile, bench, pairs, failures, report."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from editwake import benchmark, config, logs, report, session, sinks
from editwake.operators import edits as E
from editwake.operators import pairs as P
from editwake.operators import propagation as G
from editwake.operators import resolve as R
from editwake.operators import triage as T
from editwake.sources import gzip_lines, sse
from editwake.sources.lookup import HttpClient
from editwake.streaming import archive as A

log = logging.getLogger("editwake")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="editwake", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--archive", default="data/raw", help="folder of the archive")
    p.add_argument("--pattern", default="*.jsonl.gz", help="which of its files")
    p.add_argument("--snapshot", default="data/resolutions.parquet")
    p.add_argument("--records", default="data/records")
    p.add_argument("--results", default="results")
    p.add_argument("--labels", default="labels")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("archive")
    a.add_argument("--url", required=True)
    a.add_argument("--checkpoint", default="data/checkpoint")
    a.add_argument("--max-events", type=int)
    r = sub.add_parser("resolve")
    r.add_argument("--url", help="lookup service for pages the snapshot doesn't know; without it nothing is asked")
    r.add_argument("--agent", default="editwake")
    for name in ("stats", "join", "profile", "bench"):
        q = sub.add_parser(name)
        if name in ("profile", "bench"):
            q.add_argument("--label", default="after", choices=["before", "after"], help="which of the two results it is")
    q.add_argument("--stage", choices=benchmark.STAGES, help="this stage alone, printed and not written")
    q.add_argument("--workers", type=int, default=1)
    for name, last in (("pairs", "evaluate"), ("failures", "summarise")):
        q = sub.add_parser(name)
        q.add_argument("step", choices=["sample", last])
        q.add_argument("--force", action="store_true", help="replace a sheet that people may have worked on")
    r = sub.add_parser("report")
    r.add_argument("--readme", default="README.md")
    return p


class Run:
    def __init__(self, args: argparse.Namespace, spark: SparkSession | None = None) -> None:
        self.args, self.config, self._spark = args, config.load(args.config), spark

    @property
    def spark(self) -> SparkSession:
        self._spark = self._spark or SparkSession.getActiveSession() or session.make_session()
        return self._spark

    def lines(self):
        return gzip_lines.read_archive(self.spark, self.args.archive, self.args.pattern)

    def snapshot(self):
        """The last version that a lookup made, else the folder given, else an empty snapshot."""
        made = session.published(self.spark, f"{self.args.snapshot}.versions")
        path = f"{self.args.snapshot}.versions/v{made[0]}" if made else self.args.snapshot
        if not made and not session.exists(self.spark, path):
            return self.spark.createDataFrame([], R.SNAPSHOT)
        return self.spark.read.parquet(path)

    def keep_snapshot(self, after) -> None:
        folder = f"{self.args.snapshot}.versions"
        number = (session.published(self.spark, folder) or (0, ""))[0] + 1
        session.remove(self.spark, f"{folder}/v{number}")
        after.write.parquet(f"{folder}/v{number}")
        session.publish(self.spark, folder, number, "")
        session.remove(self.spark, f"{folder}/v{number - 2}")

    def unresolved_edits(self):
        kept = session.stage(E.kept(self.lines(), self.config.filters), "kept")
        numbered = P.positioned(kept, ["file", "line_no"], "seq")
        return session.stage(E.unique_recent(numbered, "seq", self.config.filters.dedupe_window), "unique")

    def edits(self):
        return session.stage(R.resolved(self.unresolved_edits(), self.snapshot()), "edits")

    def save(self, name: str, **payload) -> None:
        log.info("result written", extra={"path": str(sinks.write_result(self.args.results, name, payload))})

    def archive(self) -> None:
        self.spark.dataSource.register(sse.EventFeed)
        a = self.config.archive
        feed = self.spark.readStream.format("event_feed").option("url", self.args.url).option("timeout", a.read_timeout)
        feed = feed.option("first_wait", a.reconnect_first).option("most_wait", a.reconnect_most)
        if self.args.max_events:
            feed = feed.option("most", self.args.max_events)
        A.archive(sse.is_message(feed.load()), self.args.archive, self.args.checkpoint, self.config.filters, once=bool(self.args.max_events)).awaitTermination()

    def stats(self) -> None:
        lines = session.stage(self.lines(), "lines")
        gaps = session.stage(E.minute_gaps(lines), "gaps")
        gaps.write.mode("overwrite").parquet(f"{self.args.results}/gaps.parquet")  # all of them; the document has the longest
        total = gaps.agg(F.count(F.lit(1)).alias("gap_count"), F.coalesce(F.sum("minutes"), F.lit(0)).alias("gap_minutes"))
        longest = [r.asDict() for r in gaps.orderBy(F.desc("minutes"), "gap_start").limit(3).collect()]
        self.save("archive", **sinks.as_document(E.coverage(lines)), **sinks.as_document(total), gaps=longest)

    def resolve(self) -> None:
        asked = {}
        if self.args.url:
            url, agent = self.args.url, self.args.agent
            _, after, answers = R.online(self.unresolved_edits(), self.snapshot(), lambda: HttpClient(url, agent), self.config.resolution)
            asked = sinks.as_document(answers.agg(F.count(F.lit(1)).alias("pages_asked"), F.count("qid").alias("pages_found")))
            self.keep_snapshot(after)
        edits = self.edits()
        self.save("resolve", **asked, **sinks.as_document(R.counters(edits, self.snapshot(), self.config.resolution.block)), **sinks.as_document(R.with_item_rate(edits)))

    def join(self) -> None:
        p = self.config.propagation
        cells = G.propagation_cells(self.edits(), p, in_order=False)
        found, windows = session.stage(G.records(cells, p), "records"), session.stage(G.windows(cells), "windows")
        sinks.write_records(found, self.args.records)
        lists = {"lag_by_rank": G.lag_by_rank(found), "lag_by_pair": G.lag_by_pair(found, p), "editions": G.leadership(cells, p), "reached_rank": G.reached_rank(windows, p)}
        self.save("propagation", statistics=sinks.as_document(G.statistics(windows)), **{k: [r.asDict() for r in v.collect()] for k, v in lists.items()})

    def _replayed(self):
        return G.records(G.propagation_cells(self.edits(), self.config.propagation))

    def profile(self) -> None:
        self.save(f"profile_{self.args.label}", **benchmark.profiled(self.spark, lambda: benchmark.digest(self._replayed())))

    def bench(self) -> None:
        if self.args.stage:
            spark = self._spark = self._spark or session.make_session("bench", self.args.workers)
            run = self._replayed if self.args.stage == "full" else lambda: E.kept(self.lines(), self.config.filters)
            print(json.dumps(benchmark.measured(spark, run, self.lines().count())))
            return
        given = [f"--{k}={v}" for k in ("config", "archive", "pattern", "snapshot") if (v := getattr(self.args, k))]
        self.save(f"bench_{self.args.label}", **benchmark.scaled([sys.executable, "-m", "editwake", *given]))

    def pairs(self) -> None:
        sheet = f"{self.args.labels}/pairs.csv"
        if self.args.step == "sample":
            pages = session.stage(P.pages(self.edits()), "pages")
            sinks.write_labelling(P.labelling_sample(pages, self.config.labels.sample, self.config.labels.seed), sheet, self.args.force)
            self.save("pairs", strata=[r.asDict() for r in P.allocation(pages, self.config.labels.sample).collect()])
        else:
            sizes = sinks.load_results(self.args.results)["pairs"]["strata"]
            read = lambda path: self.spark.read.csv(path, header=True, multiLine=True, escape='"')
            frame = self.spark.createDataFrame([(s["stratum"], s["pairs"]) for s in sizes], "stratum string, pairs bigint")
            self.save("baseline", **sinks.as_document(P.evaluation(read(sheet), read(sheet.replace(".csv", ".key.csv")), frame)))

    def failures(self) -> None:
        sheet = f"{self.args.labels}/failures.csv"
        if self.args.step == "sample":
            kinds = (
                "qid string, rank int, leader_wiki string, leader_title string, leader_timestamp bigint, follower_wiki string, follower_title string, "
                "follower_timestamp bigint, follower_user string, lag_seconds bigint"
            )
            drawn = session.stage(T.review_sample(sinks.read_records(self.spark, self.args.records, kinds), self.config.triage.candidates, self.config.triage.seed), "drawn")
            evidence = T.evidence_of_lines(self.lines()).join(T.wanted(drawn), T.KEY, "left_semi")
            rows = session.stage(T.review_sheet(drawn, T.first_evidence(evidence, ["file", "line_no"]), self.config.triage, self.config.propagation), "sheet")
            sinks.write_sheet(rows.orderBy("case_id"), sheet, self.args.force)
            counts = rows.groupBy("suggested_category").agg(F.count(F.lit(1)).alias("records"))
            self.save("failures_sample", categories=[r.asDict() for r in counts.collect()])
        else:
            rows = self.spark.read.csv(sheet, header=True, multiLine=True, escape='"')
            self.save("failures", **sinks.as_document(T.review_agreement(rows)), categories=[r.asDict() for r in T.review_summary(rows).collect()])

    def report(self) -> None:
        changed = report.splice(self.args.readme, report.render(sinks.load_results(self.args.results)))
        log.info("report", extra={"changed": changed})


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    logs.configure()
    getattr(Run(args, spark), args.command)()


if __name__ == "__main__":
    main()
