"""A client for pages that the snapshot doesn't know. Off unless one is given: nothing here opens a connection by itself."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwake.config import DEFAULT, Resolution


class TryAgain(Exception):
    """A passing failure; after says how many seconds the server asked to wait."""

    def __init__(self, reason: str, after: float | None = None) -> None:
        super().__init__(reason)
        self.after = after


class Refused(Exception):
    """A failure of the request itself: asking again won't help, asking for less may."""


class Client(Protocol):
    def lookup(self, site: str, titles: Sequence[str]) -> dict[str, str | None]: ...


def matched(body: dict, site: str, titles: Sequence[str]) -> dict[str, str | None]:
    """Item per requested title from an answer's entities; exact titles only, None where nothing was found."""
    named = {
        link["title"]: e["id"]
        for e in body.get("entities", {}).values()
        if "missing" not in e and (link := e.get("sitelinks", {}).get(site))
    }
    return {t: named.get(t) for t in titles}


def matched_table(answers: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same for tables: answers (site, body) and wanted (site, title) give (site, title, qid)."""
    entity = "struct<id:string,missing:string,sitelinks:map<string,struct<title:string>>>"
    rows = answers.select("site", F.explode(F.map_values(F.from_json(F.get_json_object("body", "$.entities"), f"map<string,{entity}>"))).alias("e"))
    found = rows.where(F.col("e.missing").isNull()).select("site", F.element_at("e.sitelinks", F.col("site"))["title"].alias("title"), F.col("e.id").alias("qid"))
    return wanted.join(found.where("title is not null").groupBy("site", "title").agg(F.min("qid").alias("qid")), ["site", "title"], "left")


class HttpClient:
    def __init__(self, url: str, agent: str, timeout: float = 30.0, maxlag: int = 5) -> None:
        self.url, self.agent, self.timeout, self.maxlag = url, agent, timeout, maxlag

    def lookup(self, site: str, titles: Sequence[str]) -> dict[str, str | None]:
        # The form of the public protocol.
        form = {
            "action": "wbgetentities", "format": "json", "formatversion": "2", "sites": site, "titles": "|".join(titles), "props": "sitelinks", "sitefilter": site, "maxlag": str(self.maxlag),
        }
        ask = urllib.request.Request(self.url, urllib.parse.urlencode(form).encode(), {"User-Agent": self.agent})
        try:
            with urllib.request.urlopen(ask, timeout=self.timeout) as answer:
                body, after = json.load(answer), answer.headers.get("Retry-After")
        except urllib.error.HTTPError as e:
            if e.code in (429, 503):
                raise TryAgain(f"status {e.code}", _number(e.headers.get("Retry-After"))) from e
            raise (TryAgain if e.code >= 500 else Refused)(f"status {e.code}") from e
        except (OSError, ValueError) as e:
            raise TryAgain(str(e)) from e
        if error := body.get("error"):
            raise TryAgain("maxlag", _number(after)) if error.get("code") == "maxlag" else Refused(str(error.get("code")))
        return matched(body, site, titles)


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text is not None else None
    except ValueError:
        return None


@dataclass
class Lookups:
    """Batches with retries; a refused batch is halved until the title at fault is alone, which then counts as without item."""

    client: Client
    settings: Resolution = field(default_factory=lambda: DEFAULT.resolution)
    sleep: Callable[[float], None] = time.sleep
    requests: int = 0
    retries: int = 0
    refused: int = 0
    failed: int = 0

    def site(self, site: str, titles: Sequence[str]) -> dict[str, str | None]:
        """Items of a site's titles; those whose batch failed for good are missing from the result, so that they aren't stored."""
        out: dict[str, str | None] = {}
        waiting = [list(titles[i : i + self.settings.batch]) for i in range(0, len(titles), self.settings.batch)][::-1]
        while waiting:
            batch = waiting.pop()
            try:
                got = self._ask(site, batch)
            except Refused:
                if len(batch) > 1:
                    waiting += [batch[len(batch) // 2 :], batch[: len(batch) // 2]]
                    continue
                self.refused += 1
                got = {batch[0]: None}
            self.failed += len(batch) - len(got)
            out |= got
        return out

    def _waits(self):
        """How long to wait after each failed try: twice as long each time; ends with the last try."""
        wait = self.settings.backoff_first
        for _ in range(self.settings.max_retries):
            yield min(wait, self.settings.backoff_most)
            wait *= 2

    def _ask(self, site: str, batch: list[str]) -> dict[str, str | None]:
        waits = self._waits()
        while True:
            try:
                got = self.client.lookup(site, batch)
            except TryAgain as e:
                wait = next(waits, None)
                if wait is None:
                    return {}
                self.retries += 1
                self.sleep(wait if e.after is None else min(e.after, self.settings.backoff_most))
            else:
                self.requests += 1
                return got


def look_up(pages: DataFrame, make_client: Callable[[], Client], settings: Resolution = DEFAULT.resolution, tasks: int = 4) -> DataFrame:
    """(wiki, title, qid) of unknown pages, asked in batches per site by `tasks` tasks; titles that failed for good are left out."""
    import pyarrow as pa

    from editwake import session

    session.ship(pages.sparkSession)

    def run(batches):
        lookups = Lookups(make_client(), settings)
        for batch in batches:
            by_site: dict[str, list[str]] = {}
            for wiki, title in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_site.setdefault(wiki, []).append(title)
            for site in sorted(by_site):
                got = lookups.site(site, by_site[site])
                yield pa.RecordBatch.from_pydict({"wiki": [site] * len(got), "title": list(got), "qid": pa.array(list(got.values()), pa.string())})

    spread = pages.select("wiki", "title").where("wiki is not null and title is not null").distinct().repartition(tasks, "wiki", F.pmod(F.xxhash64("title"), F.lit(tasks)))
    return spread.sortWithinPartitions("wiki", "title").mapInArrow(run, "wiki string, title string, qid string")
