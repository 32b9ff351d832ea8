"""A feed of server-sent events: the frame decoder, and a streaming source over it."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "id string, event string, data string"


def frames(lines: Iterable[str]) -> Iterator[tuple[str | None, str, str]]:
    """(id, event, data) of each block that ends with a blank line and has data. The id lasts until another one comes."""
    last, kind, data = None, "message", []
    for raw in lines:
        line = raw.rstrip("\r\n")
        if not line:
            if data:
                yield last, kind, "\n".join(data)
            kind, data = "message", []
        elif not line.startswith(":"):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "data":
                data.append(value)
            elif name == "id":
                last = value
            elif name == "event":
                kind = value


def frames_of(lines: DataFrame, connection: list[str], order: str = "line_no", text: str = "line") -> DataFrame:
    """The same from a table of lines: (connection, block, id, event, data), a row per block that ends and has data.

    Each connection is read in its own order, which a window runs over as a stream; only a block's lines are held.
    """
    over = Window.partitionBy(*connection).orderBy(order)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    value = F.regexp_replace(F.regexp_extract(text, r"^[^:]*:(.*)$", 1), "^ ", "")
    name = F.regexp_extract(text, "^([^:]*)", 1)
    marked = lines.select(
        *connection, order, (F.col(text) == "").cast("int").alias("blank"), name.alias("name"), value.alias("value"), F.coalesce(F.sum((F.col(text) == "").cast("int")).over(before), F.lit(0)).alias("block"),
        F.last(F.when(name == "id", value), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0)).alias("id"),
    )
    pairs = F.sort_array(F.collect_list(F.when(F.col("name") == "data", F.struct(order, "value"))))
    blocks = marked.groupBy(*connection, "block").agg(
        F.max("blank").alias("ended"), F.max(F.struct(order, "id")).alias("last"), F.max(F.when(F.col("name") == "event", F.struct(order, "value"))).alias("kind"), pairs.alias("data")
    )
    return blocks.where((F.col("ended") == 1) & (F.size("data") > 0)).select(
        *connection, "block", F.col("last.id").alias("id"), F.coalesce("kind.value", F.lit("message")).alias("event"), F.array_join(F.transform("data", lambda d: d["value"]), "\n").alias("data")
    )


def connect(url: str, resume: str | None, timeout: float, agent: str = "editwake") -> Iterator[str]:
    headers = {"Accept": "text/event-stream", "User-Agent": agent} | ({"Last-Event-ID": resume} if resume else {})
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
        for raw in answer:
            yield raw.decode("utf-8", "replace")


def received(
    url: str, resume: str | None = None, most: int = 1_000, seconds: float = 10.0, first_wait: float = 1.0, most_wait: float = 60.0,
    opened: Callable[..., Iterator[str]] = connect, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, timeout: float = 60.0,
) -> list[tuple[str | None, str, str]]:
    """Up to `most` events within `seconds`, reconnecting from the last id. Failed connections wait twice as long each time;
    an event, or a connection that ended well, sets the wait back."""
    out: list[tuple[str | None, str, str]] = []
    wait, until = first_wait, clock() + seconds
    while len(out) < most and clock() < until:
        try:
            for frame in frames(opened(url, resume, timeout)):
                wait, resume = first_wait, frame[0] or resume
                out.append(frame)
                if len(out) >= most or clock() >= until:
                    return out
            sleep(first_wait)
        except (OSError, urllib.error.URLError):
            sleep(wait)
            wait = min(wait * 2, most_wait)
    return out


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"id": self.options.get("resume")}

    def read(self, start: dict):
        o = self.options
        if o.get("file"):
            # A captured feed: one batch of `most` events after the id.
            with open(o["file"], encoding="utf-8", newline="") as f:
                all_frames = list(frames(f))
            ids = [x[0] for x in all_frames]
            begin = len(ids) - 1 - ids[::-1].index(start["id"]) + 1 if start["id"] in ids else 0
            got = all_frames[begin : begin + int(o.get("most", 1_000))]
        else:
            got = received(o["url"], start["id"], int(o.get("most", 1_000)), float(o.get("seconds", 10)), float(o.get("first_wait", 1)), float(o.get("most_wait", 60)), timeout=float(o.get("timeout", 60)))
        return iter(got), {"id": got[-1][0] if got else start["id"]}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        """A batch again after a failure: the feed is asked from the start id on, as often as it takes to reach the end id."""
        at = start
        while at["id"] != end["id"]:
            got, after = self.read(at)
            for frame in got:
                yield frame
                if frame[0] == end["id"]:
                    return
            if after["id"] == at["id"] and self.options.get("file"):
                raise ValueError(f"the feed ends before {end['id']}")
            at = after


class EventFeed(DataSource):
    """spark.dataSource.register(EventFeed); spark.readStream.format("event_feed").option("url", ...). The checkpoint keeps the id."""

    @classmethod
    def name(cls) -> str:
        return "event_feed"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema):  # noqa: ANN001, N802
        return _Reader(dict(self.options))


def is_message(feed: DataFrame) -> DataFrame:
    """Events of the plain kind; other kinds are the feed's own."""
    return feed.where(F.col("event") == "message")


def decoded_payload(data: str) -> dict | None:
    try:
        value = json.loads(data)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None
