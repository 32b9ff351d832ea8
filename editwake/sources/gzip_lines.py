"""Lines of damaged gzip archives: every line that was flushed, whatever happened to the file after."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editwake import session
from editwake.operators.badrows import assemble

MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 16
SCHEMA = "file string, member int, line_no bigint, text string, damaged boolean"
_ARROW = pa.schema([("file", pa.string()), ("member", pa.int32()), ("line_no", pa.int64()), ("text", pa.string()), ("damaged", pa.bool_())])


def _pieces(data: memoryview, start: int) -> Iterator[tuple[bytes, int | None]]:
    """Decoded pieces of the member at start, each with None, then (b"", end) where it ended whole or (b"", -1) where not."""
    member = zlib.decompressobj(wbits=31)
    at = start
    while at < len(data) and not member.eof:
        chunk = bytes(data[at : at + STEP])
        spare = member.copy()
        try:
            out = member.decompress(chunk)
        except zlib.error:
            yield from ((x, None) for x in _salvaged(spare, chunk))
            yield b"", -1
            return
        at += len(chunk) - len(member.unused_data)
        if out:
            yield out, None
    yield b"", at if member.eof else -1


def _salvaged(member, chunk: bytes) -> Iterator[bytes]:
    """What the chunk holds before its bad byte: halves are fed as long as they decode, down to single bytes."""
    while chunk:
        half = max(1, len(chunk) // 2)
        spare = member.copy()
        try:
            out = member.decompress(chunk[:half])
        except zlib.error:
            if half == 1:
                return
            member, chunk = spare, chunk[:half]
            continue
        yield out
        chunk = chunk[half:]


def members(data: bytes) -> Iterator[tuple[int, bool]]:
    """(start, damaged) of each member; after a damaged one reading goes on at the next gzip header."""
    view, start = memoryview(data), 0
    while start < len(data):
        end = -1
        for _, ended in _pieces(view, start):
            end = ended if ended is not None else end
        yield start, end < 0
        if end < 0:
            end = data.find(MAGIC, start + 1)
            if end < 0:
                return
        start = end


def raw_lines(data: bytes) -> Iterator[tuple[int, str, bool]]:
    """(member, text, damaged) of each physical line, its line feed removed; bytes that are no UTF-8 become replacement marks.

    A member is decoded twice, once to learn whether it is damaged, so that only one line is held at a time.
    """
    view = memoryview(data)
    for member, (start, damaged) in enumerate(members(data)):
        rest = b""
        for piece, ended in _pieces(view, start):
            if ended is not None:
                break
            *whole, rest = (rest + piece).split(b"\n")
            for raw in whole:
                yield member, raw.decode("utf-8", "replace"), damaged
        if rest:
            yield member, rest.decode("utf-8", "replace"), damaged


def lines(data: bytes) -> Iterator[tuple[int, int, str, bool]]:
    """(member, line_no, text, damaged) of a file's content; a last line without its end counts.

    Blank lines are dropped, others stripped; line_no counts the lines that come out.
    """
    number = 0
    for member, text, damaged in raw_lines(data):
        if text.strip():
            number += 1
            yield member, number, text.strip(), damaged


def csv_records(data: bytes) -> Iterator[tuple[int, int, str, bool]]:
    """(member, line_no, text, damaged) of each CSV record: physical lines joined while a quoted field is open.

    A record doesn't go on from one member to the next. Blank lines outside quotes are dropped; line_no counts records.
    """
    number = 0
    for (member, damaged), part in groupby(raw_lines(data), key=lambda x: (x[0], x[2])):
        for text in assemble(x[1] for x in part):
            if text.strip():
                number += 1
                yield member, number, text.removesuffix("\r"), damaged


def lines_of(files: DataFrame) -> DataFrame:
    """Lines of gzip files given as (path, content): file, member, line_no, text, damaged.

    Files named *.csv.gz give records, quote-aware, all others lines. A file is one task, so files should stay at the
    hourly size archives have; the number of files sets the parallelism. No file, no row; NULL content gives no line.
    """
    session.ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name, rows = path.rsplit("/", 1)[-1], []
                for row in (csv_records if name.endswith(".csv.gz") else lines)(content.as_py() or b""):
                    rows.append((name, *row))
                    if len(rows) >= 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW, strict=True)], schema=_ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW, strict=True)], schema=_ARROW)

    return files.select(F.col("path"), F.col("content")).mapInArrow(run, SCHEMA)


def read_archive(spark: SparkSession, folder: str, pattern: str = "*.jsonl.gz") -> DataFrame:
    """Lines of all files of a folder that match the pattern. An empty folder gives an empty table."""
    return lines_of(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder))


def partitions(spark: SparkSession, folder: str, pattern: str = "*.jsonl.gz") -> DataFrame:
    """Names and sizes of the archive's files, in order of name, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes")).orderBy("file")
