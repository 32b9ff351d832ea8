"""Lines that fail to parse, apart from those that load, each with its reason."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwake import session

#: 2001-01-01 and 2036-01-01 UTC.
FIRST_SECOND, END_SECOND = 978_307_200, 2_082_758_400
RECORD_FIELDS = [
    "qid", "rank", "leader_wiki", "leader_title", "leader_timestamp", "follower_wiki", "follower_title", "follower_timestamp",
    "follower_user", "lag_seconds",
]
_DIGITS = re.compile(r"[0-9]+")
_INTEGER = re.compile(r"[+-]?[0-9]+")
_ITEM = re.compile(r"Q[0-9]+")
_BLANKS = " \t\n\r"


class Fault(ValueError):
    """Why a line isn't loaded."""


class Long(str):
    """The digits of an integer that is too long to be worked out as a number."""


def _no_constant(name: str) -> None:
    raise Fault(f"json: {name} is no JSON value")


def _integer_or_long(digits: str) -> int | Long:
    return int(digits) if len(digits) < 4_000 else Long(digits)


_decoder = json.JSONDecoder(parse_constant=_no_constant)
_decoder_of_long = json.JSONDecoder(parse_constant=_no_constant, parse_int=_integer_or_long)
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\]:,])|(")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}


def decode_deep(text: str) -> object:
    """A JSON text of any depth, read with a stack of its own instead of the interpreter's. Same values, same faults."""
    stack: list = []  # open lists and objects; an object with the key that waits for its value
    keys: list[str | None] = []
    at, state, result = 0, "value", None
    while True:
        m = _TOKEN.match(text, at)
        if state == "end" and (not m or m.end() == at):
            break
        if not m:
            raise Fault("json: no JSON value")
        at = m.end()
        mark, quote, number, word = m.groups()
        if state == "end":
            raise Fault("json: more than one value")
        if quote:
            try:
                value, at = json.decoder.scanstring(text, at, True)
            except json.JSONDecodeError as e:
                raise Fault(f"json: {e.msg}") from None
            if state in {"key", "first key"}:
                keys[-1], state = value, "colon"
                continue
        elif number:
            value = _integer_or_long(number) if number.lstrip("-").isdigit() else float(number)
        elif word:
            value = _WORDS[word]
        elif mark in "{[" and state in {"value", "first value"}:
            stack.append({} if mark == "{" else [])
            keys.append(None)
            state = "first key" if mark == "{" else "first value"
            continue
        elif mark == ":" and state == "colon":
            state = "value"
            continue
        elif mark == "," and state == "comma":
            state = "key" if isinstance(stack[-1], dict) else "value"
            continue
        elif (mark == "}" and state in {"first key", "comma"} and isinstance(stack[-1], dict)) or (mark == "]" and state in {"first value", "comma"} and isinstance(stack[-1], list)):
            value = stack.pop()
            keys.pop()
            state = "value"
        else:
            raise Fault(f"json: {mark} out of place")
        if state not in {"value", "first value"}:
            raise Fault("json: value out of place")
        if not stack:
            result, state = value, "end"
        else:
            if isinstance(stack[-1], dict):
                stack[-1][keys[-1]] = value
            else:
                stack[-1].append(value)
            state = "comma"
    if text[at:].strip(_BLANKS):
        raise Fault("json: more than one value")
    return result


def decode_json(text: str) -> object:
    """One RFC 8259 value, blanks around it allowed, or Fault; integers of any length and any depth."""
    text = text.strip(_BLANKS)
    if not text:
        raise Fault("json: nothing")
    try:
        try:
            return _decoder.decode(text)
        except (json.JSONDecodeError, Fault, RecursionError):
            raise
        except ValueError:  # an integer of more digits than the interpreter converts
            return _decoder_of_long.decode(text)
    except RecursionError:
        return decode_deep(text)
    except json.JSONDecodeError as e:
        raise Fault(f"json: {e.msg}") from None


def _integer(text: str) -> int | Long:
    """An integer's value from its digits, zeros in front and a sign allowed; its text where it is too long for a number."""
    digits = text.lstrip("+-").lstrip("0") or "0"
    sign = "-" if text.startswith("-") and digits != "0" else ""
    return int(sign + digits) if len(digits) < 4_000 else Long(sign + digits)


def _second(value: object, field: str) -> int:
    if type(value) is str and _DIGITS.fullmatch(value):
        value = _integer(value)
    if type(value) is not int and not isinstance(value, Long):
        raise Fault(f"{field}: no integer")
    if isinstance(value, Long) or not FIRST_SECOND <= value < END_SECOND:
        raise Fault(f"{field}: outside 2001 to 2035")
    return value


def _big(value: object) -> int | None:
    return value if type(value) is int and -(2**63) <= value < 2**63 else None


def _utf8(text: str) -> str:
    """The text with a replacement mark for each half of a surrogate pair that stands alone, which JSON allows."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def parse_event(text: str) -> dict:
    """Typed fields of an event line, or Fault. Keys that don't decide validity become NULL where their type is wrong."""
    event = decode_json(text)
    if not isinstance(event, dict):
        raise Fault("json: no object")
    meta = event.get("meta")
    if not isinstance(meta, dict):
        raise Fault("meta: no object")
    named = {"event_id": meta.get("id"), "wiki": event.get("wiki"), "title": event.get("title"), "change_type": event.get("type")}
    for field, value in named.items():
        if not isinstance(value, str) or isinstance(value, Long) or not value:
            raise Fault(f"{field}: no text")
        named[field] = _utf8(value)
    revision, length = event.get("revision"), event.get("length")
    revision, length = (x if isinstance(x, dict) else {} for x in (revision, length))
    text_of = lambda x: _utf8(x) if isinstance(x, str) and not isinstance(x, Long) else None
    return named | {
        "ts": _second(event.get("timestamp"), "timestamp"), "namespace": _big(event.get("namespace")), "bot": event.get("bot") is True,
        "user_name": text_of(event.get("user")), "edit_comment": text_of(event.get("comment")), "revision": _big(revision.get("new")),
        "length_old": _big(length.get("old")), "length_new": _big(length.get("new")), "stream_dt": text_of(meta.get("dt")),
    }


def quotes_open(text: str, is_open: bool = False) -> bool:
    """Whether a quoted field is still open after text; a doubled quote closes and opens again."""
    return is_open ^ (text.count('"') % 2 == 1)


def assemble(lines: Iterable[str]) -> Iterator[str]:
    """Records from the physical lines of a CSV file: lines are joined while a quoted field is open.

    A quote that is never closed takes all lines to the end of the file into one faulty record, as it stands.
    """
    held: list[str] = []
    is_open = False
    for line in lines:
        held.append(line)
        is_open = quotes_open(line, is_open)
        if not is_open:
            yield "\n".join(held)
            held = []
    if held:
        yield "\n".join(held)


_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",\r\n]*+)'
_RECORD = re.compile(rf"{_FIELD}(?:,{_FIELD})*+")


def parse_csv(text: str) -> list[str]:
    """The fields of exactly one RFC 4180 record, or Fault. One line end after the record is allowed.

    The physical lines of the text are assembled to records, quote-aware; there must be one. What the strict reader would
    still let pass is checked before it splits the record: a quote inside an unquoted field, a bare carriage return.
    """
    records = list(assemble(text.split("\n")))
    ended = len(records) > 1 and not records[-1]
    if len(records) != 1 + ended:
        raise Fault("csv: not one record")
    body = records[0].removesuffix("\r") if ended else records[0]
    if ('"' in body or "\r" in body or "\n" in body) and not _RECORD.fullmatch(body):
        raise Fault("csv: quote or line break out of place")
    try:
        rows = list(csv.reader(io.StringIO(body, newline=""), strict=True))
    except csv.Error as e:
        raise Fault(f"csv: {e}") from None
    if len(rows) > 1:
        raise Fault("csv: not one record")
    return rows[0] if rows else [""]


csv.field_size_limit(2**31 - 1)


def parse_record(text: str) -> dict:
    """Typed fields of a propagation record line, or Fault."""
    fields = parse_csv(text)
    if len(fields) != len(RECORD_FIELDS):
        raise Fault("csv: fewer than ten fields" if len(fields) < len(RECORD_FIELDS) else "csv: more than ten fields")
    row: dict = dict(zip(RECORD_FIELDS, fields, strict=True))
    if not _ITEM.fullmatch(row["qid"]):
        raise Fault("qid: no item")
    for field in ("rank", "leader_timestamp", "follower_timestamp", "lag_seconds"):
        if not _INTEGER.fullmatch(row[field]):
            raise Fault(f"{field}: no integer")
        row[field] = _integer(row[field])
    if str(row["rank"]).startswith("-") or row["rank"] in (0, 1):
        raise Fault("rank: below 2")
    for field in ("leader_wiki", "follower_wiki"):
        if not row[field]:
            raise Fault(f"{field}: empty")
    for field in ("leader_timestamp", "follower_timestamp"):
        _second(row[field], field)
    beyond = []
    for field, bits in (("rank", 31), ("lag_seconds", 63)):
        if isinstance(row[field], Long) or not -(2**bits) <= row[field] < 2**bits:
            beyond.append(f"{field}={row[field]}")
            row[field] = None
    return row | {"beyond": ",".join(beyond) or None}


EVENT = (
    "event_id string, wiki string, title string, change_type string, ts bigint, namespace bigint, bot boolean, user_name string, "
    "edit_comment string, revision bigint, length_old bigint, length_new bigint, stream_dt string"
)
RECORD = (
    "qid string, rank int, leader_wiki string, leader_title string, leader_timestamp bigint, follower_wiki string, "
    "follower_title string, follower_timestamp bigint, follower_user string, lag_seconds bigint, beyond string"
)
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _struct(ddl: str) -> pa.StructType:
    return pa.struct([(n, _KINDS[t]) for n, t in (x.split() for x in ddl.split(","))])


def parsed(lines: DataFrame, file: str = "file", line_no: str = "line_no", text: str = "text") -> DataFrame:
    """Every line: file, line_no, reason (NULL where it loads), and its typed fields in event or record.

    *.jsonl.gz and *.jsonl hold events, *.csv.gz and *.csv records; lines of other files, and NULL lines, have a reason of
    their own. A rank or lag that the column's type can't hold is a valid integer: the column is NULL then, and beyond
    holds the number as text. Lines are parsed where they lie, without a shuffle; the structure is checked first, then each typed field.
    """
    schema = pa.schema([("file", pa.string()), ("line_no", pa.int64()), ("reason", pa.string()), ("event", _struct(EVENT)), ("record", _struct(RECORD))])

    def parse(name: str | None, line: str | None) -> tuple[str | None, dict | None, dict | None]:
        try:
            if line is None:
                raise Fault("line: missing")
            if name and name.endswith((".jsonl.gz", ".jsonl")):
                return None, parse_event(line), None
            if name and name.endswith((".csv.gz", ".csv")):
                return None, None, parse_record(line)
            raise Fault("file: unknown kind")
        except Fault as e:
            return str(e)[:200], None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                names, numbers, texts = (c.to_pylist() for c in batch.slice(start, 2_000).columns)
                got = [parse(n, t) for n, t in zip(names, texts, strict=True)]
                reasons, events, records = zip(*got, strict=True)
                yield pa.RecordBatch.from_pydict(
                    {"file": names, "line_no": numbers, "reason": reasons, "event": events, "record": records}, schema=schema
                )

    session.ship(lines.sparkSession)
    chosen = lines.select(F.col(file).alias("file"), F.col(line_no).cast("bigint").alias("line_no"), F.col(text).alias("text"))
    return session.widened(chosen).mapInArrow(run, f"file string, line_no bigint, reason string, event struct<{_colons(EVENT)}>, record struct<{_colons(RECORD)}>")


def _colons(ddl: str) -> str:
    return ", ".join(":".join(x.split()) for x in ddl.split(","))


def faulty(lines: DataFrame) -> DataFrame:
    return parsed(lines).where("reason is not null").select("file", "line_no", "reason")


def events(lines: DataFrame) -> DataFrame:
    return parsed(lines).where("event is not null").select("file", "line_no", "event.*")


def records(lines: DataFrame) -> DataFrame:
    return parsed(lines).where("record is not null").select("file", "line_no", "record.*")


def reasons(lines: DataFrame) -> DataFrame:
    """Lines per kind of file and of fault, which is the part of the line that fails first; valid lines under NULL."""
    kind = F.when(F.col("file").rlike(r"\.jsonl(\.gz)?$"), "events").when(F.col("file").rlike(r"\.csv(\.gz)?$"), "records").otherwise("other")
    part = F.substring_index("reason", ":", 1)
    return parsed(lines).groupBy(kind.alias("kind"), part.alias("reason")).agg(F.count(F.lit(1)).alias("lines"))
