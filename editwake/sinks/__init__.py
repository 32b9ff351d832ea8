"""Results as files."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame

RUN_ID = uuid.uuid4().hex[:12]


class WouldOverwrite(RuntimeError):
    """A file that people have worked on is only replaced on request."""


def write_records(df: DataFrame, path: str) -> None:
    """Compressed CSV with a header, quotes doubled as RFC 4180 has it."""
    df.write.mode("overwrite").csv(path, header=True, compression="gzip", escape='"')


def read_records(spark, path: str, schema) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def write_sheet(df: DataFrame, path: str, force: bool = False) -> None:
    """A sheet for people: one CSV file. df is a drawn sample of known size."""
    target = Path(path)
    if target.exists() and not force:
        raise WouldOverwrite(f"{path} exists")
    target.parent.mkdir(parents=True, exist_ok=True)
    df.toPandas().to_csv(target, index=False, encoding="utf-8", lineterminator="\r\n")


def write_labelling(sample: DataFrame, path: str, force: bool = False) -> None:
    """The blind sheet, and its key beside it as <name>.key.csv."""
    target = Path(path)
    if target.exists() and not force:
        raise WouldOverwrite(f"{path} exists")
    target.parent.mkdir(parents=True, exist_ok=True)
    rows = sample.toPandas().sort_values("pair_id")
    sheet = rows[["pair_id", "wiki_a", "title_a", "url_a", "wiki_b", "title_b", "url_b"]].assign(same_subject="", note="")
    sheet.to_csv(target, index=False, encoding="utf-8", lineterminator="\r\n")
    rows[["pair_id", "stratum"]].to_csv(target.with_name(target.stem + ".key.csv"), index=False, encoding="utf-8", lineterminator="\r\n")


def as_document(df: DataFrame) -> list[dict] | dict:
    """A small result as plain values: a row as an object, more as a list."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return rows[0] if len(rows) == 1 else rows


def write_result(folder: str, name: str, payload: dict) -> Path:
    target = Path(folder) / f"{name}.json"
    target.parent.mkdir(parents=True, exist_ok=True)
    body = payload | {"generated_at": datetime.now(UTC).isoformat(timespec="seconds"), "run_id": RUN_ID}
    target.write_text(json.dumps(body, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n", encoding="utf-8")
    return target


def load_results(folder: str) -> dict[str, dict | None]:
    """All results of a folder by name; a missing one is simply not there."""
    return {p.stem: json.loads(p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.json"))}
