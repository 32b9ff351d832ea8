"""Settings, as data classes and from a TOML file."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

# Editions, change types and text marks that results depend on.
EDITIONS = (
    "enwiki", "dewiki", "frwiki", "eswiki", "ptwiki", "itwiki", "nlwiki", "plwiki", "ruwiki", "svwiki", "trwiki", "arwiki",
    "fawiki", "hiwiki", "idwiki", "jawiki", "kowiki", "zhwiki",
)
REVERT_PATTERNS = (
    r"(?i)\brevert", r"(?i)\bundid\b", r"(?i)\brv\b", "(?i)rückgängig", "(?i)annul", "(?i)отмен", "(?i)deshecha", "(?i)revertid", "取り消し", "撤销",
    "되돌림",
)
DISAMBIGUATION_MARKS = (
    "(disambiguation)", "(desambiguación)", "(homonymie)", "(Begriffsklärung)", "(disambigua)", "(значения)", "(曖昧さ回避)", "(消歧义)",
)


@dataclass(frozen=True)
class Filters:
    editions: tuple[str, ...] = EDITIONS
    namespaces: tuple[int, ...] = (0,)
    change_types: tuple[str, ...] = ("edit", "new")
    dedupe_window: int = 20_000


@dataclass(frozen=True)
class Propagation:
    watermark: int = 21_600
    reorder: int = 120
    warmup: int = 21_600
    horizon: int = 86_400
    ranks: tuple[int, ...] = (2, 3, 5)
    min_samples: int = 20


@dataclass(frozen=True)
class Resolution:
    block: int = 5_000
    batch: int = 50
    max_retries: int = 6
    backoff_first: float = 1.0
    backoff_most: float = 60.0


@dataclass(frozen=True)
class Triage:
    bot_user: str = r"(?i)bot\b"
    reverts: tuple[str, ...] = REVERT_PATTERNS
    disambiguation: tuple[str, ...] = DISAMBIGUATION_MARKS
    trivial_bytes: int = 10
    candidates: int = 60
    seed: int = 20260914


@dataclass(frozen=True)
class Labels:
    sample: int = 200
    seed: int = 20260913


@dataclass(frozen=True)
class Archive:
    reconnect_first: float = 1.0
    reconnect_most: float = 60.0
    read_timeout: float = 60.0


@dataclass(frozen=True)
class Config:
    filters: Filters = field(default_factory=Filters)
    propagation: Propagation = field(default_factory=Propagation)
    resolution: Resolution = field(default_factory=Resolution)
    triage: Triage = field(default_factory=Triage)
    labels: Labels = field(default_factory=Labels)
    archive: Archive = field(default_factory=Archive)


def _build(kind: type, values: dict, path: str = ""):
    known = {f.name: f for f in fields(kind)}
    if extra := set(values) - set(known):
        raise KeyError(f"unknown setting {path}{sorted(extra)[0]}")
    made = {}
    for name, value in values.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else known[name].default
        if is_dataclass(default):
            made[name] = _build(type(default), value, f"{path}{name}.")
        else:
            made[name] = tuple(sorted(value) if name == "ranks" else value) if isinstance(default, tuple) else value
    return kind(**made)


def load(path: str | os.PathLike | None = None) -> Config:
    """Settings from the path given, else from the file that $EDITWAKE_CONFIG names, else the defaults. Unknown names are errors."""
    chosen = path or os.environ.get("EDITWAKE_CONFIG")
    return _build(Config, tomllib.loads(Path(chosen).read_text(encoding="utf-8"))) if chosen else Config()


DEFAULT = Config()
