"""Numbers and tables as text, for reports."""

from __future__ import annotations

from collections.abc import Sequence

PENDING = "_pending_"


def number(value: float | None, digits: int = 0) -> str:
    return "-" if value is None else f"{value:,.{digits}f}"


def percent(part: float | None, digits: int = 1) -> str:
    return "-" if part is None else f"{part * 100:.{digits}f}%"


def duration(seconds: float | None) -> str:
    """Seconds below a minute and a half, minutes and seconds below an hour and a half, else hours and minutes."""
    if seconds is None:
        return "-"
    sign, whole = ("-" if seconds < 0 else ""), abs(round(seconds))
    if whole < 90:
        return f"{sign}{whole}s"
    if whole < 90 * 60:
        return f"{sign}{whole // 60}m {whole % 60:02d}s"
    return f"{sign}{whole // 3600}h {whole % 3600 // 60:02d}m"


def counted(n: int, one: str, many: str | None = None) -> str:
    return f"{n:,} {one if n == 1 else many or one + 's'}"


def ordinal(n: int) -> str:
    ending = "th" if n % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    return f"{n}{ending}"


def table(head: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    if not rows:
        return PENDING
    clean = lambda x: str(x).replace("|", "\\|")
    lines = ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(map(clean, r)) + " |" for r in rows])
