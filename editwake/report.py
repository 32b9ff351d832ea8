"""A markdown report from result documents, and its place in a README."""

from __future__ import annotations

from pathlib import Path

from editwake.functions.text import PENDING, counted, duration, number, ordinal, percent, table

BEGIN, END = "<!-- results:begin -->", "<!-- results:end -->"


def _rows(value) -> list[dict]:
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def archive_section(r: dict | None) -> str:
    if not r:
        return PENDING
    gaps = sorted(_rows(r.get("gaps")), key=lambda g: (-g["minutes"], g["gap_start"]))
    lines = [
        f"{counted(r['events'], 'event')} in {counted(r['files'], 'file')}, {r.get('first_event')} to {r.get('last_event')}; "
        f"{number(r['undecodable'])} undecodable ({percent(r.get('undecodable_rate'), 3)}), {counted(r['damaged_members'], 'damaged member')}; "
        f"{counted(len(gaps), 'gap')} of {counted(sum(g['minutes'] for g in gaps), 'minute')} in all."
    ]
    return "\n\n".join(lines + ([table(["longest gaps from", "minutes"], [[g["gap_start"], g["minutes"]] for g in gaps[:3]])] if gaps else []))


def resolution_section(r: dict | None) -> str:
    if not r:
        return PENDING
    return table(["figure", "value"], [
        ["edits with an item", f"{number(r.get('with_item'))} ({percent(r.get('rate'))})"], ["lookups", number(r.get("references"))],
        ["answered from memory", f"{number(r.get('cache_hits'))} ({percent(r.get('cache_hit_rate'))})"], ["known to have no item", number(r.get("negative_cache_hits"))],
        ["shared within a block", number(r.get("coalesced"))], ["read from the snapshot", number(r.get("store_hits"))], ["unknown", number(r.get("offline_unresolved"))],
    ])


def baseline_section(r: dict | None) -> str:
    if not r:
        return PENDING
    rows = [
        [name, number(r.get(f"{key}_pairs")), percent(r.get(f"{key}_precision")), percent(r.get(f"{key}_recall"))]
        for name, key in (("equal titles", "naive"), ("same item", "wikidata"))
    ]
    missed = f"Titles alone miss {number(r.get('missed_by_naive'), 1)} true pairs ({percent(r.get('share_missed_by_naive'))})."
    return "\n\n".join([f"{counted(r.get('labelled', 0), 'label')}, {number(r.get('unlabelled'))} open.", table(["method", "pairs", "precision", "pooled recall"], rows), missed])


def propagation_section(r: dict | None, top: int = 15) -> str:
    if not r:
        return PENDING
    s = r.get("statistics") or {}
    parts = [
        f"{counted(s.get('windows_opened', 0), 'window')}, {number(s.get('warmup_windows'))} in the warm-up, {number(s.get('windows_open_at_end'))} still open; "
        f"{percent(s.get('never_propagated'))} of the rated ones never reached a second edition; late follow-ups {percent(s.get('late_followup_rate'))}; "
        f"bots made {percent(s.get('bot_share'))} of the edits in windows of several editions.",
        table(["edition", "records", "median", "95th percentile"], [
            [ordinal(x["rank"]), number(x["n"]), duration(x["median_seconds"]), duration(x["p95_seconds"])] for x in sorted(_rows(r.get("lag_by_rank")), key=lambda x: x["rank"])]),
        table(["leader", "follower", "records", "median", "95th percentile"], [
            [x["leader_wiki"], x["follower_wiki"], number(x["n"]), duration(x["median_seconds"]), duration(x["p95_seconds"])]
            for x in sorted(_rows(r.get("lag_by_pair")), key=lambda x: (-x["n"], x["leader_wiki"], x["follower_wiki"]))[:top]]),
        table(["edition", "windows", "leads", "expected", "lift", "median follow lag"], [
            [x["wiki"], number(x["windows"]), percent(x["lead_rate"]), percent(x["expected_lead_rate"]), number(x["lead_lift"], 3), duration(x["median_follow_lag_seconds"])]
            for x in sorted(_rows(r.get("editions")), key=lambda x: (-x["lead_lift"], x["wiki"]))]),
    ]
    return "\n\n".join(parts)


def performance_section(before: dict | None, after: dict | None) -> str:
    if not after:
        return PENDING
    old = {(x["stage"], x["workers"]): x for x in _rows((before or {}).get("runs"))}
    rows = []
    for x in sorted(_rows(after.get("runs")), key=lambda x: (x["stage"], x["workers"])):
        was = old.get((x["stage"], x["workers"]))
        if before and was is None:
            raise ValueError(f"the run before has no {x['stage']} with {x['workers']} workers")
        rows.append([x["stage"], x["workers"], number(x["events_per_second"]), number(was["events_per_second"]) if was else PENDING, number(x["speed_up"], 2), number(x["efficiency"], 2)])
    return table(["stage", "cores", "events/s", "events/s before", "speed-up", "efficiency"], rows)


def triage_section(r: dict | None) -> str:
    if not r:
        return PENDING
    rows = sorted(_rows(r.get("categories")), key=lambda x: (-x["cases"], x["category"]))
    head = f"{number(r.get('reviewed'))} of {counted(r.get('candidates', 0), 'candidate')} reviewed, {number(r.get('confirmed_wrong'))} wrong; the suggestion stood in {percent(r.get('heuristic_agreement'))}."
    return head + "\n\n" + table(["category", "cases", "ids"], [[x["category"], x["cases"], ", ".join(x["case_ids"])] for x in rows])


def render(results: dict[str, dict | None]) -> str:
    """The whole report; what has no result yet is marked as pending."""
    of = results.get
    parts = [
        ("Data", archive_section(of("archive"))), ("Resolution", resolution_section(of("resolve"))), ("Baseline", baseline_section(of("baseline"))),
        ("Propagation", propagation_section(of("propagation"))), ("Performance", performance_section(of("bench_before"), of("bench_after"))), ("Wrong records", triage_section(of("failures"))),
    ]
    return "\n\n".join(f"### {name}\n\n{body}" for name, body in parts)


def splice(path: str, body: str) -> bool:
    """Puts the report between the marks of a file; True if that changed it. Missing marks are an error."""
    file = Path(path)
    text = file.read_text(encoding="utf-8")
    start, end = text.find(BEGIN), text.find(END)
    if start < 0 or end < start:
        raise ValueError(f"{path} lacks the marks {BEGIN} and {END}")
    new = text[: start + len(BEGIN)] + "\n" + body + "\n" + text[end:]
    if new != text:
        file.write_text(new, encoding="utf-8")
    return new != text
