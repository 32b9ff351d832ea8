"""How fast the archive is replayed at several core counts, and where the time of a replay goes."""

from __future__ import annotations

import json
import os
import subprocess
import time
from statistics import median

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES, WORKERS, REPEATS = ("parse", "full"), (1, 2, 4), 3
TOP = 15


def digest(rows: DataFrame) -> tuple[int, str]:
    """Rows and a sum of their hashes: the same whatever their order, and another one if any value changes."""
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in rows.columns])
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    got = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(number), F.lit(0)).cast("string")).first()
    return got[0], got[1]


def peak_memory(spark: SparkSession) -> float | None:
    """Greatest resident memory of the JVM so far in MB, where the system tells."""
    pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    try:
        with open(f"/proc/{pid}/status", encoding="ascii") as f:
            return next(round(int(line.split()[1]) / 1024, 1) for line in f if line.startswith("VmHWM"))
    except (OSError, StopIteration):
        return None


def measured(spark: SparkSession, run, events: int, repeats: int = REPEATS) -> dict:
    """Median seconds of run(), which returns the rows to count, after one run to warm up; all runs must agree."""
    seen, seconds = {digest(run())}, []
    for _ in range(repeats):
        start = time.perf_counter()
        seen.add(digest(run()))
        seconds.append(time.perf_counter() - start)
    if len(seen) > 1:
        raise RuntimeError("two runs gave different rows")
    rows, mark = seen.pop()
    middle = median(seconds)
    return {"seconds": round(middle, 3), "events": events, "events_per_second": round(events / middle), "rows": rows, "digest": mark, "peak_rss_mb": peak_memory(spark)}


def scaled(command: list[str], stages=STAGES, workers=WORKERS) -> dict:
    """Every stage at every core count, each in a process of its own that prints its figures as its last line."""
    runs = []
    for stage in stages:
        for cores in workers:
            done = subprocess.run([*command, "bench", "--stage", stage, "--workers", str(cores)], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONHASHSEED": "0"})
            runs.append({"stage": stage, "workers": cores} | json.loads(done.stdout.strip().splitlines()[-1]))
    for stage in stages:
        mine = [r for r in runs if r["stage"] == stage]
        if len({r["digest"] for r in mine}) > 1:
            raise RuntimeError(f"the rows of stage {stage} depend on the number of cores")
        for r in mine:
            r["speed_up"] = round(mine[0]["seconds"] / r["seconds"], 2)
            r["efficiency"] = round(r["speed_up"] * mine[0]["workers"] / r["workers"], 2)
    return {"repeats": REPEATS, "cores": os.cpu_count(), "runs": runs}


def profiled(spark: SparkSession, run) -> dict:
    """Seconds of a run and its dearest stages by task time, each with its own share of all task time."""
    scheduler, store = spark.sparkContext._jsc.sc().dagScheduler(), spark.sparkContext._jsc.sc().statusStore()
    first = scheduler.nextStageId()
    start = time.perf_counter()
    run()
    seconds = time.perf_counter() - start
    stages = []
    for number in range(first, scheduler.nextStageId()):
        try:
            s = store.lastStageAttempt(number)
        except Py4JJavaError:  # never submitted: its output was there already
            continue
        stages.append({"stage": number, "name": s.name(), "tasks": s.numTasks(), "seconds": s.executorRunTime() / 1000})
    whole = sum(s["seconds"] for s in stages)
    top = sorted(stages, key=lambda s: -s["seconds"])[:TOP]
    return {"seconds": round(seconds, 3), "stages": len(stages), "task_seconds": round(whole, 3), "top": [s | {"own_share": round(s["seconds"] / whole, 4) if whole else 0.0} for s in top]}
