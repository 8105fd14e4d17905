"""Summarise a Spark event log by job description: jobs, stages, busiest stages.

usage: python scripts/stage_times.py <event-log-file>
"""

from __future__ import annotations

import json
import sys
from collections import defaultdict


def _lines(path: str):
    """Lines of an event log file, or of every part of a rolling (v2) log directory."""
    import os
    files = ([os.path.join(path, f) for f in sorted(os.listdir(path)) if f.startswith("events")]
             if os.path.isdir(path) else [path])
    for f in files:
        if f.endswith(".zstd"):
            import io

            import zstandard
            with open(f, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(f, encoding="utf-8") as fh:
                yield from fh


def main(path: str) -> None:
    job_desc, stage_job, stages = {}, {}, {}
    for line in _lines(path):
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerJobStart":
            desc = (ev.get("Properties") or {}).get("spark.job.description", "-")
            job_desc[ev["Job ID"]] = desc
            for sid in ev.get("Stage IDs", []):
                stage_job[sid] = ev["Job ID"]
        elif kind == "SparkListenerStageCompleted":
            info = ev["Stage Info"]
            if "Completion Time" in info and "Submission Time" in info:
                stages[info["Stage ID"]] = (info["Completion Time"] - info["Submission Time"],
                                            info["Stage Name"], info.get("Number of Tasks", 0))
    per = defaultdict(list)
    for sid, (ms, name, tasks) in stages.items():
        per[job_desc.get(stage_job.get(sid), "-")].append((ms, sid, name, tasks))
    for desc, items in sorted(per.items(), key=lambda kv: -sum(i[0] for i in kv[1])):
        total = sum(i[0] for i in items)
        print(f"{desc:40s} stages={len(items):3d} stage_ms={total}")
        for ms, sid, name, tasks in sorted(items, reverse=True)[:3]:
            print(f"    {ms:7d} ms  stage {sid:4d}  tasks={tasks:4d}  {name[:70]}")


if __name__ == "__main__":
    main(sys.argv[1])
