"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then twice; the faster run counts. The result
is written to the noop sink, so that every row and column is produced.
"""

from __future__ import annotations

import json
import os
import time

from asclera import registry
from asclera.session import local_session

HEADLINE = [
    "JN-03", "WN-01", "WN-05", "WN-06", "WN-09", "WN-11", "V-09", "V-10", "V-11", "V-12", "V-15", "PF-01", "PV-01", "PV-02", "PV-03", "PV-05",
    "SE-03", "SE-04", "SE-05", "SV-03", "SV-04", "CL-03", "CL-04", "CL-07", "FH-02", "FH-11", "DOC-03", "DOC-17", "TX-01", "TX-02", "GV-06",
    "AG-17", "AG-18", "FE-02", "SC-02", "SC-04", "VA-02", "MO-04", "MO-10", "SEM-04", "SS-04", "SS-07",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, "16g", **{"spark.sql.shuffle.partitions": cpus})
    queries = registry.callables()
    taken: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        taken[name] = round(min(times[1:]), 3)
    line = {
        "metric": "headline_total",
        "value": round(sum(taken.values()), 3),
        "unit": "sec",
        "queries": taken,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus) if cpus.isdigit() else cpus,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
