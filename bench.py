"""Benchmark: every registered query on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is fully executed (``write.format("noop")``) once to warm up and
then ``$BENCH_RUNS`` times (default 3); the per-query figure is the median.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    os.environ.setdefault("QUARRY_SHUFFLE_PARTITIONS", cpus)

    from quarry.plans import QUERIES
    from quarry.session import build_session

    spark = build_session(master=f"local[{cpus}]", app="quarry-bench")
    names = only or sorted(QUERIES)
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples = []
            for _ in range(runs):
                t0 = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                samples.append(time.perf_counter() - t0)
        except Exception as e:  # report the failure, keep measuring the others
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
            print(f"# {name}: FAILED {errors[name]}", file=sys.stderr)
            continue
        times[name] = round(statistics.median(samples), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_median_query_sec", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
