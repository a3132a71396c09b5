"""Summarise the executed (adaptive, final) physical plan of every registered query.

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md
Each query is run once, then ``explain("formatted")`` of the same DataFrame
shows AQE's final plan; the table counts its operators.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.plans import QUERIES  # noqa: E402
from quarry.session import build_session  # noqa: E402

PATTERNS = {
    "shuffles": r"\bShuffleQueryStage \(",
    "broadcasts": r"\bBroadcastQueryStage \(",
    "smj": r"\bSortMergeJoin\b",
    "bhj": r"\bBroadcastHashJoin\b",
    "windows": r"\bWindow \(",
    "python": r"\b(?:MapInPandas|PythonMapInArrow|ArrowEvalPython|MapInArrow) \(",
    "cartesian": r"\b(?:CartesianProduct|BroadcastNestedLoopJoin)\b",
}


def final_tree(plan: str) -> list[str]:
    """Tree lines of the final adaptive plan(s), including subquery plans."""
    out, keep = [], True
    for line in plan.splitlines():
        if "== Initial Plan ==" in line:
            keep = False
        elif "== Final Plan ==" in line:
            keep = True
        elif line.startswith("("):  # node details section begins
            break
        elif keep:
            out.append(line)
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    print(f"# Executed plans ({sf})\n")
    print("Counts from the final adaptive plan of each query (after it ran). `scans with pushed filters`")
    print("lists the parquet scans that received filters; `read cols` is the widest ReadSchema.\n")
    print("| query | shuffles | broadcasts | SMJ | BHJ | windows | python | cartesian | scans with pushed filters | read cols |")
    print("|---|---|---|---|---|---|---|---|---|---|")
    for name in sorted(QUERIES):
        df = QUERIES[name](spark, sf)
        df.collect()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        plan = buf.getvalue()
        lines = final_tree(plan)
        counts = {k: sum(1 for l in lines if re.search(p, l)) for k, p in PATTERNS.items()}
        lines = plan.splitlines()
        pushed = sum(1 for l in lines if l.startswith("PushedFilters: [") and l != "PushedFilters: []")
        widths = [len(m.split(",")) for m in re.findall(r"ReadSchema: struct<(.*)>", plan)]
        print(f"| `{name}` | {counts['shuffles']} | {counts['broadcasts']} | {counts['smj']} | {counts['bhj']} | "
              f"{counts['windows']} | {counts['python']} | {counts['cartesian']} | {pushed} | "
              f"{max(widths) if widths else 0} |")


if __name__ == "__main__":
    main()
