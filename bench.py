"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tagloom.catalog.queries import QUERIES
from tagloom.session import local_session

HEADLINE = [
    "element_usages",
    "attributed_usages",
    "attributed_join",
    "usage_location",
    "usage_summary",
    "prop_levels",
    "event_prop_levels",
    "prop_combos",
    "combo_pivot",
    "directory_rollup",
    "first_match",
    "match_anchor",
    "stored_rules",
    "skeleton_rewrites",
    "variant_counts",
    "rule_applied",
    "imports_rewired",
    "changed_files",
    "line_changes",
    "document_line_changes",
    "run_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    for name in ("variant_counts", "changed_files"):  # start the session and warm it up before the clock runs
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
