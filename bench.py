"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the
timed runs per query (the median counts) after one warm-up run of the same query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "audit_kpis",
    "pii_access_by_user",
    "apply_masks_reader",
    "row_keys",
    "retention_compliance",
    "compliance_metrics_rollup",
    "merge_table_edges",
    "trace_tables_up",
    "trace_columns_down",
    "search_tables",
    "find_subject_copies_scored",
    "erase_survivors",
    "restore_rows",
    "pre_delete_version",
    "disclosure",
    "reports",
)


def main() -> None:
    from stewardry.plans import registry
    from stewardry.session import build_session, scratch

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        app="bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        timed = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            with scratch(spark):
                registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                took = time.perf_counter() - start
            if attempt:
                timed.append(took)
        seconds[name] = round(statistics.median(timed), 3)
    result = {
        "metric": "headline queries, total of median warm runs",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1].strip("/"),
        "cpus": cpus,
        "runs": runs,
        "spark": spark.version,
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
