"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

``queries`` holds the first run of each, plan and data together; ``build`` the
part of it in which the plan is made, ``second`` a repeated run.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from rolesift.plans import QUERIES
from rolesift.session import build_session

HEADLINE = [
    "A3_run_quality",
    "F2_url_quality_gate",
    "W2_distinct_in_order",
    "W3_discovery_state",
    "W1_dedupe_batch",
    "C1_qualify",
    "M1_upsert_postings",
    "A7_build_source_registry",
    "W5_select_endpoints",
    "X3_build_postings",
]
#: The given files hold one row group each, which one task must read; a lake's tables have many files.
SPREAD = ["events", "orders", "pages", "documents", "part", "customer", "supplier", "nation", "region", "lineitem", "labels"]


def spread(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables in as many files as there are cores; not timed."""
    at = tempfile.mkdtemp(prefix="bench-")
    for name in SPREAD:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{at}/{name}.parquet")
    return at


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = spread(spark, sf_dir, int(cpus))
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    seconds, build, second = {}, {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        made = QUERIES[name](spark, tables)
        build[name] = round(time.perf_counter() - start, 3)
        run(made)
        seconds[name] = round(time.perf_counter() - start, 3)
        start = time.perf_counter()
        run(QUERIES[name](spark, tables))
        second[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "build": build, "second": second, "sf": sf_dir}))


if __name__ == "__main__":
    main()
