"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``facts_build`` reads all contents and stores the facts; each query over them is run RUNS times. ``queries`` has the medians, ``first``
the first runs, in which the relations (or the index) that a query is the first to need are computed and stored too. A query that
takes longer than LIMIT seconds is cancelled and listed in ``stopped``; each query's line goes to stderr as it finishes.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import threading
import time

from pyspark.sql import SparkSession

from loam.operators import registry
from loam.plans.engine import Engine

RUNS, LIMIT, WHOLE = 3, 90, 1200
HEADLINE = (
    "flagship_surfaces", "s6_file_facts", "c1_classify_file", "a1_metrics", "a11_health", "i1_i7_issues", "sc2_file_risks", "sc3_hotspots",
    "c25_test_coverage", "a6_components", "a7_frameworks", "j1_snapshot_diff", "r1_retrieve_files", "w14_snippets", "a13_degree", "w16_sc6_ranked_suggestions",
    "sc10_sc11_understanding", "w18_o10_contexts", "r1_index_ranking", "a24_fleet_audit", "s24_fleet_suggestions", "s1_s9_incremental_scan", "st6_st7_versions",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    began = time.perf_counter()

    def timed(run) -> float | None:
        """Seconds; None if the limit stopped it."""
        stop = threading.Timer(LIMIT, spark.sparkContext.cancelAllJobs)
        stop.start()
        at = time.perf_counter()
        try:
            run()
        except Exception as e:  # noqa: BLE001  (a cancelled job arrives as whatever the query made of it)
            print(f"{type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
            return None
        finally:
            stop.cancel()
        return time.perf_counter() - at

    times: dict[str, float] = {}
    first: dict[str, float] = {}
    stopped: list[str] = []
    build = timed(lambda: Engine.from_documents(spark, sf_dir))
    times["facts_build"] = round(build, 3) if build is not None else float(LIMIT)
    for name in HEADLINE:
        if time.perf_counter() - began > WHOLE:
            stopped.append(name)
            continue
        runs: list[float] = []
        for _ in range(RUNS):
            t = timed(lambda name=name: registry.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
            if t is None:
                break
            runs.append(t)
        if len(runs) < RUNS:
            stopped.append(name)
        if runs:
            times[name], first[name] = round(statistics.median(runs), 3), round(runs[0], 3)
        print(name, [round(t, 3) for t in runs], file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "first": first, "stopped": stopped, "sf": sf, "spark": spark.version, "cpus": cpus, "driver_memory": "8g"}))
    spark.stop()


if __name__ == "__main__":
    main()
