"""Time the headline queries; prints one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
Each query is built, planned and run in full to a sink that discards rows. Times also go to
standard error as they are taken. A query over EACH seconds is stopped and named in "stopped",
as is one that is running when ALL seconds are over; those after it are named in "not_begun". So
a slow query does not take the figures of the others with it.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

from pyspark.sql import SparkSession

from freshet.bindings.registry import QUERIES

EACH, ALL = 400, 1600
HEADLINE = (
    "clean_samples",
    "flow_percent_rank",
    "lowflow_flag",
    "seasonal_lowflow_masked",
    "season_pivot",
    "season_count_with_total",
    "cq_regression",
    "regression_compare",
    "transport_behavior",
    "regression_scenarios",
    "flow_weighted_daily",
    "sites_above_threshold",
    "field_event_summary",
    "attribute_bundle_join",
    "fuzzy_describe",
    "column_summary",
    "boxplot_stats",
    "exact_split",
    "standardize_train_stats",
    "forest_impute",
    "forest_fit_predict",
    "permutation_importance",
    "partial_dependence",
    "forest_tune",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("freshet-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["season_sample_count"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    taken, stopped, not_begun, began = {}, [], [], time.perf_counter()
    for name in HEADLINE:
        left = ALL - (time.perf_counter() - began)
        if left < 10:
            not_begun.append(name)
            continue
        start, late = time.perf_counter(), threading.Event()

        def stop() -> None:
            late.set()  # noqa: B023  called before the next round
            while not over.wait(1):  # noqa: B023  a fit may begin jobs after those cancelled
                spark.sparkContext.cancelAllJobs()

        over, timer = threading.Event(), threading.Timer(min(EACH, left), stop)
        timer.start()
        try:
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception:
            if not late.is_set():
                raise
        finally:
            timer.cancel()
            over.set()
        if late.is_set():
            stopped.append(name)
        else:
            taken[name] = round(time.perf_counter() - start, 3)
        print(name, taken.get(name, "stopped"), file=sys.stderr, flush=True)
    report = {
        "metric": "headline queries, total wall time",
        "value": round(sum(taken.values()), 3),
        "unit": "sec",
        "queries": taken,
        "stopped": stopped,
        "not_begun": not_begun,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report), flush=True)


if __name__ == "__main__":
    main()
