"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from siteskill.catalog import all_cases
from siteskill.session import local_session

HEADLINE = (
    "e1_regression_stats", "e7_median_and_terciles", "e12_zone_metrics", "e15_hexagon_counts", "e16_kernel_density",
    "e17_correlation_kendall", "f2_runs", "f5_merged_runs", "f6_daily_anomalies", "f7_linear_interpolation",
    "l1_prepare_drivers", "l2_observation_levels", "l5_match_levels", "l7_mean_day_of_year", "l10_anomaly_stats_by_site",
    "l11_evaluate", "l12_density_classes", "l13_rank_correlation_matrix", "l14_align_events_normalised", "l15_score_runs",
    "l17_compare_tables",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "siteskill-bench", settings={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="siteskill-bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    cases = all_cases()
    cases["e1_regression_stats_pooled"].frame(spark, sf_dir).collect()  # start-up is not a query
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        cases[name].frame(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
