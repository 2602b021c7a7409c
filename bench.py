"""Time the headline queries: one JSON line, warm median seconds per query.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8) and
``BENCH_RUNS`` (default 3) set data, cores and repetitions.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from insolara import build_session
from insolara.plans import PLANS

HEADLINE = [
    "verify_by_station", "station_hour_mean", "hour_mean_by", "corr_by_slice_hour", "box_stats",
    "completeness", "missing_map", "hourly_uncertainty", "align_sources", "merge_time", "extract_at_stations",
    "cell_hour_mean", "station_hour_cloud_bias", "solar_zenith", "histogram", "linear_regression", "pca_variance",
    "gmm_fit", "mlp_predict", "mlp_train",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for attempt in range(runs + 1):
            began = time.perf_counter()
            PLANS[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken), 4)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of warm medians", "value": round(sum(times.values()), 4),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
