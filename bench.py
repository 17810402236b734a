"""Headline queries at one scale factor; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pitgauge.plans import load_all
from pitgauge.session import local_session

HEADLINE = [
    "deteriorating_fastest", "panel_daily_dense", "temporal_features", "wetting_memory", "capped_damage", "trend_last3", "crossings",
    "evidence_timeline", "sequence_windows", "zone_baseline_delta", "monthly_climatology", "distribution_profile", "wet_dry_transitions",
    "pooled_quantiles", "partial_corr", "lag_corr", "two_level_audit", "ppv_attenuation", "fos_score_bands", "nearest_zone", "decisions_by_band",
    "scenario_summary", "quality_rules", "panel_quality_rules", "reg_metrics", "cluster_bootstrap", "confusion_metrics", "brier_ece",
    "raster_slope", "raster_relief", "route_compare", "stream_trend", "stream_daily_rollup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cores, shuffle_partitions=int(cores))
    registry = load_all()
    names = sys.argv[1:] or HEADLINE
    # one untimed scan so that the first query does not pay for the start of the JVM
    registry.QUERIES["extract_integrity"](spark, folder).collect()
    timings = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
            spark.catalog.clearCache()
        timings[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
