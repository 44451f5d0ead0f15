"""Wall time of the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; one JSON line on standard output.

BENCH_QUERIES may hold names separated by commas, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "e0_suspicious_meter_ranking", "a1_time_range_scan", "b3_impute_peer_median", "b4_duplicate_removal", "c6_power_factor",
    "d2_peer_join", "d3_topology_join", "d13_audit_lineage", "d16_as_of_weather", "e1_row_lags", "e2_rolling_statistics",
    "e7_register_rollback", "e12_last_rows_per_meter", "e15_alert_ranks", "f4_hourly_rollup", "f7_daily_vector", "f8_kpi_row",
    "f10_zone_summary", "f16_grid_rollup", "g3_top_alerts_per_zone", "h2_profile_vectors", "h7_nearest_centroid",
    "i15_sigma_and_fences", "i16_pattern_rules", "j3_feeder_balance", "j4_neighbour_means", "k1_hash_chain", "l2_stream_hourly_rollup",
    "e0_feature_table", "i1_isolation_forest", "i7_theft_classifier", "m1_stability_index", "m8_roc_auc_and_average_precision", "n4_conformal_intervals", "n18_cause_table",
]


def main() -> None:
    from meterlake.plans import catalog
    from meterlake.session import get_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.TemporaryDirectory(prefix="meterlake-bench-")
    parts = int(cpus) if cpus.isdigit() else 8
    spark = get_session("meterlake-bench", master=f"local[{cpus}]", shuffle_partitions=parts, scratch=scratch.name)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load_all()
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE

    # start the JVM, the Python workers and the code cache before the clock
    catalog.QUERIES["f4_hourly_rollup"](spark, folder).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr)
    line = {
        "metric": "headline_wall_time",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()
    scratch.cleanup()


if __name__ == "__main__":
    main()
