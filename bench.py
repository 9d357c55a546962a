"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "flagship_agreement", "p05_paired_dataset", "a01_a02_bias_table", "j11_apply_bias", "a03_a04_error_metrics",
    "a05_a06_confusion", "a08_u02_paired_cycles", "a10_doy_histogram", "o02_select_models", "j03_nearest_match",
    "w07_collapsed_turns", "w10_f06_densify", "w11_shifted_sample", "j09_merge_timeline", "f18_w12_rank_sections",
    "x02_decompose", "w14_a25_best_solution", "j14_a24_fit_source", "s01_p01_station_text", "s12_s10_observation_sink",
    "t01_t05_observation_stream",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from seastate.plans.catalog import QUERIES
    from seastate.session import local_session

    spark = local_session(CPUS, int(CPUS), "seastate-bench")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    # One small run first, so that starting the engine is not charged to the first query.
    QUERIES["f01_units"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    took = {}
    for n in names:
        t = time.perf_counter()
        QUERIES[n](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[n] = round(time.perf_counter() - t, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(n, took[n], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
                      "cores": CPUS, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
