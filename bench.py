"""Time the headline queries: median of three runs after a warm-up, into a ``noop`` sink.

Prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores; ``BENCH_ALL=1``
times every registered query once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "mart_sales", "prj_clean", "prj_contract_values", "flt_conditions", "rte_label", "jn_equi_orders", "jn_star", "jn_temporal",
    "jn_point_in_time", "agg_group", "agg_bucket", "agg_distinct_dims", "agg_features", "win_dedupe", "win_rolling_rows",
    "win_rolling_range", "win_cumulative", "win_rank_family", "srt_sort", "sql_chain", "jsn_explode", "jsn_events_to_lines",
    "msk_normalized_hash", "hist_scd2_check", "hist_scd2_effective", "mrg_upsert", "mrg_cdc", "mdl_fact", "mdl_wide_mart",
    "dqc_validate", "dqc_validate_report", "dqc_reconcile_rows", "dqc_profile", "tim_business_day", "snk_merge", "str_window_agg",
]


def main() -> None:
    from millrace.plans import QUERIES
    from millrace.session import build_session

    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    everything = os.environ.get("BENCH_ALL") == "1"
    names = list(QUERIES) if everything else HEADLINE

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times: dict[str, float] = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(1 if everything else 3)), 3)
    print(
        json.dumps(
            {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
             "sf": os.path.basename(path.rstrip("/")), "cpus": int(cpus)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
