"""Time the headline queries: median of warm runs, results written to a sink that discards them."""

from __future__ import annotations

import json
import os
import statistics
import time

from daypanel.session import local_session
from workload.queries import QUERIES

HEADLINE = (
    "report_current",
    "enrich_country",
    "enrich_district",
    "trend_class",
    "scenario_recurrent",
    "scenario_exponential",
    "loess_rate",
    "loess_growth",
    "report_totals",
    "report_estimators",
    "report_trajectory",
    "report_district_table",
    "recovery_estimate",
    "weekday_box",
    "category_order",
    "null_safe_left_join",
    "scan_wide_unpivot",
    "scan_folder_distinct",
    "html_tables_promote",
    "json_items",
    "ratio_two_dims",
    "ratio_by_band",
    "ratio_of_sums_band",
    "topk_ties",
)


def run(spark, sf: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = os.environ["BENCH_QUERIES"].split(",") if "BENCH_QUERIES" in os.environ else HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, sf, name)
        times[name] = round(statistics.median(run(spark, sf, name) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median warm query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
                "cpus": int(cpus),
                "runs": repeats,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
