"""Time the headline queries: one JSON line with seconds per query (warm run).

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every result is computed in full and
thrown away (noop sink).
"""

from __future__ import annotations

import json
import os
import time

from marketloom.registry import QUERIES
from marketloom.session import build_session

HEADLINE = [
    "fct_orders",
    "fct_order_items",
    "dim_customers",
    "store_performance",
    "revenue_daily",
    "revenue_monthly",
    "refunds",
    "customer_ltv",
    "cohort_analysis",
    "campaign_performance",
    "last_touch",
    "channel_attribution",
    "customer_acquisition",
    "inventory_positions",
    "revenue_by_channel_monthly",
    "customer_segment_performance",
    "monthly_p_and_l",
    "metric_month_over_month",
    "semantic_revenue",
    "check_row_rules",
    "check_relationships",
    "check_exclusive_ranges",
    "check_sequential_days",
    "deduplicate",
    "pivot_distinct",
    "unpivot",
    "histogram",
    "url_report",
    "diff_summary_lines",
    "diff_columns_repeated_keys",
    "diff_classify_lines",
    "which_columns_differ_lines",
    "tables_identical",
    "upsert_result",
    "metric_across_facts",
    "declared_checks",
    "scd2_result",
    "stream_latest_purchase",
    "incremental_campaign_performance",
]


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = os.environ.get("BENCH_ONLY")
    names = only.split(",") if only else HEADLINE
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g"
    )
    queries = {}
    for name in names:
        seconds(spark, name, folder)  # warm-up
        queries[name] = round(min(seconds(spark, name, folder) for _ in range(runs)), 3)
    line = {
        "metric": "headline queries, warm run, total",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
