"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Every query runs
twice to a sink that discards its rows; the faster run counts.
"""

from __future__ import annotations

import json
import os
import time

from sowmill.bind import registry
from sowmill.session import local_session

HEADLINE = [
    "pj14_format_staffing", "pj25_validate", "ag07_client_summary", "ag09_summary_metrics", "ag12_department_usage",
    "ag17_word_frequency", "ag20_fte_by_department", "cl09_requirements", "cl14_org_role", "jn05_item_mentions",
    "jn09_compare_extractions", "sc07_cells_to_matrix", "sc13_upsert", "se01_keyword_search", "se05_fuzzy_match", "se09_knn",
    "se19_multi_search_exact_first", "tx13_taxonomy_extract", "tx24_table_to_entries", "wn05_dedup_best", "wn12_staffing_detail",
    "ru16_apply_rules", "ru18_recommend_plan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    registry.load()
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    times = {}
    for name in wanted:
        best = None
        for _ in range(2):
            start = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.time() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
