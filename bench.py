"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the threads."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

#: Shapes of counts, key lists, orders, feeds and reductions; each is run once to warm up and then timed.
HEADLINE = [
    "flagship", "eq", "in", "hasany", "hasall", "notin", "and", "or", "prefix", "contains", "range_merge", "unordered_limit_by_key", "top_sort", "top_pos_scalar", "top_pos_array", "top_len", "or_ordered", "offset_limit",
    "top_time", "count_filter", "count_distinct", "distinct", "group1", "group2", "having_cmp", "order_multi", "order_limit", "mixed_metrics", "measure_by_group", "planner_stats",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from quarry import catalog

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("quarry-bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 4)
    print(json.dumps({"metric": "headline queries, warm, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(folder).name.removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
