"""Wall time per query: one warm-up, then the median of three runs, or one run where a
run takes long; output discarded.

Prints one JSON line. ``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores,
``BENCH_QUERIES`` a comma-separated choice of queries, ``BENCH_RUNS`` the number of runs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyspark  # noqa: E402

from pagecatalog.plans.queries import QUERIES  # noqa: E402
from pagecatalog.session import build_session  # noqa: E402

HEADLINE = [
    "distinct_links_ordered", "group_links", "page_links", "paginated_urls", "links_running_total",
    "links_top_n_per_host", "frontier_merge", "pending_urls", "page_titles", "list_field",
    "child_page_join", "nest_children", "flatten_children", "top5_images", "second_hop_lookup",
    "upsert_latest", "surrogate_key", "batch_assignment", "progress_records", "run_summary",
    "dead_letters", "request_stats", "backoff_schedule", "catalog_json_roundtrip", "stream_upsert",
    "stream_retry", "job_process", "job_enrich",
]
LONG_SECONDS = 3.0


def run(spark, name: str, folder: str):
    began = time.perf_counter()
    df = QUERIES[name](spark, folder)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began, df


def plan_hash(df) -> str:
    """Digest of the physical plan without expression numbers and paths."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = re.sub(r"#\d+L?|plan_id=\d+|Location: .*|pagecatalog[-/][^\s,\]]*|x_\d+", "", plan)
    return hashlib.md5(plan.encode()).hexdigest()[:12]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("pagecatalog-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds, plans = {}, {}
    for name in names:
        run(spark, name, folder)
        times = []
        while len(times) < runs:
            spent, df = run(spark, name, folder)
            times.append(spent)
            if spent > LONG_SECONDS:
                break
        seconds[name] = round(statistics.median(times), 3)
        plans[name] = plan_hash(df)
        print(f"{name:28s} {seconds[name]:8.3f}", file=sys.stderr)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus),
        "spark": pyspark.__version__, "plans": plans}))
    spark.stop()


if __name__ == "__main__":
    main()
