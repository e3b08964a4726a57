"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores) choose the data and the cores. Each query is
run once to warm up and once timed; rows are written to Spark's no-op sink, so nothing reaches the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from nosoflow import build_session  # noqa: E402
from nosoflow.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "well_documented_codes top_postcoord_roots table_counts load_terms load_synonyms load_postcoord load_axes load_reports "
    "synonym_dictionary code_search code_detail translate_profiles translate_lists weighted_sample draw_per_root "
    "verify_codes axis_sizes chapter_of prompt_rows corpus_errors prf_metrics fk_violations "
    "cascade_erase evaluate_codes page_items rolling_latency latest_points monitor_counters stream_counters"
).split()
FULL_LOAD = "load_terms load_synonyms load_postcoord load_axes load_reports".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = build_session(
        "bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{
            "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(run(name), 3)
        print(f"{name:28s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "full_load": round(sum(seconds.get(n, 0.0) for n in FULL_LOAD), 3),
        "sf": float(scale.group(1)) if scale else None, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
