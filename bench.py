"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores;
names on the command line choose queries (``all`` for every one). Each query runs once to warm up and
then ``BENCH_RUNS`` times (default 1); the median counts. Results go to the no-op sink, so every
row is made and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from loomcraft.catalog import QUERIES
from loomcraft.session import build_session

HEADLINE = [
    "validate_calls", "call_verdicts", "record_verdicts", "sharegpt_multi", "scored_samples", "pass_rate",
    "doc_packing", "topk_similar", "clean_text", "task_slugs", "render_prompt", "chatml_render", "tool_call_extraction",
    "salvage_json", "schema_valid", "json_mode_export", "page_extract", "forward_fill_all", "url_union", "skip_done",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    names = list(QUERIES) if names == ["all"] else names
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
