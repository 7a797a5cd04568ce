"""Headline throughput: ``BENCH_SF_DIR`` on ``local[BENCH_CPUS]``, one JSON line.

The events tables are written once before timing (see ``setup_sec``), as a
recording is ingested once and then analysed; each query is timed from plan to
all rows materialised. Parsing is timed on the same rows as JSON lines.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from beaconlake.plans import catalog  # noqa: E402
from beaconlake.plans import driver_tables as dt  # noqa: E402
from beaconlake.plans import queries_ingest  # noqa: E402
from beaconlake.session import build, tune  # noqa: E402

QUERIES = (
    "src_ndjson", "recording_to_latency", "replay_order", "dedupe_events", "sequence_gaps", "class_counts", "timeline_buckets", "filter_table",
    "request_spans", "latency_stats_by_producer", "token_totals", "prompt_cache_totals", "agent_counters", "resource_counters", "cursor_counters",
    "det_error_burst", "det_no_progress", "det_compaction", "det_cache_thrash", "det_latency_outlier", "det_resource_pressure",
    "topology_nodes", "topology_edges", "pipeline_requests", "request_facts", "metric_deltas", "related_groups", "gpu_warnings",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = tune(build("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
    }))
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    started = time.time()
    rows = {view: dt.events_of(spark, sf_dir, view).count() for view in ("core", "agents", "pipe")}
    queries_ingest.line_folder(spark, sf_dir)
    setup = time.time() - started

    times: dict[str, float] = {}
    for name in QUERIES:
        begin = time.time()
        run(name)
        times[name] = round(time.time() - begin, 3)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
        "events": rows["core"], "setup_sec": round(setup, 3), "events_per_sec": {n: round(rows["core"] / t) for n, t in times.items() if t > 0},
    }))


if __name__ == "__main__":
    main()
