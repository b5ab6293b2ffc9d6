"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from fieldmarch import plans
from fieldmarch.session import local_session

HEADLINES = [
    "frame_roundtrip", "ingest_quality", "sequence_gaps", "fix_carry", "co_alarm", "co_alarm_intervals", "alert_edges", "trail_output",
    "throttle", "point_ago", "device_snapshot", "button_sessions", "power_phase", "history_summary", "nearest_node", "trail_offset",
    "nearest_poi", "segments", "graph_wcc", "graph_scc", "route_progress", "route_deviation", "sun_times", "return_deadline",
    "normalize_text", "route_utterance", "token_estimate", "device_state_text", "card_render",
    "intent_guard", "polish_guard", "eval_score", "latency_budget", "stage_latency", "acceptance", "energy_per_query", "co_rise",
    "line_kinds", "trail_status", "shortest_path", "route_geometry", "route_record", "suggested_points", "overlay_cascade",
    "collapse_repeats", "rule_match", "telemetry_json", "waypoint_log", "conversation_sessions", "alerts_from_readings", "acceptance_runs",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINES
    spark.read.parquet(f"{sf}/events.parquet").count()
    spent = {}
    for name in names:
        start = time.perf_counter()
        plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {spent[name]} s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent, "sf": os.path.basename(sf.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
