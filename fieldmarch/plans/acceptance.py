"""Acceptance runs: each order is a run of its customer's session, with one of many defects or none."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import acceptance as A
from . import tables as T
from .registry import query

#: Eight events a run are made and read where it lies, so runs are dealt to tasks of so many.
RUNS_A_TASK = 50_000
#: What a flawless run's events say.
FLAWLESS = {
    "run": {"simulated": False, "evidence_origin": "hardware_observation", "path": "b", "tts_pcm_valid": True, "tts_playback_observed": True, "tts_engine": "x"},
    "button_release": {"button_release_monotonic_ns": 1_000_000_000, "button_release_source": "gpio", "observed": True},
    "first_sound": {"first_sound_monotonic_ns": 2_500_000_000, "first_sound_source": "loopback", "first_sound_method": "loopback_onset", "loopback_observed": True, "observed": True},
    "stt": {"stt_exit_code": 0, "stt_false_positive_keywords": [], "stt_expected_keywords_missed": [], "stt_recall_ok": True, "observed": True},
    "resources": {"mem_available_min_mb": 1500.5, "swap_before_mb": 10, "swap_after_mb": 10, "swap_delta_mb": 0, "observed": True},
    "concurrency": {"stt_tts_overlap": False, "stt_start_monotonic_ns": 10, "stt_end_monotonic_ns": 20, "tts_start_monotonic_ns": 20, "tts_end_monotonic_ns": 30, "observed": True},
    "network": {"external_connections": 0, "observed": True},
    "complete": {},
}
GONE = object()
#: Changes to a flawless run, and what comes of it: status, failed checks.
DEFECTS: list[tuple[dict[str, dict], str, list[str]]] = [
    ({}, "pass", []),
    ({"network": {"observed": False}}, "unverified", ["observed"]),
    ({"run": {"simulated": True}}, "fail", ["not_simulated"]),
    ({"run": {"simulated": GONE}}, "unverified", ["not_simulated"]),
    ({"run": {"evidence_origin": "lab"}}, "unverified", ["evidence_origin"]),
    ({"complete": {"event": "done"}}, "unverified", ["complete"]),
    ({"run": {"path": "C"}}, "fail", ["path"]),
    ({"first_sound": {"first_sound_monotonic_ns": 4_000_000_000}}, "fail", ["first_sound_budget"]),
    ({"first_sound": {"first_sound_monotonic_ns": 4_000_000_000}, "run": {"path": "A"}}, "pass", []),
    ({"first_sound": {"first_sound_monotonic_ns": 999_999_999}}, "fail", ["timestamp_order"]),
    ({"button_release": {"button_release_monotonic_ns": GONE}}, "unverified", ["button_release"]),
    ({"first_sound": {"first_sound_monotonic_ns": "2500000000"}}, "unverified", ["first_sound"]),
    ({"run": {"button_release_to_first_sound_ms": 1502.5}}, "fail", ["timing_consistent"]),
    ({"button_release": {"button_release_source": "guess"}}, "unverified", ["button_source"]),
    ({"first_sound": {"first_sound_method": "ear"}}, "unverified", ["loopback_method"]),
    ({"first_sound": {"loopback_observed": "true"}}, "unverified", ["loopback_observed"]),
    ({"stt": {"stt_false_positive_keywords": ["fire"]}}, "fail", ["false_positive_zero"]),
    ({"stt": {"stt_false_positive_keywords": 0}}, "unverified", ["false_positive_zero"]),
    ({"stt": {"stt_expected_keywords_missed": ["help"]}}, "fail", ["stt_recall"]),
    ({"stt": {"stt_exit_code": 1}}, "fail", ["stt_exit"]),
    ({"resources": {"mem_available_min_mb": 1023.9}}, "fail", ["memory_floor"]),
    ({"resources": {"mem_available_min_mb": True}}, "unverified", ["memory_floor"]),
    ({"resources": {"swap_after_mb": GONE}}, "unverified", ["swap_observed"]),
    ({"resources": {"swap_after_mb": 15, "swap_delta_mb": 5}}, "fail", ["swap_not_increased"]),
    ({"resources": {"swap_delta_mb": -1}}, "fail", ["swap_consistent"]),
    ({"concurrency": {"stt_tts_overlap": True}}, "fail", ["stt_tts_non_overlap", "overlap_flag_consistent"]),
    ({"concurrency": {"stt_tts_overlap": True, "tts_start_monotonic_ns": 19}}, "fail", ["stt_tts_non_overlap", "interval_non_overlap"]),
    ({"concurrency": {"tts_end_monotonic_ns": 30.5}}, "unverified", ["intervals_observed"]),
    ({"network": {"external_connections": 2}}, "fail", ["external_network_zero"]),
    ({"run": {"tts_pcm_valid": False}}, "fail", ["tts_pcm"]),
    ({"stt": {"path": "C", "simulated": True}}, "pass", []),
    ({"run": {"tts_playback_observed": GONE}}, "unverified", ["tts_playback"]),
    ({"run": {"tts_engine": " "}}, "unverified", ["tts_engine"]),
    ({"complete": {"tts_pcm_valid": None}}, "unverified", ["tts_pcm"]),
    ({"first_sound": {"first_sound_source": "microphone"}}, "unverified", ["loopback_source"]),
    ({"stt": {"stt_recall_ok": GONE}}, "unverified", ["stt_recall"]),
    ({"network": {"external_connections": None}, "stt": {"stt_exit_code": 2}}, "unverified", ["stt_exit", "external_network_zero"]),
]
MATRIX = {"event": "stt_matrix", "stt_cases": 21, "stt_false_positive_keywords": [], "stt_expected_keywords_missed": [], "stt_recall_ok": True, "observed": True}


def _payloads(changes: dict[str, dict]) -> list[str]:
    out = []
    for event, fields in FLAWLESS.items():
        said = {"event": event, "run": "@", **fields, **changes.get(event, {})}
        out.append(json.dumps({k: v for k, v in said.items() if v is not GONE}).replace('"@"', "@"))
    return out


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Events of all runs, out of order in time with those of other runs, and one matrix a session."""
    c = F.col
    by = Window.partitionBy("o_custkey")
    orders = T.read(spark, d, "orders")
    tasks = max(orders.count() // RUNS_A_TASK + 1, 4 * spark.sparkContext.defaultParallelism)
    runs = orders.select(
        c("o_custkey").alias("session"), c("o_orderkey"), F.row_number().over(by.orderBy("o_orderkey")).cast("bigint").alias("run"), F.count("*").over(by).alias("n")).repartition(tasks, "o_orderkey")
    requested = c("n") + F.when(c("session") % 6 == 0, 1).when((c("session") % 6 == 1) & (c("n") > 1), -1).otherwise(0)
    templates = F.array(*[F.array(*[F.lit(p) for p in _payloads(changes)]) for changes, _, _ in DEFECTS])
    said = runs.select("session", requested.alias("requested"), "run", F.posexplode(F.get(templates, (c("o_orderkey") % len(DEFECTS)).cast("int"))).alias("i", "p"))
    events = said.select("session", "requested", (c("i") * 1000 + c("run")).cast("bigint").alias("at"), F.replace("p", F.lit("@"), c("run").cast("string")).alias("payload"))
    matrix = json.dumps(MATRIX)
    few, less = json.dumps({**MATRIX, "stt_cases": 20}), json.dumps({k: v for k, v in MATRIX.items() if k != "observed"})
    one = runs.filter("run = 1").filter(c("session") % 7 != 2).select(
        "session", requested.alias("requested"), F.lit(100_000).cast("bigint").alias("at"), F.when(c("session") % 7 == 1, few).when(c("session") % 7 == 3, less).otherwise(matrix).alias("payload"))
    return events.unionByName(one)


_EXPECTED = ", ".join(f"({i}, '{status}', {json.dumps(failed).replace(chr(34), chr(39)) if failed else 'CAST([] AS VARCHAR[])'})" for i, (_, status, failed) in enumerate(DEFECTS))
_DELAY = "CASE WHEN code IN (7, 8) THEN 3000.0::DOUBLE WHEN code IN (9, 10, 11) THEN NULL ELSE 1500.0::DOUBLE END"
T.define("aruns", [], f"""SELECT session, run, requested, n, code, status, failed, {_DELAY} AS delay_ms FROM (
    SELECT *, n + CASE WHEN session%6=0 THEN 1 WHEN session%6=1 AND n>1 THEN -1 ELSE 0 END AS requested FROM (SELECT o_custkey AS session, o_orderkey%{len(DEFECTS)} AS code,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders))
    JOIN (VALUES {_EXPECTED}) AS x(code, status, failed) USING (code)""")


@query("acceptance_runs", T.ctes("aruns") + """ SELECT session, run, status, delay_ms, array_to_string(failed, ',') AS failed FROM aruns WHERE run<=requested""")
def acceptance_runs(spark, d):
    out = A.run_verdicts(observations(spark, d), ["session"], "at")
    return out.select("session", "run", "status", "delay_ms", F.concat_ws(",", "failed").alias("failed"))


@query("acceptance_sessions", T.ctes("aruns") + """ SELECT session, requested, n_runs, n_passed, CASE WHEN requested>n THEN CAST(requested AS VARCHAR) ELSE '' END AS missing, n_problems, ok AS matrix_ok, max_delay_ms,
    CASE WHEN requested>n OR session%7 IN (2,3) THEN 'unverified' WHEN n_problems>0 OR NOT ok THEN 'fail' WHEN unverified>0 THEN 'unverified' WHEN n_passed=requested THEN 'pass' ELSE 'fail' END AS status FROM (
      SELECT session, max(requested) AS requested, max(n) AS n, session%7 NOT IN (1,2,3) AS ok, count(*) FILTER (run<=requested) AS n_runs, count(*) FILTER (run<=requested AND status='pass') AS n_passed,
        count(*) FILTER (run<=requested AND status='unverified') AS unverified, CAST(sum(CASE WHEN run>requested THEN 8 WHEN code=5 THEN 1 ELSE 0 END) AS BIGINT) AS n_problems,
        max(delay_ms) FILTER (run<=requested) AS max_delay_ms FROM aruns GROUP BY session)""")
def acceptance_sessions(spark, d):
    out = A.session_verdicts(observations(spark, d), ["session"], "at")
    return out.withColumn("missing", F.array_join("missing", ","))
