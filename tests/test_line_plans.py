"""Telemetry lines are made in one pass over the events."""

from pyspark.sql import functions as F

from fieldmarch.plans import ingest


def test_telemetry_lines_read_events_once(spark, sf):
    plan = ingest.telemetry_lines(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan parquet") == 1


def test_lines_are_made_by_as_many_tasks_as_the_events_need(spark, monkeypatch):
    monkeypatch.setattr(ingest, "EVENTS_A_TASK", 50)
    for lines in (ingest.csv_lines, ingest.event_lines, ingest.telemetry_lines):
        rows = lines(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()
        assert len(rows) > 15 and max(r["count"] for r in rows) < 150, lines
