"""Streams over the batch operators: cut anywhere, replayed or not, they give what one batch gives."""

import tempfile

import pytest
from pyspark.sql import functions as F

from fieldmarch.operators import fleet as fleet_ops
from fieldmarch.operators import routes
from fieldmarch.plans import fleet, routes as plan_routes, tables as T
from fieldmarch.streaming import carry


def co(spark, sf):
    return carry.co_levels(["device_id", "boot_id"]), T.co_readings(spark, sf)


def alerts(spark, sf):
    return carry.alerts(["device_id"]), fleet.alert_channels(spark, sf)


def throttled(spark, sf):
    return carry.throttled(["device_id", "boot_id"], "t_s", 100.0), fleet_ops.live_fixes(T.fixes(spark, sf)).select("event_id", "device_id", "boot_id", "t_s")


def buttons(spark, sf):
    c = F.col
    return carry.buttons(["device_id"]), T.ev(spark, sf).select(
        "device_id", "t_s", F.when(c("event_id") % 5 == 0, "power").otherwise("voice").alias("button"),
        F.when(c("event_id") % 2 == 0, "pressed").otherwise("released").alias("state"),
        F.when(c("event_id") % 2 == 0, 0).otherwise(F.floor(c("value") * 100)).cast("long").alias("held_ms"))


def power(spark, sf):
    c = F.col
    at = lambda items, n: F.get(F.array(*[F.lit(i) for i in items]), (n % len(items)).cast("int"))
    return carry.power(["device_id"]), T.ev(spark, sf).select(
        "device_id", (c("event_id") * 1.25).alias("t_s"), at(["event", "telemetry", "command", "command", "event"], c("event_id")).alias("source"),
        F.when(c("event_id") % 5 == 2, "ack").when(c("event_id") % 5 == 3, at(["cancel", "ack"], F.floor(c("event_id") / 5)))
        .when(c("event_id") % 5 == 0, at(["shutdown_requested", "shutdown_requested", "shutdown_ack", "status", "gate_off"], F.floor(c("event_id") / 5))).otherwise("status").alias("state"),
        (c("event_id") % 7 != 0).alias("gate_on"), (c("event_id") % 3 != 0).alias("shutdown_pending"))


def following(spark, sf):
    spots = routes.candidates(plan_routes.walkers(spark, sf), routes.route_profile(plan_routes.walks(spark, sf)))
    return carry.following(["device_id"]), spots.select("event_id", "device_id", "t_s", "route_id", "spots")


JOBS = [co, alerts, throttled, buttons, power, following]


def rows_of(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


CASES = [(job, 3) for job in JOBS] + [(throttled, 1), (throttled, 20)]


@pytest.mark.parametrize("job, cuts", CASES, ids=lambda x: getattr(x, "__name__", x))
def test_cut_anywhere(spark, sf, job, cuts):
    job, df = job(spark, sf)
    few = df.select("device_id").distinct().orderBy("device_id").limit(2 if cuts == 20 else 20)
    df = spark.createDataFrame(df.join(few, "device_id").select(*df.columns).collect(), df.schema)
    want = job.run(df)
    ends = [r.t_s for r in df.select("t_s").distinct().orderBy("t_s").collect()]
    bounds = [float("-inf"), *[ends[len(ends) * i // cuts] for i in range(1, cuts)], float("inf")]
    handler = carry.Carried(job, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = df.filter((F.col("t_s") >= low) & (F.col("t_s") < high))
        handler(part, i)
        if i == 1:  # run again, as after a failure between its two writes
            handler(part, i)
    got = rows_of(handler.results(spark), want.columns)
    assert got and got == rows_of(want, want.columns)
