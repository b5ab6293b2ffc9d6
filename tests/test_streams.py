"""Stream jobs give what their batch twins give."""

import tempfile

from pyspark.sql import functions as F

from fieldmarch.operators import fleet as fleet_ops
from fieldmarch.plans import ingest, tables as T
from fieldmarch.streaming import carry, jobs


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def as_stream(df, order, parts=3):
    """Time-ordered files read one a trigger, so state has to carry over micro-batches."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df = df.repartitionByRange(parts, order)
    rows = df.select(F.spark_partition_id().alias("_p"), "*").persist()
    for i in range(parts):
        rows.filter(f"_p = {i}").drop("_p").coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b, cols):
    key = lambda df: sorted(map(repr, df.select(*cols).collect()))
    got, want = key(a), key(b)
    assert want and got == want


def test_ingest_and_quarantine(spark, sf):
    lines = ingest.raw_lines(spark, sf)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    q = jobs.ingest(as_stream(lines, "recv_s"), path + "/out", path + "/ck")
    q.awaitTermination(120)
    stored = spark.read.parquet(path + "/out").groupBy("kind").count()
    from fieldmarch.sources.telemetry import route_lines

    same(stored, route_lines(lines).groupBy("kind").count(), ["kind", "count"])


def test_duplicates_are_dropped_within_the_watermark(spark, sf):
    e = T.ev(spark, sf).select("device_id", "boot_id", F.col("event_id").alias("seq"), F.timestamp_seconds("t_s").alias("recv_ts"))
    twice = e.unionByName(e)
    out = run(jobs.once(as_stream(twice, "recv_ts", 1)), "once_stream")
    assert out.count() == e.count()


def test_a_stream_of_carried_rows(spark, sf):
    fx = fleet_ops.live_fixes(T.fixes(spark, sf)).select("event_id", "device_id", "boot_id", "t_s")
    job, folder = carry.throttled(["device_id", "boot_id"], "t_s", 100.0), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    q = carry.start(as_stream(fx, "t_s"), job, folder)
    q.awaitTermination(300)
    assert q.exception() is None
    same(carry.Carried(job, folder).results(spark), job.run(fx), ["event_id", "t_s"])


def test_newest_goes_stale(spark, sf):
    rows = T.ev(spark, sf).select("device_id", "t_s", "value")
    q = jobs.newest(as_stream(rows, "t_s", 1)).writeStream.format("memory").queryName("newest").outputMode("update").option(
        "checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(processingTime="1 second").start()
    import time

    end = time.time() + 60
    while time.time() < end and not spark.sql("SELECT 1 FROM newest WHERE NOT valid LIMIT 1").count():
        time.sleep(1)
    q.stop()
    got = spark.table("newest")
    want = rows.groupBy("device_id").agg(F.max("t_s").alias("t_s"))
    same(got.filter("valid"), want, ["device_id", "t_s"])
    assert got.filter("NOT valid").count() == want.count()
