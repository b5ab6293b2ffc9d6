"""Streams that run the batch operators: rows carried between micro-batches stand for all that came before.

What an ordered operator remembers of a key is a handful of rows: fed to it ahead of new rows, they leave it as the whole history would.
A micro-batch runs the operator over its rows and its keys' carried rows, writes what is newer than those, and replaces them. Outputs and
carried rows are written under the batch's number, and a batch starts from the newest carried rows under a smaller number, so one that is
run again after a failure writes the same files again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import fleet, latch, ordered, routes

UNTIL = "_until"  # time of the newest row that the carried rows of a key stand for
COUNT = "_count"  # how many rows of the key came before


@dataclass(frozen=True)
class Job:
    """A batch operator and the rows that carry its state.

    ``run(rows)`` gives the outputs of the rows of whole keys. ``carry(rows, outputs)`` gives the rows, in the columns of the input, that
    stand for them. Keys are rows' ``keys``, time is ``t``; a row no later than the newest of its key before is late and dropped.
    ``count``, if any, is an output that numbers a key's rows.
    """

    keys: list[str]
    t: str
    run: Callable[[DataFrame], DataFrame]
    carry: Callable[[DataFrame, DataFrame], DataFrame]
    count: str | None = None


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


class Carried:
    """The handler of a stream's micro-batches: ``stream.writeStream.foreachBatch(Carried(job, folder))``.

    ``folder`` must be one that all executors share; results are in ``folder/out/batch=<number>``.
    """

    def __init__(self, job: Job, folder: str):
        self.job, self.folder = job, folder

    def _versions(self, spark: SparkSession) -> list[int]:
        at, fs = _path(spark, f"{self.folder}/carried")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and fs.exists(_path(spark, f"{self.folder}/carried/{n}/_SUCCESS")[0]))

    def _before(self, spark: SparkSession, batch_id: int, like: DataFrame) -> DataFrame:
        older = [v for v in self._versions(spark) if v < batch_id]
        schema = f"{', '.join(f'`{n}` {k}' for n, k in like.dtypes)}, {UNTIL} double, {COUNT} long"
        if not older:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.folder}/carried/v-{older[-1]}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        job, spark = self.job, batch.sparkSession
        old = self._before(spark, batch_id, batch)
        batch = batch.persist()
        try:
            touched = batch.select(*job.keys).distinct()
            same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"k.{k}")) for k in job.keys])
            mine = old.alias("o").join(touched.alias("k"), same, "left_semi")
            marks = mine.groupBy(*job.keys).agg(F.max(UNTIL).alias(UNTIL), F.max(COUNT).alias(COUNT), F.count("*").alias("_rows"))
            known = reduce(lambda a, b: a & b, [F.col(f"b.{k}").eqNullSafe(F.col(f"m.{k}")) for k in job.keys])

            def with_marks(df: DataFrame) -> DataFrame:
                return df.alias("b").join(marks.alias("m"), known, "left").select("b.*", *[F.col(f"m.{c}") for c in (UNTIL, COUNT, "_rows")])

            newer = F.col(UNTIL).isNull() | (F.col(job.t) > F.col(UNTIL))
            fresh = with_marks(batch).filter(newer).select(*batch.columns)
            rows = fresh.unionByName(mine.select(*batch.columns))
            out = job.run(rows)
            new = with_marks(out).filter(newer)
            if job.count:
                new = new.withColumn(job.count, F.col(job.count) - F.coalesce("_rows", F.lit(0)) + F.coalesce(COUNT, F.lit(0)))
            new.select(*out.columns).write.mode("overwrite").parquet(f"{self.folder}/out/batch={batch_id}")
            ends = with_marks(rows).groupBy(*job.keys).agg(
                F.max(job.t).alias("_t"), (F.coalesce(F.max(COUNT), F.lit(0)) + F.count("*") - F.coalesce(F.max("_rows"), F.lit(0))).alias("_n"))
            kept = job.carry(rows, out).alias("b").join(ends.alias("m"), known).select("b.*", F.greatest(F.col("m._t"), F.col(f"b.{job.t}")).alias(UNTIL), F.col("m._n").alias(COUNT))
            rest = old.alias("o").join(touched.alias("k"), same, "left_anti")
            kept.unionByName(rest).write.mode("overwrite").parquet(f"{self.folder}/carried/v-{batch_id}")
        finally:
            batch.unpersist()
        for version in [v for v in self._versions(spark) if v < batch_id][:-1]:  # a batch may be run again from the one before it
            at, fs = _path(spark, f"{self.folder}/carried/v-{version}")
            fs.delete(at, True)

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/out").drop("batch")


def start(stream: DataFrame, job: Job, folder: str, **trigger):
    """Run a job on a stream; its checkpoint lies beside its results."""
    writer = stream.writeStream.foreachBatch(Carried(job, folder)).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _newest_run(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """A row a key: the newest ``value`` and since when it has been that."""
    runs = latch.run_starts(ordered.chunked(df, t), keys, t, value)
    newest = F.max_by(F.struct(F.col("run_start").alias("since"), F.col(value).alias("value")), t)
    return runs.groupBy(*keys).agg(newest.alias("run"), F.max(t).alias("last"))


def _points(keyed: DataFrame, keys: list[str], points: Column, like: DataFrame) -> DataFrame:
    """A row a struct of ``points``; columns of the input that they lack are NULL."""
    rows = keyed.select(*keys, F.explode(points).alias("p")).select(*keys, "p.*")
    kinds = dict(like.dtypes)
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in like.columns])


def co_levels(keys: list[str], t: str = "t_s", ppm: str = "ppm") -> Job:
    """Latched carbon monoxide levels (:func:`latch.co_latch`).

    A key is carried by what made its level, the first row of the newest run of like readings, and the newest row.
    """

    def carry(rows: DataFrame, out: DataFrame) -> DataFrame:
        runs = _newest_run(out.withColumn("_band", latch.co_band(F.col(ppm))), keys, t, "_band")
        last = out.groupBy(*keys).agg(F.max_by(F.struct(F.col(ppm).alias("ppm"), "level"), t).alias("now"))
        state = runs.join(last, keys)
        since, level = F.col("run.since"), F.col("now.level")
        point = lambda at, value: F.struct(at.alias(t), value.cast("double").alias(ppm))
        held = latch.CO_WARN_HOLD_S
        raised = F.when(level == "alarm", F.array(point(since - 1.0, F.lit(latch.CO_ALARM_PPM)))).when(
            level == "warning", F.array(point(since - 3 * held, F.lit(latch.CO_WARN_PPM)), point(since - held, F.lit(latch.CO_WARN_PPM)))
        ).otherwise(F.array().cast(f"array<struct<{t}:double,{ppm}:double>>"))
        now = F.array_distinct(F.array(point(since, F.col("now.ppm")), point(F.col("last"), F.col("now.ppm"))))
        return _points(state, keys, F.concat(raised, now), rows)

    return Job(keys, t, lambda rows: latch.co_latch(rows, keys, t, ppm), carry)


def throttled(keys: list[str], t: str, interval_s: float) -> Job:
    """Rows at least ``interval_s`` apart (:func:`ordered.throttle`); the newest kept row carries a key."""

    def carry(rows: DataFrame, out: DataFrame) -> DataFrame:
        return out.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), t).alias("r")).select(*keys, "r.*").select(*rows.columns)

    return Job(keys, t, lambda rows: ordered.throttle(rows, keys, t, interval_s), carry)


def alerts(keys: list[str], t: str = "t_s") -> Job:
    """Alert edges with repeats (:func:`latch.alert_edges`).

    A channel is carried since the first row of its newest run, the sounding one since its newest alert, from which its repeats count.
    """
    channels = ["co_key", "trail_key", "daylight_key", "arrival_key"]

    def carry(rows: DataFrame, out: DataFrame) -> DataFrame:
        long = rows.select(*keys, t, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("key")) for c in channels])).alias("c")).select(*keys, t, "c.*")
        runs = _newest_run(long, [*keys, "channel"], t, "key")
        sounded = out.filter("sound").groupBy(*keys).agg(F.max(t).alias("sounded"))
        of = lambda c, what: F.max(F.when(F.col("channel") == c, F.col(what)))
        state = runs.groupBy(*keys).agg(F.max("last").alias("last"), *[of(c, "run.value").alias(f"v_{c}") for c in channels], *[of(c, "run.since").alias(f"s_{c}") for c in channels])
        state = state.join(sounded, keys, "left").withColumn("s_co_key", F.coalesce(F.greatest("s_co_key", "sounded"), "s_co_key"))
        times = F.array_distinct(F.array_compact(F.array(F.col("last"), *[F.when(F.col(f"v_{c}").isNotNull(), F.col(f"s_{c}")) for c in channels])))
        point = lambda at: F.struct(at.alias(t), *[F.when(at >= F.col(f"s_{c}"), F.col(f"v_{c}")).alias(c) for c in channels])
        return _points(state, keys, F.transform(times, point), rows)

    return Job(keys, t, lambda rows: latch.alert_edges(rows, keys, t), carry)


def buttons(keys: list[str], t: str = "t_s") -> Job:
    """Ended button sessions (:func:`fleet.button_sessions`); the newest row of each button carries it."""

    def carry(rows: DataFrame, out: DataFrame) -> DataFrame:
        newest = rows.groupBy(*keys, "button").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in [*keys, "button"]]), t).alias("r"))
        return newest.select(*keys, "button", "r.*").select(*rows.columns)

    return Job(keys, t, lambda rows: fleet.button_sessions(rows, keys, t), carry, count="event_no")


def power(keys: list[str], t: str = "t_s") -> Job:
    """Phases of the shutdown transaction (:func:`fleet.power_phase`).

    A key is carried by one or two rows that lead to its phase and by the newest report, in a state that moves nothing.
    """

    def carry(rows: DataFrame, out: DataFrame) -> DataFrame:
        report = F.col("source") != "command"
        state = out.groupBy(*keys).agg(
            F.max_by("phase", t).alias("phase"), F.max(t).alias("last"),
            F.max_by(F.when(report, F.struct(F.col(t).alias("at"), "gate_on", "shutdown_pending")), F.when(report, F.col(t))).alias("seen"))
        on, none = F.lit(True), F.lit(None).cast("boolean")
        row = lambda at, source, st, gate, pending: F.struct(
            at.alias(t), F.lit(source).alias("source"), F.lit(st).alias("state"), gate.alias("gate_on"), pending.alias("shutdown_pending"))
        at = F.coalesce("seen.at", "last")
        asked = row(at - 2.0, "event", "shutdown_requested", on, on)
        way = {
            "pending": [asked], "armed": [row(at - 2.0, "event", "shutdown_ack", on, on)],
            "ack_queued": [asked, row(at - 1.0, "command", "ack", none, none)], "cancel_queued": [asked, row(at - 1.0, "command", "cancel", none, none)],
        }
        led = reduce(lambda acc, kv: acc.when(F.col("phase") == kv[0], F.array(*kv[1])), way.items(), F.when(F.lit(False), F.array(asked)))
        seen = F.when(F.col("seen").isNotNull(), F.array(row(at, "event", "seen", F.col("seen.gate_on"), F.col("seen.shutdown_pending"))))
        last = F.array(row(F.col("last"), "command", "none", none, none))
        empty = F.filter(F.array(asked), lambda x: F.lit(False))
        return _points(state, keys, F.concat(F.coalesce(led, empty), F.coalesce(seen, empty), last), rows)

    return Job(keys, t, lambda rows: fleet.power_phase(rows, keys, t), carry)


def following(keys: list[str], t: str = "t_s", order: str = "event_id") -> Job:
    """Progress along routes (:func:`routes.follow`); a place on the newest route at its progress carries a key."""

    def carry(rows: DataFrame, out: DataFrame) -> DataFrame:
        newest = out.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in out.columns if c not in keys]), F.struct(t, order)).alias("r")).select(*keys, "r.*")
        kind = rows.schema["spots"].dataType
        here = F.array(F.struct(*[(F.col("progress_m") if f.name == "progress" else F.lit(0)).cast(f.dataType).alias(f.name) for f in kind.elementType.fields]))
        return newest.withColumn("spots", here.cast(kind)).select(*rows.columns)

    return Job(keys, t, lambda rows: routes.follow(rows, keys, t, order), carry)
