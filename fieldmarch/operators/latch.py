"""Alarm latches, edge-triggered alerts and keep-alive output over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import CHUNK, CHUNK_S, chunked, throttle, within

# Carbon monoxide thresholds (ppm) and holds (s).
CO_WARN_PPM, CO_WARN_HOLD_S = 35.0, 180.0
CO_ALARM_PPM = 100.0
CO_CLEAR_PPM, CO_CLEAR_HOLD_S = 30.0, 30.0
# Repeat intervals (s) of spoken carbon monoxide alerts and of the trail output.
CO_ALARM_REPEAT_S, CO_WARNING_REPEAT_S = 20.0, 60.0
TRAIL_KEEPALIVE_S = 2.0


def run_starts(df: DataFrame, keys: list[str], t: str, value: str, name: str = "run_start") -> DataFrame:
    """Time at which the maximal run of equal ``value`` around each row began (chunked input)."""
    w = within(keys, t)
    changed = F.lag(F.struct(value)).over(w).isNotNull() & ~F.lag(value).over(w).eqNullSafe(F.col(value))
    base = df.withColumn("_changed_at", F.when(changed, F.col(t)))
    base = base.withColumn(
        "_local", F.last("_changed_at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    part = base.groupBy(*keys, CHUNK).agg(
        F.min(t).alias("_first_t"),
        F.min_by(F.struct(value), t).alias("_first"),
        F.max_by(F.struct(value), t).alias("_last"),
        F.max("_local").alias("_last_change"),
    )
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    starts_here = ~F.lag("_last").over(by_chunk).eqNullSafe(F.col("_first"))
    part = part.withColumn("_head", F.when(starts_here, F.col("_first_t")))
    part = part.withColumn("_out", F.coalesce("_last_change", "_head"))
    carry = F.last("_out", ignorenulls=True).over(by_chunk.rowsBetween(Window.unboundedPreceding, -1))
    part = part.select(*keys, CHUNK, F.coalesce("_head", carry).alias("_carry"))
    out = base.join(part, [*keys, CHUNK])
    return out.withColumn(name, F.coalesce("_local", "_carry")).drop("_changed_at", "_local", "_carry")


def co_band(v: Column) -> Column:
    """What a reading does to the latch: x (missing), A, W, m (neither raises nor clears) or C."""
    return (
        F.when(v.isNull() | F.isnan(v), "x")
        .when(v >= CO_ALARM_PPM, "A")
        .when(v >= CO_WARN_PPM, "W")
        .when(v >= CO_CLEAR_PPM, "m")
        .otherwise("C")
    )


def co_latch(df: DataFrame, keys: list[str], t: str = "t_s", ppm: str = "ppm", chunk_s: float = CHUNK_S) -> DataFrame:
    """Latched carbon monoxide level of every reading: none, warning or alarm.

    A missing value resets both hold timers and never clears a level; 30 to 35 ppm neither raises
    nor clears. A reading that completes the clear hold opens a new epoch; the level is the
    worst thing seen in the epoch so far.
    """
    base = run_starts(chunked(df.withColumn("_band", co_band(F.col(ppm))), t, chunk_s), keys, t, "_band")
    held = F.col(t) - F.col("run_start")
    clear = (F.col("_band") == "C") & (held >= CO_CLEAR_HOLD_S)
    rank = F.when(F.col("_band") == "A", 2).when((F.col("_band") == "W") & (held >= CO_WARN_HOLD_S), 1).otherwise(0)
    upto = within(keys, t).rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("_rank", rank).withColumn("_epoch", F.sum(clear.cast("int")).over(upto))
    in_epoch = Window.partitionBy(*keys, CHUNK, "_epoch").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("_worst", F.max("_rank").over(in_epoch))

    part = base.groupBy(*keys, CHUNK).agg(
        F.max("_epoch").alias("_clears"), F.max_by("_worst", t).alias("_tail")
    )
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    part = part.withColumn("_era", F.sum((F.col("_clears") > 0).cast("int")).over(by_chunk))
    era = Window.partitionBy(*keys, "_era").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("_out", F.max("_tail").over(era))
    part = part.select(*keys, CHUNK, F.coalesce(F.lag("_out").over(by_chunk), F.lit(0)).alias("_carry"))

    out = base.join(part, [*keys, CHUNK])
    rank = F.when(F.col("_epoch") == 0, F.greatest("_worst", "_carry")).otherwise(F.col("_worst"))
    level = F.when(rank == 2, "alarm").when(rank == 1, "warning").otherwise("none")
    return out.withColumn("level", level).select(*df.columns, "level")


def intervals(df: DataFrame, keys: list[str], t: str, value: str, chunk_s: float = CHUNK_S) -> DataFrame:
    """Maximal runs of equal ``value`` with their first and last time and row count."""
    runs = run_starts(chunked(df, t, chunk_s), keys, t, value)
    return runs.groupBy(*keys, value, "run_start").agg(
        F.max(t).alias("run_end"), F.count(F.lit(1)).alias("n_rows")
    )


def alert_edges(df: DataFrame, keys: list[str], t: str = "t_s", chunk_s: float = CHUNK_S) -> DataFrame:
    """Alert events: one when a channel's key appears or changes, repeats for carbon monoxide.

    Input channels are the key columns ``co_key`` (alarm, warning), ``trail_key``,
    ``daylight_key`` and ``arrival_key``; NULL means silent and re-arms the channel. ``ord`` is
    the order of alerts that fall on one instant. Only carbon monoxide sounds.
    """
    channels = ["co_key", "trail_key", "daylight_key", "arrival_key"]
    rows = df.select(
        *keys, t, F.posexplode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("key")) for c in channels]))
    ).select(*keys, t, F.col("pos").alias("ord"), "col.channel", "col.key")
    group = [*keys, "channel", "ord"]
    runs = run_starts(chunked(rows, t, chunk_s), group, t, "key").drop(CHUNK).filter("key IS NOT NULL")
    edges = runs.filter((F.col(t) == F.col("run_start")) & (F.col("channel") != "co_key"))
    co = runs.filter("channel = 'co_key'")
    group_run = [*group, "run_start"]
    alarm = throttle(co.filter("key = 'alarm'"), group_run, t, CO_ALARM_REPEAT_S, chunk_s=chunk_s)
    warning = throttle(co.filter("key = 'warning'"), group_run, t, CO_WARNING_REPEAT_S, chunk_s=chunk_s)
    out = edges.unionByName(alarm).unionByName(warning)
    return out.select(
        *keys, t, "ord", "channel", "key",
        (F.col(t) > F.col("run_start")).alias("repeated"), (F.col("channel") == "co_key").alias("sound"),
    )


def trail_output(df: DataFrame, keys: list[str], t: str, status: str, chunk_s: float = CHUNK_S) -> DataFrame:
    """Output commands: on every change of action, and every 2 s while a trail alert is active."""
    action = (
        F.when(F.col(status) == "off_trail", "trail_alert")
        .when(F.col(status) == "off_trail_estimate", "trail_caution")
        .otherwise("trail_clear")
    )
    runs = run_starts(chunked(df.withColumn("action", action), t, chunk_s), keys, t, "action").drop(CHUNK)
    active = F.col("action") != "trail_clear"
    sent = throttle(runs.filter(active), [*keys, "run_start"], t, TRAIL_KEEPALIVE_S, chunk_s=chunk_s)
    return runs.filter(~active & (F.col(t) == F.col("run_start"))).unionByName(sent).withColumn(
        "keepalive", F.col(t) > F.col("run_start")
    )
