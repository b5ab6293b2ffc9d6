"""Fleet state: sensors, buttons, power, positions, waypoints, diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .asof import RETENTION_S, STALE_AFTER_S, newest, stale
from .ordered import CHUNK, CHUNK_S, automaton, chunked, previous, running, running_all

# Firmware limits (s), button holds (ms), checkpoints kept, and command names.
WARM_UP_S, VALID_FOR_S = 30.0, 5.0
VOICE_HOLD_MS, POWER_HOLD_MS = (250, 15_000), 2_000
CHECKPOINTS_KEPT = 50
POWER_PHASES = ["idle", "pending", "ack_queued", "armed", "cancel_queued"]
COMMANDS = [
    "save_basecamp", "save_checkpoint", "route_basecamp", "route_destination", "route_last_checkpoint",
    "route_recent_trace", "clear_destination", "find_nearest_water", "confirm_destination", "reject_destination",
    "night_on", "night_off", "night_toggle", "status", "cancel",
]


def sensor_state(df: DataFrame, keys: list[str], t: str, since_boot: str, valid: str, fix: str, chunk_s=CHUNK_S) -> DataFrame:
    """CO and GNSS state of every reading: CO from the time of the last valid one, GNSS from the newest sentence.

    ``fix`` is NULL in readings that came without a sentence. Without one for 5 s the receiver is not found; a sentence without a fix ends it.
    """
    out = running_all(chunked(df, t, chunk_s), keys, [t], {
        "_ok_t": (F.when(F.col(valid), F.col(t)), "last"),
        "_heard": (F.when(F.col(fix).isNotNull(), F.struct(F.col(t).alias("t"), F.col(fix).alias("fix"))), "last"),
    })
    co = (
        F.when(F.col(since_boot) < WARM_UP_S, "warming_up")
        .when(F.col(t) - F.col("_ok_t") <= VALID_FOR_S, "valid").otherwise("stale")
    )
    # a fix is as old as the sentence that is the newest
    gps = F.when(F.coalesce(F.col(t) - F.col("_heard.t") > VALID_FOR_S, F.lit(True)), "not_found").when(F.col("_heard.fix"), "fix").otherwise("no_fix")
    return out.withColumn("co_state", co).withColumn("gps_state", gps).select(*df.columns, "co_state", "gps_state")


def button_sessions(df: DataFrame, keys: list[str], t: str, chunk_s: float = CHUNK_S) -> DataFrame:
    """Button events that end a session: a release counts only after a press of the same button.

    ``outcome`` is finish or discard for the voice button, shutdown for a long power press;
    ``event_no`` numbers the device's events.
    """
    cdf = chunked(df, t, chunk_s)
    out = running(cdf, keys, [t], "event_no", F.lit(1).cast("bigint"), "sum").drop(CHUNK)
    out = previous(chunked(out, t, chunk_s), [*keys, "button"], [t], {"_before": "state"}).drop(CHUNK)
    released = (F.col("state") == "released") & (F.col("_before") == "pressed")
    held = F.col("held_ms")
    outcome = F.when(
        F.col("button") == "voice", F.when(held.between(*VOICE_HOLD_MS), "finish").otherwise("discard")
    ).when((F.col("button") == "power") & (held >= POWER_HOLD_MS), "shutdown")
    return out.filter(released).withColumn("outcome", outcome).drop("_before")


def power_phase(df: DataFrame, keys: list[str], t: str, chunk_s: float = CHUNK_S) -> DataFrame:
    """Phase of the shutdown transaction after every row.

    ``source`` is event, telemetry or command; ``state`` is the event's state or the command (ack,
    cancel); ``gate_on`` and ``shutdown_pending`` are what events and telemetry report. An ack
    is accepted only while the newest report is pending, gated on and at most 3 s old.
    """
    report = F.when(F.col("source") != "command", F.struct(F.col(t).alias("t"), "gate_on", "shutdown_pending"))
    out = running(chunked(df, t, chunk_s), keys, [t], "_seen", report, "last").drop(CHUNK)
    live = (
        (F.col(t) - F.col("_seen.t") <= STALE_AFTER_S) & F.coalesce("_seen.gate_on", F.lit(False))
        & F.coalesce("_seen.shutdown_pending", F.lit(False))
    )
    idle = F.col("state").isin("shutdown_cancelled", "shutdown_timeout", "gate_off", "gate_on") | (
        (F.col("state") == "status") & ~F.coalesce("shutdown_pending", F.lit(False)))
    symbol = (
        F.when(F.col("source") == "command", F.when(F.col("state") == "cancel", "cancel").when((F.col("state") == "ack") & live, "ack"))
        .when(F.col("source") == "telemetry", F.when(F.col("shutdown_pending") == F.lit(False), "idle"))
        .when(F.col("state") == "shutdown_requested", "pending")
        .when(F.col("state") == "shutdown_ack", "armed")
        .when(idle, "idle")
    )
    step = {(s, to): to for s in POWER_PHASES for to in ("idle", "pending", "armed")}
    step |= {(s, "ack"): "ack_queued" for s in ("idle", "pending")}
    step |= {(s, "cancel"): "cancel_queued" for s in ("pending", "ack_queued", "armed")}
    out = automaton(
        out.withColumn("_symbol", symbol), keys, t, "_symbol", POWER_PHASES, step, name="phase", chunk_s=chunk_s
    )
    return out.drop("_seen", "_symbol")


def device_snapshot(readings: DataFrame, at: Column) -> DataFrame:
    """Newest state of each device as seen at time ``at`` (s, may use ``last_t``): one row a device.

    ``readings`` has ``device_id, t_s`` and the columns below, up to ``at``; each part keeps its own
    newest value. A part older than 3 s is stale: not valid, trend unknown, value withheld.
    """
    c = F.col
    parts = {
        "fix": F.when(c("fix"), F.struct("lat", "lon", "acc_m", "satellites")),
        "env": F.when(c("temp_c").isNotNull(), F.struct("temp_c", "press_trend")),
        "co": F.struct("co_valid", "co_ppm"),
    }
    snap = newest(readings, ["device_id"], "t_s", parts)
    live = at - c("fix_t") <= STALE_AFTER_S
    env_stale, co_stale = stale(at - c("env_t")), stale(at - c("co_t"))
    return snap.select(
        "device_id", "last_t",
        F.coalesce(live, F.lit(False)).alias("fix_live"),
        F.when(live, "current_fix").when(c("fix").isNotNull(), "last_fix").otherwise("none").alias("location_ref"),
        c("fix.lat").alias("lat"), c("fix.lon").alias("lon"), F.when(live, c("fix.acc_m")).alias("acc_m"),
        (at - c("fix_t")).alias("fix_age_s"),
        env_stale.alias("env_stale"), F.when(~env_stale, c("env.temp_c")).alias("temp_c"),
        F.when(env_stale, "unknown").otherwise(c("env.press_trend")).alias("press_trend"),
        co_stale.alias("co_stale"), (~co_stale & c("co.co_valid")).alias("co_valid"),
        F.when(~co_stale & c("co.co_valid"), c("co.co_ppm")).alias("co_ppm"),
    )


def public_view(snapshot: DataFrame) -> DataFrame:
    """A snapshot without coordinates; values that are not valid are withheld."""
    return snapshot.select(
        "device_id", "location_ref", "fix_live", F.bround("fix_age_s", 1).alias("fix_age_s"),
        F.when(F.col("fix_live"), F.col("acc_m")).alias("acc_m"),
        F.when(~F.col("env_stale"), F.col("temp_c")).alias("temp_c"),
        F.when(F.col("co_valid"), F.col("co_ppm")).alias("co_ppm"),
    )


def live_fixes(df: DataFrame) -> DataFrame:
    """True fixes with everything in range and a clock that has started."""
    c = F.col
    return df.filter(
        c("fix") & (c("t_s") >= 0) & c("lat").between(-90, 90) & c("lon").between(-180, 180)
        & (c("acc_m").isNull() | (c("acc_m") >= 0)) & (c("satellites").isNull() | c("satellites").between(0, 100))
    )


def load_history(records: DataFrame, now: Column, boot: Column, retention_s: float = RETENTION_S) -> DataFrame:
    """Stored positions fit for use: whole, of this boot, at most ``retention_s`` old, not from the future."""
    c = F.col
    age = now - c("monotonic_s")
    whole = (
        (c("version") == 1) & c("boot_id").isNotNull() & (F.length("boot_id") <= 80) & (c("monotonic_s") >= 0)
        & c("lat").between(-90, 90) & c("lon").between(-180, 180)
        & (c("accuracy_m").isNull() | (c("accuracy_m") >= 0))
        & (c("satellites").isNull() | c("satellites").between(0, 100))
    )
    return records.filter(whole & (c("boot_id") == boot) & age.between(-1.0, retention_s))


def history_summary(positions: DataFrame, keys: list[str], t: str, now: Column, gap_s: float = 25.0, age_s: float = 180.0) -> DataFrame:
    """Count, oldest and newest age, and whether a point about three minutes back exists."""
    age = now - F.col(t)
    return positions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.bround(F.max(age), 1).alias("oldest_age_s"),
        F.bround(F.min(age), 1).alias("newest_age_s"),
        F.max(F.abs(age - age_s) <= gap_s).alias("recent_trace_ready"),
    )


def last_checkpoints(df: DataFrame, keys: list[str], t: str, keep: int = CHECKPOINTS_KEPT) -> DataFrame:
    """The newest checkpoints of each device; Spark cuts each task's rows to ``keep`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(t).desc())
    return df.withColumn("rank_back", F.row_number().over(w)).filter(F.col("rank_back") <= keep)


def valid_commands(df: DataFrame, body: str) -> DataFrame:
    """Command bodies that are objects of a known ``action`` (space around it ignored), perhaps a ``request_id``, and nothing else."""
    keys = F.json_object_keys(F.col(body))
    action = F.trim(F.get_json_object(F.col(body), "$.action"))
    exact = F.array_contains(keys, "action") & (F.size(F.array_except(keys, F.array(F.lit("action"), F.lit("request_id")))) == 0)
    return df.withColumn("action", action).withColumn(
        "accepted", F.coalesce(exact & action.isin(COMMANDS), F.lit(False))
    )


def env_bands(temp: Column, co_valid: Column, co_level: Column) -> dict[str, Column]:
    """Display bands: temperature level, Fahrenheit, and the state of the carbon monoxide tile."""
    return {
        "temp_band": F.when(temp.isNull() | F.isnan(temp), "none").when(temp > 30, "hot").when(temp > 20, "warm").otherwise("cool"),
        "temp_f": temp * 9 / 5 + 32,
        "co_glance": F.when(co_level == "alarm", "warn").when(co_level == "warning", "caution").when(co_valid, "live").otherwise("none"),
    }


def clock_source(valid: Column, is_stale: Column, iso: Column) -> Column:
    """``ds3231`` when the hardware clock is valid, fresh and readable, else ``system``."""
    return F.when(F.coalesce(valid & ~is_stale & iso.isNotNull(), F.lit(False)), "ds3231").otherwise("system")


def alert_priority(co_alarm: Column, co_level: Column, co_stale: Column, trail: Column, sun: Column) -> dict[str, Column]:
    """The one alert to show: carbon monoxide first, then trail, then daylight; a stale sensor is silent."""
    fresh = ~F.coalesce(co_stale, F.lit(False))
    kind = (
        F.when(co_alarm & fresh, "co_alarm").when((co_level == "warning") & fresh, "co_warning")
        .when(trail == "off_trail", "trail").when(sun == "return_now", "daylight")
    )
    return {
        "kind": kind,
        "severity": F.when(kind == "co_warning", "caution").when(kind.isNotNull(), "alarm"),
        "sound": F.coalesce(kind.isin("co_alarm", "co_warning"), F.lit(False)),
    }


def diagnostics(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Roll checks (state pass, demo, waiting or fail; critical or not) up to one status."""
    def any_of(cond):
        return F.coalesce(F.bool_or(cond), F.lit(False))

    agg = checks.groupBy(*keys).agg(
        any_of((F.col("state") == "fail") & F.col("critical")).alias("_fail"),
        any_of(F.col("state") == "demo").alias("_demo"),
        any_of(F.col("state") == "waiting").alias("_waiting"),
        F.count_if(F.col("state") == "pass").alias("n_pass"),
        F.count(F.lit(1)).alias("n_checks"),
    )
    status = (
        F.when(F.col("_fail"), "degraded").when(F.col("_demo"), "demo").when(F.col("_waiting"), "waiting").otherwise("ready")
    )
    return agg.withColumn("status", status).drop("_fail", "_demo", "_waiting")
