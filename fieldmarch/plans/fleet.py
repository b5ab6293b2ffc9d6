"""Fleet state: snapshots, position history, sessions, commands, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import alerts, asof, fleet, latch, ordered
from ..vocabulary import DEMO_PREFIX
from . import tables as T
from .registry import query

BOOT = ["device_id", "boot_id"]


def readings(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return T.fixes(spark, d).select(
        "event_id", *BOOT, "t_s", "fix", "lat", "lon", "acc_m", "satellites", "event_type",
        F.when(c("event_id") % 3 != 0, (c("event_id") % 600 - 100) / 10.0).alias("temp_c"),
        F.element_at(F.array(*[F.lit(x) for x in ("rising", "steady", "falling", "unknown")]), (c("event_id") % 4 + 1).cast("int")).alias("press_trend"),
        (c("event_type") != "error").alias("co_valid"), c("value").alias("co_ppm"),
    )


T.define("readings", ["fixes", "ev"], """SELECT f.*, CASE WHEN f.event_id%3<>0 THEN CAST(f.event_id%600-100 AS DOUBLE)/10.0::DOUBLE END AS temp_c,
    (['rising','steady','falling','unknown'])[f.event_id%4+1] AS press_trend, f.event_type<>'error' AS co_valid, e.value AS co_ppm
    FROM fixes f JOIN ev e USING (event_id)""")
T.define("snap", ["readings"], """SELECT device_id, last_t, coalesce(at_s-fix_t<=3,false) AS fix_live,
    CASE WHEN at_s-fix_t<=3 THEN 'current_fix' WHEN fix_t IS NOT NULL THEN 'last_fix' ELSE 'none' END AS location_ref,
    lat, lon, CASE WHEN at_s-fix_t<=3 THEN acc END AS acc_m, at_s-fix_t AS fix_age_s,
    coalesce(at_s-env_t>3,true) AS env_stale, CASE WHEN at_s-env_t<=3 THEN temp END AS temp_c,
    CASE WHEN at_s-env_t<=3 THEN trend ELSE 'unknown' END AS press_trend, at_s-last_t>3 AS co_stale,
    at_s-last_t<=3 AND cov AS co_valid, CASE WHEN at_s-last_t<=3 AND cov THEN ppm END AS co_ppm FROM (
    SELECT device_id, max(t_s) AS last_t, max(t_s)+device_id%6 AS at_s, max(t_s) FILTER (fix) AS fix_t, max(t_s) FILTER (event_id%3<>0) AS env_t,
      arg_max(lat,t_s) FILTER (fix) AS lat, arg_max(lon,t_s) FILTER (fix) AS lon,
      (arg_max({'a':acc_m},t_s) FILTER (fix)).a AS acc, arg_max(temp_c,t_s) FILTER (event_id%3<>0) AS temp,
      arg_max(press_trend,t_s) FILTER (event_id%3<>0) AS trend, arg_max(co_valid,t_s) AS cov, arg_max(co_ppm,t_s) AS ppm
    FROM readings GROUP BY device_id)""")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    return fleet.device_snapshot(readings(spark, d), F.col("last_t") + F.col("device_id") % 6)


@query("device_snapshot", T.ctes("snap") + " SELECT * FROM snap")
def device_snapshot(spark, d):
    return snapshots(spark, d)


@query("public_view", T.ctes("snap") + """ SELECT device_id, location_ref, fix_live, round(fix_age_s,1) AS fix_age_s, acc_m, temp_c, co_ppm FROM snap""")
def public_view(spark, d):
    return fleet.public_view(snapshots(spark, d))


@query("demo_devices", """SELECT user_id AS device_id, bool_or(starts_with(event_type,'p')) AS demo FROM events GROUP BY user_id""")
def demo_devices(spark, d):
    source = F.when(F.col("event_type") == "purchase", "demo_walk").otherwise("gps")
    e = T.ev(spark, d).withColumn("source", source)
    return e.groupBy("device_id").agg(F.bool_or(F.col("source").startswith("demo_")).alias("demo"))


@query("live_fixes", T.ctes("fixes") + " SELECT event_id, device_id, t_s, lat, lon, acc_m FROM fixes WHERE fix AND lat BETWEEN -90 AND 90")
def live_fixes(spark, d):
    return fleet.live_fixes(T.fixes(spark, d)).select("event_id", "device_id", "t_s", "lat", "lon", "acc_m")


@query("history_load", T.ctes("fixes") + """ SELECT event_id, device_id, t_s AS monotonic_s FROM fixes
    WHERE event_id%31<>0 AND boot_id=2 AND 8000.0::DOUBLE-t_s BETWEEN -1 AND 2000""")
def history_load(spark, d):
    c = F.col
    records = T.fixes(spark, d).select(
        "event_id", "device_id", F.when(c("event_id") % 31 != 0, 1).otherwise(9).alias("version"),
        c("boot_id").cast("string").alias("boot_id"), c("t_s").alias("monotonic_s"), "lat", "lon", c("acc_m").alias("accuracy_m"), "satellites")
    return fleet.load_history(records, F.lit(8000.0), F.lit("2"), 2000.0).select("event_id", "device_id", "monotonic_s")


@query("history_summary", T.ctes("fixes") + """ SELECT device_id, boot_id, count(*) AS n, round(9000.0::DOUBLE-min(t_s),1) AS oldest_age_s,
    round(9000.0::DOUBLE-max(t_s),1) AS newest_age_s, bool_or(abs(9000.0::DOUBLE-t_s-180)<=25) AS recent_trace_ready FROM fixes WHERE fix GROUP BY device_id, boot_id""")
def history_summary(spark, d):
    return fleet.history_summary(fleet.live_fixes(T.fixes(spark, d)), BOOT, "t_s", F.lit(9000.0))


@query("point_ago", T.ctes("fixes") + """ SELECT r.event_id, r.t_s, b.event_id AS found_event_id, b.gap AS found_gap_s FROM fixes r LEFT JOIN (
    SELECT r.event_id AS rid, arg_min(p.event_id, [abs(p.t_s-(r.t_s-180)), p.t_s]) AS event_id, min(abs(p.t_s-(r.t_s-180))) AS gap
    FROM fixes r JOIN fixes p ON p.device_id=r.device_id AND p.boot_id=r.boot_id AND p.fix AND abs(p.t_s-(r.t_s-180))<=25 GROUP BY r.event_id) b ON b.rid=r.event_id""")
def point_ago(spark, d):
    fx = T.fixes(spark, d)
    pos = fleet.live_fixes(fx).select(*BOOT, "t_s", "event_id")
    req = fx.select(*BOOT, "t_s", "event_id")
    return asof.point_ago(req, pos, BOOT, "t_s", "t_s").select("event_id", "t_s", "found_event_id", "found_gap_s")


T.define("seq_fix", ["fixes"], "SELECT *, row_number() OVER (PARTITION BY device_id, boot_id ORDER BY t_s) AS rn FROM fixes WHERE fix")
T.define("thin", ["seq_fix"], """SELECT device_id, boot_id, rn, t_s AS kept, event_id, true AS k FROM seq_fix WHERE rn=1
    UNION ALL SELECT s.device_id, s.boot_id, s.rn, CASE WHEN s.t_s>=t.kept+100 THEN s.t_s ELSE t.kept END, s.event_id, s.t_s>=t.kept+100
    FROM thin t JOIN seq_fix s ON s.device_id=t.device_id AND s.boot_id=t.boot_id AND s.rn=t.rn+1""")


@query("throttle", T.ctes("thin") + " SELECT event_id, device_id, boot_id, kept AS t_s FROM thin WHERE k")
def throttle(spark, d):
    fx = fleet.live_fixes(T.fixes(spark, d)).select("event_id", *BOOT, "t_s")
    return ordered.throttle(fx, BOOT, "t_s", 100.0)


T.define("buttons", ["ev"], """SELECT device_id, event_id, t_s, CASE WHEN event_type IN ('click','view','error') THEN 'voice' ELSE 'power' END AS button,
    CASE WHEN event_id%2=0 THEN 'pressed' ELSE 'released' END AS state, CASE WHEN event_id%2=0 THEN 0 ELSE CAST(floor(value*100) AS BIGINT) END AS held_ms FROM ev""")


@query("button_sessions", T.ctes("buttons") + """ SELECT event_id, device_id, t_s, button, held_ms, event_no,
    CASE WHEN button='voice' THEN CASE WHEN held_ms BETWEEN 250 AND 15000 THEN 'finish' ELSE 'discard' END WHEN held_ms>=2000 THEN 'shutdown' END AS outcome FROM (
    SELECT *, count(*) OVER (PARTITION BY device_id ORDER BY t_s) AS event_no, lag(state) OVER (PARTITION BY device_id, button ORDER BY t_s) AS before FROM buttons)
    WHERE state='released' AND before='pressed'""")
def button_sessions(spark, d):
    c = F.col
    b = T.ev(spark, d).select(
        "device_id", "event_id", "t_s", F.when(c("event_type").isin("click", "view", "error"), "voice").otherwise("power").alias("button"),
        F.when(c("event_id") % 2 == 0, "pressed").otherwise("released").alias("state"),
        F.when(c("event_id") % 2 == 0, 0).otherwise(F.floor(c("value") * 100)).cast("bigint").alias("held_ms"))
    out = fleet.button_sessions(b, ["device_id"], "t_s")
    return out.select("event_id", "device_id", "t_s", "button", "held_ms", "event_no", "outcome")


T.define("pw", ["ev"], """SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t_s) AS rn, lag(rep IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY t_s) AS seen FROM (
    SELECT *, CASE WHEN source<>'command' THEN {'t': t_s, 'p': pending} END AS rep FROM (
    SELECT device_id, event_id, t_s/50.0::DOUBLE AS t_s, CASE WHEN event_type IN ('signup','purchase') THEN 'event' WHEN event_type='error' THEN 'telemetry' ELSE 'command' END AS source,
      CASE event_type WHEN 'signup' THEN 'shutdown_requested' WHEN 'purchase' THEN (CASE WHEN event_id%3=0 THEN 'shutdown_timeout' ELSE 'shutdown_ack' END)
        WHEN 'click' THEN 'ack' WHEN 'view' THEN 'cancel' END AS state,
      CASE event_type WHEN 'signup' THEN true WHEN 'purchase' THEN event_id%3<>0 WHEN 'error' THEN event_id%4<>0 END AS pending FROM ev))""")
T.define("pwf", ["pw"], """SELECT device_id, rn, event_id, CASE WHEN state='shutdown_requested' THEN 'pending' WHEN state='shutdown_ack' THEN 'armed' ELSE 'idle' END AS phase FROM pw WHERE rn=1
    UNION ALL SELECT p.device_id, p.rn, p.event_id, CASE WHEN p.source='telemetry' THEN (CASE WHEN NOT p.pending THEN 'idle' ELSE f.phase END)
      WHEN p.state='shutdown_requested' THEN 'pending' WHEN p.state='shutdown_ack' THEN 'armed' WHEN p.state='shutdown_timeout' THEN 'idle'
      WHEN p.state='ack' AND f.phase IN ('idle','pending') AND p.t_s-p.seen.t<=3 AND p.seen.p THEN 'ack_queued'
      WHEN p.state='cancel' AND f.phase IN ('pending','ack_queued','armed') THEN 'cancel_queued' ELSE f.phase END
    FROM pwf f JOIN pw p ON p.device_id=f.device_id AND p.rn=f.rn+1""")


@query("power_phase", T.ctes("pwf") + " SELECT event_id, device_id, phase FROM pwf")
def power_phase(spark, d):
    c, k = F.col, F.col("event_type")
    e = T.ev(spark, d).select(
        "device_id", "event_id", (c("t_s") / 50.0).alias("t_s"),
        F.when(k.isin("signup", "purchase"), "event").when(k == "error", "telemetry").otherwise("command").alias("source"),
        F.when(k == "signup", "shutdown_requested").when(k == "purchase", F.when(c("event_id") % 3 == 0, "shutdown_timeout").otherwise("shutdown_ack"))
        .when(k == "click", "ack").when(k == "view", "cancel").alias("state"),
        F.lit(True).alias("gate_on"),
        F.when(k == "signup", True).when(k == "purchase", c("event_id") % 3 != 0).when(k == "error", c("event_id") % 4 != 0).alias("shutdown_pending"))
    return fleet.power_phase(e, ["device_id"], "t_s", chunk_s=60.0).select("event_id", "device_id", "phase")


@query("last_checkpoints", T.ctes("ev") + """ SELECT device_id, event_id, t_s FROM ev QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY t_s DESC)<=50""")
def last_checkpoints(spark, d):
    return fleet.last_checkpoints(T.ev(spark, d).select("device_id", "event_id", "t_s"), ["device_id"], "t_s").drop("rank_back")


@query("env_bands", T.ctes("readings") + """ SELECT event_id, CASE WHEN temp_c IS NULL THEN 'none' WHEN temp_c>30 THEN 'hot' WHEN temp_c>20 THEN 'warm' ELSE 'cool' END AS temp_band,
    round(temp_c*9/5+32,2) AS temp_f, CASE WHEN co_ppm>=100 THEN 'warn' WHEN co_ppm>=35 THEN 'caution' WHEN co_valid THEN 'live' ELSE 'none' END AS co_glance FROM readings""")
def env_bands(spark, d):
    level = F.when(F.col("co_ppm") >= 100, "alarm").when(F.col("co_ppm") >= 35, "warning").otherwise("normal")
    r = readings(spark, d).withColumn("level", level)
    bands = fleet.env_bands(F.col("temp_c"), F.col("co_valid"), F.col("level"))
    out = r.select("event_id", *[v.alias(k) for k, v in bands.items()])
    return out.withColumn("temp_f", F.round("temp_f", 2))


@query("valid_commands", """SELECT event_id, a AS action, coalesce(event_id%5<>0 AND a IN ('status','night_on','save_basecamp'), false) AS accepted FROM (
    SELECT event_id, CASE WHEN event_id%7=0 THEN NULL ELSE (['status','night_on','save_basecamp','fly'])[event_id%4+1] END AS a FROM events)""")
def valid_commands(spark, d):
    c = F.col
    action = F.element_at(F.array(*[F.lit(x) for x in ("status", "night_on", "save_basecamp", "fly")]), (c("event_id") % 4 + 1).cast("int"))
    body = (
        F.when(c("event_id") % 7 == 0, F.lit("[1, 2"))
        .when(c("event_id") % 5 == 0, F.format_string('{"action":"%s","request_id":"r%d","lat":1}', action, c("event_id")))
        .when(c("event_id") % 3 == 0, F.format_string('{"action":" %s "}', action))
        .otherwise(F.format_string('{"action":"%s","request_id":"r%d"}', action, c("event_id")))
    )
    e = T.read(spark, d, "events").select("event_id", body.alias("body"))
    return fleet.valid_commands(e, "body").select("event_id", "action", "accepted")


@query("clock_source", """SELECT event_id, CASE WHEN event_id%2=0 AND event_id%3<>0 AND event_id%5<>0 THEN 'ds3231' ELSE 'system' END AS clock FROM events""")
def clock_source(spark, d):
    c = F.col("event_id")
    return T.read(spark, d, "events").select(
        "event_id", fleet.clock_source(c % 2 == 0, c % 3 == 0, F.when(c % 5 != 0, F.col("ts"))).alias("clock"))


@query("alert_priority", """SELECT event_id, kind, CASE WHEN kind='co_warning' THEN 'caution' WHEN kind IS NOT NULL THEN 'alarm' END AS severity,
    coalesce(kind IN ('co_alarm','co_warning'),false) AS sound FROM (SELECT event_id, CASE WHEN value>=100 AND event_id%5<>0 THEN 'co_alarm'
      WHEN value>=35 AND value<100 AND event_id%5<>0 THEN 'co_warning' WHEN event_type='view' THEN 'trail' WHEN event_type='click' THEN 'daylight' END AS kind FROM events)""")
def alert_priority(spark, d):
    c = F.col
    level = F.when(c("value") >= 100, "alarm").when(c("value") >= 35, "warning").otherwise("normal")
    cols = fleet.alert_priority(
        level == "alarm", level, c("event_id") % 5 == 0, F.when(c("event_type") == "view", "off_trail"),
        F.when(c("event_type") == "click", "return_now"))
    return T.read(spark, d, "events").select("event_id", *[v.alias(k) for k, v in cols.items()])


@query("diagnostics", """SELECT user_id AS device_id, CASE WHEN bool_or(st='fail' AND cr) THEN 'degraded' WHEN bool_or(st='demo') THEN 'demo' WHEN bool_or(st='waiting') THEN 'waiting' ELSE 'ready' END AS status,
    count(*) FILTER (st='pass') AS n_pass, count(*) AS n_checks FROM (SELECT user_id, event_type IN ('click','view') AS cr,
      CASE WHEN value>250 THEN 'fail' WHEN value>200 THEN 'demo' WHEN value>150 THEN 'waiting' ELSE 'pass' END AS st FROM events) GROUP BY user_id""")
def diagnostics(spark, d):
    v = F.col("value")
    checks = T.ev(spark, d).select(
        "device_id", F.col("event_type").isin("click", "view").alias("critical"),
        F.when(v > 250, "fail").when(v > 200, "demo").when(v > 150, "waiting").otherwise("pass").alias("state"))
    return fleet.diagnostics(checks, ["device_id"])


T.define("chan", ["ev"], """SELECT device_id, t_s, 0 AS ord, 'co_key' AS channel, CASE WHEN event_id%5<>0 THEN CASE WHEN value>=60 THEN 'alarm' WHEN value>=20 THEN 'warning' END END AS key FROM ev
    UNION ALL SELECT device_id, t_s, 1, 'trail_key', CASE WHEN event_type='view' THEN 'off_trail' WHEN event_type='click' THEN 'off_trail_estimate' END FROM ev
    UNION ALL SELECT device_id, t_s, 2, 'daylight_key', CASE WHEN event_id%3=0 THEN 'return_now' END FROM ev
    UNION ALL SELECT device_id, t_s, 3, 'arrival_key', CASE WHEN event_type='signup' THEN 'basecamp' END FROM ev""")
T.define("chan_n", ["chan"], """SELECT *, row_number() OVER w AS rn, lag(key) OVER w AS pk FROM chan WINDOW w AS (PARTITION BY device_id, ord ORDER BY t_s)""")
T.define("emit", ["chan_n"], """SELECT device_id, ord, channel, key, t_s, rn, key IS NOT NULL AS e, key IS NOT NULL AND false AS rep, t_s AS last_t FROM chan_n WHERE rn=1
    UNION ALL SELECT c.device_id, c.ord, c.channel, c.key, c.t_s, c.rn,
      coalesce(c.key IS NOT NULL AND (c.pk IS DISTINCT FROM c.key OR (c.ord=0 AND c.t_s>=e.last_t+CASE WHEN c.key='alarm' THEN 20 ELSE 60 END)), false),
      coalesce(c.key IS NOT NULL AND c.pk=c.key, false),
      CASE WHEN c.key IS NOT NULL AND (c.pk IS DISTINCT FROM c.key OR c.t_s>=e.last_t+CASE WHEN c.key='alarm' THEN 20 ELSE 60 END) THEN c.t_s ELSE e.last_t END
    FROM emit e JOIN chan_n c ON c.device_id=e.device_id AND c.ord=e.ord AND c.rn=e.rn+1""")


def alert_channels(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return T.ev(spark, d).select(
        "device_id", "t_s",
        F.when(c("event_id") % 5 != 0, F.when(c("value") >= 60, "alarm").when(c("value") >= 20, "warning")).alias("co_key"),
        F.when(c("event_type") == "view", "off_trail").when(c("event_type") == "click", "off_trail_estimate").alias("trail_key"),
        F.when(c("event_id") % 3 == 0, "return_now").alias("daylight_key"),
        F.when(c("event_type") == "signup", "basecamp").alias("arrival_key"))


@query("alert_edges", T.ctes("emit") + " SELECT device_id, t_s, CAST(ord AS INTEGER) AS ord, channel, key, rep AS repeated, ord=0 AS sound FROM emit WHERE e")
def alert_edges(spark, d):
    return latch.alert_edges(alert_channels(spark, d), ["device_id"])


T.define("acts", ["ev"], """SELECT *, row_number() OVER w AS rn, lag(action) OVER w AS pa FROM (SELECT device_id, event_id, t_s/40.0::DOUBLE AS t_s,
    CASE WHEN event_type IN ('view','error') THEN 'trail_alert' WHEN event_type='click' THEN 'trail_caution' ELSE 'trail_clear' END AS action FROM ev) WINDOW w AS (PARTITION BY device_id ORDER BY t_s)""")
T.define("sent", ["acts"], """SELECT device_id, event_id, t_s, action, rn, true AS e, false AS ka, t_s AS last_t FROM acts WHERE rn=1
    UNION ALL SELECT a.device_id, a.event_id, a.t_s, a.action, a.rn, a.action<>a.pa OR (a.action<>'trail_clear' AND a.t_s>=s.last_t+2), a.action=a.pa,
      CASE WHEN a.action<>a.pa OR (a.action<>'trail_clear' AND a.t_s>=s.last_t+2) THEN a.t_s ELSE s.last_t END
    FROM sent s JOIN acts a ON a.device_id=s.device_id AND a.rn=s.rn+1""")


@query("trail_output", T.ctes("sent") + " SELECT device_id, event_id, t_s, action, ka AS keepalive FROM sent WHERE e")
def trail_output(spark, d):
    k = F.col("event_type")
    e = T.ev(spark, d).select(
        "device_id", "event_id", (F.col("t_s") / 40.0).alias("t_s"),
        F.when(k.isin("view", "error"), "off_trail").when(k == "click", "off_trail_estimate").otherwise("on_trail").alias("status"))
    out = latch.trail_output(e, ["device_id"], "t_s", "status", chunk_s=100.0)
    return out.select("device_id", "event_id", "t_s", "action", "keepalive")


def alert_readings(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots a few seconds apart, some with longer silence between; the device's own level may stay above its reading."""
    c, k = F.col, F.col("event_id")
    return T.ev(spark, d).select(
        "device_id", (c("t_s") / 50.0).alias("t_s"), F.when(k % 13 != 0, c("value")).alias("co_ppm"),
        ((c("value") >= 60) & (k % 5 != 0)).alias("co_alarm"), F.when(c("value") >= 20, "warning").otherwise("normal").alias("co_level"),
        F.when(c("event_type") == "view", "off_trail").when(c("event_type") == "click", "off_trail_estimate").otherwise("on_trail").alias("trail_status"),
        F.when(k % 3 == 0, "return_now").otherwise("normal").alias("sun_status"), (c("event_type") == "signup").alias("arrived"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "basecamp").when(k % 4 == 2, "checkpoint-2").alias("target_id"),
        F.when(k % 7 < 3, "basecamp").when(k % 7 < 6, "destination").alias("target_kind"), (k % 6 == 0).alias("demo"))


T.define("ard", ["ev"], """SELECT device_id, t_s/50.0::DOUBLE AS t_s, event_id AS k, CASE WHEN event_id%13<>0 THEN value END AS ppm, event_id%6=0 AS demo,
    CASE WHEN value>=60 AND event_id%5<>0 THEN 'alarm' WHEN value>=20 THEN 'warning' END AS co, CASE event_type WHEN 'view' THEN 'off_trail' WHEN 'click' THEN 'off_trail_estimate' END AS trail,
    CASE WHEN event_id%3=0 THEN 'return_now' END AS sun, CASE WHEN event_type='signup' THEN coalesce(CASE event_id%4 WHEN 1 THEN 'basecamp' WHEN 2 THEN 'checkpoint-2' END,
      CASE WHEN event_id%7<3 THEN 'basecamp' WHEN event_id%7<6 THEN 'destination' END, 'target') END AS arr, event_id%4=1 OR event_id%7<3 AS base,
    lead(t_s/50.0::DOUBLE) OVER (PARTITION BY device_id ORDER BY t_s) AS nt FROM ev""")
T.define("achan", ["ard"], """SELECT device_id, t_s, 0 AS ord, 'co_key' AS channel, co AS key FROM ard UNION ALL SELECT device_id, t_s, 1, 'trail_key', trail FROM ard
    UNION ALL SELECT device_id, t_s, 2, 'daylight_key', sun FROM ard UNION ALL SELECT device_id, t_s, 3, 'arrival_key', arr FROM ard
    UNION ALL SELECT device_id, t_s+3.0::DOUBLE, o, ch, CASE WHEN o=2 THEN sun END FROM ard, (VALUES (0,'co_key'),(1,'trail_key'),(2,'daylight_key'),(3,'arrival_key')) AS x(o, ch)
      WHERE nt IS NULL OR nt>t_s+3.0::DOUBLE""")
for _name, _new in (("chan_n", "achan_n"), ("emit", "aemit")):
    T.define(_new, ["achan" if _new == "achan_n" else "achan_n"], T.sql_of(_name).replace("FROM chan ", "FROM achan ").replace("chan_n", "achan_n").replace("FROM emit ", "FROM aemit "))


@query("alerts_from_readings", T.ctes("aemit") + f""" SELECT e.device_id, e.t_s, CAST(ord AS INTEGER) AS ord, CASE ord WHEN 0 THEN 'co_'||key WHEN 1 THEN 'trail' WHEN 2 THEN 'daylight' ELSE 'arrival' END AS kind,
    'SAFE-PROACTIVE-'||(['CO','TRAIL','DAYLIGHT','ARRIVAL'])[ord+1] AS source_id, CASE WHEN ord=0 AND key='warning' THEN 'caution' ELSE 'alarm' END AS severity,
    CASE WHEN ord=0 THEN key END AS sound, rep AS repeated, CASE WHEN demo AND ord<>0 THEN '{DEMO_PREFIX}' ELSE '' END||CASE ord
      WHEN 0 THEN CASE key WHEN 'alarm' THEN '{alerts.CO_TEXT["alarm"][0]}' ELSE '{alerts.CO_TEXT["warning"][0]}' END||' 센서 계측은 '||coalesce(CAST(CAST(round_even(ppm,0) AS BIGINT) AS VARCHAR),'확인 불가')||'피피엠입니다. '||
        CASE key WHEN 'alarm' THEN '{alerts.CO_TEXT["alarm"][1]}' ELSE '{alerts.CO_TEXT["warning"][1]}' END
      WHEN 1 THEN CASE key WHEN 'off_trail' THEN '{alerts.TRAIL_TEXT["off_trail"]}' ELSE '{alerts.TRAIL_TEXT["off_trail_estimate"]}' END
      WHEN 2 THEN '{alerts.DAYLIGHT_TEXT}' ELSE CASE WHEN coalesce(base, false) THEN '{alerts.ARRIVAL_TEXT[0]}' ELSE '{alerts.ARRIVAL_TEXT[1]}' END END AS text
    FROM aemit e JOIN ard a ON a.device_id=e.device_id AND a.t_s=e.t_s WHERE e.e""")
def alerts_from_readings(spark, d):
    return alerts.alerts_from_readings(alert_readings(spark, d), ["device_id"], chunk_s=60.0)
