"""Logs of commands and speech: stored places and conversations, folded in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import conversation, waypoints
from ..operators.fleet import COMMANDS
from . import tables as T
from .registry import query

ACTIONS = [*COMMANDS, "save_checkpoint", "set", "select", "remove", "save_current", "route_last_checkpoint", "dance"]
IDS = ["basecamp", "destination", *[f"checkpoint-{k}" for k in range(1, 9)], "", "checkpoint-x"]


def waypoint_commands(spark: SparkSession, d: str) -> DataFrame:
    """Commands to store, route to and remove places, as events spread them over devices."""
    c, n = F.col, F.col("event_id") * 7919
    pick = lambda items, by: F.get(F.array(*[F.lit(i) for i in items]), (by % len(items)).cast("int"))
    fx = T.fixes(spark, d)
    return fx.select(
        "event_id", "device_id", "t_s", pick(ACTIONS, n).alias("action"), pick(["basecamp", "destination", "checkpoint", "camp", None], F.floor(n / 22)).alias("kind"),
        pick(IDS, F.floor(n / 110)).alias("id"), "fix", "lat", "lon",
        F.when(c("event_id") % 5 != 0, c("lat") + 0.25).alias("poi_lat"), F.when(c("event_id") % 5 != 0, c("lon") + 0.25).alias("poi_lon"),
        F.when(c("event_id") % 4 != 0, c("lat") - 0.25).alias("ago_lat"), F.when(c("event_id") % 4 != 0, c("lon") - 0.25).alias("ago_lon"))


def _list(items: list) -> str:
    return "[" + ", ".join("NULL" if i is None else f"'{i}'" for i in items) + "]"


T.define("wc", ["fixes"], f"""SELECT event_id, device_id, row_number() OVER (PARTITION BY device_id ORDER BY t_s, event_id) AS rn,
    ({_list(ACTIONS)})[event_id*7919%{len(ACTIONS)}+1] AS action, ({_list(["basecamp", "destination", "checkpoint", "camp", None])})[event_id*7919//22%5+1] AS kind,
    ({_list(IDS)})[event_id*7919//110%{len(IDS)}+1] AS id, fix, lat, lon, event_id%5<>0 AS poi, event_id%4<>0 AS ago FROM fixes""")
T.define("wlog", ["wc"], f"""SELECT DISTINCT device_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, '' AS status, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n,
      CAST([] AS BIGINT[]) AS gone, CAST(NULL AS DOUBLE) AS plat, CAST(NULL AS DOUBLE) AS plon, CAST(NULL AS DOUBLE) AS blat, CAST(NULL AS DOUBLE) AS blon,
      CAST(NULL AS DOUBLE) AS dlat, CAST(NULL AS DOUBLE) AS dlon, CAST(NULL AS VARCHAR) AS sel, false AS night FROM wc
    UNION ALL SELECT device_id, rn, event_id, CASE WHEN action='find_nearest_water' AND fix AND poi THEN 'confirmation_required'
        WHEN ch IS NOT NULL OR action IN ('night_on','night_off','night_toggle','status','reject_destination','cancel','remove') OR action='clear_destination' AND dlat IS NOT NULL THEN 'accepted'
        WHEN action='dance' THEN 'ignored' ELSE 'rejected' END,
      seq+CAST(voice AS BIGINT), n2, CASE WHEN action='remove' AND k<=n AND NOT list_contains(gone, k) THEN list_append(gone, k) ELSE gone END,
      CASE WHEN action='find_nearest_water' AND fix AND poi THEN lat+0.25::DOUBLE WHEN action IN ('clear_destination','confirm_destination','reject_destination','cancel') THEN NULL ELSE plat END,
      CASE WHEN action='find_nearest_water' AND fix AND poi THEN lon+0.25::DOUBLE WHEN action IN ('clear_destination','confirm_destination','reject_destination','cancel') THEN NULL ELSE plon END,
      CASE WHEN put='basecamp' THEN lat WHEN action='remove' AND nm='basecamp' THEN NULL ELSE blat END, CASE WHEN put='basecamp' THEN lon WHEN action='remove' AND nm='basecamp' THEN NULL ELSE blon END,
      CASE WHEN put='destination' THEN lat WHEN action='confirm_destination' AND plat IS NOT NULL THEN plat WHEN action='clear_destination' OR action='remove' AND nm='destination' THEN NULL ELSE dlat END,
      CASE WHEN put='destination' THEN lon WHEN action='confirm_destination' AND plat IS NOT NULL THEN plon WHEN action='clear_destination' OR action='remove' AND nm='destination' THEN NULL ELSE dlon END,
      CASE WHEN ch IS NOT NULL THEN ch WHEN action='clear_destination' AND dlat IS NOT NULL AND sel='destination' THEN NULL WHEN action='remove' AND nm=sel THEN NULL ELSE sel END,
      CASE action WHEN 'night_on' THEN true WHEN 'night_off' THEN false WHEN 'night_toggle' THEN NOT night ELSE night END
    FROM (SELECT *, CASE WHEN put='checkpoint' THEN 'checkpoint-'||n2 WHEN put IS NOT NULL THEN put WHEN action='route_basecamp' AND blat IS NOT NULL AND fix THEN 'basecamp'
          WHEN action='route_destination' AND dlat IS NOT NULL AND fix THEN 'destination' WHEN action='route_last_checkpoint' AND lk IS NOT NULL AND fix THEN 'checkpoint-'||lk
          WHEN action='select' AND (nm='basecamp' AND blat IS NOT NULL OR nm='destination' AND dlat IS NOT NULL OR k<=n AND n-k<50 AND NOT list_contains(gone, k)) THEN nm
          WHEN action='confirm_destination' AND plat IS NOT NULL THEN 'destination' END AS ch
      FROM (SELECT *, n+CAST(coalesce(put='checkpoint', false) AS BIGINT) AS n2 FROM (
        SELECT p.device_id, p.rn, p.event_id, p.action, p.fix, p.lat, p.lon, p.poi, s.seq, s.n, s.gone, s.plat, s.plon, s.blat, s.blon, s.dlat, s.dlon, s.sel, s.night,
          p.action IN ({_list(COMMANDS)[1:-1]}) AS voice, coalesce(nullif(p.id,''), p.kind) AS nm, TRY_CAST(regexp_extract(coalesce(nullif(p.id,''), p.kind), '^checkpoint-([0-9]+)$', 1) AS BIGINT) AS k,
          list_max(list_filter(range(greatest(1, s.n-49), s.n+1), lambda j: NOT list_contains(s.gone, j))) AS lk,
          CASE WHEN p.action='save_basecamp' AND p.fix THEN 'basecamp' WHEN p.action='save_checkpoint' AND p.fix OR p.action='route_recent_trace' AND p.fix AND p.ago THEN 'checkpoint'
            WHEN (p.action='save_current' AND p.fix OR p.action='set') AND p.kind IN ('basecamp','destination','checkpoint') THEN p.kind END AS put
        FROM wlog s JOIN wc p ON p.device_id=s.device_id AND p.rn=s.rn+1)))""")


@query("waypoint_log", T.ctes("wlog") + """ SELECT device_id, event_id, status, seq, n AS n_saved, sel AS selected, night, blat AS base_lat, blon AS base_lon, dlat AS dest_lat, dlon AS dest_lon
    FROM wlog WHERE rn>0""")
def waypoint_log(spark, d):
    out = waypoints.waypoint_log(waypoint_commands(spark, d), ["device_id"], chunk_s=1000.0)
    return out.select("device_id", "event_id", "status", "seq", "n_saved", "selected", "night", "base_lat", "base_lon", "dest_lat", "dest_lon")


def heard_segments(spark: SparkSession, d: str) -> DataFrame:
    """Users' turns as segments heard by a few devices, some of them within seconds of each other for long."""
    c, k = F.col, F.col("conv_id") * 31 + F.col("turn") * 17
    pick = lambda items, by: F.get(F.array(*[F.lit(i) for i in items]), (by % len(items)).cast("int"))
    rows = T.read(spark, d, "conversations").filter("role = 'user'").withColumn("k", k)
    at = c("conv_id") * 3 / F.lit(4.0) + c("turn") * 2 + c("k") % 13 / F.lit(2.0)
    return rows.select(
        (c("conv_id") % 7).alias("device_id"), (c("conv_id") * 1000 + c("turn")).cast("bigint").alias("seq"), at.alias("t_s"),
        (c("k") % 50 / F.lit(10.0)).alias("speech_s"), F.substring(F.coalesce("text", F.lit("")), 1, (c("k") % 5).cast("int")).alias("norm"), (c("k") % 3 == 0).alias("wake"),
        F.when(c("k") % 2 == 0, "x").otherwise("").alias("remainder"), pick(["yes", "no", None, None], c("k")).alias("answer"), (c("k") % 4 == 1).alias("asks"),
        (at + c("k") % 9 / F.lit(4.0)).alias("said_at"))


T.define("seg", [], """SELECT *, t_s+CAST(k%9 AS DOUBLE)/4.0::DOUBLE AS said_at, row_number() OVER (PARTITION BY device_id ORDER BY t_s, seq) AS rn FROM (
    SELECT *, CAST(conv_id*3 AS DOUBLE)/4.0::DOUBLE+turn*2+CAST(k%13 AS DOUBLE)/2.0::DOUBLE AS t_s, conv_id%7 AS device_id, CAST(conv_id*1000+turn AS BIGINT) AS seq,
      CAST(k%50 AS DOUBLE)/10.0::DOUBLE AS speech, substr(coalesce(text,''),1,k%5) AS norm, k%3=0 AS wake, k%2=1 AS bare, (['yes','no',NULL,NULL])[k%4+1] AS answer, k%4=1 AS asks
    FROM (SELECT *, CAST(conv_id*31+turn*17 AS BIGINT) AS k FROM conversations WHERE role='user'))""")
T.define("talk", ["seg"], """SELECT DISTINCT device_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS DOUBLE) AS t_s, 'idle' AS was, 'idle' AS now, '' AS act, false AS sc, false AS spoken,
      'idle' AS st, CAST(0 AS DOUBLE) AS until FROM seg
    UNION ALL SELECT device_id, rn, seq, t_s, was, now, act, sc, spoken, CASE WHEN act='G' THEN 'await_command' WHEN act='C' AND asks THEN 'await_confirm' WHEN act='C' THEN 'followup' ELSE now END,
      CASE WHEN act='G' OR act='C' AND asks THEN greatest(t_s, said_at)+10 WHEN act='C' THEN greatest(t_s, said_at)+6 ELSE until END
    FROM (SELECT *, CASE WHEN now='idle' THEN CASE WHEN NOT (spoken AND wake) THEN '' WHEN bare THEN 'G' ELSE 'C' END WHEN sc THEN 'C' WHEN norm='' THEN '' WHEN wake AND bare THEN 'G' ELSE 'C' END AS act
      FROM (SELECT *, now='await_confirm' AND speech>0 AND speech<=1 AND (coalesce(answer='yes',false) OR answer IS NULL AND length(replace(norm,' ',''))<=2) AS sc FROM (
        SELECT p.*, p.speech BETWEEN 0.25 AND 4 AS spoken, s.st AS was, CASE WHEN s.st<>'idle' AND p.t_s>=s.until THEN 'idle' ELSE s.st END AS now, s.until
        FROM talk s JOIN seg p ON p.device_id=s.device_id AND p.rn=s.rn+1)))""")


@query("conversation_sessions", T.ctes("talk") + """ SELECT device_id, seq, t_s, CAST(row_number() OVER (PARTITION BY device_id, seq ORDER BY o)-1 AS INTEGER) AS n, event, state FROM (
    SELECT device_id, seq, t_s, 0 AS o, 'timeout' AS event, was AS state FROM talk WHERE rn>0 AND was<>now
    UNION ALL SELECT device_id, seq, t_s, 1, 'short_confirm', now FROM talk WHERE rn>0 AND sc
    UNION ALL SELECT device_id, seq, t_s, 2, CASE act WHEN 'G' THEN 'wake' WHEN 'C' THEN 'command' ELSE CASE WHEN now<>'idle' THEN 'empty' WHEN NOT spoken THEN 'ignored_length' ELSE 'no_wake' END END, now FROM talk WHERE rn>0)""")
def conversation_sessions(spark, d):
    return conversation.conversation(heard_segments(spark, d), ["device_id"], chunk_s=60.0)
