"""Spoken alerts from device snapshots: keys of what is active, silence that ends them, edges, repeats and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..vocabulary import DEMO_PREFIX
from .asof import STALE_AFTER_S
from .latch import alert_edges
from .ordered import CHUNK_S, chunked, previous
from .replies import fixed

# Sources and sentences of the alerts.
SOURCES = {"co_key": "SAFE-PROACTIVE-CO", "trail_key": "SAFE-PROACTIVE-TRAIL", "daylight_key": "SAFE-PROACTIVE-DAYLIGHT", "arrival_key": "SAFE-PROACTIVE-ARRIVAL"}
CO_TEXT = {
    "alarm": ("일산화탄소 경보입니다.", "즉시 환기하고 대피하세요."),
    "warning": ("일산화탄소 주의입니다.", "환기하고 상태를 확인하세요."),
}
TRAIL_TEXT = {
    "off_trail": "트레일 이탈 경보입니다. 지도에서 현재 위치와 GPS 정확도를 확인하세요.",
    "off_trail_estimate": "트레일 이탈 가능성이 큽니다. GPS 정확도는 확인되지 않았으므로 지도에서 현재 위치를 확인하세요.",
}
DAYLIGHT_TEXT = "귀환 권고 시각에 도달했습니다. 베이스캠프 경로를 화면에서 확인하세요."
ARRIVAL_TEXT = ("베이스캠프에 도착하였습니다.", "목적지에 도착하였습니다.")


def silences(readings: DataFrame, keys: list[str], t: str, chunk_s: float = CHUNK_S) -> DataFrame:
    """The times at which a key has said nothing for 3 s: a row ``keys, t, since`` for each reading that none follows by then."""
    back = chunked(readings.select(*keys, F.col(t).alias("since")).withColumn("_back", -F.col("since")), "_back", chunk_s)
    later = previous(back, keys, ["_back"], {"_next": "since"})
    return later.filter(F.col("_next").isNull() | (F.col("_next") > F.col("since") + STALE_AFTER_S)).select(*keys, (F.col("since") + STALE_AFTER_S).alias(t), "since")


def active_keys(readings: DataFrame, keys: list[str], t: str = "t_s", chunk_s: float = CHUNK_S) -> DataFrame:
    """What is active at each reading, and after each silence: ``keys, t`` and the four channels of :func:`latch.alert_edges`.

    ``readings`` has the device's ``co_alarm`` and ``co_level``, ``trail_status``, ``sun_status``, ``arrived``, ``target_id`` and
    ``target_kind``; times are unique in a key. A silent device has no current value and no live fix: only daylight, which the clock
    decides, outlasts it.
    """
    c = F.col
    filled = lambda name: F.when(c(name) != "", c(name))
    active = readings.select(
        *keys, t,
        F.when(c("co_alarm"), "alarm").when(c("co_level") == "warning", "warning").alias("co_key"),
        F.when(c("trail_status").isin(list(TRAIL_TEXT)), c("trail_status")).alias("trail_key"),
        F.when(c("sun_status") == "return_now", "return_now").alias("daylight_key"),
        F.when(c("arrived"), F.coalesce(filled("target_id"), filled("target_kind"), F.lit("target"))).alias("arrival_key"))
    quiet = silences(readings, keys, t, chunk_s).withColumnRenamed(t, "_at").withColumnRenamed("since", t)
    none = F.lit(None).cast("string")
    ended = quiet.join(active.select(*keys, t, "daylight_key"), [*keys, t]).select(
        *keys, c("_at").alias(t), none.alias("co_key"), none.alias("trail_key"), "daylight_key", none.alias("arrival_key"))
    return active.unionByName(ended)


def alerts_from_readings(readings: DataFrame, keys: list[str], t: str = "t_s", chunk_s: float = CHUNK_S) -> DataFrame:
    """Alerts to be spoken: ``keys, t, ord, kind, source_id, severity, sound, repeated, text``.

    One when something becomes active or changes, carbon monoxide again every 20 s (alarm) or 60 s (warning) while it lasts; what ends, by
    a reading or by 3 s of silence, is told again when it comes back. Samples carry a prefix (``demo``), carbon monoxide never: its value
    is measured whatever the map shows. A value that is missing is said to be so (``co_ppm``).
    """
    c = F.col
    edges = alert_edges(active_keys(readings, keys, t, chunk_s), keys, t, chunk_s)
    said = readings.select(*keys, t, "co_ppm", F.coalesce("demo", F.lit(False)).alias("demo"), "target_id", "target_kind")
    rows = edges.join(said, [*keys, t])
    pick = lambda table, i=None: reduce(lambda acc, kv: acc.when(c("key") == kv[0], kv[1] if i is None else kv[1][i]), table.items(), F.when(F.lit(False), ""))
    value = F.coalesce(fixed(c("co_ppm")), F.lit("확인 불가"))
    base = F.coalesce((c("target_id") == "basecamp") | (c("target_kind") == "basecamp"), F.lit(False))
    text = (
        F.when(c("channel") == "co_key", F.concat(pick(CO_TEXT, 0), F.lit(" 센서 계측은 "), value, F.lit("피피엠입니다. "), pick(CO_TEXT, 1)))
        .when(c("channel") == "trail_key", pick(TRAIL_TEXT)).when(c("channel") == "daylight_key", DAYLIGHT_TEXT)
        .otherwise(F.when(base, ARRIVAL_TEXT[0]).otherwise(ARRIVAL_TEXT[1]))
    )
    kind = F.when(c("channel") == "co_key", F.concat(F.lit("co_"), c("key"))).otherwise(F.regexp_replace("channel", "_key$", ""))
    source = reduce(lambda acc, kv: acc.when(c("channel") == kv[0], kv[1]), SOURCES.items(), F.when(F.lit(False), ""))
    return rows.select(
        *keys, t, "ord", kind.alias("kind"), source.alias("source_id"), F.when(kind == "co_warning", "caution").otherwise("alarm").alias("severity"),
        F.when(c("sound"), c("key")).alias("sound"), "repeated", F.when(c("demo") & ~c("sound"), F.concat(F.lit(DEMO_PREFIX), text)).otherwise(text).alias("text"))
