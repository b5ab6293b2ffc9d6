"""Spoken replies and state lines built from device snapshots, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import settle
from ..functions.text import char_classes, tokens_of
from ..vocabulary import DEMO_PREFIX


def fixed(value: Column, digits: int = 0) -> Column:
    """A number with a fixed count of decimals, ties to even; NULL stays NULL."""
    rounded = F.bround(value, digits)
    return rounded.cast("bigint").cast("string") if digits == 0 else F.when(
        value.isNotNull(), F.format_string(f"%.{digits}f", rounded))


def _when_all(cond: Column, *pieces: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.array_compact(F.array(*pieces)))


def card_lines(scenario: Column, d: str, sentences: Column) -> Column:
    """Sentences of a reply: live values where the scenario has them, else the card's own.

    ``d`` is a struct column with gps_fix, acc_m, satellites, has_last_fix, last_age_s, arrived,
    target_kind, trail_status, offset_m, route_available, bearing_deg, distance_m, sun_computed,
    sun_reference, remaining_min, return_by_clock, sun_level, env_valid, temp_c, humidity_pct,
    press_hpa, press_trend, power_valid, percent, days_left, co_valid, co_stale, co_ppm.
    """
    c = lambda name: F.col(f"{d}.{name}")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    acc, off = fixed(c("acc_m"), 1), fixed(c("offset_m"))
    # Sentence formats of the live replies.
    lost_fix = F.array(
        F.lit("GPS가 현재 위치를 수신 중입니다."),
        say("정확도는 ", F.coalesce(say("플러스마이너스 ", acc, "미터"), F.lit("확인 불가")), "이며 위성은 ",
            F.coalesce(say(c("satellites").cast("string"), "개"), F.lit("확인 불가")), "입니다."),
        F.lit("좌표는 화면에서 정확도와 함께 확인하세요."))
    lost_old = F.array(
        F.lit("현재 GPS가 미수신입니다."),
        F.coalesce(say("마지막 확정 위치는 ", fixed(c("last_age_s")), "초 전 값입니다."), F.lit("마지막 확정 위치의 경과 시간은 확인할 수 없습니다.")),
        F.lit("위치를 추정하지 않으며 좌표는 화면에서 확인하세요."))
    trail = (
        F.when((c("trail_status") == "off_trail") & off.isNotNull(), say("지도 엔진 기준 트레일에서 ", off, "미터 벗어난 상태입니다."))
        .when(c("trail_status") == "on_trail", "현재 위치는 트레일 허용 범위 안입니다.")
        .when((c("trail_status") == "off_trail_estimate") & off.isNotNull(), say("트레일에서 ", off, "미터 벗어난 것으로 추정되지만 현재 상태는 확정할 수 없습니다."))
        .when(c("trail_status").isin("accuracy_unknown", "uncertain"), say(
            F.coalesce(say("트레일까지 계산 거리는 ", off, "미터이지만 "), F.lit("")), "GPS 정확도가 없어 트레일 상태를 확정할 수 없습니다."))
        .when(c("trail_status") == "last_fix_only", "현재 GPS가 미수신이므로 트레일 상태를 확정하지 않고 마지막 위치만 표시합니다.")
    )
    guided = c("route_available") & c("gps_fix") & c("bearing_deg").isNotNull() & c("distance_m").isNotNull()
    way = F.array_compact(F.array(
        trail, F.when(guided, say("지도 엔진 계산 방위는 ", fixed(c("bearing_deg")), "도입니다.")),
        F.when(guided, say("경로 거리는 ", fixed(c("distance_m")), "미터입니다.")),
        F.when(guided, F.coalesce(say("GPS 정확도는 플러스마이너스 ", acc, "미터입니다."), F.lit("GPS 정확도는 확인할 수 없습니다.")))))
    way = F.when(c("arrived"), F.array(F.when(c("target_kind") == "basecamp", "베이스캠프에 도착하였습니다.").otherwise("목적지에 도착하였습니다."))).when(
        F.size(way) > 0, F.slice(way, 1, 4))
    left = F.bround(c("remaining_min"))
    sun = _when_all(
        c("sun_computed") & left.isNotNull(),
        F.when(left < 0, say("일몰 후 ", fixed(F.abs(left)), "분 지났습니다.")).otherwise(say("일몰까지 ", fixed(left), "분 남았습니다.")),
        F.when(c("sun_reference") == "last_fix", "마지막 확정 위치 기준입니다.").otherwise("현재 GPS 위치 기준입니다."),
        F.when(c("return_by_clock").isNotNull(), say("등록된 베이스캠프 기준 귀환 권고 시각은 ", c("return_by_clock"), "입니다.")),
        F.when(c("sun_level") == "danger", "귀환 권고 시각에 도달했습니다. 베이스캠프 경로를 확인하세요.")
        .when(c("sun_level") == "caution", "귀환 권고 시각이 가까워졌습니다. 베이스캠프 경로를 확인하세요.")
        .when(c("sun_level") == "normal", "현재는 귀환 주의 임계 전입니다."))
    trend = F.when(c("press_trend") == "rising", "상승").when(c("press_trend") == "steady", "유지").when(c("press_trend") == "falling", "하강").otherwise("확인 불가")
    env = _when_all(
        c("env_valid") & c("temp_c").isNotNull() & c("humidity_pct").isNotNull(),
        say("현장 센서 온도는 ", fixed(c("temp_c"), 1), "도, 습도는 ", fixed(c("humidity_pct")), "퍼센트입니다."),
        say("현장 기압은 ", fixed(c("press_hpa"), 1), "헥토파스칼이며 추세는 ", trend, "입니다."),
        F.lit("이 값은 예보가 아닌 국지 추정 입력입니다."))
    power = _when_all(
        c("power_valid") & c("percent").isNotNull(), say("실제 전원 계측값은 ", fixed(c("percent")), "퍼센트입니다."),
        say("현재 운용 패턴 기준 예상 잔여는 ", fixed(c("days_left"), 1), "일입니다."))
    co = _when_all(
        c("co_valid") & ~F.coalesce(c("co_stale"), F.lit(False)) & c("co_ppm").isNotNull(),
        say("현재 일산화탄소 센서 계측값은 ", fixed(c("co_ppm")), "피피엠입니다."),
        F.lit("텐트나 차량 안에서는 연소 기구를 켜지 마세요."), F.lit("센서 감시는 예방을 대신하지 않습니다."))
    live = (
        F.when(scenario == "lost", F.when(c("gps_fix"), lost_fix).when(c("has_last_fix"), lost_old))
        .when(scenario == "route", way).when(scenario == "daylight", sun).when(scenario == "weather", env)
        .when(scenario == "gear", power).when(scenario == "sleep_safety", co)
    )
    return F.coalesce(live, sentences)


def spoken(lines: Column, demo: Column) -> Column:
    text = F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), " ")
    return F.when(demo, F.concat(F.lit(DEMO_PREFIX), text)).otherwise(text)


def state_parts(d: str) -> list[Column]:
    """The ordered parts of a device's state line, NULL where a part is absent; ``d`` names a struct as for :func:`card_lines`.

    Besides those fields it has the device's own ``co_alarm, co_level`` (a latched alarm outlives its reading), ``pressure_valid``,
    ``sunset_clock``, ``target_id`` and ``eta_min``.
    """
    c = lambda name: F.col(f"{d}.{name}")
    tag = lambda pre, v, post: F.concat(F.lit(pre), v, F.lit(post))

    def join(head: str, *items: Column) -> Column:
        return F.concat(F.lit(head), F.concat_ws(" ", *items))

    filled = lambda name: F.when(c(name) != "", c(name))
    gps = F.when(c("gps_fix"), join("gps=", F.lit("fix"), tag("acc", fixed(c("acc_m")), "m"), tag("sats", c("satellites").cast("string"), ""))).otherwise(
        join("gps=", F.lit("nofix"), tag("last", fixed(c("last_age_s")), "s")))
    sun = F.when(F.coalesce(c("sun_computed"), F.lit(False)) | c("remaining_min").isNotNull(), join(
        "sun=", tag("set", filled("sunset_clock"), ""), tag("rem", fixed(c("remaining_min")), "min"), tag("return", filled("return_by_clock"), ""),
        tag("lvl=", filled("sun_level"), "")))
    pressed = F.coalesce(c("pressure_valid"), F.lit(False)) & c("press_hpa").isNotNull()
    env = F.when(c("env_valid"), join(
        "env=", tag("", fixed(c("temp_c"), 1), "C"), tag("", fixed(c("humidity_pct")), "%"),
        F.when(pressed, F.concat_ws(" ", tag("", fixed(c("press_hpa"), 1), "hPa"), F.coalesce(filled("press_trend"), F.lit("unknown"))))))
    level = F.when(c("co_alarm"), "alarm").otherwise(F.coalesce(filled("co_level"), F.lit("normal")))
    co = F.when(c("co_valid") & ~F.coalesce(c("co_stale"), F.lit(False)), join("co=", tag("", fixed(c("co_ppm")), "ppm"), level))
    power = F.when(c("power_valid"), join("pwr=", tag("", fixed(c("percent")), "%"), tag("", fixed(c("days_left"), 1), "d")))
    trail = F.when(c("trail_status") != "", join("trail=", c("trail_status"), tag("off", fixed(c("offset_m")), "m")))
    route = F.when(c("route_available"), join(
        "route=", F.coalesce(filled("target_id"), filled("target_kind"), F.lit("target")), tag("", fixed(c("distance_m")), "m"),
        tag("", fixed(c("bearing_deg")), "deg"), tag("eta", fixed(c("eta_min")), "min")))
    return [gps, sun, env, co, power, trail, route, F.when(c("arrived"), F.lit("arrived=yes"))]


def state_line(df: DataFrame, d: str, max_tokens: int = 60, name: str = "state") -> DataFrame:
    """Add the state line: as many leading parts as fit the token limit, joined by a bar; the tail goes first.

    The estimate only grows with each part, so counts of each part are taken once and summed along the line.
    """
    parts = state_parts(d)
    n = len(parts)
    df = settle(df, **{f"_p{i}": p for i, p in enumerate(parts)})
    kinds = ("hangul", "plain", "other")
    df = settle(df, **{f"_n{i}": char_classes(F.col(f"_p{i}")) for i in range(n)})
    total = {k: F.lit(0) for k in kinds}
    bars, fits = F.lit(-1), []
    for i in range(n):
        there = F.col(f"_p{i}").isNotNull()
        bars = bars + there.cast("int")
        total = {k: total[k] + F.coalesce(F.col(f"_n{i}.{k}"), F.lit(0)) for k in kinds}
        fits.append(there & (tokens_of(total["hangul"], total["plain"], total["other"] + bars) <= max_tokens))
    text = F.concat_ws(" | ", *[F.when(fit, F.col(f"_p{i}")) for i, fit in enumerate(fits)])
    any_part = reduce(lambda a, b: a | b, [F.col(f"_p{i}").isNotNull() for i in range(n)])
    line = F.when(F.col(d).isNull(), "device=unavailable").when(~any_part, "device=empty").when(text == "", "device=truncated").otherwise(text)
    return df.withColumn(name, line).drop(*[f"_p{i}" for i in range(n)], *[f"_n{i}" for i in range(n)])
