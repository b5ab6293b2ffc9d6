"""Device lines to typed columns: CSV frames, JSON with CRC, hardware events and NMEA.

Every parser adds columns and one ``reason``: NULL when the line is good, a short code when it
breaks the contract. Nothing is coerced and no default stands in for an unknown value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import LARGEST, between, first_reason, settle
from ..functions.checksum import crc16, hex_upper, xor8
from ..functions.geo import nmea_degrees

# Line tags, the CSV field order, and the bounds of the wire formats.
CSV_TAGS = ["SA1", "OGT1"]
CSV_FIELDS = [
    "seq", "uptime_ms", "dht_valid", "temp_x10", "hum_x10", "co_state", "co_ppm", "gps_state", "lat_e7", "lon_e7", "sats",
]
UINT32_MAX = 4_294_967_295
CSV_BOUNDS = {
    "seq": (0, UINT32_MAX), "uptime_ms": (0, UINT32_MAX), "dht_valid": (0, 1), "co_state": (0, 2),
    "gps_state": (0, 2), "sats": (0, 99),
}
TRENDS = ["rising", "steady", "falling", "unknown"]
CO_LEVELS = ["unknown", "normal", "warning", "alarm"]
BUTTONS = ["power", "checkpoint", "voice"]
OUTPUT_LEVELS = {"alert": "trail_alert", "caution": "trail_caution", "off": "trail_clear"}
POWER_STATES = {  # state -> (gate_on, shutdown_pending); None allows any
    "gate_on": (True, False), "gate_off": (False, False), "shutdown_requested": (True, True),
    "shutdown_ack": (True, True), "shutdown_cancelled": (True, False), "shutdown_timeout": (True, False), "status": None,
}
#: Longer lines are rejected and not parsed.
MAX_LINE_BYTES = 4096
#: Where a member that is named like a flag is sent as text; whether it is the flag is then told by its place.
QUOTED_FLAG = (
    r'"(fix|valid|sht_valid|pressure_valid|warming_up|alarm|jetson_gate_on|shutdown_pending|active|gate_on|ok)"\s*:\s*"(true|false)"'
)


def frame_csv(fields: list[Column], tag: str = "SA1") -> Column:
    """``$TAG,…*XX`` line of the given fields."""
    body = F.concat_ws(",", F.lit(tag), *[f.cast("string") for f in fields])
    return F.concat(F.lit("$"), body, F.lit("*"), hex_upper(xor8(body), 2))


def frame_json(payload: Column) -> Column:
    """JSON object text with its CRC appended as the last member."""
    return F.concat(
        F.regexp_replace(payload, r"\}$", ""),
        F.lit(',"crc16":"'), hex_upper(crc16(payload), 4), F.lit('"}'),
    )


def parse_csv(df: DataFrame, line: str = "line") -> DataFrame:
    """Columns of a CSV telemetry frame; ``reason`` is NULL for good frames and other lines alike.

    ``is_csv`` tells whether the line carries one of the tags.
    """
    s = F.trim(F.col(line))
    is_csv = reduce(lambda a, b: a | b, [s.startswith(f"${t},") for t in CSV_TAGS])
    # The checksum follows the last star.
    tail = F.substring_index(s, "*", -1)
    body = F.when(is_csv, F.substring(s, F.lit(2), F.length(s) - F.length(tail) - 2))
    df = settle(df, is_csv=is_csv, _body=body, _sum=F.when(s.contains("*"), tail))
    df = settle(df, _f=F.split("_body", ","), _xor=xor8(F.col("_body")))
    texts = {name: F.get("_f", F.lit(i + 1)) for i, name in enumerate(CSV_FIELDS)}
    df = settle(df, **{
        f"_v_{n}": F.when(t.rlike(r"^-?[0-9]{1,10}$"), t.try_cast("bigint")) for n, t in texts.items()
    })
    v = lambda name: F.col(f"_v_{name}")
    fix, dht, co_ok = v("gps_state") == 2, v("dht_valid") == 1, v("co_state") == 1
    outside = reduce(lambda a, b: a | b, [~v(n).between(lo, hi) for n, (lo, hi) in CSV_BOUNDS.items()])
    reason = first_reason(
        (~s.contains("*"), "checksum_missing"),
        (F.length("_sum") != 2, "checksum_length"),
        (~F.col("_sum").rlike("^[0-9A-Fa-f]{2}$"), "checksum_format"),
        (~F.conv("_sum", 16, 10).cast("int").eqNullSafe(F.col("_xor")), "checksum_mismatch"),
        (F.size("_f") != len(CSV_FIELDS) + 1, "field_count"),
        (reduce(lambda a, b: a | b, [v(n).isNull() for n in CSV_FIELDS]), "not_integer"),
        (outside, "out_of_range"),
        (fix & ~(v("lat_e7").between(-900000000, 900000000) & v("lon_e7").between(-1800000000, 1800000000)), "coordinate_range"),
        (dht & ~(v("temp_x10").between(-450, 1300) & v("hum_x10").between(0, 1000)), "environment_range"),
        (co_ok & ~v("co_ppm").between(0, 10000), "co_range"),
    )
    df = settle(df, reason=F.when(F.col("is_csv"), reason))
    good = F.col("is_csv") & F.col("reason").isNull()

    def when(cond, value):
        return F.when(good & cond, value)

    return df.select(
        *[c for c in df.columns if c not in ("_body", "_sum", "_f", "_xor") and not c.startswith("_v_")],
        F.when(good, F.lit("ogt1")).alias("protocol"),
        F.when(good, v("seq")).alias("seq"),
        F.when(good, v("uptime_ms")).alias("uptime_ms"),
        F.when(good, fix).alias("fix"),
        when(fix, v("lat_e7") / 1e7).alias("lat"),
        when(fix, v("lon_e7") / 1e7).alias("lon"),
        F.when(good, v("sats")).alias("satellites"),
        F.lit(None).cast("double").alias("acc_m"),
        F.when(good, dht).alias("env_valid"),
        when(dht, v("temp_x10") / 10.0).alias("temp_c"),
        when(dht, v("hum_x10") / 10.0).alias("humidity_pct"),
        F.when(good, co_ok).alias("co_valid"),
        F.when(good, v("co_state") == 0).alias("co_warming_up"),
        when(co_ok, v("co_ppm").cast("double")).alias("co_ppm"),
        F.when(good, F.when(co_ok, "normal").otherwise("unknown")).alias("co_level"),
    )


TELEMETRY_JSON = """v string, event string, seq string, uptime_ms string,
 gps struct<fix:string,lat:string,lon:string,acc_m:string,hdop:string,sats:string,age_s:string,last_age_s:string>,
 rtc struct<valid:string,iso_utc:string,age_s:string>,
 env struct<valid:string,sht_valid:string,pressure_valid:string,temp_c:string,humidity_pct:string,press_hpa:string,
   press_trend:string,age_s:string,press_age_s:string,bmp_address:string>,
 co struct<valid:string,warming_up:string,ppm:string,level:string,alarm:string,age_s:string>,
 power struct<valid:string,percent:string,days_left:string,jetson_gate_on:string,shutdown_pending:string>,
 button string, state string, held_ms string, output string, level string, active string, watchdog_ms string,
 gate_on string, shutdown_pending string, ok string, reason string, fix string, lat string, lon string, acc_m string,
 sats string, age_s string, last_age_s string, crc16 string"""


def parse_json_line(df: DataFrame, line: str = "line") -> DataFrame:
    """Add ``_j`` (all members of any device event) and ``json_reason`` for what every event needs."""
    s = F.trim(F.col(line))
    has_crc = s.rlike(r',"crc16":"[0-9A-Fa-f]{4}"\}$')
    # The CRC member is the last 16 characters; it covers everything before it plus the brace.
    base = F.when(has_crc, F.concat(F.substring(s, F.lit(1), F.length(s) - 16), F.lit("}")))
    # A flag sent as text is no flag, and satellites that are given must be a number.
    df = settle(df, _quoted=s.rlike(QUOTED_FLAG))
    df = settle(
        df, _j=F.from_json(s, TELEMETRY_JSON, {"mode": "PERMISSIVE"}), _json=F.try_parse_json(s).isNotNull(),
        _v=F.when(F.col("_quoted"), F.try_parse_json(s)), _blank_sats=s.rlike(r'"sats"\s*:\s*(null|"\s*")'),
        _sent=F.when(has_crc, F.substring(s, -6, 4)), _crc=crc16(base), _object=s.startswith("{"),
    )
    event = F.col("_j.event")
    framed = event.isin("telemetry", "button", "output", "power")
    version = F.col("_j.v").try_cast("double")
    seq = F.col("_j.seq").try_cast("double")
    reason = first_reason(
        (~F.col("_json"), "not_json"),
        (~F.col("_object"), "not_object"),
        (framed & F.col("_sent").isNull(), "crc_missing"),
        (framed & ~F.conv("_sent", 16, 10).cast("int").eqNullSafe(F.col("_crc")), "crc_mismatch"),
        (framed & ~between(version, 1, 255), "version_range"),
        (framed & (F.floor(version) != 1), "version_unsupported"),
        (framed & ~between(seq, 0, UINT32_MAX), "seq_range"),
    )
    return settle(df, json_reason=reason).drop("_json", "_object", "_sent", "_crc")


def _flag(name: str) -> Column:
    text = F.col(name)
    as_text = F.col("_quoted") & (F.schema_of_variant(F.try_variant_get("_v", "$" + name.removeprefix("_j"), "variant")) == "STRING")
    return F.when(as_text, F.lit(None).cast("boolean")).when(text == "true", True).when(text == "false", False)


def _num(name: str) -> Column:
    return F.col(name).try_cast("double")


def _bad(text: Column, value: Column, low: float = -LARGEST, high: float = LARGEST) -> Column:
    """An optional number that is given but is no number or out of bounds."""
    return text.isNotNull() & (text != "") & ~between(value, low, high)


# Bounds of the optional numbers of JSON telemetry, and their reject codes.
OPTIONAL_BOUNDS = {
    "gps.sats": (0, 99, "gps_sats_range"), "gps.hdop": (0, 99.9, "gps_hdop_range"), "gps.acc_m": (0, 10000, "gps_accuracy_range"),
    "gps.age_s": (0, LARGEST, "gps_age_range"), "gps.last_age_s": (0, LARGEST, "gps_last_age_range"),
    "rtc.age_s": (0, LARGEST, "rtc_age_range"), "env.age_s": (0, LARGEST, "env_age_range"),
    "env.press_age_s": (0, LARGEST, "pressure_age_range"), "co.ppm": (0, 10000, "co_range"), "co.age_s": (0, LARGEST, "co_age_range"),
    "power.percent": (0, 100, "power_percent_range"), "power.days_left": (0, LARGEST, "power_days_range"),
}
OTHER_NUMBERS = ["seq", "uptime_ms", "gps.lat", "gps.lon", "env.temp_c", "env.humidity_pct", "env.press_hpa", "env.bmp_address"]
FLAGS = [
    "gps.fix", "rtc.valid", "env.valid", "env.sht_valid", "env.pressure_valid", "co.valid", "co.warming_up", "co.alarm",
    "power.valid", "power.jetson_gate_on", "power.shutdown_pending",
]


def parse_telemetry_json(df: DataFrame) -> DataFrame:
    """Typed telemetry of JSON lines, after :func:`parse_json_line`; NULL for other events.

    Three settled steps: text to typed values, the flags that have defaults, then the checks.
    """
    keep = df.columns
    is_tel = F.coalesce(F.col("_j.event") == "telemetry", F.lit(False))
    iso, trend = F.col("_j.rtc.iso_utc"), F.col("_j.env.press_trend")
    names = [*OPTIONAL_BOUNDS, *OTHER_NUMBERS]
    df = settle(
        df,
        **{"_n_" + x.replace(".", "_"): _num(f"_j.{x}") for x in names},
        **{"_f_" + x.replace(".", "_"): _flag(f"_j.{x}") for x in FLAGS},
        _utc=F.when(iso.rlike(r"(Z|\+00:00)$"), F.regexp_replace(iso, r"Z$", "+00:00").try_cast("timestamp")),
        _trend=F.lower(F.trim(F.coalesce(F.when(trend != "", trend), F.lit("unknown")))),
    )

    def defaulted(text: str, flag: str, default: Column) -> Column:
        return F.when(F.col(text).isNull(), default).otherwise(F.col(flag))

    no = F.lit(False)
    df = settle(
        df,
        _sht=defaulted("_j.env.sht_valid", "_f_env_sht_valid", F.col("_f_env_valid")),
        _press=defaulted("_j.env.pressure_valid", "_f_env_pressure_valid", F.col("_j.env.press_hpa").isNotNull()),
        _co_alarm=defaulted("_j.co.alarm", "_f_co_alarm", no), _warming=defaulted("_j.co.warming_up", "_f_co_warming_up", no),
        _rtc=defaulted("_j.rtc", "_f_rtc_valid", no), _power=defaulted("_j.power", "_f_power_valid", no),
        _level=F.coalesce("_j.co.level", F.lit("unknown")),
        _bounds=first_reason(*[
            (_bad(F.col(f"_j.{x}"), F.col("_n_" + x.replace(".", "_")), lo, hi), code)
            for x, (lo, hi, code) in OPTIONAL_BOUNDS.items()
        ]),
    )
    c = F.col
    fix, env, press, rtc, trend = c("_f_gps_fix"), c("_f_env_valid"), c("_press"), c("_rtc"), c("_trend")
    reason = first_reason(
        (~between(c("_n_uptime_ms"), 0), "uptime_range"),
        (fix.isNull(), "gps_missing"),
        (c("_bounds").isNotNull(), "bounds"),
        (c("_blank_sats"), "gps_sats_range"),
        (fix & ~(between(c("_n_gps_lat"), -90, 90) & between(c("_n_gps_lon"), -180, 180)), "coordinate_range"),
        (rtc.isNull(), "rtc_valid_type"),
        (~rtc & iso.isNotNull(), "rtc_unexpected_time"),
        (rtc & (iso.isNull() | (F.length(iso) > 40) | c("_utc").isNull()), "rtc_time_format"),
        (rtc & ~F.year("_utc").between(2025, 2100), "rtc_year_range"),
        (env.isNull(), "env_missing"),
        (~c("_sht").eqNullSafe(env), "env_sht_conflict"),
        (press.isNull(), "env_pressure_type"),
        (~trend.isin(TRENDS), "env_trend"),
        (env & ~(between(c("_n_env_temp_c"), -45, 130) & between(c("_n_env_humidity_pct"), 0, 100)), "environment_range"),
        (~env & (c("_j.env.temp_c").isNotNull() | c("_j.env.humidity_pct").isNotNull()), "env_unexpected_value"),
        (press & ~between(c("_n_env_press_hpa"), 300, 1100), "pressure_range"),
        (press & c("_j.env.bmp_address").isNotNull() & ~F.coalesce(c("_n_env_bmp_address").isin(118.0, 119.0), no), "pressure_address"),
        (~press & (c("_j.env.press_hpa").isNotNull() | (trend != "unknown")), "pressure_unexpected_value"),
        (c("_f_co_valid").isNull() | c("_warming").isNull() | c("_co_alarm").isNull(), "co_missing"),
        (~c("_level").isin(CO_LEVELS), "co_level"),
        (c("_co_alarm") & (c("_level") != "alarm"), "co_alarm_conflict"),
        (c("_f_co_valid") & c("_n_co_ppm").isNull(), "co_ppm_missing"),
        (c("_power").isNull(), "power_valid_type"),
        ((c("_j.power.jetson_gate_on").isNotNull() & c("_f_power_jetson_gate_on").isNull())
         | (c("_j.power.shutdown_pending").isNotNull() & c("_f_power_shutdown_pending").isNull()), "power_gate_type"),
    )
    reason = F.when(reason == "bounds", c("_bounds")).otherwise(reason)
    df = settle(df, tel_reason=F.when(is_tel, F.coalesce("json_reason", reason)))
    good = is_tel & c("tel_reason").isNull()
    tel = F.struct(
        F.lit("v1").alias("protocol"), c("_n_seq").cast("bigint").alias("seq"), c("_n_uptime_ms").cast("bigint").alias("uptime_ms"),
        fix.alias("fix"), F.when(fix, c("_n_gps_lat")).alias("lat"), F.when(fix, c("_n_gps_lon")).alias("lon"),
        F.coalesce(c("_n_gps_sats"), F.lit(0.0)).cast("bigint").alias("satellites"),
        c("_n_gps_hdop").alias("hdop"), c("_n_gps_acc_m").alias("acc_m"),
        F.when(c("_j.gps.acc_m").isNotNull(), "reported").otherwise("unknown").alias("accuracy_kind"),
        rtc.alias("rtc_valid"), F.when(rtc, c("_utc")).alias("rtc_utc"), c("_n_rtc_age_s").alias("rtc_age_s"),
        env.alias("env_valid"), F.when(env, c("_n_env_temp_c")).alias("temp_c"),
        F.when(env, c("_n_env_humidity_pct")).alias("humidity_pct"), press.alias("pressure_valid"),
        F.when(press, c("_n_env_press_hpa")).alias("press_hpa"), F.when(press, trend).otherwise("unknown").alias("press_trend"),
        F.when(press, c("_n_env_bmp_address").cast("int")).alias("bmp_address"),
        c("_f_co_valid").alias("co_valid"), c("_warming").alias("co_warming_up"), c("_n_co_ppm").alias("co_ppm"),
        c("_level").alias("co_level"), c("_co_alarm").alias("co_alarm"),
        c("_power").alias("power_valid"), c("_n_power_percent").alias("percent"), c("_n_power_days_left").alias("days_left"),
        c("_f_power_jetson_gate_on").alias("gate_on"), c("_f_power_shutdown_pending").alias("shutdown_pending"),
    )
    return df.select(*keep, "tel_reason", F.when(good, tel).alias("telemetry"))


def parse_hw_event(df: DataFrame) -> DataFrame:
    """Typed button, output, power and position events of JSON lines, with ``event_reason``."""
    event = F.coalesce(F.col("_j.event"), F.lit(""))
    held = _num("_j.held_ms")
    active, gate, pending = _flag("_j.active"), _flag("_j.gate_on"), _flag("_j.shutdown_pending")
    needed = reduce(lambda a, b: a | b, [
        (F.col("_j.state") == s) & ~((gate == pair[0]) & (pending == pair[1])) for s, pair in POWER_STATES.items() if pair
    ])
    has_fix = F.when(F.col("_j.fix").isNull(), F.col("_j.lat").isNotNull() & F.col("_j.lon").isNotNull()).otherwise(
        F.coalesce(_flag("_j.fix"), F.lit(False)))
    reasons = {
        "button": first_reason(
            (~F.coalesce(F.col("_j.button"), F.lit("")).isin(BUTTONS), "button_kind"),
            (~F.coalesce(F.col("_j.state"), F.lit("")).isin("pressed", "released"), "button_state"),
            (~between(held, 0, 3_600_000), "held_range"),
            ((F.col("_j.state") == "pressed") & (F.floor(held) != 0), "held_while_pressed"),
        ),
        "output": first_reason(
            (active.isNull(), "active_type"),
            (~F.coalesce(F.col("_j.output") == "trail", F.lit(False))
             | ~F.coalesce(F.col("_j.level"), F.lit("")).isin(list(OUTPUT_LEVELS)), "output_kind"),
            (active != (F.col("_j.level") != "off"), "level_active_conflict"),
            (~between(_num("_j.watchdog_ms"), 100, 60_000), "watchdog_range"),
        ),
        "power": first_reason(
            (~F.coalesce(F.col("_j.state"), F.lit("")).isin(list(POWER_STATES)), "power_state"),
            (gate.isNull() | pending.isNull(), "gate_type"),
            (needed, "state_gate_conflict"),
        ),
        "fix": first_reason(
            (~F.coalesce(_flag("_j.ok"), F.lit(False)), "fix_failed"),
            (~has_fix & _bad(F.col("_j.last_age_s"), _num("_j.last_age_s"), 0), "fix_age_range"),
            (has_fix & ~(between(_num("_j.lat"), -90, 90) & between(_num("_j.lon"), -180, 180)), "coordinate_range"),
            (has_fix & (_bad(F.col("_j.acc_m"), _num("_j.acc_m"), 0) | _bad(F.col("_j.age_s"), _num("_j.age_s"), 0)), "fix_quality_range"),
            (has_fix & F.col("_j.sats").isNotNull() & ~between(_num("_j.sats"), 0, 99), "fix_sats_range"),
        ),
    }
    own = reduce(lambda acc, kv: acc.when(event == kv[0], kv[1]), reasons.items(), F.when(F.lit(False), F.lit("")))
    df = settle(df, event_reason=F.when(event.isin(list(reasons)), F.coalesce("json_reason", own)))
    action = reduce(lambda a, kv: a.when(F.col("_j.level") == kv[0], kv[1]), OUTPUT_LEVELS.items(), F.when(F.lit(False), ""))
    seq = _num("_j.seq").cast("bigint").alias("seq")
    good = F.col("event_reason").isNull()
    return (
        df.withColumn("button_event", F.when(good & (event == "button"), F.struct(
            seq, F.col("_j.button").alias("button"), F.col("_j.state").alias("state"), held.cast("bigint").alias("held_ms"))))
        .withColumn("output_event", F.when(good & (event == "output"), F.struct(
            seq, F.col("_j.level").alias("level"), active.alias("active"),
            _num("_j.watchdog_ms").cast("bigint").alias("watchdog_ms"), action.alias("action"))))
        .withColumn("power_event", F.when(good & (event == "power"), F.struct(
            seq, F.col("_j.state").alias("state"), gate.alias("gate_on"), pending.alias("shutdown_pending"))))
        .withColumn("fix_event", F.when(good & (event == "fix"), F.struct(
            has_fix.alias("fix"), F.when(has_fix, _num("_j.lat")).alias("lat"), F.when(has_fix, _num("_j.lon")).alias("lon"),
            F.when(has_fix, _num("_j.acc_m")).alias("acc_m"))))
    )


def route_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """One pass over raw lines: ``kind`` (what the line is), ``reason`` (why it was rejected), typed parts.

    Blank lines are dropped. Rejected lines keep their text, so they can be stored as quarantine.
    """
    df = df.filter(F.trim(F.col(line)) != "")
    names, too_long = df.columns, F.octet_length(line) > MAX_LINE_BYTES
    df = df.withColumn("_read", F.when(~too_long, F.col(line)).otherwise(""))
    csv = parse_csv(df, "_read").withColumnRenamed("reason", "csv_reason")
    fields = [c for c in csv.columns if c not in df.columns and c not in ("is_csv", "csv_reason")]
    csv = csv.select(*df.columns, "is_csv", "csv_reason", *[F.col(f).alias(f"_csv_{f}") for f in fields])
    out = parse_hw_event(parse_telemetry_json(parse_json_line(csv, "_read")))
    event = F.coalesce(F.col("_j.event"), F.lit(""))
    reason = F.when(too_long, "line_length").when(F.col("is_csv"), F.col("csv_reason")).otherwise(
        F.coalesce("json_reason", "tel_reason", "event_reason"))
    kind = (
        F.when(reason.isNotNull(), "rejected")
        .when(F.col("is_csv"), "telemetry")
        .when(event.isin("telemetry", "button", "output", "power", "fix"), event)
        .otherwise("ignored")
    )
    return settle(out, kind=kind, reason=reason).select(
        *names, "kind", "reason", F.struct(*[F.col(f"_csv_{f}").alias(f) for f in fields]).alias("csv"), "telemetry",
        "button_event", "output_event", "power_event", "fix_event",
    )


def parse_nmea(df: DataFrame, line: str = "line") -> DataFrame:
    """GGA and RMC sentences; ``nmea_kind`` is fix, other or rejected, ``reason`` says why."""
    s = F.trim(F.col(line))
    tail = F.substring_index(s, "*", -1)
    body = F.when(s.startswith("$") & s.contains("*"), F.substring(s, F.lit(2), F.length(s) - F.length(tail) - 2))
    df = settle(df, _body=body, _sum=tail)
    df = settle(df, _f=F.split("_body", ","), _xor=xor8(F.col("_body")))
    f = lambda i: F.get("_f", F.lit(i))
    kind = F.substring(f(0), -3, 3)
    gga, rmc = kind == "GGA", kind == "RMC"

    def opt(i):
        return F.when(f(i) != "", f(i).try_cast("double"))

    def bad(i, low=-LARGEST, high=LARGEST):
        return (f(i) != "") & ~between(f(i).try_cast("double"), low, high)

    quality = F.when(f(6) == "", 0.0).otherwise(f(6).try_cast("double"))
    sats = F.when(f(7) == "", 0.0).otherwise(f(7).try_cast("double"))
    fix = F.when(gga, F.floor(quality) > 0).when(rmc, f(2) == "A")
    at = F.when(gga, 2).otherwise(3)
    lat = nmea_degrees(F.get("_f", at), F.get("_f", at + 1))
    lon = nmea_degrees(F.get("_f", at + 2), F.get("_f", at + 3))
    place = lat.between(-90, 90) & lon.between(-180, 180) & F.get("_f", at + 1).isin("N", "S") & F.get("_f", at + 3).isin("E", "W")
    reason = first_reason(
        (~s.startswith("$") | ~s.contains("*"), "frame"),
        (F.length("_sum") < 2, "checksum_length"),
        (~F.substring("_sum", 1, 2).rlike("^[0-9A-Fa-f]{2}$"), "checksum_format"),
        (~F.conv(F.substring("_sum", 1, 2), 16, 10).cast("int").eqNullSafe(F.col("_xor")), "checksum_mismatch"),
        ((gga | rmc) & (F.size("_f") < 10), "field_count"),
        (gga & ~between(quality, 0, 8), "quality_range"),
        (gga & ~between(sats, 0, 99), "satellites_range"),
        (gga & bad(8, 0), "hdop_range"),
        (rmc & bad(7, 0), "speed_range"),
        (rmc & bad(8, 0, 360), "course_range"),
        (fix & ~F.coalesce(place, F.lit(False)), "coordinate"),
        (gga & fix & bad(9), "altitude"),
    )
    df = settle(df, reason=reason)
    good = F.col("reason").isNull()
    text = lambda i: F.when(f(i) != "", f(i))
    return df.select(
        *[c for c in df.columns if c not in ("_body", "_sum", "_f", "_xor")],
        F.when(~good, "rejected").when(gga | rmc, "fix").otherwise("other").alias("nmea_kind"),
        F.when(good & (gga | rmc), kind).alias("sentence"),
        F.when(good, fix).alias("fix"),
        F.when(good & fix, lat).alias("lat"), F.when(good & fix, lon).alias("lon"),
        F.when(good & gga, sats.cast("bigint")).alias("satellites"),
        F.when(good & gga, opt(8)).alias("hdop"),
        F.when(good & gga & fix, opt(9)).alias("alt_m"),
        F.when(good & (gga | rmc), text(1)).alias("utc"),
        F.when(good & rmc, text(9)).alias("date"),
        F.when(good & rmc, opt(7)).alias("speed_knots"),
        F.when(good & rmc, opt(8)).alias("course_deg"),
        F.lit(None).cast("double").alias("acc_m"), F.when(good & (gga | rmc), "unknown").alias("accuracy_kind"),
    )


def replay(spark, path: str, stream: bool = False, files_per_trigger: int = 1) -> DataFrame:
    """Recorded lines of text files, without blanks and ``#`` comments, as a table or a stream."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    lines = reader.text(path).withColumnRenamed("value", "line")
    return lines.filter((F.trim("line") != "") & ~F.ltrim("line").startswith("#"))
