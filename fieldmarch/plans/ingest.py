"""Telemetry ingest: frames, parsing with quarantine, lost frames, sensor state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..columns import between, first_reason, settle
from ..functions.checksum import crc16, hex_upper, xor8
from ..functions.geo import nmea_e7
from ..operators import fleet, ordered
from ..session import cut
from ..sources import telemetry as S
from . import tables as T
from .registry import query

XOR_SQL = "list_reduce(list_transform(string_split({0},''), lambda c: ascii(c)), lambda a, b: xor(a, b))"
CRC_BYTE = "xor(xor(((acc<<8)&65535), ((x<<12)&65535)), xor(((x<<5)&65535), x))"
CRC_SQL = (
    "list_reduce(list_prepend(65535, list_transform(string_split({0},''), lambda c: ascii(c))), lambda acc, b: "
    "list_reduce([acc, xor(xor((acc>>8),b), xor((acc>>8),b)>>4)], lambda acc, x: " + CRC_BYTE + "))"
)


#: So many events go to a task that makes and reads lines; a file packs far more of them into one split.
EVENTS_A_TASK = 50_000


def dealt(df: DataFrame, d: str) -> DataFrame:
    """A row an event, dealt to tasks in proportion to the events."""
    spark = df.sparkSession
    tasks = T.read(spark, d, "events").count() // EVENTS_A_TASK + 1
    return df.repartition(max(tasks, spark.sparkContext.defaultParallelism), "event_id")


def frame_fields(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry fields of every device event; sequence numbers skip where a frame was lost."""
    e = ordered.chunked(T.ev(spark, d), "t_s")
    lost = F.when(F.col("event_id") % 17 == 0, 2).otherwise(1).cast("bigint")
    e = ordered.running(e, ["device_id"], ["t_s"], "seq", lost, "sum").drop(ordered.CHUNK)
    return e.select(
        "event_id", "device_id", "boot_id", "t_s", "event_type", "seq",
        F.expr("t_us div 1000 - boot_id * 2880000").alias("uptime_ms"),
        (F.col("event_id") % 3 != 0).cast("bigint").alias("dht_valid"),
        (F.col("event_id") % 600 - 100).alias("temp_x10"), (F.col("event_id") * 37 % 1100).alias("hum_x10"),
        F.when(F.col("event_type") == "error", F.col("event_id") % 2 * 2).otherwise(1).cast("bigint").alias("co_state"),
        F.floor("value").cast("bigint").alias("co_ppm"),
        F.when(F.col("event_type") == "error", 1).otherwise(2).cast("bigint").alias("gps_state"),
        F.expr("375000000 + (device_id * 5000) div 3 + event_id * 7919 % 20001 - 10000").alias("lat_e7"),
        F.expr("1270000000 + event_id * 104729 % 600001 - 200000").alias("lon_e7"),
        (F.col("event_id") % 21).alias("sats"),
    )


T.define("frames", ["ev"], """SELECT event_id, device_id, boot_id, t_s, event_type,
    CAST(sum(CASE WHEN event_id%17=0 THEN 2 ELSE 1 END) OVER (PARTITION BY device_id ORDER BY t_s) AS BIGINT) AS seq,
    t_us//1000-boot_id*2880000 AS uptime_ms, CAST(event_id%3<>0 AS BIGINT) AS dht_valid, event_id%600-100 AS temp_x10, event_id*37%1100 AS hum_x10,
    CASE WHEN event_type='error' THEN event_id%2*2 ELSE 1 END AS co_state, CAST(floor(value) AS BIGINT) AS co_ppm,
    CASE WHEN event_type='error' THEN 1 ELSE 2 END AS gps_state,
    375000000+(device_id*5000)//3+event_id*7919%20001-10000 AS lat_e7, 1270000000+event_id*104729%600001-200000 AS lon_e7, event_id%21 AS sats FROM ev""")


def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """CSV frames as devices send them; every 23rd event's checksum has a flipped bit, every 29th line a letter that is not ASCII."""
    f = dealt(frame_fields(spark, d), d)
    line = S.frame_csv([F.col(c) for c in S.CSV_FIELDS])
    f = settle(f, line=line)
    flipped = F.conv(F.substring_index("line", "*", -1), 16, 10).cast("int").bitwiseXOR(F.lit(1))
    broken = F.concat(F.substring_index("line", "*", 1), F.lit("*"), hex_upper(flipped, 2))
    foreign = F.concat(F.substring_index("line", "*", 1), F.lit("\ufffd*"), F.substring_index("line", "*", -1))
    f = f.withColumn("line", F.when(F.col("event_id") % 23 == 0, broken).when(F.col("event_id") % 29 == 0, foreign).otherwise(F.col("line")))
    return f.select("event_id", "device_id", "boot_id", F.col("t_s").alias("recv_s"), "line")


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of the same devices: buttons, output acknowledgements, power states and junk."""
    e = dealt(T.ev(spark, d).drop("props"), d)
    c = F.col
    held = F.when(c("event_id") % 2 == 0, 0).otherwise(F.floor(c("value") * 100)).cast("bigint")
    state = F.when(c("event_id") % 2 == 0, "pressed").otherwise("released")
    button = F.format_string('{"v":1,"event":"button","seq":%d,"button":"voice","state":"%s","held_ms":%d}', c("event_id"), state, held)
    output = F.format_string(
        '{"v":1,"event":"output","seq":%d,"output":"trail","level":"%s","active":true,"watchdog_ms":%d}', c("event_id"),
        F.when(c("event_id") % 2 == 0, "alert").otherwise("off"), c("event_id") % 3000 + 50)
    power = F.format_string(
        '{"v":1,"event":"power","seq":%d,"state":"shutdown_ack","gate_on":true,"shutdown_pending":%s}', c("event_id"),
        F.when(c("event_id") % 4 == 0, "false").otherwise("true"))
    payload = F.when(c("event_type") == "click", button).when(c("event_type") == "view", output).when(c("event_type") == "signup", power)
    e = settle(e, payload=payload)
    payload = c("payload")
    line = (
        F.when(payload.isNotNull(), F.when(c("event_id") % 19 == 0, payload).when(
            # changed after it was signed, beside a letter that no checksum covers
            c("event_id") % 31 == 0, F.regexp_replace(S.frame_json(payload), r'^\{"v":1,', '{"v":1,"note":"\uac00",')).otherwise(S.frame_json(payload)))
        .when(c("event_type") == "purchase", '{"event":"hello"}').otherwise("boot ok")
    )
    return settle(e, line=line).select("event_id", "device_id", "boot_id", c("t_s").alias("recv_s"), "line")


def raw_lines(spark: SparkSession, d: str) -> DataFrame:
    return csv_lines(spark, d).unionByName(event_lines(spark, d))


CSV_REASON_SQL = """CASE WHEN event_id%23=0 OR event_id%29=0 THEN 'checksum_mismatch'
    WHEN dht_valid=1 AND (hum_x10>1000 OR temp_x10<-450) THEN 'environment_range' END"""
T.define("lines", ["frames"], f"""SELECT event_id, device_id, 'csv' AS form, t_s AS recv_s, seq, uptime_ms,
      {CSV_REASON_SQL} AS reason, CASE WHEN ({CSV_REASON_SQL}) IS NULL THEN 'telemetry' ELSE 'rejected' END AS kind FROM frames
    UNION ALL SELECT event_id, device_id, 'json', t_s, NULL, NULL, reason,
      CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN event_type='click' THEN 'button' WHEN event_type='view' THEN 'output'
        WHEN event_type='signup' THEN 'power' ELSE 'ignored' END FROM (SELECT *, CASE WHEN event_type='error' THEN 'not_json'
        WHEN event_type<>'purchase' AND event_id%19=0 THEN 'crc_missing'
        WHEN event_type<>'purchase' AND event_id%31=0 THEN 'crc_mismatch'
        WHEN event_type='click' AND event_id%2=1 AND floor(value*100)>3600000 THEN 'held_range'
        WHEN event_type='view' AND event_id%2=1 THEN 'level_active_conflict'
        WHEN event_type='view' AND event_id%3000+50<100 THEN 'watchdog_range'
        WHEN event_type='signup' AND event_id%4=0 THEN 'state_gate_conflict' END AS reason FROM ev)""")


@query("frame_roundtrip", T.ctes("lines") + f""" SELECT f.event_id, f.seq, f.uptime_ms, {CSV_REASON_SQL} AS reason,
    CASE WHEN good AND gps_state=2 THEN CAST(lat_e7 AS DOUBLE)/1e7 END AS lat, CASE WHEN good AND gps_state=2 THEN CAST(lon_e7 AS DOUBLE)/1e7 END AS lon,
    CASE WHEN good AND dht_valid=1 THEN CAST(temp_x10 AS DOUBLE)/10.0::DOUBLE END AS temp_c,
    CASE WHEN good AND co_state=1 THEN CAST(co_ppm AS DOUBLE) END AS co_ppm, CASE WHEN good THEN co_state=0 END AS co_warming_up
    FROM (SELECT event_id, CASE WHEN good THEN seq END AS seq, CASE WHEN good THEN uptime_ms END AS uptime_ms, good, gps_state, lat_e7, lon_e7,
      dht_valid, temp_x10, hum_x10, co_state, co_ppm FROM (SELECT *, ({CSV_REASON_SQL}) IS NULL AS good FROM frames)) f""")
def frame_roundtrip(spark, d):
    return S.parse_csv(csv_lines(spark, d)).select(
        "event_id", "seq", "uptime_ms", "reason", "lat", "lon", "temp_c", "co_ppm", "co_warming_up"
    )


@query("line_kinds", T.ctes("lines") + """ SELECT kind, coalesce(reason,'') AS reason, count(*) AS n FROM lines GROUP BY kind, reason""")
def line_kinds(spark, d):
    routed = S.route_lines(raw_lines(spark, d))
    return routed.groupBy("kind", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("hw_events", T.ctes("lines") + """ SELECT device_id, kind, count(*) AS n FROM lines WHERE kind IN ('button','output','power') GROUP BY device_id, kind""")
def hw_events(spark, d):
    routed = S.route_lines(event_lines(spark, d)).filter("kind IN ('button', 'output', 'power')")
    return routed.groupBy("device_id", "kind").agg(F.count(F.lit(1)).alias("n"))


T.define("gaps", ["lines"], """SELECT *, coalesce(uptime_ms>=lag(uptime_ms) OVER w AND seq<>(lag(seq) OVER w+1)%4294967296, false) AS seq_gap
    FROM lines WHERE kind='telemetry' WINDOW w AS (PARTITION BY device_id ORDER BY recv_s, seq)""")


@query("sequence_gaps", T.ctes("gaps") + " SELECT event_id, device_id, recv_s, seq, seq_gap FROM gaps")
def sequence_gaps(spark, d):
    frames = S.parse_csv(csv_lines(spark, d)).filter("reason IS NULL")
    return ordered.sequence_gaps(frames, ["device_id"]).select("event_id", "device_id", "recv_s", "seq", "seq_gap")


@query("ingest_quality", T.ctes("gaps") + """ SELECT l.device_id, count(*) AS received, count(*) FILTER (kind='rejected') AS rejected,
    count(*) FILTER (kind='ignored') AS ignored, count(*) FILTER (kind='button') AS buttons, any_value(g.gaps) AS gaps
    FROM lines l LEFT JOIN (SELECT device_id, count(*) FILTER (seq_gap) AS gaps FROM gaps GROUP BY device_id) g USING (device_id) GROUP BY l.device_id""")
def ingest_quality(spark, d):
    # Lines are parsed once into a stored table, as the ingest job does; both reports read that.
    routed = S.route_lines(raw_lines(spark, d))
    routed = cut(routed.select("device_id", "recv_s", "kind", "csv.seq", "csv.uptime_ms"))
    counts = routed.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("kind") == "rejected").alias("rejected"),
        F.count_if(F.col("kind") == "ignored").alias("ignored"), F.count_if(F.col("kind") == "button").alias("buttons"),
    )
    tel = routed.filter("kind = 'telemetry'")
    gaps = ordered.sequence_gaps(tel, ["device_id"]).groupBy("device_id").agg(F.count_if("seq_gap").alias("gaps"))
    return counts.join(gaps, "device_id", "left")


@query("checksum_xor", f"SELECT event_id, CAST({XOR_SQL.format('props')} AS INTEGER) AS xor8 FROM events")
def checksum_xor(spark, d):
    return T.read(spark, d, "events").select("event_id", xor8(F.col("props")).cast("int").alias("xor8"))


@query("checksum_crc16", f"SELECT event_id, CAST({CRC_SQL.format('props')} AS INTEGER) AS crc FROM events")
def checksum_crc16(spark, d):
    return T.read(spark, d, "events").select("event_id", crc16(F.col("props")).cast("int").alias("crc"))


@query("coord_e7", """SELECT event_id, e7*CASE WHEN event_id%2=0 THEN 1 ELSE -1 END AS e7 FROM (
    SELECT event_id, (event_id%90)*10000000+((event_id*7%60)*10000000+(event_id*104729%10000)*1000)//60 AS e7 FROM events)""")
def coord_e7(spark, d):
    raw = F.format_string("%02d%02d.%04d", F.col("event_id") % 90, F.col("event_id") * 7 % 60, F.col("event_id") * 104729 % 10000)
    e = T.read(spark, d, "events")
    return e.select("event_id", nmea_e7(raw, F.when(F.col("event_id") % 2 == 0, "N").otherwise("S")).alias("e7"))


@query("nmea_ingest", T.ctes("fixes") + """ SELECT device_id, count(*) AS n, count(*) FILTER (NOT bad AND fix) AS fixes,
    count(*) FILTER (bad) AS rejected, CAST(sum(CASE WHEN NOT bad AND fix THEN CAST(round(deg*6000) AS BIGINT) END) AS BIGINT) AS sum_centimin
    FROM (SELECT *, event_id%29=0 OR event_id%31=0 OR event_id%37=0 AS bad, event_id%90+(CAST(event_id%6000 AS DOUBLE)/100.0::DOUBLE)/60.0::DOUBLE AS deg FROM fixes) GROUP BY device_id""")
def nmea_ingest(spark, d):
    c = F.col
    body = F.format_string(
        "GNGGA,120000.00,%02d%02d.%02d,N,12704.5428,E,%d,%02d,0.8,35.0,M,0.0,M,,", c("event_id") % 90,
        F.expr("event_id % 6000 div 100"), c("event_id") % 100, c("fix").cast("int"), c("satellites"))
    check = xor8(body).bitwiseXOR((c("event_id") % 29 == 0).cast("int"))
    # a letter that no checksum covers, once beside the right checksum and once beside one of nothing
    foreign = F.when(c("event_id") % 31 == 0, "\ufffd").when(c("event_id") % 37 == 0, "\uac00").otherwise("")
    check = F.when(c("event_id") % 37 == 0, 0).otherwise(check)
    lines = T.fixes(spark, d).select("device_id", F.concat(F.lit("$"), body, foreign, F.lit("*"), hex_upper(check, 2)).alias("line"))
    p = S.parse_nmea(lines)
    return p.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("fix").alias("fixes"),
        F.count_if(c("nmea_kind") == "rejected").alias("rejected"), F.sum(F.round(c("lat") * 6000).cast("bigint")).alias("sum_centimin"),
    )


@query("fix_carry", T.ctes("fixes") + """ SELECT event_id, device_id, t_s, (m).satellites AS satellites, (m).hdop AS hdop FROM (
    SELECT *, last_value(CASE WHEN event_id%3=0 THEN {'satellites': satellites, 'hdop': acc_m} END IGNORE NULLS)
      OVER (PARTITION BY device_id ORDER BY t_s ROWS UNBOUNDED PRECEDING) AS m FROM fixes WHERE fix)""")
def fix_carry(spark, d):
    fx = T.fixes(spark, d).withColumn("sentence", F.when(F.col("event_id") % 3 == 0, "GGA").otherwise("RMC"))
    fx = fx.withColumn("hdop", F.col("acc_m")).withColumn("alt_m", F.lit(None).cast("double"))
    return ordered.carry_fix(fx, ["device_id"], "t_s").select("event_id", "device_id", "t_s", "satellites", "hdop")


@query("validate_ranges", """SELECT user_id AS device_id, coalesce(CASE WHEN v IS NULL THEN 'missing' WHEN v<1 THEN 'low' WHEN v>100 THEN 'high' END,'ok') AS verdict,
    count(*) AS n FROM (SELECT user_id, CASE WHEN event_type<>'error' THEN value END AS v FROM events) GROUP BY ALL""")
def validate_ranges(spark, d):
    v = F.when(F.col("event_type") != "error", F.col("value"))
    code = first_reason((v.isNull(), "missing"), (~between(v, 1), "low"), (~between(v, high=100), "high"))
    e = T.read(spark, d, "events").select(F.col("user_id").alias("device_id"), F.coalesce(code, F.lit("ok")).alias("verdict"))
    return e.groupBy("device_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("sensor_state", T.ctes("ev") + """ SELECT event_id, device_id, t AS t_s, CASE WHEN since<30 THEN 'warming_up' WHEN t-okt<=5 THEN 'valid' ELSE 'stale' END AS co_state,
    CASE WHEN heard IS NULL OR t-heard>5 THEN 'not_found' WHEN fixed THEN 'fix' ELSE 'no_fix' END AS gps_state FROM (SELECT *, t-boot_id*57.6::DOUBLE AS since,
      max(CASE WHEN event_type<>'error' THEN t END) OVER w AS okt, max(CASE WHEN fix IS NOT NULL THEN t END) OVER w AS heard, last_value(fix IGNORE NULLS) OVER w AS fixed
      FROM (SELECT *, t_s/50.0::DOUBLE AS t, CASE WHEN event_id%7>2 THEN event_id%3<>0 END AS fix FROM ev) WINDOW w AS (PARTITION BY device_id, boot_id ORDER BY t ROWS UNBOUNDED PRECEDING))""")
def sensor_state(spark, d):
    e = T.ev(spark, d).withColumn("t_s", F.col("t_s") / 50.0).withColumn("since", F.col("t_s") - F.col("boot_id") * 57.6)
    e = e.withColumn("ok", F.col("event_type") != "error").withColumn("has_fix", F.when(F.col("event_id") % 7 > 2, F.col("event_id") % 3 != 0))
    out = fleet.sensor_state(e, ["device_id", "boot_id"], "t_s", "since", "ok", "has_fix", chunk_s=60.0)
    return out.select("event_id", "device_id", "t_s", "co_state", "gps_state")


def telemetry_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON telemetry as devices send it, with every part present for some lines, and lines that break one rule each."""
    c, k = F.col, F.col("event_id")
    part = lambda cond, **m: F.when(cond, F.struct(*[v.alias(n) for n, v in m.items()]))
    yes, fix, env, press, alarm = F.lit(True), k % 3 != 0, k % 5 != 0, k % 4 != 0, c("value") >= 60
    payload = F.to_json(F.struct(
        F.lit(1).alias("v"), F.lit("telemetry").alias("event"), k.alias("seq"), F.expr("t_us div 1000").alias("uptime_ms"),
        part(yes, fix=fix, lat=F.when(fix, c("lat")), lon=F.when(fix, c("lon")), sats=F.when(k % 8 != 0, c("satellites")), acc_m=c("acc_m"), age_s=k % 9 / 4.0).alias("gps"),
        part(k % 6 != 0, valid=k % 4 != 3, iso_utc=F.when(k % 4 != 3, F.format_string("2026-08-09T03:%02d:%02dZ", k % 60, k * 7 % 60))).alias("rtc"),
        part(yes, valid=env, temp_c=F.when(env | (k % 43 == 0), (k % 600 - 100) / 10.0), humidity_pct=F.when(env, (k % 1000) / 10.0), pressure_valid=F.when(k % 7 != 0, press),
             press_hpa=F.when(press, (k % 800 + 300).cast("double")), press_trend=F.when(press, "rising"), bmp_address=F.when(k % 10 == 0, k % 3 + 117)).alias("env"),
        part(yes, valid=c("event_type") != "error", warming_up=F.when(k % 2 == 0, k % 9 == 0), ppm=F.when(c("event_type") != "error", c("value")),
             level=F.when(alarm & (k % 29 != 0), "alarm").otherwise("normal"), alarm=alarm).alias("co"),
        part(k % 11 != 0, valid=k % 2 == 0, percent=(k % 102).cast("double"), days_left=k % 90 / 10.0, jetson_gate_on=k % 3 == 1).alias("power")))
    # a foreign member named like a flag changes nothing; a flag sent as text is none
    payload = F.when(k % 31 == 0, F.replace(payload, F.lit('{"v":1'), F.lit('{"v":1,"note":{"ok":"true","alarm":"false"}'))).when(
        k % 37 == 0, F.regexp_replace(payload, '"fix":(true|false)', '"fix":"$1"')).otherwise(payload)
    e = settle(dealt(T.fixes(spark, d), d), payload=payload)
    e = settle(e, line=S.frame_json(c("payload")))
    return e.select("event_id", "device_id", F.when(k % 23 == 0, F.replace("line", F.lit('"seq":'), F.lit('"seq":1'))).otherwise(c("line")).alias("line"))


@query("telemetry_json", T.ctes("fixes", "ev") + """ SELECT event_id, reason, CASE WHEN good THEN event_id END AS seq, CASE WHEN good THEN t_us//1000 END AS uptime_ms, CASE WHEN good THEN fix END AS fix,
    CASE WHEN good AND fix THEN lat END AS lat, CASE WHEN good THEN CASE WHEN event_id%8<>0 THEN satellites ELSE 0 END END AS satellites,
    CASE WHEN good THEN CASE WHEN acc_m IS NOT NULL THEN 'reported' ELSE 'unknown' END END AS accuracy_kind,
    CASE WHEN good AND event_id%6<>0 AND event_id%4<>3 THEN 1786244400+60*(event_id%60)+event_id*7%60 END AS rtc_s, CASE WHEN good AND env THEN CAST(event_id%600-100 AS DOUBLE)/10.0::DOUBLE END AS temp_c,
    CASE WHEN good AND press THEN CAST(event_id%800+300 AS DOUBLE) END AS press_hpa, CASE WHEN good THEN CASE WHEN press THEN 'rising' ELSE 'unknown' END END AS press_trend,
    CASE WHEN good AND press AND event_id%10=0 THEN CAST(event_id%3+117 AS INTEGER) END AS bmp_address, CASE WHEN good AND event_type<>'error' THEN value END AS co_ppm,
    CASE WHEN good THEN CASE WHEN value>=60 THEN 'alarm' ELSE 'normal' END END AS co_level, CASE WHEN good THEN value>=60 END AS co_alarm, CASE WHEN good THEN event_id%2=0 AND event_id%9=0 END AS co_warming_up,
    CASE WHEN good THEN event_id%11<>0 AND event_id%2=0 END AS power_valid, CASE WHEN good AND event_id%11<>0 THEN CAST(event_id%102 AS DOUBLE) END AS percent, CASE WHEN good AND event_id%11<>0 THEN event_id%3=1 END AS gate_on
    FROM (SELECT *, reason IS NULL AS good FROM (SELECT f.event_id, f.lat, f.acc_m, f.satellites, f.event_id%3<>0 AS fix, ev.t_us, ev.value, ev.event_type, event_id%5<>0 AS env, event_id%4<>0 AS press, CASE WHEN event_id%23=0 THEN 'crc_mismatch'
      WHEN event_id%37=0 AND event_id%31<>0 THEN 'gps_missing' WHEN event_id%11<>0 AND event_id%102>100 THEN 'power_percent_range' WHEN event_id%5=0 AND event_id%43=0 THEN 'env_unexpected_value'
      WHEN event_id%4<>0 AND event_id%10=0 AND event_id%3=0 THEN 'pressure_address' WHEN ev.value>=60 AND event_id%29=0 THEN 'co_alarm_conflict' END AS reason FROM fixes f JOIN ev USING (event_id)
      )) """)
def telemetry_json(spark, d):
    t = lambda n: F.col(f"telemetry.{n}")
    return S.route_lines(telemetry_lines(spark, d)).select(
        "event_id", "reason", *[t(n).alias(n) for n in ("seq", "uptime_ms", "fix", "lat", "satellites", "accuracy_kind")], F.unix_timestamp(t("rtc_utc")).alias("rtc_s"),
        *[t(n).alias(n) for n in ("temp_c", "press_hpa", "press_trend", "bmp_address", "co_ppm", "co_level", "co_alarm", "co_warming_up", "power_valid", "percent", "gate_on")])
