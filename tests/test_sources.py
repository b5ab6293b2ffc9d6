"""Line, map, clip and file sources on small fixtures."""

import io
import json
import math
import tempfile
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmarch.functions.checksum import crc16, xor8
from fieldmarch.operators import fleet
from fieldmarch.sources import capture, files, maps, telemetry as S


def xor(body):
    out = 0
    for ch in body:
        out ^= ord(ch)
    return f"{out:02X}"


def csv(body):
    return f"${body}*{xor(body)}"


def crc(data):
    reg = 0xFFFF
    for b in data.encode():
        reg ^= b << 8
        for _ in range(8):
            reg = (reg << 1 ^ 0x1021 if reg & 0x8000 else reg << 1) & 0xFFFF
    return reg


def signed(payload):
    base = json.dumps(payload, separators=(",", ":"))
    return f'{base[:-1]},"crc16":"{crc(base):04X}"}}'


GOOD = "SA1,17,321000,1,234,582,1,3,2,375435000,1270767000,9"


def lines(spark, items):
    return spark.createDataFrame([(i, x) for i, x in enumerate(items)], "n int, line string")


CSV_CASES = [
    (csv(GOOD), None), (csv(GOOD.replace("SA1", "OGT1")), None), (csv(GOOD)[:-1] + "!", "checksum_format"), (csv(GOOD) + "0", "checksum_length"),
    ("$" + GOOD, "checksum_missing"), ("$" + GOOD + "*00", "checksum_mismatch"), (csv(GOOD + ",1"), "field_count"), (csv(GOOD.replace("234", "2.4")), "not_integer"),
    (csv(GOOD.replace("582", "1001")), "environment_range"), (csv(GOOD.replace(",1,3,2", ",3,3,2")), "out_of_range"),
    (csv(GOOD.replace(",1,3,2", ",1,10001,2")), "co_range"), (csv(GOOD.replace("375435000", "975435000")), "coordinate_range"), ("hello", None),
]


def test_csv_frames(spark):
    rows = S.parse_csv(lines(spark, [c[0] for c in CSV_CASES])).orderBy("n").collect()
    assert [r.reason for r in rows] == [c[1] for c in CSV_CASES]
    for row in rows[:2]:
        assert (row.seq, row.lat, row.lon, row.temp_c, row.humidity_pct, row.co_ppm, row.co_level) == (17, 37.5435, 127.0767, 23.4, 58.2, 3.0, "normal")


def test_csv_values_that_are_not_known_stay_null(spark):
    no_fix, no_dht, warming = GOOD.replace(",1,3,2,", ",1,3,1,"), GOOD.replace("321000,1,", "321000,0,"), GOOD.replace(",1,3,2,", ",0,3,2,")
    a, b, c = S.parse_csv(lines(spark, [csv(no_fix), csv(no_dht), csv(warming)])).orderBy("n").collect()
    assert (a.fix, a.lat, a.lon) == (False, None, None)
    assert (b.env_valid, b.temp_c, b.humidity_pct) == (False, None, None)
    assert (c.co_valid, c.co_warming_up, c.co_ppm, c.co_level) == (False, True, None, "unknown")


TEL = {
    "v": 1, "event": "telemetry", "seq": 17, "uptime_ms": 321000,
    "gps": {"fix": True, "lat": 37.5435, "lon": 127.0767, "acc_m": 6.0, "hdop": 0.9, "sats": 11, "age_s": 0.2},
    "rtc": {"valid": True, "iso_utc": "2026-08-09T03:00:00Z", "age_s": 0.1},
    "env": {"valid": True, "sht_valid": True, "pressure_valid": True, "temp_c": 23.45, "humidity_pct": 58.2, "press_hpa": 1007.4, "press_trend": "falling", "bmp_address": 119},
    "co": {"valid": True, "warming_up": False, "ppm": 3.2, "level": "normal", "alarm": False},
    "power": {"valid": True, "percent": 80, "days_left": 5.5, "jetson_gate_on": True, "shutdown_pending": False},
}


def changed(**parts):
    out = json.loads(json.dumps(TEL))
    for name, values in parts.items():
        if isinstance(values, dict):
            out[name].update(values)
        else:
            out[name] = values
    return signed(out)


JSON_CASES = [
    (signed(TEL), None), (signed(TEL).replace("23.45", "23.46"), "crc_mismatch"), (json.dumps(TEL), "crc_missing"), (changed(v=2), "version_unsupported"),
    (changed(co={"alarm": True}), "co_alarm_conflict"), (changed(env={"press_trend": "sideways"}), "env_trend"), (changed(env={"pressure_valid": False}), "pressure_unexpected_value"),
    (changed(env={"bmp_address": 100}), "pressure_address"), (changed(env={"sht_valid": False}), "env_sht_conflict"), (changed(rtc={"iso_utc": "2026-08-09T03:00:00+09:00"}), "rtc_time_format"),
    (changed(rtc={"iso_utc": "2024-08-09T03:00:00Z"}), "rtc_year_range"), (changed(gps={"lat": 99}), "coordinate_range"), (changed(gps={"fix": "maybe"}), "gps_missing"),
    (changed(power={"percent": 101}), "power_percent_range"), (changed(seq=2**32), "seq_range"), ("[1]", "not_object"), ("boot", "not_json"),
]


def test_json_telemetry(spark):
    rows = S.route_lines(lines(spark, [c[0] for c in JSON_CASES])).orderBy("n").collect()
    assert [r.reason for r in rows] == [c[1] for c in JSON_CASES]
    assert [r.kind for r in rows] == ["rejected" if c[1] else "telemetry" for c in JSON_CASES]
    for t in [r.telemetry for r in rows if r.reason is None]:
        assert (t.seq, t.lat, t.temp_c, t.press_trend, t.bmp_address, t.co_ppm, t.percent, t.accuracy_kind) == (17, 37.5435, 23.45, "falling", 119, 3.2, 80.0, "reported")


EVENT_CASES = [
    ({"v": 1, "event": "button", "seq": 1, "button": "voice", "state": "pressed", "held_ms": 0}, "button", None),
    ({"v": 1, "event": "button", "seq": 1, "button": "voice", "state": "pressed", "held_ms": 5}, "rejected", "held_while_pressed"),
    ({"v": 1, "event": "button", "seq": 1, "button": "bell", "state": "pressed", "held_ms": 0}, "rejected", "button_kind"),
    ({"v": 1, "event": "output", "seq": 1, "output": "trail", "level": "alert", "active": True, "watchdog_ms": 100}, "output", None),
    ({"v": 1, "event": "output", "seq": 1, "output": "trail", "level": "off", "active": True, "watchdog_ms": 100}, "rejected", "level_active_conflict"),
    ({"v": 1, "event": "output", "seq": 1, "output": "trail", "level": "off", "active": False, "watchdog_ms": 99}, "rejected", "watchdog_range"),
    ({"v": 1, "event": "power", "seq": 1, "state": "shutdown_ack", "gate_on": True, "shutdown_pending": True}, "power", None),
    ({"v": 1, "event": "power", "seq": 1, "state": "gate_off", "gate_on": True, "shutdown_pending": False}, "rejected", "state_gate_conflict"),
    ({"v": 1, "event": "hello", "seq": 1}, "ignored", None),
]


def test_hardware_events(spark):
    rows = S.route_lines(lines(spark, [signed(c[0]) for c in EVENT_CASES])).orderBy("n").collect()
    assert [(r.kind, r.reason) for r in rows] == [c[1:] for c in EVENT_CASES]


def test_nmea_replay(spark, tmp_path):
    rmc = "GNRMC,120000.00,A,3732.7908,N,12704.5428,E,0.0,0.0,030826,,,A"
    text = ["# replay", "", "$GNGGA,120000.00,3732.7908,N,12704.5428,E,1,10,0.8,35.0,M,0.0,M,,*76",
            "$GNGGA,120003.00,3732.8088,N,12704.5788,E,1,12,0.6,35.5,M,0.0,M,,*7B", "$GNGGA,120004.00,,,,,0,00,99.9,,,,,,*46", csv(rmc), "$GNGSV,1*00", csv("GNGSV,1")]
    (tmp_path / "a.txt").write_text("\n".join(text))
    rows = S.parse_nmea(S.replay(spark, str(tmp_path))).collect()
    assert [r.nmea_kind for r in rows] == ["fix", "fix", "fix", "fix", "rejected", "other"]
    a, b, c, d = rows[:4]
    assert (a.fix, a.satellites, a.hdop, a.alt_m) == (True, 10, 0.8, 35.0) and abs(a.lat - (37 + 32.7908 / 60)) < 1e-9
    assert (c.fix, c.lat, c.satellites) == (False, None, 0)
    assert (d.sentence, d.satellites, d.date) == ("RMC", None, "030826") and b.satellites == 12


def test_checksums(spark):
    row = spark.range(1).select(crc16(F.lit("123456789")).alias("c"), xor8(F.lit("GNGSV,1")).alias("x")).collect()[0]
    assert row.c == 0x29B1 and f"{row.x:02X}" == xor("GNGSV,1")


def frame(ppm):
    body = [0xFF, 0x04, 0x03, 0, ppm >> 8, ppm & 255, 0, 0]
    return bytes(body + [-sum(body[1:]) & 255])


def test_co_frames_resync(spark, tmp_path):
    bad = bytearray(frame(40))
    bad[8] ^= 1
    (tmp_path / "a.bin").write_bytes(b"\x01\xff" + frame(12) + bytes(bad) + b"\xff\xff\x04" + frame(300) + b"\xff\x04")
    got = capture.co_frames(capture.files(spark, str(tmp_path))).orderBy("at").collect()
    assert [(r.at, r.ppm) for r in got] == [(2, 12), (23, 300)]


def wav(path, x, rate=16000, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes((np.asarray(x) * 32767).astype("<i2").tobytes() if width == 2 else bytes(len(x)))
    path.write_bytes(out.getvalue())


def test_audio_checks_and_bursts(spark, tmp_path):
    t = np.arange(32000) / 16000
    tone = 0.3 * np.sin(2 * math.pi * 440 * t)
    wav(tmp_path / "good.wav", tone)
    wav(tmp_path / "loud.wav", np.sign(tone))
    wav(tmp_path / "silent.wav", 0 * tone)
    wav(tmp_path / "short.wav", tone[:100])
    wav(tmp_path / "bytes.wav", tone, width=1)
    (tmp_path / "junk.wav").write_bytes(b"RIFFxxxx")
    got = {r.path.split("/")[-1][:-4]: r.reason for r in capture.audio_qc(capture.files(spark, str(tmp_path))).collect()}
    assert got == {"good": None, "loud": "clipped", "silent": "silent", "short": "duration", "bytes": "not_pcm16", "junk": "unreadable"}
    gap = np.zeros(16000)
    clips = tmp_path / "b"
    clips.mkdir()
    wav(clips / "two.wav", np.concatenate([gap, tone[:8192], gap, tone[:16384], gap]))
    rows = capture.bursts(capture.files(spark, str(clips))).orderBy("start_s").collect()
    assert len(rows) == 2 and all(abs(a - b) < 0.1 for r, w in zip(rows, [(1.0, 1.512), (2.512, 3.536)]) for a, b in zip((r.start_s, r.end_s), w))


def test_graphml(spark, tmp_path):
    text = """<graphml><key id="d0" for="node" attr.name="x"/><key id="d1" for="node" attr.name="y"/>
<key id="d2" for="edge" attr.name="length"><default>7.5</default></key><key id="d3" for="edge" attr.name="geometry"/>
<graph edgedefault="undirected"><node id="a"><data key="d0">127.0</data><data key="d1">37.5</data></node><node id="b"><data key="d0">127.1</data><data key="d1">37.6</data></node>
<edge source="a" target="b"><data key="d2">12.5</data><data key="d3">LINESTRING (127 37.5, 127.1 37.6)</data></edge><edge source="b" target="a" id="9"></edge></graph></graphml>"""
    (tmp_path / "m.graphml").write_text(text)
    nodes, edges = maps.read_graphml(spark, str(tmp_path / "m.graphml"))
    assert {(r.node_id, r.lon, r.lat) for r in nodes.collect()} == {("a", 127.0, 37.5), ("b", 127.1, 37.6)}
    assert sorted((r.u, r.v, r.length_m) for r in edges.collect()) == [("a", "b", 7.5), ("a", "b", 12.5), ("b", "a", 7.5), ("b", "a", 12.5)]
    (tmp_path / "evil.graphml").write_text('<!DOCTYPE x [<!ENTITY a "b">]>' + text)
    with pytest.raises(ValueError):
        maps.read_graphml(spark, str(tmp_path / "evil.graphml"))


def test_osm(spark, tmp_path):
    node = lambda i, x: f'<node id="{i}" lon="{127 + x}" lat="37.5"/>'
    way = lambda i, refs, **tags: f'<way id="{i}">' + "".join(f'<nd ref="{r}"/>' for r in refs) + "".join(
        f'<tag k="{k.replace("__", ":")}" v="{v}"/>' for k, v in tags.items()) + "</way>"
    (tmp_path / "m.osm").write_text("<osm>" + node(1, 0) + node(2, 0.001) + node(3, 0.002) + way(10, [1, 2, 3, 99], highway="path") + way(11, [1, 3], highway="motorway")
                                    + way(12, [1, 3], highway="steps", oneway__foot="-1") + way(13, [1, 3], highway="path", foot="no")
                                    + way(14, [2, 1], highway="track", access="private", foot="yes", oneway__foot="yes") + "</osm>")
    ways, places = maps.read_osm(spark, str(tmp_path / "m.osm"))
    got = sorted((r.way_id, r.u, r.v) for r in maps.osm_to_graph(ways, places).collect())
    assert got == [("10", "1", "2"), ("10", "2", "1"), ("10", "2", "3"), ("10", "3", "2"), ("12", "3", "1"), ("14", "2", "1")]


def test_position_history_file(spark, tmp_path):
    keep = {"version": 1, "boot_id": "b", "monotonic_s": 45.0, "lat": 37.5, "lon": 127.0}
    rows = [json.dumps(keep), "{not-json}", json.dumps({**keep, "boot_id": "x"}), json.dumps({**keep, "monotonic_s": 300.0}), json.dumps({**keep, "lat": 95})]
    (tmp_path / "h.jsonl").write_text("\n".join(rows))
    got = fleet.load_history(files.position_records(spark, str(tmp_path)), F.lit(200.0), F.lit("b")).collect()
    assert [r.monotonic_s for r in got] == [45.0]


def test_positions_are_written_and_compacted(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df = spark.createDataFrame([(1, 5.0, "2026-08-01 10:00:00"), (1, 15.0, "2026-08-02 10:00:00")], "device_id long, monotonic_s double, recorded_at string")
    files.write_positions(df, path + "/a")
    files.compact_positions(spark, path + "/a", path + "/b", "2026-08-02")
    assert [r.monotonic_s for r in spark.read.parquet(path + "/b").collect()] == [15.0]


def test_catalog_and_cases(spark, tmp_path):
    poi = {"version": 1, "map_sources": ["m"], "demo": False, "pois": [{"id": "w", "kind": "water_source", "name": "n", "lat": 37.54, "lon": 127.07, "potable": False, "source": "s"}]}
    (tmp_path / "p.json").write_text(json.dumps(poi))
    (tmp_path / "old.json").write_text(json.dumps({**poi, "version": 2}))
    assert [r.id for r in files.poi_catalog(spark, str(tmp_path / "p.json")).collect()] == ["w"]
    assert files.poi_catalog(spark, str(tmp_path / "old.json")).count() == 0
    (tmp_path / "c.jsonl").write_text('{"id":"a","text":"t","expected":"lost"}\n{oops')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        files.eval_cases(spark, str(tmp_path / "c.jsonl"), "id string, text string, expected string").collect()


def test_nmea_letters_that_no_checksum_covers(spark):
    body = "GNGGA,120000.00,3730.00,N,12704.5428,E,1,08,0.8,35.0,M,0.0,M,,"
    lines = [(f"${body}�*00",), (f"${body}�*{_xor(body)}",), (f"${body}*{_xor(body)}",)]
    got = S.parse_nmea(spark.createDataFrame(lines, "line string")).collect()
    assert [(r.nmea_kind, r.reason, r.lat is None) for r in got] == [("rejected", "checksum_mismatch", True)] * 2 + [("fix", None, False)]


def _xor(body):
    x = 0
    for b in body.encode():
        x ^= b
    return f"{x:02X}"


def test_lines_over_the_limit_are_rejected(spark):
    long, short = ('{"event":"hello","x":"' + "가" * n + '"}' for n in (1400, 1300))
    got = S.route_lines(spark.createDataFrame([(long,), (short,)], "line string")).collect()
    assert [(r.kind, r.reason, len(r.line)) for r in got] == [("rejected", "line_length", 1424), ("ignored", None, 1324)]


def test_state_line_of_a_latched_alarm(spark):
    from pyspark.sql import functions as F

    from fieldmarch.operators import replies

    names = """gps_fix:boolean,acc_m:double,satellites:long,last_age_s:double,sun_computed:boolean,remaining_min:double,return_by_clock:string,sun_level:string,
        sunset_clock:string,env_valid:boolean,temp_c:double,humidity_pct:double,press_hpa:double,pressure_valid:boolean,press_trend:string,co_valid:boolean,co_stale:boolean,
        co_ppm:double,co_alarm:boolean,co_level:string,power_valid:boolean,percent:double,days_left:double,trail_status:string,offset_m:double,route_available:boolean,
        target_id:string,target_kind:string,distance_m:double,bearing_deg:double,eta_min:double,arrived:boolean"""
    kinds = dict(x.strip().split(":") for x in names.split(","))

    def line(most=60, **values):
        df = spark.range(1).select(F.struct(*[F.lit(values.get(n)).cast(k).alias(n) for n, k in kinds.items()]).alias("dev"))
        return replies.state_line(df, "dev", most).first().state

    assert line() == "gps=nofix"
    assert line(co_valid=True, co_ppm=20.0, co_alarm=True, co_level="normal") == "gps=nofix | co=20ppm alarm"
    assert line(co_valid=True, co_ppm=120.0, co_level="warning") == "gps=nofix | co=120ppm warning"
    assert line(env_valid=True, temp_c=1.25, press_hpa=1000.0) == "gps=nofix | env=1.2C"
    full = dict(sun_computed=True, sunset_clock="18:05", remaining_min=7.5, sun_level="normal", route_available=True, target_id="checkpoint-3", distance_m=9.0, arrived=True)
    assert line(**full) == "gps=nofix | sun=set18:05 rem8min lvl=normal | route=checkpoint-3 9m | arrived=yes"
    assert line(18, **full) == "gps=nofix | sun=set18:05 rem8min lvl=normal" and line(2, **full) == "device=truncated"


def test_bursts_end_with_the_clip_or_when_they_last_too_long(spark, tmp_path):
    t = np.arange(16000 * 12) / 16000
    tone, gap = 0.3 * np.sin(2 * math.pi * 440 * t), np.zeros(16000)
    wav(tmp_path / "long.wav", np.concatenate([gap, tone]))
    wav(tmp_path / "blips.wav", np.concatenate([gap, tone[:900], gap, tone[:900], gap]))
    wav(tmp_path / "paused.wav", np.concatenate([gap, tone[:8192], gap[:4096], tone[:8192], gap]))
    wav(tmp_path / "open.wav", np.concatenate([gap, tone[:8192]]))
    wav(tmp_path / "none.wav", gap[:0])
    (tmp_path / "junk.wav").write_bytes(b"RIFFxxxx")
    got = {}
    for r in capture.bursts(capture.files(spark, str(tmp_path))).orderBy("path", "start_s").collect():
        got.setdefault(r.path.split("/")[-1][:-4], []).append((round(r.start_s, 1), round(r.end_s, 1)))
    assert got == {"long": [(1.0, 9.0), (9.0, 13.0)], "paused": [(1.0, 2.3)], "open": [(1.0, 1.5)]}
