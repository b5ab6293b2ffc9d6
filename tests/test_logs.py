"""Folded logs against plain folds over the rows, whatever the chunks and however many rows one device has."""

import random

import pytest
from pyspark.sql import functions as F

from fieldmarch.operators import conversation as talk, waypoints
from fieldmarch.plans import logs

COMMANDS = """device_id long, t_s double, event_id long, action string, kind string, id string, fix boolean, lat double, lon double,
    poi_lat double, poi_lon double, ago_lat double, ago_lon double"""


def plain_log(rows):
    """status, seq, n_saved, selected, night, base, dest of each command, by device and event."""
    out, states = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        s = states.setdefault(r[0], {"seq": 0, "n": 0, "gone": set(), "basecamp": None, "destination": None, "pending": None, "selected": None, "night": False})
        _, _, event, action, kind, name, fix, lat, lon, poi_lat, poi_lon, ago_lat, ago_lon = r
        name = name or kind
        status = "accepted"

        def left():
            return [k for k in range(max(1, s["n"] - 49), s["n"] + 1) if k not in s["gone"]]  # noqa: B023

        def put(what, point):
            if what == "checkpoint":  # noqa: B023
                s["n"] += 1  # noqa: B023
                s["selected"] = f"checkpoint-{s['n']}"  # noqa: B023
            else:
                s[what], s["selected"] = point, what  # noqa: B023

        if action in ("save_basecamp", "save_checkpoint") and fix:
            put(action[5:], (lat, lon))
        elif action == "route_recent_trace" and fix and ago_lat is not None:
            put("checkpoint", None)
        elif action == "save_current" and fix and kind in waypoints.KINDS or action == "set" and kind in waypoints.KINDS:
            put(kind, (lat, lon))
        elif action == "select" and (name in ("basecamp", "destination") and s[name] or name in {f"checkpoint-{k}" for k in left()}):
            s["selected"] = name
        elif action == "remove":
            if name in ("basecamp", "destination"):
                s[name] = None
            elif name and name.startswith("checkpoint-") and name[11:].isdigit() and int(name[11:]) <= s["n"]:
                s["gone"].add(int(name[11:]))
            if s["selected"] == name:
                s["selected"] = None
        elif action in ("route_basecamp", "route_destination") and s[action[6:]] and fix:
            s["selected"] = action[6:]
        elif action == "route_last_checkpoint" and left() and fix:
            s["selected"] = f"checkpoint-{left()[-1]}"
        elif action == "clear_destination":
            s["pending"] = None
            if s["destination"] is None:
                status = "rejected"
            elif s["selected"] == "destination":
                s["selected"] = None
            s["destination"] = None
        elif action == "find_nearest_water" and fix and poi_lat is not None:
            s["pending"], status = (poi_lat, poi_lon), "confirmation_required"
        elif action == "confirm_destination":
            if s["pending"]:
                put("destination", s["pending"])
            else:
                status = "rejected"
            s["pending"] = None
        elif action in ("reject_destination", "cancel"):
            s["pending"] = None
        elif action in ("night_on", "night_off", "night_toggle"):
            s["night"] = not s["night"] if action == "night_toggle" else action == "night_on"
        elif action != "status":
            status = "ignored" if action == "dance" or action is None else "rejected"
        s["seq"] += action in waypoints.COMMANDS
        out[r[0], event] = (status, s["seq"], s["n"], s["selected"], s["night"], s["basecamp"], s["destination"])
    return out


def test_waypoint_log(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        lat, maybe = float(i % 80), lambda x: x if rng.random() < 0.8 else None
        saves = rng.random() < 0.25
        rows.append((
            0 if rng.random() < 0.6 else rng.randrange(1, 5), float(rng.randrange(0, 400)), i, "save_checkpoint" if saves else rng.choice([*logs.ACTIONS, None, "route_last_checkpoint", "remove"]),
            rng.choice(["basecamp", "destination", "checkpoint", "camp", None]), rng.choice(["basecamp", "destination", "", None, "checkpoint-x", *[f"checkpoint-{rng.randrange(1, 90)}" for _ in range(6)]]),
            rng.random() < 0.8, lat, -lat, maybe(lat + 1), 0.5, maybe(lat - 1), 0.25))
    want = plain_log(rows)
    df = spark.createDataFrame(rows, COMMANDS).repartition(4)
    for chunk in (17.0, 1e6):
        got = {(r.device_id, r.event_id): (
            r.status, r.seq, r.n_saved, r.selected, r.night, None if r.base_lat is None else (r.base_lat, r.base_lon), None if r.dest_lat is None else (r.dest_lat, r.dest_lon))
            for r in waypoints.waypoint_log(df, ["device_id"], chunk_s=chunk).collect()}
        assert got == want
    assert max(v[2] for v in want.values()) > 60 and {v[0] for v in want.values()} == {"accepted", "rejected", "confirmation_required", "ignored"}
    assert waypoints.waypoint_log(df.limit(0), ["device_id"]).count() == 0


def plain_talk(rows):
    out, states = [], {}
    for device, t, seq, speech, norm, wake, remainder, answer, asks, said in sorted(rows, key=lambda r: r[:3]):
        now, until = states.get(device, ("idle", 0.0))
        events = []
        if now != "idle" and t >= until:
            events.append(("timeout", now))
            now = "idle"
        bare, said = not remainder, max(t, t if said is None else said)
        few = len((norm or "").replace(" ", "")) <= 2
        short = now == "await_confirm" and 0 < speech <= 1 and (answer == "yes" or answer is None and few)
        if short:
            events.append(("short_confirm", now))
        if now == "idle" and not (0.25 <= speech <= 4 and wake):
            events.append(("no_wake" if 0.25 <= speech <= 4 else "ignored_length", now))
        elif now != "idle" and not short and not norm:
            events.append(("empty", now))
        elif wake and bare and not short:
            events.append(("wake", now))
            now, until = "await_command", said + 10
        else:
            events.append(("command", now))
            now, until = ("await_confirm", said + 10) if asks else ("followup", said + 6)
        states[device] = (now, until)
        out += [(device, seq, n, *e) for n, e in enumerate(events)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [4.0, 1e6])
def test_conversation(spark, chunk):
    rng = random.Random(11)
    rows, t = [], 0.0
    for i in range(700):
        t += rng.choice([0.0, 0.5, 1.0, 2.0, 4.0, 6.0, 9.0]) if i % 40 else 30.0
        rows.append((
            0 if rng.random() < 0.8 else rng.randrange(1, 4), t, i, rng.choice([0.1, 0.5, 1.0, 2.0, 5.0]), rng.choice(["", "a", "a b", "abcd", None]), rng.random() < 0.4,
            rng.choice(["", None, "x"]), rng.choice(["yes", "no", None]), rng.random() < 0.5, rng.choice([None, t - 1, t + 0.5, t + 3.0])))
    df = spark.createDataFrame(rows, "device_id long, t_s double, seq long, speech_s double, norm string, wake boolean, remainder string, answer string, asks boolean, said_at double").repartition(4)
    got = talk.conversation(df, ["device_id"], chunk_s=chunk).collect()
    assert sorted((r.device_id, r.seq, r.n, r.event, r.state) for r in got) == plain_talk(rows)
    assert {r.event for r in got} == {"timeout", "short_confirm", "no_wake", "ignored_length", "empty", "wake", "command"}


def test_conversation_waits_run_out(spark):
    said = [(0, {}), (1, dict(wake=True)), (5, dict(asks=True)), (8, dict(speech_s=0.5, norm="uh")), (13.9, {}), (20, {}), (21, dict(speech_s=5.0, wake=True))]
    rows = [(1, float(t), i, *{**dict(speech_s=1.5, norm="x y z", wake=False, remainder="", answer=None, asks=False, said_at=float(t)), **k}.values()) for i, (t, k) in enumerate(said)]
    df = spark.createDataFrame(rows, "device_id long, t_s double, seq long, speech_s double, norm string, wake boolean, remainder string, answer string, asks boolean, said_at double")
    by = {}
    for r in sorted(talk.conversation(df, ["device_id"]).collect(), key=lambda r: (r.seq, r.n)):
        by.setdefault(r.seq, []).append(r.event)
    assert list(by.values()) == [["no_wake"], ["wake"], ["command"], ["short_confirm", "command"], ["command"], ["timeout", "no_wake"], ["ignored_length"]]


def test_commands_that_name_no_checkpoint_are_dealt_to_many_tasks(spark):
    rows = spark.range(4000).selectExpr("CAST(id >= 0 AS int) AS device_id", "CAST(id AS double) AS t_s", "id AS event_id", "CASE WHEN id % 40 = 0 THEN id DIV 40 END AS _k")
    removed = spark.range(0, 100, 2).selectExpr("CAST(id >= 0 AS int) AS device_id", "id AS _k", "id * 10 AS _removed_at")
    out = waypoints._with_removal(rows, removed, ["device_id"], ["t_s", "event_id"], 8)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
    got = {r.event_id: r._removed_at for r in out.collect()}
    assert got == {i: i // 40 * 10 if i % 80 == 0 else None for i in range(4000)}
