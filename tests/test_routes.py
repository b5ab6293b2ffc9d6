"""Progress along routes: work done once a position, and chunks that pass on what walking in order gives."""

import random

import pytest

from fieldmarch.operators import routes


def test_places_are_worked_out_once(spark):
    pts = spark.createDataFrame([(1, [(127.0, 37.5), (127.001, 37.5), (127.002, 37.501)])], "route_id long, points array<struct<lon:double,lat:double>>")
    pos = spark.createDataFrame([(1, 1, 127.0005, 37.50001, 0.0), (2, 7, 127.0, 37.5, 0.0)], "event_id long, route_id long, lon double, lat double, min_progress_m double")
    out = routes.progress(pos, routes.route_profile(pts))
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    scale = plan.count("greatest(0.15")
    assert scale == 1
    got = {r.event_id: r["at"] for r in out.collect()}
    assert got[1].next == 1 and got[1].cross == pytest.approx(1.11, abs=0.01) and got[2] is None


def walk(rows):
    """The plain fold: device, t, event, route, spots."""
    out, state = {}, {}
    for dev, t, event, route, spots in sorted(rows):
        was, low = state.get(dev, (None, 0.0))
        low = low if was == route else 0.0
        ahead = [s for s in spots if s[1] + 3.0 >= low]
        ties = [(s[0], abs(s[1] - low), s[1], s[2]) for s in ahead if s[0] <= min(a[0] for a in ahead) + 0.75]
        pick = min(ties) if ties and max(x[2] for x in ties) - min(x[2] for x in ties) <= 5.0 and min(ties)[0] <= 8.0 else None
        low = max(low, pick[2]) if pick else low
        state[dev] = (route, low)
        out[event] = (pick is None, low, pick[3] if pick else None)
    return out


@pytest.mark.parametrize("chunk", [5.0, 60.0, 1e9])
def test_follow_equals_walking_in_order(spark, chunk):
    rng = random.Random(3)
    rows = []
    for dev, n in ((1, 400), (2, 30), (3, 1)):
        for i in range(n):
            far = rng.choice([0, 0, 0, 60])  # a jump ahead that later chunks must hear of
            spots = [(rng.choice([1.0, 1.5, 7.9, 8.0, 8.5, 8.75, 20.0]), rng.uniform(0, i + far), rng.uniform(0, 9)) for _ in range(rng.randint(0, 4))]
            rows.append((dev, float(i // 2), dev * 1000 + i, 1 + (i // 90) % 2, spots))
    df = spark.createDataFrame(rows, "device_id long, t_s double, event_id long, route_id long, spots array<struct<cross:double,progress:double,remaining:double>>").repartition(3)
    got = routes.follow(df, ["device_id"], chunk_s=chunk)
    assert "spots" not in got.columns
    assert {r.event_id: (r.reroute, r.progress_m, r.remaining_m) for r in got.collect()} == walk(rows)
