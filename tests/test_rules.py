"""Scalar rules on known cases: alarms, history, status, sun, text, guards."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldmarch import vocabulary as V
from fieldmarch.functions import guard, solar, status, text as X
from fieldmarch.operators import asof, fleet, latch, rules


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).collect()[0]


@pytest.mark.parametrize("points, last", [
    ([(0, 100.0)], "alarm"), ([(t, 35.0) for t in range(0, 180)], "none"), ([(t, 35.0) for t in range(0, 181)], "warning"),
    ([(0, 35.0), (100, 20.0), (101, 35.0), (280, 35.0)], "none"), ([(0, 100.0), (1, None), (500, None)], "alarm"),
    ([(0, 100.0), (1, 29.0), (31, 29.0)], "none"), ([(0, 100.0), (1, 30.0), (900, 30.0)], "alarm"), ([(0, 100.0), (1, 29.0), (30, 29.0)], "alarm"),
])
def test_co_levels(spark, points, last):
    df = spark.createDataFrame([(1, float(t), v) for t, v in points], "dev long, t double, ppm double")
    out = latch.co_latch(df, ["dev"], "t", "ppm", 40.0)
    assert out.orderBy(F.desc("t")).first().level == last


@pytest.mark.parametrize("t, found", [(45.0, 45.0), (-6.0, None), (-5.0, -5.0), (44.0, 44.0)])
def test_point_ago_tolerance(spark, t, found):
    pos = spark.createDataFrame([(1, t), (1, 200.0)], "dev long, t double")
    req = spark.createDataFrame([(1, 200.0)], "dev long, now double")
    assert asof.point_ago(req, pos, ["dev"], "now", "t").first().found_t == found
    tie = spark.createDataFrame([(1, 10.0), (1, 30.0)], "dev long, t double")
    assert asof.point_ago(req, tie, ["dev"], "now", "t").first().found_t == 10.0


@pytest.mark.parametrize("loc, fix, off, acc, want", [
    (False, True, 5.0, 3.0, "unavailable"), (True, False, 5.0, 3.0, "last_fix_only"), (True, True, 61.0, None, "off_trail_estimate"), (True, True, 60.0, None, "accuracy_unknown"),
    (True, True, 41.0, 10.0, "off_trail"), (True, True, 20.0, 10.0, "on_trail"), (True, True, 35.0, 10.0, "uncertain"),
])
def test_trail_status(spark, loc, fix, off, acc, want):
    assert one(spark, s=status.trail_status(F.lit(loc), F.lit(fix), F.lit(off), F.lit(acc).cast("double"))).s == want


def test_sun_in_seoul_and_at_the_pole(spark):
    rows = [(dt.date(2026, 8, 9), 37.5665, 126.9780, 540), (dt.date(2026, 12, 21), 89.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "day date, lat double, lon double, off int")
    r, pole = solar.sun_events(df, *[F.col(c) for c in ("day", "lat", "lon", "off")]).orderBy("day").collect()
    kst = dt.timezone(dt.timedelta(hours=9))
    up, down = (dt.datetime.fromtimestamp(e, kst) for e in (r.sunrise, r.sunset))
    assert 4 <= up.hour <= 7 and 18 <= down.hour <= 21 and up.date() == down.date() == dt.date(2026, 8, 9)
    assert r.civil_end > r.sunset and (pole.sunrise, pole.sunset, pole.civil_end) == (None, None, None)


def test_return_plan_levels(spark):
    plan = lambda left: status.return_plan(F.lit(True), F.lit(True), F.lit(True), F.lit(True), F.lit(0.0), F.lit(100_000), F.lit(100_000 - 1800 - left * 60))
    got = [one(spark, s=plan(n)["status"], r=plan(n)["return_in_min"]) for n in (0, 30, 31)]
    assert [(g.s, g.r) for g in got] == [("return_now", 0), ("caution", 30), ("scheduled", 31)]


def test_normalize_and_lexicon(spark):
    r = one(spark, a=X.normalize_utterance(F.lit("  Ｈｅｌｌｏ…\t世界!!  네,  ")), b=X.apply_lexicon(F.lit("목격체로  베이스   캠프 번호 불"), V.LEXICON), c=X.apply_lexicon(F.lit("전화번호 알려"), V.LEXICON))
    assert (r.a, r.b, r.c) == ("hello 世界 네", "목적지로 베이스캠프 버너 불", "전화번호 알려")


@pytest.mark.parametrize("said, variant, rest", [
    ("오지야", "오지야", ""), ("음 어 오지 야 길 알려줘", "오지야", "길 알려줘"), ("오지", "오지", ""), ("오지 않아", None, None), ("어디야", None, None),
    ("어디야 날씨", "어디야", "날씨"), ("오지야아 물", "오지야아", "물"), ("네", None, None),
])
def test_wake_words(spark, said, variant, rest):
    df = spark.createDataFrame([(said,)], "t string").select(X.strip_fillers(X.normalize_utterance(F.col("t")), V.WAKE_FILLERS).alias("t"))
    hit = df.select(X.match_wake(F.col("t"), V.WAKE_EXACT, V.WAKE_PREFIXES, V.WAKE_COMMAND_ONLY).alias("h")).first().h
    assert (hit and (hit.variant, hit.remainder)) == (variant and (variant, rest))


def test_loops_fold(spark):
    df = spark.createDataFrame([("a b a b a b",), ("a b a b",), ("x x x x",), ("a b c",), ("solo",)], "t string").withColumn("w", F.split("t", " "))
    assert [r.f for r in df.select(X.fold_loop(F.col("t"), F.col("w")).alias("f")).collect()] == ["a b", "a b a b", "x", "a b c", "solo"]


@pytest.mark.parametrize("body, pending, reason", [
    ('{"scenario_id":"weather","action":"none"}', False, "validated_llm_label"), ('{"scenario_id":"weather","action":"none","x":1}', False, "schema_validation_failed"),
    ('{"scenario_id":"moon","action":"none"}', False, "schema_validation_failed"), ('{"scenario_id":"route","action":"confirm_destination"}', False, "validated_llm_label"),
    ('{"scenario_id":"route","action":"confirm_destination"}', True, "validated_llm_map_action"), ('{"scenario_id":"lost","action":"status"}', False, "llm_life_label_blocked"),
    ('{"scenario_id":"weather","action":"status"}', False, "validated_llm_map_action"), ('{"scenario_id":"food","action":"status"}', False, "validated_llm_label"),
    ('{"scenario_id":"injury","action":"none"}', False, "llm_life_label_blocked"), ('{"scenario_id":"food","action":"repeat_response"}', False, "validated_llm_assistant_action"), ("nope", False, "schema_validation_failed"),
])
def test_intent_guard(spark, body, pending, reason):
    v = guard.intent(F.lit(body), F.lit(pending), ["status", "confirm_destination", "save_basecamp"])
    assert one(spark, v=v).v.reason == reason


RULES = {
    "refuse_patterns": ["eat.*mushroom"], "confirmation": {"yes_patterns": ["^yes$"], "no_patterns": ["^no$", "^yes$x?"]},
    "assistant_rules": [{"action": "repeat_response", "scenario_id": "gear", "patterns": ["^again$"]}],
    "map_rules": [{"action": "night_on", "scenario_id": "gear", "patterns": ["night"], "exclude_patterns": ["goodnight"]}, {"action": "status", "scenario_id": "weather", "patterns": ["night|cold"]}],
    "scenario_rules": [{"scenario_id": "lost", "patterns": ["lost"]}, {"scenario_id": "food", "patterns": ["food"]}, {"scenario_id": "gear", "patterns": ["gear"]}],
}


@pytest.mark.parametrize("said, pending, want", [
    ("?!", False, ("unknown", None, "B", "empty")), ("May I EAT this mushroom at night", False, ("refuse", None, "B", "refuse_priority")),
    ("yes", True, ("route", "reject_destination", "B", "confirmation_no")), ("yes", False, ("unknown", None, "A", "no_rule_match")),
    ("again", False, ("gear", None, "B", "assistant_action")), ("night", False, ("gear", "night_on", "B", "map_enum_action")),
    ("goodnight", False, ("weather", "status", "B", "map_enum_action")), ("lost", False, ("lost", None, "B", "single_scenario")), ("food", False, ("food", None, "A", "single_scenario")),
    ("lost food", False, ("unknown", None, "B", "ambiguous_life_scenario")), ("food gear", False, ("unknown", None, "A", "ambiguous")),
])
def test_routing_order(spark, said, pending, want):
    df = spark.createDataFrame([(said, pending)], "t string, p boolean")
    d = rules.route(df, "t", "p", RULES).first().decision
    assert (d.scenario_id, d.map_action, d.path, d.reason) == want


def test_button_holds(spark):
    rows = [(1, 0.0, "pressed", 0), (1, 1.0, "released", 249), (1, 2.0, "released", 900), (1, 3.0, "pressed", 0), (1, 4.0, "pressed", 0), (1, 5.0, "released", 250),
            (1, 6.0, "pressed", 0), (1, 7.0, "released", 15000), (1, 8.0, "pressed", 0), (1, 9.0, "released", 15001)]
    df = spark.createDataFrame(rows, "device_id long, t double, state string, held_ms long").withColumn("button", F.lit("voice"))
    got = fleet.button_sessions(df, ["device_id"], "t", 2.0).orderBy("t").collect()
    assert [(r.held_ms, r.outcome) for r in got] == [(249, "discard"), (250, "finish"), (15000, "finish"), (15001, "discard")]
