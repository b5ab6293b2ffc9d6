"""Audits of model output, map contract and provenance of stored responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import vocabulary as V
from ..columns import settle
from ..functions import guard
from ..operators import rules as R
from . import tables as T
from .registry import query
from .router import CARD_SQL, cards, q

ACTIONS = ["none", "status", "save_basecamp", "confirm_destination", "repeat_response", "night_on", "find_nearest_water", "fly"]
LABELS = ["weather", "lost", "unknown", "route", "banana", "gear", "sleep_safety"]
ALLOWED = ["status", "save_basecamp", "confirm_destination", "find_nearest_water"]


def _arr(items) -> str:
    return "[" + ",".join("NULL" if i is None else q(i) for i in items) + "]"


def at(items, n: int, by: str = "event_id"):
    return F.get(F.array(*[F.lit(i) for i in items]), (F.col(by) % n).cast("int"))


T.define("intents", [], f"""SELECT event_id, ({_arr(LABELS)})[event_id%7+1] AS s, ({_arr(ACTIONS)})[event_id%8+1] AS a0, event_id%11 AS form, event_id%2=0 AS pending FROM events""")


@query("intent_guard", T.ctes("intents") + f""" SELECT event_id, CASE WHEN NOT ok THEN 'unknown' WHEN a0='repeat_response' THEN 'gear' WHEN a='status' AND s='lost' THEN 'unknown' WHEN a='status' AND s='sleep_safety' THEN 'unknown' WHEN a='status' THEN s
      WHEN a='find_nearest_water' THEN 'water' WHEN a<>'none' THEN 'route' WHEN s IN ('unknown','lost','sleep_safety') THEN 'unknown' ELSE s END AS scenario_id,
    CASE WHEN NOT ok OR a0='repeat_response' OR a='none' OR (a='status' AND s IN ('lost','sleep_safety')) THEN NULL ELSE a END AS map_action,
    CASE WHEN NOT ok THEN 'schema_validation_failed' WHEN a0='repeat_response' THEN 'validated_llm_assistant_action' WHEN a='status' AND s IN ('lost','sleep_safety') THEN 'llm_life_label_blocked'
      WHEN a<>'none' THEN 'validated_llm_map_action' WHEN s='unknown' THEN 'llm_unknown' WHEN s IN ('lost','sleep_safety') THEN 'llm_life_label_blocked' ELSE 'validated_llm_label' END AS reason FROM (
    SELECT *, form>3 AND s<>'banana' AND a0<>'fly' AS ok, CASE WHEN (a0='confirm_destination' AND NOT pending) OR a0 NOT IN {tuple(ALLOWED)} OR (a0='status' AND s='unknown') THEN 'none' ELSE a0 END AS a FROM intents)""")
def intent_guard(spark, d):
    c = F.col
    body = (
        F.when(c("event_id") % 11 == 0, F.lit("not json {"))
        .when(c("event_id") % 11 == 1, F.format_string('{"scenario_id":"%s","action":"%s","extra":1}', c("s"), c("a")))
        .when(c("event_id") % 11 == 2, F.format_string('{"scenario_id":"%s"}', c("s")))
        .when(c("event_id") % 11 == 3, F.format_string('{"scenario_id":"%s","action":7}', c("s")))
        .otherwise(F.format_string('{"action":"%s","scenario_id":"%s"}', c("a"), c("s"))))
    e = T.read(spark, d, "events").select("event_id", at(LABELS, 7).alias("s"), at(ACTIONS, 8).alias("a"))
    e = settle(e, body=body)
    e = settle(e, v=guard.intent(c("body"), c("event_id") % 2 == 0, ALLOWED))
    return e.select("event_id", "v.scenario_id", "v.map_action", "v.reason")


@query("polish_guard", """SELECT event_id, CASE event_id%8 WHEN 0 THEN 'schema_validation_failed' WHEN 1 THEN 'line_count' WHEN 2 THEN 'line_type' WHEN 3 THEN 'line_length' WHEN 4 THEN 'new_number:'||(event_id+1)
    WHEN 5 THEN 'forbidden:http' WHEN 6 THEN 'line_length' ELSE 'ok' END AS reason FROM events""")
def polish_guard(spark, d):
    c = F.col
    n = c("event_id")
    body = (
        F.when(n % 8 == 0, F.lit('{"lines":["a","b"],"x":1}')).when(n % 8 == 1, F.lit('{"lines":["only one"]}'))
        .when(n % 8 == 2, F.lit('{"lines":["first",2]}')).when(n % 8 == 3, F.lit('{"lines":["  ","b"]}'))
        .when(n % 8 == 4, F.format_string('{"lines":["number %d here","and %d"]}', n, n + 1))
        .when(n % 8 == 5, F.lit('{"lines":["see HTTP page","b"]}'))
        .when(n % 8 == 6, F.lit('{"lines":["short","this line is far longer than the forty characters allowed"]}'))
        .otherwise(F.format_string('{"lines":["go %d m","then  rest"]}', n)))
    e = settle(T.read(spark, d, "events").select("event_id"), body=body)
    source = F.concat(F.lit("walk "), n.cast("string"), F.lit(" metres"))
    return e.select("event_id", guard.polish(c("body"), source, V.POLISH_FORBIDDEN).alias("reason"))


@query("polish_eligible", T.ctes("decided") + f""" SELECT id, map_action IS NULL AND assistant_action IS NULL AND path='A' AND source IN ('rule','llm')
    AND scenario_id NOT IN {tuple(R.LIFE)} AS eligible FROM decided""")
def polish_eligible(spark, d):
    from .router import RULES, utterances

    u = R.route(utterances(spark, d), "text", "pending", RULES)
    u = R.cards_for(u.select("id", "decision", F.col("decision.scenario_id").alias("scenario")), cards(spark), "scenario")
    p = lambda n: F.col(f"decision.{n}")
    return u.select("id", guard.polishable(
        p("map_action"), p("assistant_action"), p("path"), p("source"), p("scenario_id"), F.col("source_id")).alias("eligible"))


@query("response_triage", """SELECT event_id, (['not_json','malformed_response','content_not_string','content_not_json','content_not_object',NULL,'malformed_response'])[event_id%7+1] AS error FROM events""")
def response_triage(spark, d):
    n = F.col("event_id")
    wrap = lambda content: F.concat(F.lit('{"choices":[{"message":{"content":'), content, F.lit("}}]}"))
    body = (
        F.when(n % 7 == 0, F.lit("<html>")).when(n % 7 == 1, F.lit('{"choices":[]}')).when(n % 7 == 2, wrap(n.cast("string")))
        .when(n % 7 == 3, wrap(F.lit('"plain words"'))).when(n % 7 == 4, wrap(F.lit('"[1,2]"')))
        .when(n % 7 == 5, wrap(F.lit('"{\\"a\\":1}"'))).otherwise(F.lit('{"error":"busy"}')))
    e = settle(T.read(spark, d, "events").select("event_id"), body=body)
    return e.select("event_id", guard.response_error(F.col("body")).alias("error"))


PREFIX = [{"role": "system", "content": "Pick a label."}, {"role": "user", "content": "where am I\nwait: no"}, {"role": "assistant", "content": '{"a":1}'}]


@query("prompt_rows", r"""SELECT conv_id, turn, md5('where am I|'||substr(text,1,240)||chr(10)||'wait: '||CASE WHEN turn%2=0 THEN 'yes' ELSE 'no' END) AS digest, 4 AS n_messages FROM conversations""")
def prompt_rows(spark, d):
    t = T.read(spark, d, "conversations")
    row = guard.prompt_row(PREFIX, F.col("text"), F.col("turn") % 2 == 0)
    t = settle(t, row=row)
    msgs = F.from_json("row", "array<struct<role:string,content:string>>")
    t = settle(t, msgs=msgs)
    head = F.split_part(F.get("msgs", F.lit(1))["content"], F.lit("\n"), F.lit(1))
    return t.select("conv_id", "turn", F.md5(F.concat(head, F.lit("|"), F.element_at("msgs", -1)["content"])).alias("digest"), F.size("msgs").alias("n_messages"))


STATUSES = ["accepted", "rejected", "confirmation_required", "weird", None]
T.define("calls", [], f"""SELECT event_id, ({_arr(['status', 'save_basecamp', 'find_nearest_water', 'fly'])})[event_id%4+1] AS action, ({_arr(STATUSES)})[event_id%5+1] AS st, event_id%7<>0 AS echo FROM events""")


@query("contract_check", T.ctes("calls") + """ SELECT event_id, CASE WHEN st IS NULL THEN 'map_offline' WHEN NOT echo OR action='fly' THEN 'invalid_contract'
    WHEN action='find_nearest_water' THEN CASE WHEN st IN ('confirmation_required','rejected') THEN st ELSE 'invalid_contract' END WHEN st IN ('accepted','rejected') THEN st ELSE 'invalid_contract' END AS status FROM calls""")
def contract_check(spark, d):
    e = T.read(spark, d, "events").select("event_id", at(["status", "save_basecamp", "find_nearest_water", "fly"], 4).alias("action"), at(STATUSES, 5).alias("st"))
    echoed = F.when(F.col("event_id") % 7 != 0, F.col("action")).otherwise("other")
    return e.select("event_id", guard.contract(F.col("action"), F.col("st"), echoed).alias("status"))


STORED = ["accepted", "rejected", "map_offline", "invalid_contract", None]
T.define("stored", [], f"""SELECT *, CASE WHEN action IS NULL THEN CASE WHEN st IS NULL THEN card END WHEN st IS NULL OR action='fly' THEN NULL WHEN st='map_offline' THEN 'SAFE-SYSTEM-MAP-OFFLINE'
    WHEN st='invalid_contract' THEN 'SAFE-SYSTEM-MAP-CONTRACT' WHEN action='status' AND st='accepted' THEN card WHEN action='find_nearest_water' AND st='accepted' THEN NULL ELSE 'SAFE-MAP-'||upper(action) END AS want
  FROM (SELECT event_id, scenario_id, action, st, {CARD_SQL} AS card FROM (SELECT event_id, ({_arr(R.SCENARIOS)})[event_id%14+1] AS scenario_id,
    ({_arr([None, 'status', 'save_basecamp', 'find_nearest_water', 'fly', None])})[event_id%6+1] AS action, ({_arr(STORED)})[event_id%5+1] AS st FROM events))""")


@query("provenance", T.ctes("stored") + """ SELECT event_id, want AS expected_source, coalesce(event_id%9<>0 AND event_id%10<>0 AND want IS NOT NULL, false) AS verified FROM stored""")
def provenance(spark, d):
    c = F.col
    e = T.read(spark, d, "events").select(
        "event_id", at(R.SCENARIOS, 14).alias("scenario"), at([None, "status", "save_basecamp", "find_nearest_water", "fly", None], 6).alias("action"), at(STORED, 5).alias("st"))
    e = R.cards_for(e, cards(spark), "scenario")
    want = guard.expected_source(c("scenario"), c("action"), c("st"), c("source_id"))
    e = settle(e, want=want)
    body = F.to_json(F.struct(
        c("scenario").alias("scenario_id"), F.coalesce("action", F.lit("")).alias("map_action"), F.coalesce("st", F.lit("")).alias("map_status"),
        F.when(c("event_id") % 9 == 0, "SAFE-OTHER").otherwise(c("want")).alias("source_id"), F.when(c("event_id") % 10 == 0, 1).alias("note")))
    e = settle(e, body=body)
    keys = F.array_sort(F.json_object_keys("body"))
    exact = keys == F.array(*[F.lit(k) for k in ("map_action", "map_status", "scenario_id", "source_id")])
    ok = exact & (F.get_json_object("body", "$.source_id") == c("want"))
    return e.select("event_id", c("want").alias("expected_source"), F.coalesce(ok, F.lit(False)).alias("verified"))
