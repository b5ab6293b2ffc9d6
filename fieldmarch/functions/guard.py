"""Checks of structured model output and of stored responses, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..columns import first_reason
from ..operators.rules import LIFE, SCENARIOS

# Actions a model may name, and the scenario each map action belongs to.
ACTION_SCENARIO = {
    "save_basecamp": "route", "save_checkpoint": "route", "route_basecamp": "route", "route_destination": "route",
    "route_last_checkpoint": "route", "route_recent_trace": "route", "clear_destination": "route",
    "find_nearest_water": "water", "confirm_destination": "route", "reject_destination": "route",
    "night_on": "gear", "night_off": "gear", "cancel": "route",
}
MODEL_ACTIONS = ["none", *ACTION_SCENARIO, "status", "repeat_response"]
STATUS_SCENARIOS = ["lost", "route", "daylight", "weather", "gear", "sleep_safety"]
PENDING_ONLY = ["confirm_destination", "reject_destination"]
SYNTHETIC_STATUSES = ["map_offline", "invalid_contract"]

VERDICT = "struct<scenario_id:string,map_action:string,assistant_action:string,path:string,source:string,reason:string,accepted:boolean>"


def _verdict(scenario, action, assistant, path, source, reason, accepted) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    names = ("scenario_id", "map_action", "assistant_action", "path", "source", "reason", "accepted")
    values = (scenario, action, assistant, path, source, reason, accepted)
    return F.struct(*[lit(v).alias(n) for n, v in zip(names, values)]).cast(VERDICT)


def _fixed(reason: str) -> Column:
    return _verdict("unknown", None, None, "B", "fixed", reason, False)


def _is_text(body: Column, key: str) -> Column:
    return F.schema_of_variant(F.variant_get(F.try_parse_json(body), f"$.{key}", "variant")) == "STRING"


def intent(body: Column, pending: Column, allowed: list[str], life_status: bool = False) -> Column:
    """Verdict on ``{"scenario_id": …, "action": …}``: exact keys, known values, no life label."""
    keys = F.json_object_keys(body)
    scenario, asked = F.get_json_object(body, "$.scenario_id"), F.get_json_object(body, "$.action")
    shape = (F.size(keys) == 2) & F.array_contains(keys, "scenario_id") & F.array_contains(keys, "action")
    good = shape & _is_text(body, "scenario_id") & _is_text(body, "action") & scenario.isin(SCENARIOS) & asked.isin(MODEL_ACTIONS)
    action = (
        F.when(asked.isin(PENDING_ONLY) & ~pending, "none").when((asked != "none") & ~asked.isin(allowed), "none").otherwise(asked)
    )
    action = F.when((action == "status") & ~scenario.isin(STATUS_SCENARIOS), "none").otherwise(action)
    home = reduce(lambda c, kv: c.when(action == kv[0], kv[1]), ACTION_SCENARIO.items(), F.when(F.lit(False), F.lit("")))
    return (
        F.when(~F.coalesce(good, F.lit(False)), _fixed("schema_validation_failed"))
        .when(asked == "repeat_response", _verdict("gear", None, "repeat_response", "B", "llm", "validated_llm_assistant_action", True))
        .when((action == "status") & scenario.isin(LIFE) & F.lit(not life_status), _fixed("llm_life_label_blocked"))
        .when(action == "status", _verdict(scenario, "status", None, "A", "llm", "validated_llm_map_action", True))
        .when(action != "none", _verdict(home, action, None, "A", "llm", "validated_llm_map_action", True))
        .when(scenario == "unknown", _fixed("llm_unknown"))
        .when(scenario.isin(LIFE), _fixed("llm_life_label_blocked"))
        .otherwise(_verdict(scenario, None, None, "A", "llm", "validated_llm_label", True))
    )


def polish(body: Column, source_text: Column, forbidden: list[str], max_chars: int = 40, low: int = 2, high: int = 4) -> Column:
    """``ok`` or the first fault of ``{"lines": […]}``: shape, count, type, length, new number, forbidden words.

    Faults are looked for line by line, so the first bad line gives the reason.
    """
    keys = F.json_object_keys(body)
    raw = F.try_variant_get(F.try_parse_json(body), "$.lines", "array<variant>")
    items = F.transform(raw, lambda v: F.struct(
        (F.schema_of_variant(v) == "STRING").alias("text"),
        F.trim(F.regexp_replace(F.try_variant_get(v, "$", "string"), r"(?U)\s+", " ")).alias("line")))

    def fault(x):
        line = x["line"]
        numbers = F.regexp_extract_all(line, F.lit(r"(?U)(\d+(?:[.:]\d+)?)"), F.lit(1))
        new = F.get(F.filter(numbers, lambda n: ~F.contains(source_text, n)), F.lit(0))
        banned = F.coalesce(*[F.when(line.rlike(f"(?i){p}"), F.lit(f"forbidden:{p}")) for p in forbidden], F.lit(None).cast("string"))
        return F.coalesce(
            F.when(~x["text"], "line_type"),
            F.when((line == "") | (F.length(line) > max_chars) | line.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "line_length"),
            F.when(new.isNotNull(), F.concat(F.lit("new_number:"), new)), banned)

    first = F.get(F.array_compact(F.transform(items, fault)), F.lit(0))
    return F.coalesce(first_reason(
        (~F.coalesce((F.size(keys) == 1) & F.array_contains(keys, "lines"), F.lit(False)), "schema_validation_failed"),
        (raw.isNull() | ~F.size(raw).between(low, high), "line_count"),
    ), first, F.lit("ok"))


def polishable(map_action, assistant_action, path, source, scenario, source_id) -> Column:
    return (
        map_action.isNull() & assistant_action.isNull() & (path == "A") & source.isin("rule", "llm")
        & ~scenario.isin(LIFE) & source_id.startswith("SAFE-")
    )


def response_error(body: Column) -> Column:
    """Why a chat response is unusable, NULL when its content is a JSON object."""
    root = F.try_parse_json(body)
    content = F.try_variant_get(root, "$.choices[0].message.content", "variant")
    text = F.try_variant_get(content, "$", "string")
    inner = F.try_parse_json(text)
    return first_reason(
        (root.isNull(), "not_json"), (content.isNull(), "malformed_response"),
        (F.schema_of_variant(content) != "STRING", "content_not_string"),
        (inner.isNull(), "content_not_json"), (~F.schema_of_variant(inner).startswith("OBJECT"), "content_not_object"),
    )


def contract(action: Column, status: Column, echoed: Column) -> Column:
    """Status of a map response as the caller may trust it.

    No response is ``map_offline``; a response that does not echo the action or has a status the
    action cannot have is ``invalid_contract``.
    """
    water = action == "find_nearest_water"
    fits = F.when(water, status.isin("confirmation_required", "rejected")).otherwise(status.isin("accepted", "rejected"))
    known = action.isin([*ACTION_SCENARIO, "status"])
    return F.when(status.isNull(), "map_offline").when(F.coalesce(known & (echoed == action) & fits, F.lit(False)), status).otherwise("invalid_contract")


def expected_source(scenario: Column, action: Column, status: Column, card_source: Column) -> Column:
    """Source id that a stored response must carry; NULL when the combination cannot occur."""
    water = action == "find_nearest_water"
    fits = F.when(water, status.isin("confirmation_required", "rejected")).otherwise(status.isin("accepted", "rejected"))
    allowed = action.isin([*ACTION_SCENARIO, "status"]) & (fits | status.isin(SYNTHETIC_STATUSES))
    return (
        F.when(~scenario.isin(SCENARIOS), None)
        .when(action.isNull(), F.when(status.isNull(), card_source))
        .when(~F.coalesce(allowed, F.lit(False)), None)
        .when(status == "map_offline", "SAFE-SYSTEM-MAP-OFFLINE").when(status == "invalid_contract", "SAFE-SYSTEM-MAP-CONTRACT")
        .when((action == "status") & (status == "accepted"), card_source)
        .otherwise(F.concat(F.lit("SAFE-MAP-"), F.upper(action)))
    )


def prompt_row(prefix: list[dict], text: Column, pending: Column, clip: int = 240, waiting: str = "wait", yes: str = "yes", no: str = "no") -> Column:
    """Chat messages as JSON: the fixed prefix, then the user turn clipped to ``clip`` characters."""
    turn = F.concat(F.substring(text, 1, clip), F.lit(f"\n{waiting}: "), F.when(pending, yes).otherwise(no))
    fixed = [F.struct(F.lit(m["role"]).alias("role"), F.lit(m["content"]).alias("content")) for m in prefix]
    return F.to_json(F.array(*fixed, F.struct(F.lit("user").alias("role"), turn.alias("content"))))
