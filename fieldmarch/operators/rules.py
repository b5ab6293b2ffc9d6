"""Utterance routing by ordered rules, and replies from checked cards.

A rule set is data: ``refuse_patterns``, ``confirmation`` (``yes_patterns``, ``no_patterns``),
``assistant_rules``, ``map_rules`` and ``scenario_rules``, each rule with ``scenario_id``,
``patterns``, ``exclude_patterns`` and, where it acts, ``action``. It is compiled into one regex
per list, so routing is a stateless projection without shuffle, and texts are scanned on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import settle
from ..functions.text import any_of, apply_lexicon, normalize_utterance

# Scenario labels, and those whose handling is never left to a model.
SCENARIOS = [
    "lost", "route", "daylight", "weather", "shelter", "warmth", "water", "food", "sleep_safety", "injury", "wildlife",
    "gear", "refuse", "unknown",
]
LIFE = ["lost", "daylight", "warmth", "sleep_safety", "injury", "refuse"]

DECISION = "struct<scenario_id:string,map_action:string,path:string,source:string,reason:string,matched:array<string>,assistant_action:string>"


def _decision(scenario, action, path, source, reason, matched=None, assistant=None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    matched = F.array() if matched is None else matched
    return F.struct(
        lit(scenario).alias("scenario_id"), lit(action).alias("map_action"), lit(path).alias("path"), lit(source).alias("source"),
        lit(reason).alias("reason"), matched.alias("matched"), lit(assistant).alias("assistant_action"),
    ).cast(DECISION)


def _hit(rule: dict, text: Column) -> Column:
    hit = any_of(rule["patterns"], text)
    vetoes = rule.get("exclude_patterns") or []
    return hit & ~any_of(vetoes, text) if vetoes else hit


def _first(rules: list[dict], text: Column) -> Column:
    """Position of the first rule that matches; later patterns are not tried."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(_hit(rules[0], text), 0)
    for i, rule in enumerate(rules[1:], 1):
        out = out.when(_hit(rule, text), i)
    return out


def route(df: DataFrame, text: str, pending: str, rules: dict, name: str = "decision") -> DataFrame:
    """Add the decision for every utterance.

    Refusals come first, then a pending confirmation (no before yes), assistant rules and map
    rules (first match in order); otherwise exactly one scenario decides, several with a life
    scenario are fixed to unknown, and the rest is left to a model. One settled column per layer.
    """
    df = settle(df, _norm=normalize_utterance(F.col(text)))
    norm, wait = F.col("_norm"), F.coalesce(F.col(pending), F.lit(False))
    confirm = rules.get("confirmation") or {}
    asst, maps, scen = rules.get("assistant_rules") or [], rules.get("map_rules") or [], rules.get("scenario_rules") or []
    df = settle(
        df, _refuse=any_of(rules.get("refuse_patterns") or [], norm),
        _no=wait & any_of(confirm.get("no_patterns") or [], norm),
        _yes=wait & any_of(confirm.get("yes_patterns") or [], norm),
    )
    stop = (norm == "") | F.col("_refuse") | F.col("_no") | F.col("_yes")
    df = settle(df, _asst=F.when(~stop, _first(asst, norm)))
    df = settle(df, _map=F.when(~stop & F.col("_asst").isNull(), _first(maps, norm)))
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(_hit(r, norm), F.lit(r["scenario_id"])) for r in scen])))
    none = F.array().cast("array<string>")
    df = settle(df, _scen=F.when(~stop & F.col("_asst").isNull() & F.col("_map").isNull(), hits).otherwise(none))
    pick = lambda rows, key, at: F.get(F.array(*[F.lit(r[key]) for r in rows]), F.col(at)) if rows else F.lit(None).cast("string")
    a_scen, m_scen = pick(asst, "scenario_id", "_asst"), pick(maps, "scenario_id", "_map")
    scenes, only = F.col("_scen"), F.get("_scen", F.lit(0))
    life = F.exists(scenes, lambda s: s.isin(LIFE))
    out = (
        F.when(norm == "", _decision("unknown", None, "B", "fixed", "empty"))
        .when(F.col("_refuse"), _decision("refuse", None, "B", "rule", "refuse_priority", F.array(F.lit("refuse"))))
        .when(F.col("_no"), _decision("route", "reject_destination", "B", "rule", "confirmation_no", F.array(F.lit("route"))))
        .when(F.col("_yes"), _decision("route", "confirm_destination", "B", "rule", "confirmation_yes", F.array(F.lit("route"))))
        .when(F.col("_asst").isNotNull(), _decision(a_scen, None, "B", "rule", "assistant_action", F.array(a_scen), pick(asst, "action", "_asst")))
        .when(F.col("_map").isNotNull(), _decision(m_scen, pick(maps, "action", "_map"), "B", "rule", "map_enum_action", F.array(m_scen)))
        .when(F.size(scenes) == 1, _decision(only, None, F.when(only.isin(LIFE), "B").otherwise("A"), "rule", "single_scenario", scenes))
        .when(life, _decision("unknown", None, "B", "fixed", "ambiguous_life_scenario", scenes))
        .otherwise(_decision("unknown", None, "A", "llm_required", F.when(F.size(scenes) > 0, "ambiguous").otherwise("no_rule_match"), scenes))
    )
    return settle(df, **{name: out}).drop("_norm", "_refuse", "_no", "_yes", "_asst", "_map", "_scen")


def resolve(df: DataFrame, label: str, decision: str = "decision", name: str = "resolved") -> DataFrame:
    """Settle decisions that were left to a model with the model's label; life labels are never taken.

    ``label`` NULL means there was no model to ask.
    """
    given = F.trim(F.col(label))
    d = F.col(decision)
    out = (
        F.when(d["source"] != "llm_required", d)
        .when(F.col(label).isNull(), _decision("unknown", None, "B", "fixed", "classifier_unavailable", d["matched"]))
        .when(~given.isin(SCENARIOS), _decision("unknown", None, "B", "fixed", "invalid_llm_label"))
        .when(given == "unknown", _decision("unknown", None, "B", "fixed", "llm_unknown"))
        .when(given.isin(LIFE), _decision("unknown", None, "B", "fixed", "llm_life_label_blocked"))
        .otherwise(_decision(given, None, "A", "llm", "validated_llm_label", F.array(given)))
    )
    return settle(df, **{name: out})


def cascade(df: DataFrame, text: str, pending: str, base: dict, overlay: dict, lexicon: list[tuple[str, str]]) -> DataFrame:
    """Lexicon, base rules, then the overlay's rules for what the base leaves to a model; adds ``stage``."""
    df = settle(df, _fixed=apply_lexicon(F.col(text), lexicon))
    df = route(df, "_fixed", pending, base, "_base")
    df = route(df, "_fixed", pending, overlay, "_over")
    use = (F.col("_base.source") == "llm_required") & (F.col("_over.source") == "rule")
    over = F.col("_over").withField("reason", F.concat(F.lit("demo_overlay:"), F.col("_over.reason")))
    stage = F.when(use, "overlay").when(F.col("_base.source") == "llm_required", "llm_required").otherwise("rule")
    return settle(df, decision=F.when(use, over).otherwise(F.col("_base")), stage=stage).drop("_fixed", "_base", "_over")


#: Rules that travel together; each text meets each block of them once.
RULE_BLOCK = 500


def match_table(utterances: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """Every (utterance, rule) pair that matches, for rules kept as rows ``rule_id, patterns, excludes``.

    Rules are a stated set, held against all texts in blocks of 500: an equality join on the block's number. The plan has the same
    size for any number of rules, and what a text is joined with is bounded by the block. The rules go to the texts: dealt by their few
    block numbers, all texts would be read by as few tasks.
    """
    blocks = max(1, -(-rules.count() // RULE_BLOCK))
    place = F.floor((F.row_number().over(Window.orderBy("rule_id")) - 1) / RULE_BLOCK).cast("int")
    packed = rules.withColumn("_block", place).groupBy("_block").agg(F.collect_list(F.struct("rule_id", "patterns", "excludes")).alias("_rules"))
    dealt = utterances.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(F.broadcast(packed), "_block")
    found = lambda patterns: F.exists(patterns, lambda p: F.coalesce(F.regexp_like(F.col(text), p), F.lit(False)))
    none = F.array().cast("array<string>")
    hits = F.filter("_rules", lambda r: found(F.coalesce(r["patterns"], none)) & ~found(F.coalesce(r["excludes"], none)))
    return dealt.withColumn("rule_id", F.explode(F.transform(hits, lambda r: r["rule_id"]))).drop("_block", "_rules")


def cards_for(df: DataFrame, cards: DataFrame, scenario: str) -> DataFrame:
    """Join each row's card; an unknown scenario gets the ``unknown`` card."""
    known = F.when(F.col(scenario).isin(SCENARIOS), F.col(scenario)).otherwise("unknown")
    return df.withColumn("_card", known).join(cards.withColumnRenamed("scenario_id", "_card"), "_card").withColumnRenamed("_card", "card_id")
