"""Utterance routing, replies, and audits of stored responses, over all conversation turns and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import vocabulary as V
from ..columns import settle
from ..functions import guard, text as X
from ..operators import replies, rules as R
from . import tables as T
from .registry import query

# A rule set over the invented words of the given texts, in the same shape as a product rule set.
RULES = {
    "refuse_patterns": ["^(on|ver)", "^[^ ]*heit"],
    "confirmation": {"yes_patterns": ["^[^ ]{4,6} ", "^[^ ]*ing "], "no_patterns": ["^[^ ]*e ", "ch$"]},
    "assistant_rules": [{"action": "repeat_response", "scenario_id": "gear", "patterns": ["^th[^ ]* (the|an)"]}],
    "map_rules": [
        {"action": "save_basecamp", "scenario_id": "route", "patterns": ["^(un|der) ", "^[^ ]*st "], "exclude_patterns": [" das ", "nd$"]},
        {"action": "status", "scenario_id": "weather", "patterns": ["^[^ ]{2,4} [^ ]{2,3} "]},
        {"action": "night_on", "scenario_id": "gear", "patterns": ["(ed|en)$"], "exclude_patterns": ["^e"]},
    ],
    "scenario_rules": [
        {"scenario_id": "lost", "patterns": ["^[^ ]*ou"], "exclude_patterns": ["ou$"]},
        {"scenario_id": "shelter", "patterns": ["^[^ ]*er"]},
        {"scenario_id": "water", "patterns": ["^[^ ]*an"]},
        {"scenario_id": "food", "patterns": ["^[^ ]*(re|le)"]},
        {"scenario_id": "water", "patterns": ["^[^ ]*in"]},
        {"scenario_id": "wildlife", "patterns": ["^[^ ]*on"]},
    ],
}
OVERLAY = {
    "map_rules": [{"action": "route_basecamp", "scenario_id": "route", "patterns": ["^[^ ]*ti"]}],
    "scenario_rules": [{"scenario_id": "food", "patterns": ["t$"]}, {"scenario_id": "injury", "patterns": ["^é|^d"]}],
}
LEX = [("thorn?", "route"), (r"[ \t]+-[ \t]+", " "), ("ung ", "en ")]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_sql(patterns: list[str], col: str) -> str:
    return f"regexp_matches({col}, {q('|'.join(f'(?:{p})' for p in patterns))})" if patterns else "false"


def hit_sql(rule: dict, col: str) -> str:
    veto = rule.get("exclude_patterns") or []
    return f"({any_sql(rule['patterns'], col)}" + (f" AND NOT {any_sql(veto, col)})" if veto else ")")


def route_sql(rules: dict, source: str) -> str:
    """Decision columns of rows (id, norm, pending) as plain CASE expressions."""
    conf = rules.get("confirmation") or {}
    asst, maps, scen = (rules.get(k) or [] for k in ("assistant_rules", "map_rules", "scenario_rules"))
    first = lambda rows: "CASE " + " ".join(f"WHEN {hit_sql(r, 'norm')} THEN {i}" for i, r in enumerate(rows)) + " END" if rows else "NULL::INT"
    names = lambda rows, key, at: f"([{','.join(q(r[key]) for r in rows)}])[{at}+1]" if rows else "NULL"
    labels = list(dict.fromkeys(r["scenario_id"] for r in scen))
    found = "list_filter([" + ",".join(
        "CASE WHEN " + " OR ".join(hit_sql(r, "norm") for r in scen if r["scenario_id"] == s) + f" THEN {q(s)} END" for s in labels) + "], lambda x: x IS NOT NULL)"
    life = "[" + ",".join(q(s) for s in R.LIFE) + "]"
    return f"""SELECT id, norm, pending, CASE k WHEN 'refuse' THEN 'refuse' WHEN 'no' THEN 'route' WHEN 'yes' THEN 'route' WHEN 'asst' THEN {names(asst, 'scenario_id', 'a')}
        WHEN 'map' THEN {names(maps, 'scenario_id', 'm')} WHEN 'one' THEN s[1] ELSE 'unknown' END AS scenario_id,
      CASE k WHEN 'no' THEN 'reject_destination' WHEN 'yes' THEN 'confirm_destination' WHEN 'map' THEN {names(maps, 'action', 'm')} END AS map_action,
      CASE WHEN k='none' OR k='many' OR (k='one' AND NOT list_contains({life}, s[1])) THEN 'A' ELSE 'B' END AS path,
      CASE WHEN k IN ('empty','life') THEN 'fixed' WHEN k IN ('none','many') THEN 'llm_required' ELSE 'rule' END AS source,
      CASE k WHEN 'empty' THEN 'empty' WHEN 'refuse' THEN 'refuse_priority' WHEN 'no' THEN 'confirmation_no' WHEN 'yes' THEN 'confirmation_yes' WHEN 'asst' THEN 'assistant_action'
        WHEN 'map' THEN 'map_enum_action' WHEN 'one' THEN 'single_scenario' WHEN 'life' THEN 'ambiguous_life_scenario' WHEN 'many' THEN 'ambiguous' ELSE 'no_rule_match' END AS reason,
      CASE WHEN k IN ('one','life','many') THEN array_to_string(s, ',') WHEN k='refuse' THEN 'refuse' WHEN k IN ('no','yes') THEN 'route'
        WHEN k='asst' THEN {names(asst, 'scenario_id', 'a')} WHEN k='map' THEN {names(maps, 'scenario_id', 'm')} ELSE '' END AS matched,
      CASE WHEN k='asst' THEN {names(asst, 'action', 'a')} END AS assistant_action
    FROM (SELECT *, CASE WHEN norm='' THEN 'empty' WHEN {any_sql(rules.get('refuse_patterns') or [], 'norm')} THEN 'refuse'
        WHEN pending AND {any_sql(conf.get('no_patterns') or [], 'norm')} THEN 'no' WHEN pending AND {any_sql(conf.get('yes_patterns') or [], 'norm')} THEN 'yes'
        WHEN a IS NOT NULL THEN 'asst' WHEN m IS NOT NULL THEN 'map' WHEN len(s)=1 THEN 'one' WHEN list_has_any(s, {life}) THEN 'life' WHEN len(s)>1 THEN 'many' ELSE 'none' END AS k
      FROM (SELECT *, {first(asst)} AS a, {first(maps)} AS m, {found} AS s FROM {source}))"""


NORM_SQL = r"trim(regexp_replace(regexp_replace(lower(nfc_normalize({0})), '[?!.,;:~…·]+', ' ', 'g'), '\s+', ' ', 'g'))"
T.define("utt", [], """SELECT 'c-'||conv_id||'-'||turn AS id, text, (conv_id+turn)%3=0 AS pending, conv_id*100+turn AS n FROM conversations
    UNION ALL SELECT 'd-'||doc_id, text, doc_id%3=0, doc_id FROM documents""")
T.define("norm", ["utt"], f"SELECT *, {NORM_SQL.format('text')} AS norm FROM utt")
T.define("decided", ["norm"], route_sql(RULES, "norm"))


def utterances(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    turns = T.read(spark, d, "conversations").select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), "text", ((c("conv_id") + c("turn")) % 3 == 0).alias("pending"),
        (c("conv_id") * 100 + c("turn")).alias("n"))
    docs = T.read(spark, d, "documents").select(
        F.concat_ws("-", F.lit("d"), "doc_id").alias("id"), "text", (c("doc_id") % 3 == 0).alias("pending"), c("doc_id").alias("n"))
    return turns.unionByName(docs)


def flat(df: DataFrame, name: str) -> DataFrame:
    parts = ("scenario_id", "map_action", "path", "source", "reason", "assistant_action")
    return df.select("id", *[F.col(f"{name}.{p}").alias(p) for p in parts], F.array_join(F.array_sort(f"{name}.matched"), ",").alias("matched"))


SORT_MATCHED = "array_to_string(list_sort(string_split(matched, ',')), ',') AS matched"


@query("normalize_text", T.ctes("norm") + " SELECT id, norm FROM norm")
def normalize_text(spark, d):
    return utterances(spark, d).select("id", X.normalize_utterance(F.col("text")).alias("norm"))


@query("route_utterance", T.ctes("decided") + f" SELECT id, scenario_id, map_action, path, source, reason, assistant_action, {SORT_MATCHED} FROM decided")
def route_utterance(spark, d):
    return flat(R.route(utterances(spark, d), "text", "pending", RULES), "decision")


LABELS = ["weather", "lost", "unknown", "banana", None]
T.define("labelled", ["decided", "utt"], "SELECT d.*, (['weather','lost','unknown','banana',NULL])[u.n%5+1] AS label FROM decided d JOIN utt u USING (id)")


@query("resolve_label", T.ctes("labelled") + """ SELECT id, label, CASE WHEN source<>'llm_required' THEN scenario_id WHEN label='weather' THEN 'weather' ELSE 'unknown' END AS scenario_id,
    CASE WHEN source<>'llm_required' THEN source WHEN label='weather' THEN 'llm' ELSE 'fixed' END AS source,
    CASE WHEN source<>'llm_required' THEN reason WHEN label IS NULL THEN 'classifier_unavailable' WHEN label='banana' THEN 'invalid_llm_label' WHEN label='unknown' THEN 'llm_unknown'
      WHEN label='lost' THEN 'llm_life_label_blocked' ELSE 'validated_llm_label' END AS reason FROM labelled""")
def resolve_label(spark, d):
    label = F.get(F.array(*[F.lit(x) for x in LABELS]), (F.col("n") % 5).cast("int"))
    u = R.route(utterances(spark, d).withColumn("label", label), "text", "pending", RULES)
    out = R.resolve(u, "label")
    return out.select("id", "label", *[F.col(f"resolved.{p}").alias(p) for p in ("scenario_id", "source", "reason")])


LEX_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'thorn?', 'route', 'g'), '[ \t]+-[ \t]+', ' ', 'g'), 'ung ', 'en ', 'g'), '\s+', ' ', 'g'))"
T.define("fixed_text", ["utt"], f"SELECT id, pending, {NORM_SQL.format('(' + LEX_SQL + ')')} AS norm FROM utt")
T.define("base_d", ["fixed_text"], route_sql(RULES, "fixed_text"))
T.define("over_d", ["fixed_text"], route_sql(OVERLAY, "fixed_text"))


@query("lexicon_fix", T.ctes("utt") + f" SELECT id, {LEX_SQL} AS fixed FROM utt")
def lexicon_fix(spark, d):
    return utterances(spark, d).select("id", X.apply_lexicon(F.col("text"), LEX).alias("fixed"))


@query("overlay_cascade", T.ctes("base_d", "over_d") + """ SELECT id, CASE WHEN use THEN o_s ELSE scenario_id END AS scenario_id, CASE WHEN use THEN o_a ELSE map_action END AS map_action,
    CASE WHEN use THEN 'demo_overlay:'||o_r ELSE reason END AS reason, CASE WHEN use THEN 'overlay' WHEN source='llm_required' THEN 'llm_required' ELSE 'rule' END AS stage FROM (
    SELECT b.*, b.source='llm_required' AND o.source='rule' AS use, o.scenario_id AS o_s, o.map_action AS o_a, o.reason AS o_r FROM base_d b JOIN over_d o USING (id))""")
def overlay_cascade(spark, d):
    out = R.cascade(utterances(spark, d), "text", "pending", RULES, OVERLAY, LEX)
    return out.select("id", *[F.col(f"decision.{p}").alias(p) for p in ("scenario_id", "map_action", "reason")], "stage")


@query("yes_no", T.ctes("norm") + f""" SELECT id, CASE WHEN norm='' THEN NULL WHEN {any_sql(RULES['confirmation']['no_patterns'], 'norm')} THEN false
    WHEN {any_sql(RULES['confirmation']['yes_patterns'], 'norm')} THEN true END AS answer FROM norm""")
def yes_no(spark, d):
    u = settle(utterances(spark, d), norm=X.normalize_utterance(F.col("text")))
    conf = RULES["confirmation"]
    return u.select("id", X.yes_no(F.col("norm"), conf["yes_patterns"], conf["no_patterns"]).alias("answer"))


TABLE_RULES = [(i, r["patterns"], r.get("exclude_patterns") or []) for i, r in enumerate(RULES["map_rules"] + RULES["scenario_rules"])]


@query("rule_match", T.ctes("norm") + " SELECT rule_id, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS rule_id FROM norm WHERE {hit_sql({'patterns': p, 'exclude_patterns': e}, 'norm')}" for i, p, e in TABLE_RULES) + ") GROUP BY rule_id")
def rule_match(spark, d):
    table = spark.createDataFrame(TABLE_RULES, "rule_id int, patterns array<string>, excludes array<string>")
    u = settle(utterances(spark, d), norm=X.normalize_utterance(F.col("text"))).drop("text")
    return R.match_table(u, table, "norm").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


PIECES_SQL = r"list_filter(list_transform(string_split(regexp_replace(trim(text, ' '||chr(9)||chr(10)||chr(13)), '([.?!,])\s+', '\1'||chr(31), 'g'), chr(31)), lambda p: trim(p)), lambda p: p<>'')"


@query("collapse_repeats", T.ctes("utt") + f""" SELECT id, md5(CASE WHEN k IS NULL THEN t ELSE array_to_string(w[1:k], ' ') END) AS digest, length(CASE WHEN k IS NULL THEN t ELSE array_to_string(w[1:k], ' ') END) AS n_chars FROM (
    SELECT id, t, w, list_extract(list_filter(range(1, greatest(2, len(w)//3+1)), lambda z: len(w)%z=0 AND len(w)/z>=3 AND repeat(array_to_string(w[1:z],' ')||' ', CAST(len(w)//z AS BIGINT))=t||' '), 1) AS k FROM (
    SELECT id, t, string_split(t, ' ') AS w FROM (SELECT id, array_to_string(list_filter(p, lambda x, i: i=1 OR nrm[i]<>nrm[i-1]), ' ') AS t FROM (
      SELECT id, p, list_transform(p, lambda x: {NORM_SQL.format('x')}) AS nrm FROM (SELECT id, {PIECES_SQL} AS p FROM utt)))))""")
def collapse_repeats(spark, d):
    u = settle(utterances(spark, d), pieces=X.repeat_pieces(F.col("text")))
    u = settle(u, composed=X.nfkc_pieces(F.col("pieces")))
    u = settle(u, tidy=X.tidy_pieces(F.col("composed")))
    u = settle(u, joined=X.collapse_repeats(F.col("pieces"), F.col("tidy")))
    u = settle(u, words=F.split("joined", " "))
    u = settle(u, folded=X.fold_loop(F.col("joined"), F.col("words")))
    return u.select("id", F.md5("folded").alias("digest"), F.length("folded").cast("bigint").alias("n_chars"))


@query("asr_clean", T.ctes("utt") + r""" SELECT id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x<>'' AND NOT contains(x, chr(13))), ' ')) AS digest FROM utt""")
def asr_clean(spark, d):
    return utterances(spark, d).select("id", F.md5(X.asr_clean(F.col("text"), V.NOISE_MARKERS)).alias("digest"))


@query("sentence_split", T.ctes("utt") + r""" SELECT id, count(*) AS n, max(length(s)) AS longest FROM (SELECT id, unnest(list_filter(list_transform(string_split(
    regexp_replace(trim(text, ' '||chr(9)||chr(10)||chr(13)), '([.!?。！？])\s+', '\1'||chr(31), 'g'), chr(31)), lambda p: trim(p)), lambda p: p<>'')) AS s FROM utt) GROUP BY id""")
def sentence_split(spark, d):
    rows = utterances(spark, d).select("id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "s"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("s")).cast("bigint").alias("longest"))


@query("token_estimate", T.ctes("utt") + """ SELECT id, CAST(ceil(h/1.3::DOUBLE+a/3.5::DOUBLE+greatest(length(text)-h-a-sp,0)/1.5::DOUBLE) AS BIGINT) AS tokens FROM (
    SELECT id, text, length(regexp_replace(text,'[^가-힣]','','g')) AS h, length(regexp_replace(text,'[^A-Za-z0-9]','','g')) AS a, length(regexp_replace(text,'[^ ]','','g')) AS sp FROM utt)""")
def token_estimate(spark, d):
    return utterances(spark, d).select("id", X.estimate_tokens(F.col("text")).alias("tokens"))


WAKE = {"exact": ["the", "un e"], "prefixes": ["the", "th e an", "de", "en le", "in"], "command_only": ["er", "on"], "fillers": ["a", "le", "der", "is", "et"]}
_WAKE_ALL = sorted([(p.replace(" ", ""), o) for o, k in ((False, "prefixes"), (True, "command_only")) for p in WAKE[k]], key=lambda x: -len(x[0]))
_HIT_SQL = "CASE " + " ".join(f"WHEN starts_with(c, {q(p)})" + (f" AND length(c)>{len(p)}" if o else "") + f" THEN {q(p)}" for p, o in _WAKE_ALL) + " END"


@query("wake_match", T.ctes("norm") + f""" SELECT id, CASE WHEN w THEN c ELSE h END AS variant, md5(CASE WHEN w THEN '' ELSE trim(substr(f, cut+1), ' ,') END) AS rest FROM (
    SELECT *, length(regexp_extract(f, '^(?: *[^ ]){{'||length(h)||'}}')) AS cut FROM (SELECT id, f, c, c IN ('the','une') AS w, {_HIT_SQL} AS h FROM (
      SELECT id, f, replace(f,' ','') AS c FROM (SELECT id, array_to_string(ws[(CASE WHEN k=0 THEN len(ws) ELSE k END):], ' ') AS f FROM (
        SELECT id, ws, coalesce(list_position(list_transform(ws, lambda x: x IN ('a','le','der','is','et')), false),0) AS k FROM (SELECT id, string_split(norm,' ') AS ws FROM norm WHERE norm<>'')))))
    WHERE w OR h IS NOT NULL)""")
def wake_match(spark, d):
    u = settle(utterances(spark, d), norm=X.normalize_utterance(F.col("text")))
    u = settle(u, clean=X.strip_fillers(F.col("norm"), WAKE["fillers"]))
    hit = X.match_wake(F.col("clean"), WAKE["exact"], WAKE["prefixes"], WAKE["command_only"])
    u = settle(u, hit=hit).filter("hit IS NOT NULL")
    return u.select("id", "hit.variant", F.md5("hit.remainder").alias("rest"))


def cards(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.CARDS, "scenario_id string, source_id string, card_path string, sentences array<string>")


CARD_SQL = "CASE scenario_id " + " ".join(f"WHEN {q(c[0])} THEN {q(c[1])}" for c in V.CARDS) + " END"
CARD_TEXT_SQL = "CASE sc " + " ".join(f"WHEN {q(c[0])} THEN {q(' '.join(c[3]))}" for c in V.CARDS) + " END"


@query("card_lookup", T.ctes("decided") + f" SELECT id, scenario_id AS card_id, {CARD_SQL} AS source_id FROM decided")
def card_lookup(spark, d):
    u = R.route(utterances(spark, d), "text", "pending", RULES).select("id", F.col("decision.scenario_id").alias("scenario"))
    return R.cards_for(u, cards(spark), "scenario").select("id", "card_id", "source_id")


def device_rows(spark: SparkSession, d: str) -> DataFrame:
    """A device state a row, from events: every section present for some rows and absent for others."""
    c, v = F.col, F.col("value")
    at = lambda items, n: F.get(F.array(*[F.lit(i) for i in items]), (c("event_id") % n).cast("int"))
    state = F.struct(
        (c("event_type") != "error").alias("gps_fix"), F.when(c("event_id") % 3 != 0, F.round(v / 8, 3)).alias("acc_m"), (c("event_id") % 21).alias("satellites"),
        F.lit(True).alias("has_last_fix"), F.when(c("event_id") % 4 != 0, F.round(v * 2, 3)).alias("last_age_s"),
        (c("event_id") % 9 == 0).alias("arrived"), at(["basecamp", "destination"], 2).alias("target_kind"),
        at(["off_trail", "on_trail", "off_trail_estimate", "uncertain", None], 5).alias("trail_status"), F.round(v, 3).alias("offset_m"),
        (c("event_id") % 2 == 0).alias("route_available"), (c("event_id") % 360).cast("double").alias("bearing_deg"), F.round(v * 7, 3).alias("distance_m"),
        (c("event_id") % 3 == 0).alias("sun_computed"), at(["current_fix", "last_fix"], 2).alias("sun_reference"), F.round(v - 30, 3).alias("remaining_min"),
        at(["17:40", None], 2).alias("return_by_clock"), at(["danger", "caution", "normal"], 3).alias("sun_level"),
        (c("event_id") % 5 != 0).alias("env_valid"), (c("event_id") % 400 / 10.0).alias("temp_c"), (c("event_id") % 100).cast("double").alias("humidity_pct"),
        F.when(c("event_id") % 4 == 0, (c("event_id") % 8000 + 3000) / 10.0).alias("press_hpa"), at(["rising", "steady", "falling", "unknown"], 4).alias("press_trend"),
        (c("event_id") % 3 == 1).alias("power_valid"), (c("event_id") % 101).cast("double").alias("percent"), (c("event_id") % 90 / 10.0).alias("days_left"),
        (c("event_type") != "error").alias("co_valid"), (c("event_id") % 7 == 0).alias("co_stale"), F.round(v, 3).alias("co_ppm"),
        (c("event_id") % 11 == 0).alias("co_alarm"), at(["normal", "warning", "unknown", None], 4).alias("co_level"), (c("event_id") % 8 != 4).alias("pressure_valid"),
        at(["18:05", None, "", "19:40", "18:30"], 5).alias("sunset_clock"), F.when(c("event_id") % 6 == 0, F.concat(F.lit("checkpoint-"), c("event_id"))).alias("target_id"),
        F.when(c("event_id") % 10 != 0, F.ceil(v / 10).cast("double")).alias("eta_min"))
    e = T.read(spark, d, "events").withColumn("scenario", at(R.SCENARIOS, 14))
    return settle(e, dev=state).select("event_id", "scenario", "dev")


def num(expr: str, digits: int = 0) -> str:
    return f"printf('%.{digits}f', round_even({expr}, {digits}))" if digits else f"CAST(CAST(round_even({expr}, 0) AS BIGINT) AS VARCHAR)"


T.define("dev", [], """SELECT event_id, (['lost','route','daylight','weather','shelter','warmth','water','food','sleep_safety','injury','wildlife','gear','refuse','unknown'])[event_id%14+1] AS sc,
    event_type<>'error' AS fix, CASE WHEN event_id%3<>0 THEN round(value/8,3) END AS acc, event_id%21 AS sats, CASE WHEN event_id%4<>0 THEN round(value*2,3) END AS lage,
    event_id%9=0 AS arr, (['basecamp','destination'])[event_id%2+1] AS kind, (['off_trail','on_trail','off_trail_estimate','uncertain',NULL])[event_id%5+1] AS trail, round(value,3) AS off,
    event_id%2=0 AS ravail, CAST(event_id%360 AS DOUBLE) AS brg, round(value*7,3) AS dist, event_id%3=0 AS sunc, round(value-30,3) AS rem, (['17:40',NULL])[event_id%2+1] AS retby,
    (['current_fix','last_fix'])[event_id%2+1] AS sref, (['danger','caution','normal'])[event_id%3+1] AS lvl, event_id%5<>0 AS envv, CAST(event_id%400 AS DOUBLE)/10.0::DOUBLE AS temp,
    CAST(event_id%100 AS DOUBLE) AS hum, CASE WHEN event_id%4=0 THEN CAST(event_id%8000+3000 AS DOUBLE)/10.0::DOUBLE END AS press, (['rising','steady','falling','unknown'])[event_id%4+1] AS trend,
    event_id%3=1 AS pwr, CAST(event_id%101 AS DOUBLE) AS pct, CAST(event_id%90 AS DOUBLE)/10.0::DOUBLE AS days, event_type<>'error' AS cov, event_id%7=0 AS costale, round(value,3) AS ppm,
    event_id%11=0 AS coalarm, (['normal','warning','unknown',NULL])[event_id%4+1] AS colevel, event_id%8<>4 AS pressv, (['18:05',NULL,NULL,'19:40','18:30'])[event_id%5+1] AS sunset,
    CASE WHEN event_id%6=0 THEN 'checkpoint-'||event_id END AS tid, CASE WHEN event_id%10<>0 THEN ceil(value/10) END AS eta FROM events""")
TOK_SQL = "ceil(length(regexp_replace({0},'[^A-Za-z0-9]','','g'))/3.5::DOUBLE+(length({0})-length(regexp_replace({0},'[^A-Za-z0-9]','','g'))-length(regexp_replace({0},'[^ ]','','g')))/1.5::DOUBLE)"


@query("device_state_text", T.ctes("dev") + f""" SELECT event_id, array_to_string(p[1:list_max(list_filter(range(1,len(p)+1), lambda n: {TOK_SQL.format("array_to_string(p[1:n],' | ')")}<=60))], ' | ') AS state FROM (
    SELECT event_id, list_filter([CASE WHEN fix THEN 'gps=fix'||coalesce(' acc'||{num('acc')}||'m','')||' sats'||sats ELSE 'gps=nofix'||coalesce(' last'||{num('lage')}||'s','') END,
      'sun='||coalesce('set'||sunset||' ','')||'rem'||{num('rem')}||'min'||coalesce(' return'||retby,'')||' lvl='||lvl,
      CASE WHEN envv THEN 'env='||{num('temp', 1)}||'C '||{num('hum')}||'%'||coalesce(CASE WHEN pressv THEN ' '||{num('press', 1)}||'hPa '||trend END,'') END,
      CASE WHEN cov AND NOT costale THEN 'co='||{num('ppm')}||'ppm '||CASE WHEN coalarm THEN 'alarm' ELSE coalesce(colevel,'normal') END END,
      CASE WHEN pwr THEN 'pwr='||{num('pct')}||'% '||{num('days', 1)}||'d' END, 'trail='||trail||' off'||{num('off')}||'m',
      CASE WHEN ravail THEN 'route='||coalesce(tid, kind)||' '||{num('dist')}||'m '||{num('brg')}||'deg'||coalesce(' eta'||{num('eta')}||'min','') END, CASE WHEN arr THEN 'arrived=yes' END], lambda x: x IS NOT NULL) AS p FROM dev)""")
def device_state_text(spark, d):
    return replies.state_line(device_rows(spark, d), "dev").select("event_id", "state")


@query("card_render", T.ctes("dev") + f""" SELECT event_id, CASE WHEN event_id%4=0 THEN {q(V.DEMO_PREFIX)} ELSE '' END || CASE
    WHEN sc='gear' AND pwr THEN '실제 전원 계측값은 '||{num('pct')}||'퍼센트입니다. 현재 운용 패턴 기준 예상 잔여는 '||{num('days', 1)}||'일입니다.'
    WHEN sc='sleep_safety' AND cov AND NOT costale THEN '현재 일산화탄소 센서 계측값은 '||{num('ppm')}||'피피엠입니다. 텐트나 차량 안에서는 연소 기구를 켜지 마세요. 센서 감시는 예방을 대신하지 않습니다.'
    WHEN sc='weather' AND envv THEN '현장 센서 온도는 '||{num('temp', 1)}||'도, 습도는 '||{num('hum')}||'퍼센트입니다.'||coalesce(' 현장 기압은 '||{num('press', 1)}||'헥토파스칼이며 추세는 '||
      CASE trend WHEN 'rising' THEN '상승' WHEN 'steady' THEN '유지' WHEN 'falling' THEN '하강' ELSE '확인 불가' END||'입니다.','')||' 이 값은 예보가 아닌 국지 추정 입력입니다.'
    WHEN sc='daylight' AND sunc THEN CASE WHEN round_even(rem,0)<0 THEN '일몰 후 '||{num('abs(round_even(rem,0))')}||'분 지났습니다.' ELSE '일몰까지 '||{num('rem')}||'분 남았습니다.' END||
      CASE WHEN sref='last_fix' THEN ' 마지막 확정 위치 기준입니다.' ELSE ' 현재 GPS 위치 기준입니다.' END||coalesce(' 등록된 베이스캠프 기준 귀환 권고 시각은 '||retby||'입니다.','')||
      CASE lvl WHEN 'danger' THEN ' 귀환 권고 시각에 도달했습니다. 베이스캠프 경로를 확인하세요.' WHEN 'caution' THEN ' 귀환 권고 시각이 가까워졌습니다. 베이스캠프 경로를 확인하세요.' ELSE ' 현재는 귀환 주의 임계 전입니다.' END
    WHEN sc='lost' AND fix THEN 'GPS가 현재 위치를 수신 중입니다. 정확도는 '||coalesce('플러스마이너스 '||{num('acc', 1)}||'미터','확인 불가')||'이며 위성은 '||sats||'개입니다. 좌표는 화면에서 정확도와 함께 확인하세요.'
    WHEN sc='lost' THEN '현재 GPS가 미수신입니다. '||coalesce('마지막 확정 위치는 '||{num('lage')}||'초 전 값입니다.','마지막 확정 위치의 경과 시간은 확인할 수 없습니다.')||' 위치를 추정하지 않으며 좌표는 화면에서 확인하세요.'
    WHEN sc='route' AND arr THEN CASE WHEN kind='basecamp' THEN '베이스캠프에 도착하였습니다.' ELSE '목적지에 도착하였습니다.' END
    WHEN sc='route' AND (trail IS NOT NULL OR (ravail AND fix)) THEN array_to_string(list_filter([CASE trail WHEN 'off_trail' THEN '지도 엔진 기준 트레일에서 '||{num('off')}||'미터 벗어난 상태입니다.'
        WHEN 'on_trail' THEN '현재 위치는 트레일 허용 범위 안입니다.' WHEN 'off_trail_estimate' THEN '트레일에서 '||{num('off')}||'미터 벗어난 것으로 추정되지만 현재 상태는 확정할 수 없습니다.'
        WHEN 'uncertain' THEN '트레일까지 계산 거리는 '||{num('off')}||'미터이지만 GPS 정확도가 없어 트레일 상태를 확정할 수 없습니다.' END,
      CASE WHEN ravail AND fix THEN '지도 엔진 계산 방위는 '||{num('brg')}||'도입니다.' END, CASE WHEN ravail AND fix THEN '경로 거리는 '||{num('dist')}||'미터입니다.' END,
      CASE WHEN ravail AND fix THEN coalesce('GPS 정확도는 플러스마이너스 '||{num('acc', 1)}||'미터입니다.','GPS 정확도는 확인할 수 없습니다.') END], lambda x: x IS NOT NULL), ' ')
    ELSE {CARD_TEXT_SQL} END AS reply FROM dev""")
def card_render(spark, d):
    rows = R.cards_for(device_rows(spark, d), cards(spark), "scenario")
    lines = replies.card_lines(F.col("scenario"), "dev", F.col("sentences"))
    rows = settle(rows, lines=lines)
    return rows.select("event_id", replies.spoken(F.col("lines"), F.col("event_id") % 4 == 0).alias("reply"))
