"""Evaluation marts over labels, events, orders and lineitem, and the optional field rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import evaluation as E, field_rules
from . import tables as T
from .registry import query

T.define("cases", [], """SELECT doc_id, CASE WHEN toxic=1 THEN 'refuse' WHEN quality=1 THEN 'keep' ELSE 'drop' END AS expected,
    CASE WHEN n_chars>3000 THEN 'keep' WHEN length(text)%5=0 THEN 'refuse' WHEN n_chars%2=0 THEN 'keep' ELSE 'drop' END AS actual, text, lang FROM labels JOIN documents USING (doc_id)""")


def cases(spark: SparkSession, d: str) -> DataFrame:
    lab = T.read(spark, d, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "refuse").when(F.col("quality") == 1, "keep").otherwise("drop").alias("expected"))
    return lab.join(T.read(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    docs = T.read(spark, d, "documents")
    actual = (
        F.when(F.col("n_chars") > 3000, "keep").when(F.length("text") % 5 == 0, "refuse").when(F.col("n_chars") % 2 == 0, "keep").otherwise("drop"))
    return docs.select("doc_id", actual.alias("expected"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return E.score(cases(spark, d), decisions(spark, d), "doc_id", ["expected"]).withColumnRenamed("got_expected", "actual")


@query("eval_score", T.ctes("cases") + " SELECT doc_id, expected, actual, expected=actual AS correct FROM cases")
def eval_score(spark, d):
    return scored(spark, d).select("doc_id", "expected", "actual", "correct")


@query("eval_accuracy", T.ctes("cases") + """ SELECT count(*) AS n, count(*) FILTER (expected=actual) AS n_correct, count(*) FILTER (expected<>actual) AS n_failed, count(*) FILTER (expected='refuse' AND actual<>'refuse') AS leaks,
    round(count(*) FILTER (expected=actual)/count(*),4) AS accuracy, count(*) FILTER (expected=actual)/count(*)>=0.9 AND count(*) FILTER (expected='refuse' AND actual<>'refuse')=0 AS passed FROM cases""")
def eval_accuracy(spark, d):
    return E.accuracy(scored(spark, d), "expected", "actual")


@query("confusion", T.ctes("cases") + """ SELECT l.expected, count(*) FILTER (actual='keep') AS as_keep, count(*) FILTER (actual='drop') AS as_drop, count(*) FILTER (actual='refuse') AS as_refuse, count(*) FILTER (actual='other') AS as_other
    FROM (VALUES ('keep'),('drop'),('refuse'),('other')) l(expected) LEFT JOIN cases c ON c.expected=l.expected GROUP BY l.expected""")
def confusion(spark, d):
    return E.confusion(scored(spark, d), "expected", "actual", ["keep", "drop", "refuse", "other"])


@query("eval_multi", T.ctes("cases") + """ SELECT lang, round(avg(CAST(expected=actual AS INT)),4) AS label_accuracy, round(avg(CASE WHEN expected<>'refuse' THEN CAST(expected=actual AS INT) END),4) AS action_accuracy,
    round(count(*) FILTER (expected='refuse' AND actual='refuse')/nullif(count(*) FILTER (expected='refuse'),0),4) AS refuse_rate FROM cases GROUP BY lang""")
def eval_multi(spark, d):
    s = scored(spark, d)
    hit = F.col("correct").cast("int")
    refuse = F.col("expected") == "refuse"
    return s.groupBy("lang").agg(
        F.round(F.avg(hit), 4).alias("label_accuracy"), F.round(F.avg(F.when(~refuse, hit)), 4).alias("action_accuracy"),
        F.round(F.count_if(refuse & F.col("correct")) / F.when(F.count_if(refuse) > 0, F.count_if(refuse)), 4).alias("refuse_rate"))


@query("leak_antijoin", """SELECT doc_id, lang FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE toxic=1)""")
def leak_antijoin(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", "lang", "text")
    shown = docs.join(T.read(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return E.drop_leaked(docs, shown, "text").select("doc_id", "lang")


@query("missing_runs", """SELECT u.device_id, CAST(r.run AS INTEGER) AS run FROM (SELECT DISTINCT user_id AS device_id FROM events) u CROSS JOIN range(1,31) r(run)
    WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id=u.device_id AND day(e.ts)=r.run)""")
def missing_runs(spark, d):
    e = T.read(spark, d, "events").select(F.col("user_id").alias("device_id"), F.dayofmonth("ts").alias("run"))
    return E.missing_runs(e, "run", 30, ["device_id"])


@query("extra_runs", """SELECT DISTINCT user_id AS device_id, CAST(CASE WHEN event_type<>'error' THEN day(ts)-3 END AS INTEGER) AS run FROM events
    WHERE event_type='error' OR NOT day(ts)-3 BETWEEN 1 AND 20+user_id%5""")
def extra_runs(spark, d):
    run = F.when(F.col("event_type") != "error", F.dayofmonth("ts") - 3)
    e = T.read(spark, d, "events").select(F.col("user_id").alias("device_id"), run.alias("run"))
    return E.extra_runs(e, "run", 20 + F.col("device_id") % 5, ["device_id"])


@query("latency_budget", """SELECT l_returnflag, max(l_quantity/20) AS max_s, median(l_quantity/20) AS median_s, count(*) FILTER (l_tax>0.07) AS errors, max(l_quantity/20)<=2.0 AS within_budget FROM lineitem GROUP BY l_returnflag""")
def latency_budget(spark, d):
    li = T.read(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") / 20).alias("s"), (F.col("l_tax") > 0.07).alias("err"))
    return E.latency(li, ["l_returnflag"], "s", "err")


@query("stage_latency", """SELECT l_returnflag AS stage, (list_sort(list(l_quantity)))[count(*)//2+1] AS upper_median, min(l_quantity) AS min_v, max(l_quantity) AS max_v FROM lineitem GROUP BY l_returnflag""")
def stage_latency(spark, d):
    li = T.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("stage"), "l_quantity")
    return E.upper_median(li, ["stage"], "l_quantity")


@query("stage_means", """SELECT stage, n, round(mean_v,4) AS mean_v, mean_v=max(mean_v) OVER () AS biggest FROM (SELECT l_returnflag AS stage, count(*) AS n, avg(l_quantity) AS mean_v FROM lineitem GROUP BY l_returnflag)""")
def stage_means(spark, d):
    m = T.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_v"))
    top = m.agg(F.max_by("stage", "mean_v").alias("stage")).withColumn("biggest", F.lit(True))
    return m.join(top, "stage", "left").select("stage", "n", F.round("mean_v", 4).alias("mean_v"), F.coalesce("biggest", F.lit(False)).alias("biggest"))


@query("step_max", """SELECT step, max(ms) AS max_ms, count(*) AS n_runs FROM (SELECT 'quantity' AS step, l_quantity AS ms FROM lineitem UNION ALL SELECT 'price', l_extendedprice FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem) GROUP BY step""")
def step_max(spark, d):
    li = T.read(spark, d, "lineitem").select(
        "l_orderkey", F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("price"), F.col("l_extendedprice"), F.lit("tax"), F.col("l_tax")).alias("steps"))
    return E.step_max(li, "l_orderkey", "steps")


@query("acceptance", """SELECT o_orderkey AS run, CASE WHEN lat IS NULL OR disc IS NULL OR flag IS NULL THEN 'unverified' WHEN lat>40 OR disc>0.09 THEN 'fail' ELSE 'pass' END AS verdict,
    CASE WHEN lat>40 THEN 1 ELSE 0 END+CASE WHEN disc>0.09 THEN 1 ELSE 0 END AS n_failed FROM (SELECT l_orderkey AS o_orderkey, arg_max(l_quantity,k) FILTER (l_linestatus='O') AS lat,
      arg_max(l_discount,k) AS disc, arg_max(l_returnflag,k) FILTER (l_returnflag<>'N') AS flag FROM (SELECT *, l_linenumber*10000000000+l_partkey*1000+l_suppkey%1000 AS k FROM lineitem) GROUP BY l_orderkey)""")
def acceptance(spark, d):
    c = F.col
    ev = T.read(spark, d, "lineitem").select(
        c("l_orderkey").alias("run"), (c("l_linenumber") * F.lit(10000000000) + c("l_partkey") * 1000 + c("l_suppkey") % 1000).alias("at"), F.when(c("l_linestatus") == "O", c("l_quantity")).alias("lat"), c("l_discount").alias("disc"),
        F.when(c("l_returnflag") != "N", c("l_returnflag")).alias("flag"))
    out = E.acceptance(ev, ["run"], "at", ["lat", "disc", "flag"], {"latency": c("lat") <= 40, "discount": c("disc") <= 0.09}, ["lat", "disc", "flag"])
    return out.select("run", "verdict", F.size("failed").alias("n_failed"))


@query("reproducible", """SELECT l_orderkey, count(*) AS n_runs, count(DISTINCT l_returnflag||l_linestatus)=1 AS reproducible FROM lineitem GROUP BY l_orderkey""")
def reproducible(spark, d):
    return E.reproducible(T.read(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query("keyword_recall", """SELECT lang, count(*) AS n, count(*) FILTER (contains(text,'ion') OR contains(text,'ung') OR contains(text,'ing')) AS recalled, count(*) FILTER (contains(text,'http') OR contains(text,'@')) AS false_positives FROM documents GROUP BY lang""")
def keyword_recall(spark, d):
    docs = T.read(spark, d, "documents").withColumn("keys", F.lit("ion,ung,ing")).withColumn("neg", F.lit("http,@"))
    out = E.keyword_recall(docs, "text", "keys", "neg")
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("recalled").alias("recalled"), F.count_if("false_positive").alias("false_positives"))


@query("energy_per_query", """SELECT l_suppkey, round((avg(l_quantity) FILTER (l_linestatus='O')-avg(l_quantity) FILTER (l_linestatus='F'))*max(l_extendedprice)/3600.0/max(l_linenumber),4) AS mwh_per_query, max(l_quantity) AS peak_mw FROM lineitem GROUP BY l_suppkey""")
def energy_per_query(spark, d):
    li = T.read(spark, d, "lineitem").withColumn("phase", F.when(F.col("l_linestatus") == "O", "active").otherwise("idle"))
    out = E.energy(li, ["l_suppkey"], "phase", "l_quantity", "l_extendedprice", "l_linenumber")
    return out.withColumn("mwh_per_query", F.round("mwh_per_query", 4))


T.define("configs", [], """SELECT l_suppkey AS config, avg(l_discount) AS acc, max(l_quantity*l_tax) AS worst, sum(l_quantity) AS mem FROM lineitem GROUP BY l_suppkey""")


@query("config_select", T.ctes("configs") + " SELECT config, worst FROM configs WHERE acc>=0.045 AND worst<=4.0 AND mem<=18000 ORDER BY worst, config LIMIT 1")
def config_select(spark, d):
    c = F.col
    conf = T.read(spark, d, "lineitem").groupBy(c("l_suppkey").alias("config")).agg(
        F.avg("l_discount").alias("acc"), F.max(c("l_quantity") * c("l_tax")).alias("worst"), F.sum("l_quantity").alias("mem"))
    conf = conf.withColumn("g1", c("acc") >= 0.045).withColumn("g2", c("worst") <= 4.0).withColumn("g3", c("mem") <= 18000)
    return E.select_config(conf, ["g1", "g2", "g3"], "worst", "config")


@query("bench_summary", """SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS best, max(o_totalprice) AS worst, round(avg(o_totalprice),2) AS mean FROM orders GROUP BY o_orderpriority""")
def bench_summary(spark, d):

    # Measurements go through their CSV form and back with the fixed schema.
    from ..sources.files import bench_rows, write_bench

    o = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("ms_total_max"))
    path = write_bench(o)
    b = bench_rows(spark, path).withColumnRenamed("label", "o_orderpriority")
    return b.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.min("ms_total_max").alias("best"), F.max("ms_total_max").alias("worst"), F.round(F.avg("ms_total_max"), 2).alias("mean"))


@query("co_rise", T.ctes("co") + """ SELECT event_id, coalesce(ppm-lo>=20,false) AS rise, coalesce(l60>=70,false) AS ul_70, coalesce(l10>=150,false) AS ul_150, coalesce(l4>=400,false) AS ul_400 FROM (SELECT event_id, ppm,
    min(ppm) OVER (PARTITION BY device_id, boot_id ORDER BY us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS lo,
    CASE WHEN us-first_us>=3600000000 THEN min(ppm) OVER (PARTITION BY device_id, boot_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) END AS l60,
    CASE WHEN us-first_us>=600000000 THEN min(ppm) OVER (PARTITION BY device_id, boot_id ORDER BY us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) END AS l10,
    CASE WHEN us-first_us>=240000000 THEN min(ppm) OVER (PARTITION BY device_id, boot_id ORDER BY us RANGE BETWEEN 240000000 PRECEDING AND CURRENT ROW) END AS l4
    FROM (SELECT *, CAST(round(t_s*1000000) AS BIGINT) AS us, min(CAST(round(t_s*1000000) AS BIGINT)) OVER (PARTITION BY device_id, boot_id) AS first_us FROM co))""")
def co_rise(spark, d):
    co = T.co_readings(spark, d).withColumn("us", F.round(F.col("t_s") * 1000000).cast("bigint"))
    return field_rules.co_rise(co, ["device_id", "boot_id"], "us").select("event_id", "rise", "ul_70", "ul_150", "ul_400")


@query("env_trend", T.ctes("ev") + """ SELECT event_id, coalesce(temp<=2,false) AS cold, coalesce(press-hi<=-4,false) AS falling FROM (SELECT event_id, temp, press,
    max(press) OVER (PARTITION BY device_id, boot_id ORDER BY us RANGE BETWEEN 10800000000 PRECEDING AND CURRENT ROW) AS hi
    FROM (SELECT *, CAST(round(t_s*1000000) AS BIGINT) AS us, CAST(event_id%600-100 AS DOUBLE)/10.0::DOUBLE AS temp, 1000.0::DOUBLE+CAST(event_id%97 AS DOUBLE)/10.0::DOUBLE AS press FROM ev))""")
def env_trend(spark, d):
    e = T.ev(spark, d).select(
        "event_id", "device_id", "boot_id", F.round(F.col("t_s") * 1000000).cast("bigint").alias("us"), ((F.col("event_id") % 600 - 100) / 10.0).alias("temp_c"),
        (1000.0 + F.col("event_id") % 97 / 10.0).alias("press_hpa"))
    return field_rules.env_trend(e, ["device_id", "boot_id"], "us").select("event_id", "cold", "falling")


@query("energy_budget", """SELECT user_id AS device_id, round(sum(w*h)*14,7) AS base_wh, round(sum(w*h)*14*1.15*1.25,9) AS planned_wh FROM (SELECT user_id, value/100 AS h, CASE event_type WHEN 'click' THEN 6.0 WHEN 'view' THEN 3.5 WHEN 'purchase' THEN 1.25 ELSE 0.5 END AS w FROM events) GROUP BY user_id""")
def energy_budget(spark, d):
    k = F.col("event_type")
    watts = F.when(k == "click", 6.0).when(k == "view", 3.5).when(k == "purchase", 1.25).otherwise(0.5)
    spent = T.read(spark, d, "events").select(F.col("user_id").alias("device_id"), watts.alias("watts"), (F.col("value") / 100).alias("hours_per_day"))
    out = field_rules.energy_budget(spent, ["device_id"], 14)
    return out.select("device_id", F.round("base_wh", 7).alias("base_wh"), F.round("planned_wh", 9).alias("planned_wh"))


@query("daylight_margin", """SELECT o_orderkey, floor(ratio*10000+0.5)/10000 AS ratio, CASE WHEN ratio>=1.5 THEN 'ample' WHEN ratio>=1 THEN 'tight' WHEN ratio IS NOT NULL THEN 'short' END AS band FROM (
    SELECT o_orderkey, (o_totalprice/20)/(CAST(nullif(o_custkey%5000,0) AS DOUBLE)/nullif(q/(30*n),0)) AS ratio FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey=o_orderkey)""")
def daylight_margin(spark, d):
    # quantities are whole numbers, so their sum is exact in any order
    speed = T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum("l_quantity") / (30 * F.count(F.lit(1)))).alias("speed_mps"))
    o = T.read(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 20).alias("light_s"), (F.col("o_custkey") % 5000).cast("double").alias("distance_m"))
    cols = field_rules.daylight_margin(F.col("light_s"), F.col("distance_m"), F.col("speed_mps"))
    return o.join(speed, "o_orderkey").select("o_orderkey", (F.floor(cols["ratio"] * 10000 + 0.5) / 10000).alias("ratio"), cols["band"].alias("band"))
