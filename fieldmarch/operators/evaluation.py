"""Evaluation and benchmark marts: scores, confusion, latency, acceptance, selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Pass marks and budgets.
ACCURACY_GATE, LATENCY_BUDGET_S = 0.90, 2.0


def score(cases: DataFrame, decisions: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Cases joined to decisions: ``correct`` when every expected field equals the actual one, NULLs alike."""
    got = decisions.select(key, *[F.col(f).alias(f"got_{f}") for f in fields])
    same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"got_{f}")) for f in fields])
    return cases.join(got, key, "left").withColumn("correct", same)


def drop_leaked(cases: DataFrame, shown: DataFrame, text: str) -> DataFrame:
    """Cases whose text was not shown to the model; whole texts are compared by digest, so none is shuffled."""
    digest = F.sha2(text, 256)
    return cases.withColumn("_d", digest).join(shown.select(digest.alias("_d")).distinct(), "_d", "left_anti").drop("_d")


def accuracy(scored: DataFrame, expected: str, actual: str, never: str = "refuse", gate: float = ACCURACY_GATE) -> DataFrame:
    """Accuracy, failures, leaks of the label that must never be missed, and the gate."""
    leaks = F.count_if((F.col(expected) == never) & ~F.col("correct"))
    out = scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"), F.count_if(~F.col("correct")).alias("n_failed"), leaks.alias("leaks"))
    out = out.withColumn("accuracy", F.round(F.col("n_correct") / F.col("n"), 4))
    return out.withColumn("passed", (F.col("n_correct") / F.col("n") >= gate) & (F.col("leaks") == 0))


def confusion(df: DataFrame, expected: str, actual: str, labels: list[str]) -> DataFrame:
    """One row per expected label with the count of each actual one; absent labels give zero rows."""
    counts = df.groupBy(expected).agg(*[F.count_if(F.col(actual) == x).alias(f"as_{x}") for x in labels])
    every = df.sparkSession.createDataFrame([(x,) for x in labels], f"{expected} string")
    return every.join(counts, expected, "left").fillna(0)


#: Slices of a group's range of values; a group's rank is looked for in one of them.
SLICES = 4096


def at_rank(df: DataFrame, keys: list[str], value: str, *ranks: Column) -> DataFrame:
    """``keys, n, min_v, max_v, v0, v1, ...``: the values at given ranks (from 0, as functions of ``n``) of each sorted group.

    A group is first counted in slices of its range, then only the slices that hold a rank are counted by value, so no task sees more
    than a slice's distinct values of a group. NULL values do not count.
    """
    stat = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min_v"), F.max(value).alias("max_v"))
    wanted = stat.withColumn("_rank", F.explode(F.array_distinct(F.array(*[r.cast("bigint") for r in ranks])))).filter("_rank >= 0 AND _rank < n")
    share = (F.col(value) - F.col("min_v")) / F.nullif(F.col("max_v") - F.col("min_v"), F.lit(0))
    part = F.coalesce(F.least(F.floor(share * SLICES), F.lit(SLICES - 1)), F.lit(0)).cast("int")
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value).join(stat, keys).select(*keys, value, part.alias("_part"))
    upto = Window.partitionBy(*keys).orderBy("_part")
    slices = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", F.sum("_c").over(upto))
    held = slices.join(wanted.select(*keys, "_rank"), keys).filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    held = held.select(*keys, "_part", "_rank", (F.col("_upto") - F.col("_c")).alias("_before"))
    inner = Window.partitionBy(*keys, "_part").orderBy(value)
    values = rows.join(held.select(*keys, "_part").distinct(), [*keys, "_part"], "left_semi").groupBy(*keys, "_part", value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = values.withColumn("_in", F.sum("_c").over(inner)).join(held, [*keys, "_part"]).filter(F.col("_before") + F.col("_in") > F.col("_rank"))
    found = ranked.groupBy(*keys, "_rank").agg(F.min(value).alias("_v"))
    out = stat
    for i, rank in enumerate(ranks):
        own = found.select(*keys, F.col("_rank").alias(f"_r{i}"), F.col("_v").alias(f"v{i}"))
        out = out.withColumn(f"_r{i}", rank.cast("bigint")).join(own, [*keys, f"_r{i}"], "left").drop(f"_r{i}")
    return out


def latency(df: DataFrame, keys: list[str], seconds: str, error: str, budget: float = LATENCY_BUDGET_S) -> DataFrame:
    """Max, exact median and errors; the budget is judged on the worst, not on the median."""
    n = F.col("n")
    middle = at_rank(df, keys, seconds, F.floor((n - 1) / 2), F.floor(n / 2)).select(*keys, ((F.col("v0") + F.col("v1")) / 2).alias("median_s"))
    worst = df.groupBy(*keys).agg(F.max(seconds).alias("max_s"), F.count_if(error).alias("errors"), (F.max(seconds) <= budget).alias("within_budget"))
    return worst.join(middle, keys)


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``sorted[n // 2]`` of each group, with its extremes."""
    return at_rank(df, keys, value, F.floor(F.col("n") / 2)).select(*keys, F.col("v0").alias("upper_median"), "min_v", "max_v")


def step_max(df: DataFrame, run: str, steps: str) -> DataFrame:
    """Worst time of each step over all runs, from a map column of step times."""
    rows = df.select(run, F.explode(steps).alias("step", "ms"))
    return rows.groupBy("step").agg(F.max("ms").alias("max_ms"), F.count(F.lit(1)).alias("n_runs"))


def missing_runs(observed: DataFrame, run: str, expected: Column | int, by: list[str]) -> DataFrame:
    """Runs 1..N without any observation."""
    n = F.lit(expected) if isinstance(expected, int) else expected
    want = observed.select(*by).distinct().withColumn(run, F.explode(F.sequence(F.lit(1), n)))
    return want.join(observed.select(*by, run).distinct(), [*by, run], "left_anti")


def extra_runs(observed: DataFrame, run: str, expected: Column | int, by: list[str]) -> DataFrame:
    """Observed runs that are none of 1..N, each once; a run without a number is extra too."""
    n = F.lit(expected) if isinstance(expected, int) else expected
    return observed.filter(~F.coalesce(F.col(run).between(F.lit(1), n), F.lit(False))).select(*by, run).distinct()


def acceptance(events: DataFrame, keys: list[str], order: str, fields: list[str], checks: dict[str, Column], need: list[str]) -> DataFrame:
    """Fold event rows into one row per run and judge it.

    The newest given value of each field counts. A run that lacks any field in ``need`` is unverified, even if a check
    fails on what there is; else a failed check fails it; else it passes. ``failed`` names the failed checks in any case.
    """
    folded = events.groupBy(*keys).agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])
    bad = reduce(lambda a, b: a | b, [F.coalesce(~c, F.lit(False)) for c in checks.values()])
    lacking = reduce(lambda a, b: a | b, [F.col(f).isNull() for f in need])
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))
    return folded.withColumn("verdict", F.when(lacking, "unverified").when(bad, "fail").otherwise("pass")).withColumn("failed", failed)


def reproducible(df: DataFrame, by: list[str], signature: list[str]) -> DataFrame:
    """Whether all runs of a case gave one signature: two extremes of one text say so without a distinct."""
    sig = F.to_json(F.struct(*signature))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), (F.min(sig) == F.max(sig)).alias("reproducible"))


def keyword_recall(df: DataFrame, heard: str, keys: str, negatives: str) -> DataFrame:
    """Add whether any expected keyword was heard and whether any unwanted one was."""
    found = lambda col: F.exists(F.filter(F.split(col, ","), lambda k: k != ""), lambda k: F.contains(F.col(heard), k))
    return df.withColumn("recalled", found(keys)).withColumn("false_positive", found(negatives))


def energy(df: DataFrame, keys: list[str], phase: str, mw: str, seconds: str, queries: str) -> DataFrame:
    """Energy per query: (mean active - mean idle) mW x wall seconds / 3600 / queries, and the peak."""
    idle = F.avg(F.when(F.col(phase) == "idle", F.col(mw)))
    active = F.avg(F.when(F.col(phase) == "active", F.col(mw)))
    wall, n = F.max(seconds), F.max(queries)
    return df.groupBy(*keys).agg(((active - idle) * wall / 3600.0 / n).alias("mwh_per_query"), F.max(mw).alias("peak_mw"))


def select_config(df: DataFrame, gates: list[str], cost: str, name: str) -> DataFrame:
    """The configuration that passes every gate with the lowest worst latency."""
    passing = reduce(lambda a, b: a & b, [F.col(g) for g in gates])
    best = F.min_by(F.struct(name, cost), F.struct(cost, name))
    return df.filter(passing).agg(best.alias("b")).select(f"b.{name}", f"b.{cost}").filter(F.col(name).isNotNull())
