"""Rules known from specifications only: carbon monoxide rise, weather trend, margins and budgets.

Their look-backs are bounded, so rows are cut into chunks of one look-back; every row also visits
the next chunk as context, and each (keys, chunk) is a window of its own. No device is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

US = 1_000_000


def _with_context(df: DataFrame, t: str, span: int) -> DataFrame:
    own = F.floor(F.col(t) / span).cast("bigint")
    return df.withColumn("_own", own).withColumn("_c", F.explode(F.array(own, own + 1)))


def _range(keys: list[str], t: str, span: int):
    return Window.partitionBy(*keys, "_c").orderBy(t).rangeBetween(-span, 0)


def co_rise(df: DataFrame, keys: list[str], t: str, ppm: str = "ppm") -> DataFrame:
    """A rise of 20 ppm within 10 min; and 70 ppm for 60 min, 150 for 10 and 400 for 4, each held throughout."""
    hour = 3600 * US
    first = df.groupBy(*keys).agg(F.min(t).alias("_first"))
    rows = _with_context(df, t, hour)
    low = lambda s: F.min(ppm).over(_range(keys, t, s * US))
    rows = rows.select("*", low(600).alias("_l10"), low(3600).alias("_l60"), low(240).alias("_l4")).filter("_c = _own")
    rows = rows.join(first, keys)
    age = F.col(t) - F.col("_first")
    held = lambda col, s, limit: F.coalesce((age >= s * US) & (F.col(col) >= limit), F.lit(False))
    return rows.select(
        *df.columns, F.coalesce(F.col(ppm) - F.col("_l10") >= 20, F.lit(False)).alias("rise"),
        held("_l60", 3600, 70).alias("ul_70"), held("_l10", 600, 150).alias("ul_150"), held("_l4", 240, 400).alias("ul_400"))


def env_trend(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """At most 2 degrees; and a fall of 4 hPa within three hours."""
    span = 10800 * US
    rows = _with_context(df, t, span)
    rows = rows.withColumn("_hi", F.max("press_hpa").over(_range(keys, t, span))).filter("_c = _own")
    return rows.select(
        *df.columns, F.coalesce(F.col("temp_c") <= 2, F.lit(False)).alias("cold"),
        F.coalesce(F.col("press_hpa") - F.col("_hi") <= -4, F.lit(False)).alias("falling"))


def daylight_margin(light_s: Column, distance_m: Column, speed_mps: Column) -> dict[str, Column]:
    """Seconds of light left over seconds of walking left, and its band; both NULL without a way to go or a speed."""
    ratio = light_s / (F.when(distance_m > 0, distance_m) / F.when(speed_mps != 0, speed_mps))
    return {"ratio": ratio, "band": F.when(ratio >= 1.5, "ample").when(ratio >= 1.0, "tight").when(ratio.isNotNull(), "short")}


def energy_budget(df: DataFrame, keys: list[str], days: int, conversion: float = 1.15, margin: float = 1.25) -> DataFrame:
    """Watt hours for ``days`` from hours a day in each power state, then with losses and margin."""
    out = df.groupBy(*keys).agg((F.sum(F.col("watts") * F.col("hours_per_day")) * days).alias("base_wh"))
    return out.withColumn("planned_wh", F.col("base_wh") * conversion * margin)
