"""Lookups in time: nearest record with a tolerance, and the newest state of each device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Default look-back and tolerance (s) and the age at which a reading is stale (s).
TRACE_AGE_S, TRACE_GAP_S = 180.0, 25.0
STALE_AFTER_S = 3.0
RETENTION_S = 21_600.0


def point_ago(
    requests: DataFrame, positions: DataFrame, keys: list[str], now: str, t: str,
    age_s: float = TRACE_AGE_S, gap_s: float = TRACE_GAP_S,
) -> DataFrame:
    """The position nearest to ``now - age_s``; NULL beyond ``gap_s`` (inclusive); first on a tie.

    A range join as an equi-join: time is cut into buckets of one gap, and a request looks into
    its own bucket and both neighbours, so nothing within the gap is missed and one device's rows
    spread over its buckets. Only the best record of each request leaves the join.
    """
    if age_s <= 0:
        return requests.withColumn("found_t", F.lit(None).cast("double"))
    req = requests.withColumn("_target", F.col(now) - F.lit(age_s))
    req = req.withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("_target") / gap_s) - 1, F.floor(F.col("_target") / gap_s) + 1))
    )
    cols = [c for c in positions.columns if c not in keys]
    pos = positions.select(
        *keys, F.col(t).alias("_t"), F.floor(F.col(t) / gap_s).alias("_b"), F.struct(*cols).alias("_pos")
    )
    hit = req.join(pos, [*keys, "_b"]).withColumn("_gap", F.abs(F.col("_t") - F.col("_target")))
    best = (
        hit.filter(F.col("_gap") <= gap_s)
        .groupBy(*keys, now)
        .agg(F.min_by(F.struct("_gap", "_pos"), F.struct("_gap", "_t")).alias("_best"))
    )
    return (
        requests.join(best, [*keys, now], "left")
        .select(
            *requests.columns,
            F.col("_best._gap").alias("found_gap_s"),
            *[F.col(f"_best._pos.{c}").alias(f"found_{c}") for c in cols],
        )
    )


def newest(df: DataFrame, keys: list[str], t: str, parts: dict[str, Column]) -> DataFrame:
    """Newest non-null value of each part with its time: one aggregation, combined on the map side."""
    aggs = []
    for name, value in parts.items():
        order = F.when(value.isNotNull(), F.col(t))
        aggs += [F.max_by(value, order).alias(name), F.max(order).alias(f"{name}_t")]
    return df.groupBy(*keys).agg(F.max(t).alias("last_t"), *aggs)


def stale(age: Column, limit_s: float = STALE_AFTER_S) -> Column:
    return F.coalesce(age > limit_s, F.lit(True))
