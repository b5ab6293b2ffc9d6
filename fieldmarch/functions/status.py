"""Trail, arrival and return-deadline verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Thresholds (m), speeds (m/s) and margins (min) of the verdicts.
TRAIL_M, ON_TRAIL_M = 30.0, 20.0
ARRIVAL_M, ARRIVAL_MAX_ACCURACY_M = 10.0, 20.0
WALK_MPS, RETURN_MPS = 1.0, 0.8
RETURN_MARGIN_MIN, CAUTION_MIN = 30, 30


def trail_status(has_location: Column, fix: Column, offset: Column, accuracy: Column) -> Column:
    fix = F.coalesce(fix, F.lit(False))
    return (
        F.when(~has_location | offset.isNull(), "unavailable")
        .when(~fix, "last_fix_only")
        .when(accuracy.isNull(), F.when(offset > 2 * TRAIL_M, "off_trail_estimate").otherwise("accuracy_unknown"))
        .when(offset - accuracy > TRAIL_M, "off_trail")
        .when(offset + accuracy <= TRAIL_M, "on_trail")
        .otherwise("uncertain")
    )


def on_trail(offset: Column, accuracy: Column) -> Column:
    return offset <= F.greatest(F.lit(ON_TRAIL_M), F.coalesce(accuracy, F.lit(0.0)))


def arrival_status(available: Column, fix: Column, accuracy: Column, straight_m: Column) -> Column:
    return (
        F.when(~F.coalesce(available, F.lit(False)), "route_unavailable")
        .when(~F.coalesce(fix, F.lit(False)), "gps_fix_required")
        .when(accuracy.isNull(), "accuracy_required")
        .when(accuracy > ARRIVAL_MAX_ACCURACY_M, "accuracy_insufficient")
        .when(straight_m.isNull(), "route_unavailable")
        .when(straight_m <= F.greatest(F.lit(ARRIVAL_M), accuracy), "arrived")
        .otherwise("enroute")
    )


def eta_min(distance_m: Column, speed: float = WALK_MPS) -> Column:
    return F.ceil(distance_m / speed / 60.0)


def return_plan(has_location, fix, target_set, available, distance_m, sunset, now) -> dict[str, Column]:
    """Return deadline (epoch s), minutes left, status and level; ``sunset`` and ``now`` are epoch seconds."""
    travel = eta_min(distance_m, RETURN_MPS)
    deadline = sunset - (travel + RETURN_MARGIN_MIN) * 60
    left = F.floor((deadline - now) / 60.0)
    planned = has_location & F.coalesce(fix, F.lit(False)) & F.coalesce(available, F.lit(False)) & sunset.isNotNull()
    status = (
        F.when(~has_location, "gps_required").when(~F.coalesce(fix, F.lit(False)), "last_fix_only")
        .when(~F.coalesce(available, F.lit(False)), F.when(target_set, "route_unavailable").otherwise("basecamp_required"))
        .when(sunset.isNull(), "sun_event_unavailable")
        .when(left <= 0, "return_now").when(left <= CAUTION_MIN, "caution").otherwise("scheduled")
    )
    level = F.when(status == "return_now", "danger").when(status == "caution", "caution").when(status == "scheduled", "normal")
    return {
        "return_by": F.when(planned, deadline), "return_in_min": F.when(planned, left),
        "travel_min": F.when(planned, travel), "status": status, "level": F.coalesce(level, F.lit("unknown")),
    }
