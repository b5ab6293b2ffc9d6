"""Positions along routes: progress with ambiguity rejection, deviation, points at a distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import settle
from ..functions.geo import EARTH_R_VOICE_M, M_PER_DEG_LAT, M_PER_DEG_LON, haversine_m
from ..session import cut, discard
from .ordered import CHUNK, CHUNK_S, chunked, previous, running

# Limits (m) of the progress rule and of the route deviation.
CACHE_CROSS_TRACK_M, BACKTRACK_M = 8.0, 3.0
TIE_CROSS_TRACK_M, TIE_PROGRESS_M = 0.75, 5.0
DEVIATION_M = 30.0


def route_profile(routes: DataFrame, key: str = "route_id") -> DataFrame:
    """``key, segs, total_m``: the segments of each route (``points``) with the metres before and after.

    Running sums are windows over a route's own vertices, both ways.
    """
    pts = routes.select(key, F.posexplode("points").alias("i", "p"))
    w = Window.partitionBy(key).orderBy("i")
    seg = pts.select(
        key, "i", F.col("p.lon").alias("lon_a"), F.col("p.lat").alias("lat_a"),
        F.lead("p.lon").over(w).alias("lon_b"), F.lead("p.lat").over(w).alias("lat_b"),
    ).filter("lon_b IS NOT NULL")
    seg = seg.withColumn("len", haversine_m(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b")))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(key).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    seg = seg.withColumn("before", F.coalesce(F.sum("len").over(before), zero))
    seg = seg.withColumn("after", F.coalesce(F.sum("len").over(after), zero))
    row = F.struct("i", "lon_a", "lat_a", "lon_b", "lat_b", "len", "before", "after")
    return seg.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("segs"), F.sum("len").alias("total_m"))


def _projected(segs: Column, lon: Column, lat: Column) -> Column:
    """The nearest place on every segment; NULL for one without length.

    Each step of the arithmetic is a pass of its own over the segments, so a value that is used many times is worked out once.
    """
    def scale(s):
        mid = F.radians((lat + s["lat_a"] + s["lat_b"]) / 3.0)
        return F.struct(s.alias("s"), (M_PER_DEG_LON * F.greatest(F.lit(0.15), F.cos(mid))).alias("sx"))

    def legs(e):
        s, sx = e["s"], e["sx"]
        ax, ay = (s["lon_a"] - lon) * sx, (s["lat_a"] - lat) * M_PER_DEG_LAT
        dx, dy = (s["lon_b"] - lon) * sx - ax, (s["lat_b"] - lat) * M_PER_DEG_LAT - ay
        return F.struct(s.alias("s"), ax.alias("ax"), ay.alias("ay"), dx.alias("dx"), dy.alias("dy"), (dx * dx + dy * dy).alias("len2"))

    def share(e):
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(e["ax"] * e["dx"] + e["ay"] * e["dy"]) / e["len2"]))
        return F.struct(e.alias("e"), F.when(e["len2"] > 0, u).alias("u"))

    def place(x):
        e, s, u = x["e"], x["e"]["s"], x["u"]
        return F.when(e["len2"] > 0, F.struct(
            F.sqrt(F.pow(e["ax"] + u * e["dx"], 2) + F.pow(e["ay"] + u * e["dy"], 2)).alias("cross"),
            (s["before"] + s["len"] * u).alias("progress"),
            (s["len"] * (1.0 - u) + s["after"]).alias("remaining"),
            (s["i"] + 1).alias("next"),
        ))

    return reduce(F.transform, (scale, legs, share, place), segs)


def candidates(positions: DataFrame, profile: DataFrame, key: str = "route_id") -> DataFrame:
    """Add ``spots``: the nearest place on every segment of the position's route."""
    spots = F.array_compact(_projected(F.col("segs"), F.col("lon"), F.col("lat")))
    return positions.join(profile, key).withColumn("spots", spots).drop("segs")


def progress(positions: DataFrame, profile: DataFrame, key: str = "route_id", minimum: str = "min_progress_m") -> DataFrame:
    """Add ``at``: cross track, progress, remaining metres and next vertex on the position's route.

    Only places not more than 3 m behind the progress so far count. Near ties in cross track must
    agree on progress within 5 m, or the place is ambiguous and ``at`` is NULL. The work is row
    by row, on the route's own segments; positions are shuffled only for the join on the route.
    Places, the best of them and the ties are settled one after the other: put together, they would be worked out again for every segment.
    """
    low = F.col(minimum)
    joined = positions.join(profile, key, "left")
    joined = settle(joined, _all=_projected(F.col("segs"), F.col("lon"), F.col("lat")))
    joined = settle(joined, _spots=F.filter("_all", lambda c: c.isNotNull() & (c["progress"] + BACKTRACK_M >= low)))
    joined = settle(joined, _best=F.array_min(F.transform("_spots", lambda c: c["cross"])))
    ties = F.filter("_spots", lambda c: c["cross"] <= F.col("_best") + TIE_CROSS_TRACK_M)
    joined = settle(joined, _ties=F.transform(ties, lambda c: F.struct(
        c["cross"].alias("cross"), F.abs(c["progress"] - low).alias("jump"), c["next"].alias("next"),
        c["progress"].alias("progress"), c["remaining"].alias("remaining"))))
    along = F.transform("_ties", lambda c: c["progress"])
    clear = (F.array_max(along) - F.array_min(along)) <= TIE_PROGRESS_M
    return joined.withColumn("at", F.when(clear & (F.col("total_m") > 0), F.array_min("_ties"))).drop(
        "_all", "_spots", "_best", "_ties", "segs")


def deviation_m(lon: Column, lat: Column, segs: Column) -> Column:
    """Distance to the nearest segment of a route in the display's flat projection."""
    def dist(s):
        kx = M_PER_DEG_LON * F.cos(F.radians(lat))
        ax, ay = (s["lon_a"] - lon) * kx, (s["lat_a"] - lat) * M_PER_DEG_LON
        dx, dy = (s["lon_b"] - lon) * kx - ax, (s["lat_b"] - lat) * M_PER_DEG_LON - ay
        len2 = dx * dx + dy * dy
        u = F.when(len2 == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / len2)))
        return F.sqrt(F.pow(ax + dx * u, 2) + F.pow(ay + dy * u, 2))

    return F.array_min(F.transform(segs, dist))


def point_along(segs: Column, metres: Column) -> Column:
    """Place ``metres`` along a route's segments, with ``done`` once the end is passed."""
    hit = F.get(F.filter(segs, lambda s: metres <= s["before"] + s["len"]), F.lit(0))
    share = F.when(hit["len"] == 0, 0.0).otherwise((metres - hit["before"]) / hit["len"])
    last = F.element_at(segs, -1)
    return F.struct(
        F.coalesce(hit["lon_a"] + (hit["lon_b"] - hit["lon_a"]) * share, last["lon_b"]).alias("lon"),
        F.coalesce(hit["lat_a"] + (hit["lat_b"] - hit["lat_a"]) * share, last["lat_b"]).alias("lat"),
        hit.isNull().alias("done"),
    )


def path_length(points: Column, radius: float = EARTH_R_VOICE_M) -> Column:
    """Length of a vertex array."""
    legs = F.zip_with(
        F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1),
        lambda a, b: haversine_m(a["lon"], a["lat"], b["lon"], b["lat"], radius))
    return F.when(F.size(points) < 2, 0.0).otherwise(F.aggregate(legs, F.lit(0.0), lambda s, x: s + x))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, also inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pick(spots: Column, low: Column) -> Column:
    """The place among ``spots`` that goes on from ``low`` metres; NULL if there is none, or near ties disagree, or it is over 8 m away."""
    def of_ties(ties):
        along = F.transform(ties, lambda s: s["progress"])
        clear = (F.array_max(along) - F.array_min(along) <= TIE_PROGRESS_M) & (F.array_min(ties)["cross"] <= CACHE_CROSS_TRACK_M)
        return F.when(clear, F.array_min(ties))

    def of_best(ahead, best):
        return _let(F.transform(F.filter(ahead, lambda s: s["cross"] <= best + TIE_CROSS_TRACK_M), lambda s: F.struct(
            s["cross"].alias("cross"), F.abs(s["progress"] - low).alias("jump"), s["progress"].alias("progress"), s["remaining"].alias("remaining"))), of_ties)

    def of_ahead(ahead):
        return _let(F.array_min(F.transform(ahead, lambda s: s["cross"])), lambda best: of_best(ahead, best))

    return _let(F.filter(spots, lambda s: s["progress"] + BACKTRACK_M >= low), of_ahead)


def follow(positions: DataFrame, keys: list[str], t: str = "t_s", order: str = "event_id", chunk_s: float = CHUNK_S) -> DataFrame:
    """Progress along the route that only grows: each position without its ``spots``, with ``reroute``, ``progress_m`` and ``remaining_m``.

    ``positions`` has ``route_id`` and ``spots`` (:func:`candidates`). Progress starts at 0 and again when a key's route changes. A place counts
    if it lies no more than 3 m behind the progress before it and within 8 m; else a new route is asked for and the progress stays.

    Places farther than 8 m and the width of a tie can neither count nor tie with one that does, so they are left behind first. A chunk of
    positions is walked in order from the progress that it enters with, and the largest progress that earlier chunks leave is the entry of
    the next; when no entry changes, it is the one that walking in order gives. A round settles at least one more chunk of each
    route, mostly all of them, and only chunks with a new entry are walked again.
    """
    by, c = [t, order], F.col
    payload = [x for x in positions.columns if x not in (*keys, "spots")]
    near = F.filter("spots", lambda s: s["cross"] <= CACHE_CROSS_TRACK_M + TIE_CROSS_TRACK_M)
    base = cut(chunked(positions.select(*keys, *payload, F.transform(near, lambda s: F.struct(*[s[x].alias(x) for x in ("cross", "progress", "remaining")])).alias("spots")), t, chunk_s))
    df = previous(base, keys, by, {"_was": "route_id"})
    df = running(df, keys, by, "_leg", (~c("_was").eqNullSafe(c("route_id"))).cast("bigint"), "sum").drop("_was")
    at = [*keys, "_leg", CHUNK]
    row = F.struct(c(t).alias("_t"), c(order).alias("_o"), F.struct(*payload).alias("_row"), c("spots").alias("_spots"))
    walked = cut(df.groupBy(*at).agg(F.sort_array(F.collect_list(row)).alias("_rows")))
    discard(base)
    leave = F.aggregate("_rows", c("_entry"), lambda p, r: F.greatest(p, _pick(r["_spots"], p)["progress"]))
    state = cut(walked.withColumn("_entry", F.lit(0.0)).select(*at, "_entry", leave.alias("_exit")))
    earlier = Window.partitionBy(*keys, "_leg").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    while True:
        moved = state.withColumn("_next", F.coalesce(F.max("_exit").over(earlier), F.lit(0.0)))
        new = cut(moved.filter("_next <> _entry").select(*at, c("_next").alias("_entry")))
        if new.isEmpty():
            break
        again = walked.join(new, at).select(*at, c("_entry").alias("_in"), leave.alias("_out"))
        before, state = state, cut(state.join(again, at, "left").select(*at, F.coalesce("_in", "_entry").alias("_entry"), F.coalesce("_out", "_exit").alias("_exit")))
        for table in (before, new):
            discard(table)
    spot = "struct<cross:double,jump:double,progress:double,remaining:double>"
    start = F.struct(c("_entry").alias("p"), F.array().cast(f"array<struct<at:{spot},after:double>>").alias("seen"))

    def step(acc, r):
        def seen(found):
            after = F.greatest(acc["p"], found["progress"])
            return F.struct(after.alias("p"), F.concat(acc["seen"], F.array(F.struct(found.cast(spot).alias("at"), after.alias("after")))).alias("seen"))

        return _let(_pick(r["_spots"], acc["p"]), seen)

    path = F.aggregate("_rows", start, step)["seen"]
    out = walked.join(state.select(*at, "_entry"), at).select(*keys, F.explode(F.arrays_zip(c("_rows"), path.alias("_path"))).alias("_z"))
    return out.select(
        *[c(x) if x in keys else c(f"_z._rows._row.{x}").alias(x) for x in positions.columns if x != "spots"],
        c("_z._path.at").isNull().alias("reroute"), c("_z._path.after").alias("progress_m"), c("_z._path.at.remaining").alias("remaining_m"))
