"""A device's log of stored places: what each command does, given all commands before it.

The places, the pending destination, the night flag and the selection are registers. What a command writes depends on other registers
only, never on the whole log, so they are settled in layers: each layer is a running sum or a last writer over ordered rows, cut in time
chunks with carried summaries, and later layers read the registers of earlier ones as they were before the row. A switch that refers to
its own value (toggle, "clear if selected") is the last constant written and what came after it. No device is one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, discard
from .fleet import CHECKPOINTS_KEPT, COMMANDS
from .ordered import CHUNK, CHUNK_S, chunked, previous, running_all

# Kinds of places and commands of the map screen.
KINDS = ["basecamp", "destination", "checkpoint"]
SCREEN = ["save_current", "set", "select", "remove"]
#: A task gets about so many commands, so what it sorts does not grow with the log.
ROWS_A_TASK = 100_000


def _point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def _written(*cases: tuple[Column, Column]) -> Column:
    """A write of the first case that holds, as a struct; NULL where nothing is written."""
    first, *rest = cases
    return reduce(lambda acc, c: acc.when(c[0], F.struct(c[1].alias("v"))), rest, F.when(first[0], F.struct(first[1].alias("v"))))


def _with_removal(df: DataFrame, removed: DataFrame, keys: list[str], by: list[str], tasks: int) -> DataFrame:
    """``_removed_at`` of the checkpoint ``_k``; rows that name none are dealt by a number below all checkpoints, not to one task a device."""
    at = F.coalesce("_k", -1 - F.pmod(F.xxhash64(*by), F.lit(1 << 20)))
    rows = df.withColumn("_at_k", at).repartition(tasks, *keys, "_at_k")
    return rows.join(removed.withColumnRenamed("_k", "_at_k").hint("merge"), [*keys, "_at_k"], "left").drop("_at_k")


def waypoint_log(commands: DataFrame, keys: list[str], t: str = "t_s", order: str = "event_id", chunk_s: float = CHUNK_S) -> DataFrame:
    """Each command with ``status`` and the registers after it.

    ``commands`` has the keys, time, ``order`` (unique in a key, decides equal times), ``action``, ``kind`` and ``id`` (of screen commands),
    ``fix, lat, lon`` (the live fix; for ``set`` the place given), ``poi_lat, poi_lon`` (nearest water) and ``ago_lat, ago_lon`` (three
    minutes ago). Out come ``status`` (accepted, rejected, confirmation_required or ignored), ``seq`` (voice commands so far), ``n_saved``
    (checkpoints so far, which number them), ``selected``, ``night``, ``base_lat, base_lon, dest_lat, dest_lon``.

    A checkpoint is there while it is one of the fifty newest and not removed. An action that is not known is ignored.
    """
    c, action = F.col, F.col("action")
    by = [t, order]
    spot = F.struct(*by)
    null = F.lit(None)
    live = F.coalesce(c("fix"), F.lit(False)) & c("lat").isNotNull() & c("lon").isNotNull()
    given = c("lat").between(-90, 90) & c("lon").between(-180, 180)
    put = (
        F.when((action == "save_basecamp") & live, "basecamp").when((action == "save_checkpoint") & live, "checkpoint")
        .when((action == "route_recent_trace") & live & c("ago_lat").isNotNull(), "checkpoint")
        .when(((action == "save_current") & live | (action == "set")) & given & c("kind").isin(KINDS), c("kind"))
    )
    place = F.when(action == "route_recent_trace", _point(c("ago_lat"), c("ago_lon"))).otherwise(_point(c("lat"), c("lon")))
    named = F.when(action.isin("select", "remove"), F.coalesce(F.when(c("id") != "", c("id")), c("kind")))
    number = F.when(named.rlike("^checkpoint-[1-9][0-9]{0,17}$"), F.substring(named, 12, 18).try_cast("bigint"))
    df = chunked(commands, t, chunk_s).withColumn("_put", put).withColumn("_place", place).withColumn("_named", named).withColumn("_k", number)
    df = df.withColumn("_voice", action.isin(COMMANDS))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, commands.count() // ROWS_A_TASK + 1)

    # what no other register decides
    sought = (action == "find_nearest_water") & live & c("poi_lat").isNotNull()
    drops = action.isin("clear_destination", "confirm_destination", "reject_destination", "cancel")
    df = running_all(df, keys, by, {
        "seq": (c("_voice").cast("bigint"), "sum"),
        "n_saved": ((c("_put") == "checkpoint").cast("bigint"), "sum"),
        "_toggles": ((action == "night_toggle").cast("bigint"), "sum"),
        "_pending": (_written((sought, _point(c("poi_lat"), c("poi_lon"))), (drops, null.cast("struct<lat:double,lon:double>"))), "last"),
        "_base": (_written((c("_put") == "basecamp", c("_place")), ((action == "remove") & (c("_named") == "basecamp"), null.cast("struct<lat:double,lon:double>"))), "last"),
    }, tasks)
    # a written table between the layers: each of them reads its rows twice
    first = df = cut(previous(df, keys, by, {"_pending_before": "_pending", "_base_before": "_base", "_saved_before": "n_saved"}, tasks))
    pending, saved = c("_pending_before.v"), F.coalesce("_saved_before", F.lit(0))

    # the destination, which a pending one may become; the night, which a toggle turns
    gone = (action == "clear_destination") | (action == "remove") & (c("_named") == "destination")
    df = running_all(df, keys, by, {
        "_dest": (_written((c("_put") == "destination", c("_place")), ((action == "confirm_destination") & pending.isNotNull(), pending),
                           (gone, null.cast("struct<lat:double,lon:double>"))), "last"),
        "_night": (F.when(action.isin("night_on", "night_off"), F.struct((action == "night_on").alias("on"), c("_toggles").alias("at"))), "last"),
    }, tasks)
    second = df = cut(previous(df, keys, by, {"_dest_before": "_dest"}, tasks))
    discard(first)

    # when each checkpoint was removed: the first removal after it was saved
    saves = df.filter("_put = 'checkpoint'").select(*keys, c("n_saved").alias("_k"), spot.alias("_saved_at"))
    removals = df.filter((action == "remove") & c("_k").isNotNull()).select(*keys, "_k", spot.alias("_at"))
    removed = cut(removals.repartition(tasks, *keys, "_k").join(saves, [*keys, "_k"]).filter("_at > _saved_at").groupBy(*keys, "_k").agg(F.min("_at").alias("_removed_at")))

    # the newest checkpoint that is left, asked for by a route: mostly the last one saved, else one of the fifty before
    df = df.withColumn("_k", F.when(action == "route_last_checkpoint", F.when(saved > 0, saved)).otherwise(c("_k")))
    df = _with_removal(df, removed, keys, by, tasks)
    there = (c("_k") <= saved) & (saved - c("_k") < CHECKPOINTS_KEPT) & F.coalesce(c("_removed_at") >= spot, F.lit(True))
    df = df.withColumn("_there", F.coalesce(there, F.lit(False)))
    lost = df.filter((action == "route_last_checkpoint") & (saved > 0) & ~c("_there")).select(*keys, *by, F.explode(
        F.sequence(F.greatest(F.lit(1), saved - CHECKPOINTS_KEPT + 1), saved)).alias("_k"))
    older = lost.repartition(tasks, *keys, "_k").join(removed, [*keys, "_k"], "left").filter(F.coalesce(c("_removed_at") > spot, F.lit(True))).groupBy(*keys, *by).agg(F.max("_k").alias("_older"))
    df = df.repartition(tasks, *keys, *by).join(older, [*keys, *by], "left")
    last = F.when(action == "route_last_checkpoint", F.when(c("_there"), c("_k")).otherwise(c("_older")))

    # what each command comes to
    at_place = F.concat(F.lit("checkpoint-"), c("n_saved").cast("string"))
    base, dest = c("_base_before.v").isNotNull(), c("_dest_before.v").isNotNull()
    known = F.when(c("_named") == "basecamp", base).when(c("_named") == "destination", dest).otherwise(c("_there"))
    target = (
        F.when((action == "route_basecamp") & base & live, "basecamp").when((action == "route_destination") & dest & live, "destination")
        .when((action == "route_last_checkpoint") & last.isNotNull() & live, F.concat(F.lit("checkpoint-"), last.cast("string")))
        .when((action == "select") & known, c("_named"))
    )
    chosen = (
        F.when(c("_put") == "checkpoint", at_place).when(c("_put").isNotNull(), c("_put")).when(target.isNotNull(), target)
        .when((action == "confirm_destination") & pending.isNotNull(), "destination")
    )
    done = (
        chosen.isNotNull() | action.isin("night_on", "night_off", "night_toggle", "status", "reject_destination", "cancel")
        | (action == "clear_destination") & dest | (action == "remove")
    )
    status = F.when(sought, "confirmation_required").when(done, "accepted").when(c("_voice") | action.isin(SCREEN), "rejected").otherwise("ignored")
    third = df = cut(df.withColumn("status", status).withColumn("_chosen", chosen))
    discard(second)

    # the selection: the last one chosen, unless its place was taken away since
    cleared = F.when((action == "clear_destination") & dest | (action == "remove") & (c("_named") == "destination"), spot)
    df = running_all(df, keys, by, {
        "_select": (F.when(c("_chosen").isNotNull(), F.struct(c("_chosen").alias("id"), spot.alias("at"))), "last"),
        "_dest_gone": (cleared, "last"),
        "_base_gone": (F.when((action == "remove") & (c("_named") == "basecamp"), spot), "last"),
    }, tasks)
    mark = F.when(c("_select.id").startswith("checkpoint-"), F.substring(c("_select.id"), 12, 18).cast("bigint"))
    df = _with_removal(df.drop("_k", "_removed_at").withColumn("_k", mark), removed, keys, by, tasks)
    away = (
        F.when(c("_select.id") == "destination", c("_dest_gone") > c("_select.at")).when(c("_select.id") == "basecamp", c("_base_gone") > c("_select.at"))
        .otherwise(c("_removed_at") <= spot)
    )
    flipped = (c("_toggles") - F.coalesce("_night.at", F.lit(0))) % 2 == 1
    out = cut(df.select(
        *commands.columns, "status", "seq", "n_saved", F.when(~F.coalesce(away, F.lit(False)), c("_select.id")).alias("selected"),
        (F.coalesce("_night.on", F.lit(False)) != flipped).alias("night"), c("_base.v.lat").alias("base_lat"), c("_base.v.lon").alias("base_lon"),
        c("_dest.v.lat").alias("dest_lat"), c("_dest.v.lon").alias("dest_lon")))
    for table in (third, removed):
        discard(table)
    return out
