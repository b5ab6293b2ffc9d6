"""Ordered-row operators that never put a whole device into one task.

A plain window over ``device_id`` makes one task sort everything that a device ever sent. Here
rows are cut into time chunks, each chunk is summarised with map-side combine, the short list of
summaries is scanned per device, and the scan result is joined back as a carry-in. Work on rows
is then done per ``(keys, chunk)``, so a device with a third of all rows is spread over all
its chunks. All results equal those of the plain window, whatever the chunk length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_S = 3600.0
CHUNK = "_chunk"


@dataclass(frozen=True)
class Carry:
    """What flows from earlier chunks: ``agg`` summarises a chunk, ``how`` combines the summaries."""

    name: str
    agg: Column
    how: str  # last | sum | max


def chunked(df: DataFrame, t: str | Column, chunk_s: float = CHUNK_S) -> DataFrame:
    t = F.col(t) if isinstance(t, str) else t
    return df.withColumn(CHUNK, F.floor(t / F.lit(float(chunk_s))).cast("bigint"))


def with_carry(df: DataFrame, keys: list[str], carries: list[Carry], tasks: int | None = None) -> DataFrame:
    """Add the combined summary of all earlier chunks of the same keys to every row; rows go to ``tasks`` tasks if given."""
    combine = {
        "last": lambda c: F.last(c, ignorenulls=True),
        "sum": F.sum,
        "max": F.max,
    }
    part = df.groupBy(*keys, CHUNK).agg(*[c.agg.alias(c.name) for c in carries])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(
        *keys, CHUNK, *[combine[c.how](F.col(c.name)).over(before).alias(c.name) for c in carries]
    )
    return (df.repartition(tasks, *keys, CHUNK) if tasks else df).join(part, [*keys, CHUNK])


def within(keys: list[str], *order) -> "Window":
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def previous(df: DataFrame, keys: list[str], order: list[str], cols: dict[str, str], tasks: int | None = None) -> DataFrame:
    """``lag`` of several columns over an already chunked table: ``cols`` maps new name to source.

    A row always has its chunk's predecessor or the newest row of the chunk before it.
    """
    row = F.struct(*[F.col(src).alias(new) for new, src in cols.items()])
    df = with_carry(df, keys, [Carry("_prev_in", F.max_by(row, F.struct(*order)), "last")], tasks)
    prev = F.coalesce(F.lag(row).over(within(keys, *order)), F.col("_prev_in"))
    return df.withColumn("_prev", prev).select(
        *[c for c in df.columns if c != "_prev_in"], *[F.col(f"_prev.{n}").alias(n) for n in cols]
    )


def running(df: DataFrame, keys: list[str], order: list[str], name: str, value: Column, how: str) -> DataFrame:
    """Running ``sum``, ``max`` or last non-null value up to and including each row."""
    agg = {"sum": F.sum, "max": F.max}.get(how)
    upto = within(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_v", value)
    if how == "last":
        summary = F.max_by(F.col("_v"), F.when(F.col("_v").isNotNull(), F.struct(*order)))
        local = F.last("_v", ignorenulls=True).over(upto)
        total = F.coalesce(local, F.col("_in"))
    else:
        summary, local = agg(F.col("_v")), agg(F.col("_v")).over(upto)
        seen = local.isNotNull() | F.col("_in").isNotNull()
        added = F.coalesce(local, F.lit(0)) + F.coalesce("_in", F.lit(0))
        total = F.when(seen, added) if how == "sum" else F.greatest(local, F.col("_in"))
    out = with_carry(df, keys, [Carry("_in", summary, how)])
    return out.withColumn(name, total).drop("_v", "_in")


def running_all(df: DataFrame, keys: list[str], order: list[str], cols: dict[str, tuple[Column, str]], tasks: int | None = None) -> DataFrame:
    """Several running values in one pass over the chunks: running ``sum``, or the ``last`` value that is not NULL, each up to its row.

    A register that can be emptied holds structs, whose members may be NULL.
    """
    upto = within(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    for i, (value, _) in enumerate(cols.values()):
        df = df.withColumn(f"_v{i}", value)
    carries = []
    for i, (_, how) in enumerate(cols.values()):
        v = F.col(f"_v{i}")
        carries.append(Carry(f"_in{i}", F.sum(v) if how == "sum" else F.max_by(v, F.when(v.isNotNull(), F.struct(*order))), how))
    out = with_carry(df, keys, carries, tasks)
    for i, (name, (_, how)) in enumerate(cols.items()):
        v, before = F.col(f"_v{i}"), F.col(f"_in{i}")
        local = F.coalesce(F.sum(v).over(upto), F.lit(0)) + F.coalesce(before, F.lit(0)) if how == "sum" else F.coalesce(F.last(v, ignorenulls=True).over(upto), before)
        out = out.withColumn(name, local)
    return out.drop(*[f"_v{i}" for i in range(len(cols))], *[f"_in{i}" for i in range(len(cols))])


def sequence_gaps(df: DataFrame, keys: list[str], t: str = "recv_s", chunk_s: float = CHUNK_S) -> DataFrame:
    """Flag rows whose ``seq`` does not follow the previous one (mod 2^32); a reboot is no gap."""
    out = previous(
        chunked(df, t, chunk_s), keys, [t, "seq"], {"prev_seq": "seq", "prev_uptime": "uptime_ms"}
    )
    gap = (F.col("uptime_ms") >= F.col("prev_uptime")) & (
        F.col("seq") != F.pmod(F.col("prev_seq") + 1, F.lit(4294967296))
    )
    return out.withColumn("seq_gap", F.coalesce(gap, F.lit(False))).drop(CHUNK)


def carry_fix(df: DataFrame, keys: list[str], t: str = "recv_s", chunk_s: float = CHUNK_S) -> DataFrame:
    """Give RMC fixes the satellites, hdop and altitude of the newest GGA fix before them.

    The three values travel as one struct, so a NULL that was present in the GGA still overwrites.
    """
    meta = F.struct("satellites", "hdop", "alt_m")
    fixes = chunked(df.filter("fix"), t, chunk_s)
    out = running(fixes, keys, [t], "_meta", F.when(F.col("sentence") == "GGA", meta), "last")
    return out.select(
        *[c for c in df.columns if c not in ("satellites", "hdop", "alt_m")],
        F.col("_meta.satellites").alias("satellites"),
        F.col("_meta.hdop").alias("hdop"),
        F.col("_meta.alt_m").alias("alt_m"),
    )


def drop_late(df: DataFrame, keys: list[str], t: str, arrival: str, chunk_s: float = CHUNK_S) -> DataFrame:
    """Drop rows older than one that arrived before them.

    The throttle can never keep such a row: the newer one was either kept, or lay inside the
    interval of a kept one, and the late row lies there too.
    """
    out = running(chunked(df, arrival, chunk_s), keys, [arrival], "_newest", F.col(t), "max")
    return out.filter(F.col(t) >= F.col("_newest")).drop("_newest", CHUNK)


def throttle(
    df: DataFrame, keys: list[str], t: str, interval_s: float = 10.0, order: str | None = None, chunk_s: float = CHUNK_S
) -> DataFrame:
    """Keep the first row, then every row at least ``interval_s`` after the last *kept* one.

    Which rows a chunk keeps depends on the earlier chunks only through its first kept row, and
    that row lies within one interval of the chunk's start. So every chunk reports, for each of
    those few possible entries, the time it would leave behind; the short reports are chained per
    keys (cut wherever silence makes the entry certain), and each chunk then folds once more
    with its real entry.
    """
    payload = [c for c in df.columns if c not in keys]
    rows = F.struct(F.col(t).alias("_t"), F.col(order or t).alias("_o"), F.struct(*payload).alias("_row"))
    per = (
        chunked(df, t, chunk_s)
        .groupBy(*keys, CHUNK)
        .agg(F.sort_array(F.collect_list(rows)).alias("_rows"))
        .withColumn("_ts", F.array_distinct(F.transform("_rows", lambda r: r["_t"])))
    )
    gap = F.lit(float(interval_s))
    head = F.get("_ts", F.lit(0))
    near = F.filter("_ts", lambda x: x < F.get(F.col("_ts"), F.lit(0)) + gap)
    entries = F.slice("_ts", F.lit(1), F.size(near) + 1)
    exits = F.transform(
        entries, lambda e: F.aggregate("_ts", e, lambda acc, x: F.when(x >= acc + gap, x).otherwise(acc))
    )
    report = per.select(
        *keys, CHUNK, head.alias("_head"), F.element_at("_ts", -1).alias("_tail"), F.arrays_zip(
            entries.alias("e"), exits.alias("x")).alias("_map"),
    )
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    fresh = F.coalesce(F.col("_head") >= F.lag("_tail").over(by_chunk) + gap, F.lit(True))
    report = report.withColumn("_seg", F.sum(fresh.cast("bigint")).over(by_chunk))

    state = "struct<last:double,entries:array<struct<chunk:bigint,carry:double>>>"
    zero = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast(
        "array<struct<chunk:bigint,carry:double>>").alias("entries")).cast(state)

    def chain(acc, c):
        hit = F.get(F.filter(c["_map"], lambda m: acc["last"].isNull() | (m["e"] >= acc["last"] + gap)), F.lit(0))
        seen = F.struct(c[CHUNK].alias("chunk"), acc["last"].alias("carry"))
        return F.struct(
            F.coalesce(hit["x"], acc["last"]).alias("last"), F.concat(acc["entries"], F.array(seen)).alias("entries")
        ).cast(state)

    links = (
        report.groupBy(*keys, "_seg")
        .agg(F.sort_array(F.collect_list(F.struct(CHUNK, "_map"))).alias("_chain"))
        .select(*keys, F.explode(F.aggregate("_chain", zero, chain)["entries"]).alias("_l"))
        .select(*keys, F.col("_l.chunk").alias(CHUNK), F.col("_l.carry").alias("_carry"))
    )
    kept_state = "struct<last:double,kept:array<double>>"
    start = F.struct(F.col("_carry").alias("last"), F.array().cast("array<double>").alias("kept")).cast(kept_state)

    def keep(acc, x):
        take = acc["last"].isNull() | (x >= acc["last"] + gap)
        return F.when(
            take, F.struct(x.alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept")).cast(kept_state)
        ).otherwise(acc)

    kept = per.join(links, [*keys, CHUNK]).withColumn("_kept", F.aggregate("_ts", start, keep)["kept"])
    picked = F.filter(
        "_rows",
        lambda r, i: F.array_contains(F.col("_kept"), r["_t"])
        & ((i == 0) | (F.get(F.col("_rows"), i - 1)["_t"] != r["_t"])),
    )
    out = kept.select(*keys, F.explode(picked).alias("_p"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_p._row.{c}").alias(c) for c in df.columns])


def automaton(
    df: DataFrame, keys: list[str], t: str, symbol: str, states: list[str], step: dict[tuple[str, str], str],
    name: str = "state", start: str | None = None, order: str | None = None, chunk_s: float = CHUNK_S,
) -> DataFrame:
    """State of a finite machine after every row; ``step`` maps (state, symbol) to the next state.

    Missing pairs leave the state alone. A chunk is a function from states to states, so each one
    reports where every start state would end; the reports are chained per keys (cut where a
    chunk ends in one state whatever came before), and rows are replayed from the real entry.
    """
    symbols = sorted({s for _, s in step})
    table = F.array(*[
        F.array(*[F.lit(states.index(step.get((s, y), s))) for y in symbols]) for s in states
    ])
    code = F.array_position(F.array(*[F.lit(y) for y in symbols]), F.col(symbol)).cast("int") - 1
    payload = [c for c in df.columns if c not in keys]
    rows = F.struct(
        F.col(t).alias("_t"), F.col(order or t).alias("_o"), F.coalesce(code, F.lit(-1)).alias("_y"),
        F.struct(*payload).alias("_row"),
    )
    per = chunked(df, t, chunk_s).groupBy(*keys, CHUNK).agg(F.sort_array(F.collect_list(rows)).alias("_rows"))

    def move(s, row):
        return F.when(row["_y"] < 0, s).otherwise(F.get(F.get(table, s), row["_y"]))

    ends = F.transform(
        F.array(*[F.lit(i) for i in range(len(states))]), lambda s: F.aggregate("_rows", s, move)
    )
    report = per.select(*keys, CHUNK, ends.alias("_ends"))
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    settled = F.lag(F.array_min("_ends") == F.array_max("_ends")).over(by_chunk)
    report = report.withColumn("_settled", F.when(settled, F.array_min(F.lag("_ends").over(by_chunk))))
    first = F.row_number().over(by_chunk) == 1
    begin = states.index(start or states[0])
    report = report.withColumn("_known", F.when(first, F.lit(begin)).otherwise(F.col("_settled")))
    report = report.withColumn("_seg", F.sum(F.col("_known").isNotNull().cast("bigint")).over(by_chunk))
    entries = "array<struct<chunk:bigint,entry:int>>"
    zero = F.struct(F.lit(begin).alias("s"), F.array().cast(entries).alias("e"))

    def chain(acc, c):
        entry = F.coalesce(c["_known"], acc["s"])
        seen = F.array(F.struct(c[CHUNK].alias("chunk"), entry.alias("entry")))
        return F.struct(F.get(c["_ends"], entry).alias("s"), F.concat(acc["e"], seen).cast(entries).alias("e"))

    links = (
        report.groupBy(*keys, "_seg")
        .agg(F.sort_array(F.collect_list(F.struct(CHUNK, "_ends", "_known"))).alias("_chain"))
        .select(*keys, F.explode(F.aggregate("_chain", zero, chain)["e"]).alias("_l"))
        .select(*keys, F.col("_l.chunk").alias(CHUNK), F.col("_l.entry").alias("_entry"))
    )
    path = F.aggregate(
        "_rows",
        F.struct(F.col("_entry").alias("s"), F.array().cast("array<int>").alias("p")),
        lambda acc, r: F.struct(move(acc["s"], r).alias("s"), F.concat(acc["p"], F.array(move(acc["s"], r))).alias("p")),
    )["p"]
    out = per.join(links, [*keys, CHUNK]).select(
        *keys, F.explode(F.arrays_zip(F.col("_rows"), path.alias("_path"))).alias("_z")
    )
    names = F.array(*[F.lit(s) for s in states])
    return out.select(
        *[F.col(c) if c in keys else F.col(f"_z._rows._row.{c}").alias(c) for c in df.columns],
        F.get(names, F.col("_z._path")).alias(name),
    )
