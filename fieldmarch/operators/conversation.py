"""Conversations of a voice interface: a timed automaton over heard segments, cut where silence makes its state certain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, discard
from .ordered import CHUNK, CHUNK_S, chunked, previous, running

# Waiting times (s) and limits of a short reply and of a waking segment.
COMMAND_WAIT_S, CONFIRM_WAIT_S, FOLLOWUP_WAIT_S = 10.0, 10.0, 6.0
WAKE_SPEECH_S, SHORT_REPLY_S, SHORT_REPLY_CHARS = (0.25, 4.0), 1.0, 2
STATES = ["idle", "await_command", "await_confirm", "followup"]
LONGEST_WAIT_S = max(COMMAND_WAIT_S, CONFIRM_WAIT_S, FOLLOWUP_WAIT_S)

_STAY, _GREET, _COMMAND = 0, 1, 2
_IDLE, _AWAIT_COMMAND, _AWAIT_CONFIRM, _FOLLOWUP = range(4)
_STATE = "struct<kind:int,until:double,moved:boolean>"


def _state(kind: Column, until: Column, moved: Column) -> Column:
    return F.struct(kind.cast("int").alias("kind"), until.cast("double").alias("until"), moved.alias("moved"))


def _now(s: Column, row: Column) -> Column:
    """The state in which a row is heard: idle once the wait is over."""
    return F.when((s["kind"] != _IDLE) & (row["t"] >= s["until"]), F.lit(_IDLE)).otherwise(s["kind"])


def _act(now: Column, row: Column) -> Column:
    return F.when(now == _IDLE, row["idle"]).when(now == _AWAIT_CONFIRM, row["confirm"]).otherwise(row["open"])


def _move(s: Column, row: Column) -> Column:
    now = _now(s, row)
    act = _act(now, row)
    stays = _state(now, s["until"], s["moved"] | (now != s["kind"]))
    return F.when(act == _GREET, _state(F.lit(_AWAIT_COMMAND), row["said"] + COMMAND_WAIT_S, F.lit(True))).when(
        act == _COMMAND, F.when(row["asks"], _state(F.lit(_AWAIT_CONFIRM), row["said"] + CONFIRM_WAIT_S, F.lit(True)))
        .otherwise(_state(F.lit(_FOLLOWUP), row["said"] + FOLLOWUP_WAIT_S, F.lit(True)))).otherwise(stays)


def conversation(segments: DataFrame, keys: list[str], t: str = "t_s", order: str = "seq", chunk_s: float = CHUNK_S) -> DataFrame:
    """What each heard segment does: rows ``keys, t, order, n, event, state``, ``n`` counting the events of a segment.

    ``segments`` has ``speech_s``, ``norm`` (normalised text), ``wake`` (whether it begins with a wake word), ``remainder`` (text after it),
    ``answer`` (yes, no or NULL), ``asks`` (whether the reply asks for confirmation) and ``said_at`` (when the reply ended). A wake word of
    0.25 to 4 s opens; a wait ends at its own deadline, counted from the end of the reply; a reply of at most 1 s that says yes, or says
    neither in at most two characters, confirms. ``state`` is the state in which an event happens.

    No wait outlasts 10 s after the last reply. Where a segment comes later than that, the state is idle whatever came before, so rows
    between such places, cut also at chunks, are worked alone. A piece that goes on over a chunk's end is a function of the state it is
    entered in: of the kind, and of which of its first rows the deadline lies before. Pieces report that and are chained.
    """
    c = F.col
    said = F.greatest(c(t), F.coalesce("said_at", c(t)))
    spoken = c("speech_s").between(*WAKE_SPEECH_S)
    bare = F.coalesce(c("remainder"), F.lit("")) == ""
    wake, norm = F.coalesce("wake", F.lit(False)), F.coalesce("norm", F.lit(""))
    opened = F.when(norm == "", _STAY).when(wake & bare, _GREET).otherwise(_COMMAND)
    few = F.length(F.replace(norm, F.lit(" "), F.lit(""))) <= SHORT_REPLY_CHARS
    short = F.coalesce((c("speech_s") > 0) & (c("speech_s") <= SHORT_REPLY_S) & ((c("answer") == "yes") | c("answer").isNull() & few), F.lit(False))
    df = segments.select(
        *keys, c(t).cast("double").alias("t"), c(order).alias("o"), said.alias("said"), F.coalesce("asks", F.lit(False)).alias("asks"), short.alias("short"),
        F.coalesce(spoken, F.lit(False)).alias("spoken"), F.when(F.coalesce(spoken, F.lit(False)) & wake, F.when(bare, _GREET).otherwise(_COMMAND)).otherwise(_STAY).alias("idle"),
        opened.alias("open"), F.when(short, _COMMAND).otherwise(opened).alias("confirm"))

    # silence: nothing that was said before can still be waited on
    df = running(chunked(df, "t", chunk_s), keys, ["t", "o"], "_reach", c("said") + LONGEST_WAIT_S, "max")
    df = previous(df, keys, ["t", "o"], {"_before": "_reach"})
    df = df.withColumn("_fresh", F.coalesce(c("t") >= c("_before"), F.lit(True)))
    # a written table: each running value reads its rows twice
    df = cut(running(df, keys, ["t", "o"], "_session", c("_fresh").cast("bigint"), "sum"))

    row = F.struct("t", "o", "said", "asks", "short", "spoken", "idle", "open", "confirm", "_before", "_fresh")
    pieces = df.groupBy(*keys, "_session", CHUNK).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    first = F.get("rows", F.lit(0))
    pieces = pieces.withColumn("starts", first["_fresh"])
    idle = _state(F.lit(_IDLE), F.lit(0.0), F.lit(False))

    # times of the first rows that the entry's deadline may lie before or after; it lies before all the others
    heads = F.transform(F.filter("rows", lambda r: r["t"] < first["_before"]), lambda r: r["t"])
    entered = pieces.filter("NOT starts").withColumn("heads", F.array_distinct(heads))
    ends = F.concat("heads", F.array(first["_before"]))
    fold = lambda kind: F.transform(ends, lambda e: F.aggregate("rows", _state(F.lit(kind), e, F.lit(False)), _move))
    report = entered.select(*keys, "_session", CHUNK, F.struct(
        F.lit(False).alias("starts"), F.col("heads"), F.aggregate("rows", idle, _move).alias("idle"), fold(_FOLLOWUP).alias("open"), fold(_AWAIT_CONFIRM).alias("confirm")).alias("r"))
    # a session's first piece is entered idle; its exit is known
    spans = entered.select(*keys, "_session").distinct()
    begun = pieces.filter("starts").join(spans, [*keys, "_session"], "left_semi").select(*keys, "_session", CHUNK, F.aggregate("rows", idle, _move).alias("exit"))

    links = "array<struct<chunk:bigint,entry:struct<kind:int,until:double,moved:boolean>>>"
    zero = F.struct(c("exit").cast(_STATE).alias("s"), F.array().cast(links).alias("e"))

    def chain(acc: Column, p: Column) -> Column:
        s = acc["s"]
        at = F.size(F.filter(p["r"]["heads"], lambda h: h < s["until"]))
        out = F.when(s["kind"] == _IDLE, p["r"]["idle"]).otherwise(
            F.when(s["kind"] == _AWAIT_CONFIRM, F.get(p["r"]["confirm"], at)).otherwise(F.get(p["r"]["open"], at)))
        # a piece in which nothing moves hands the entry on
        left = F.when(out["moved"], out).otherwise(s)
        seen = F.struct(p["chunk"].alias("chunk"), s.alias("entry"))
        return F.struct(left.cast(_STATE).alias("s"), F.concat(acc["e"], F.array(seen)).cast(links).alias("e"))

    chained = (
        report.groupBy(*keys, "_session").agg(F.sort_array(F.collect_list(F.struct(c(CHUNK).alias("chunk"), "r"))).alias("ps")).join(begun.drop(CHUNK), [*keys, "_session"])
        .select(*keys, "_session", F.explode(F.aggregate("ps", zero, chain)["e"]).alias("l"))
        .select(*keys, "_session", c("l.chunk").alias(CHUNK), c("l.entry").alias("entry"))
    )
    known = pieces.join(chained, [*keys, "_session", CHUNK], "left").withColumn("entry", F.coalesce(c("entry").cast(_STATE), idle.cast(_STATE)))

    path = "array<struct<kind:int,until:double,moved:boolean>>"
    start = F.struct(c("entry").alias("s"), F.array().cast(path).alias("p"))
    walk = F.aggregate("rows", start, lambda acc, r: F.struct(
        _move(acc["s"], r).cast(_STATE).alias("s"), F.concat(acc["p"], F.array(acc["s"])).cast(path).alias("p")))["p"]
    rows = known.select(*keys, CHUNK, F.explode(F.arrays_zip("rows", walk.alias("was"))).alias("z")).select(
        *keys, CHUNK, c("z.rows.t").alias("t"), c("z.rows.o").alias("o"), c("z.rows").alias("r"), c("z.was").alias("was"))
    done = cut(rows.withColumn("after", _move(c("was"), c("r"))["kind"]))
    # what a session that silence ended was waiting for
    rows = previous(done, keys, ["t", "o"], {"left": "after"})
    rows = rows.withColumn("was", F.when(c("r._fresh"), _state(F.coalesce("left", F.lit(_IDLE)), F.lit(float("-inf")), F.lit(False)).cast(_STATE)).otherwise(c("was").cast(_STATE)))
    rows = rows.withColumn("now", _now(c("was"), c("r"))).withColumn("act", _act(c("now"), c("r")))
    name = lambda k: F.get(F.array(*[F.lit(s) for s in STATES]), k)
    event = lambda e, at: F.struct(e.alias("event"), name(at).alias("state"))
    over = F.when(c("now") != c("was.kind"), event(F.lit("timeout"), c("was.kind")))
    confirmed = F.when((c("now") == _AWAIT_CONFIRM) & c("r.short"), event(F.lit("short_confirm"), c("now")))
    quiet = F.when(c("now") != _IDLE, "empty").when(~c("r.spoken"), "ignored_length").otherwise("no_wake")
    does = event(F.when(c("act") == _GREET, "wake").when(c("act") == _COMMAND, "command").otherwise(quiet), c("now"))
    out = rows.select(*keys, c("t").alias(t), c("o").alias(order), F.posexplode(F.array_compact(F.array(over, confirmed, does))).alias("n", "e"))
    discard(df)
    return out.select(*keys, t, order, "n", "e.event", "e.state")
