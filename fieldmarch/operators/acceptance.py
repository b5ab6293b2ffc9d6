"""Acceptance of observed runs: events folded into runs by an allow-list, checks with their evidence rules, verdicts of runs and sessions.

Payloads are read in Python, a batch of events at a time: Spark's own readers take ten times as long over such short objects, or lose
what is text and what is not.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Budgets (ms), memory floor (MB), cases of the matrix, trusted sources, and the fields each event may set.
PATH_A_BUDGET_MS, PATH_B_BUDGET_MS = 3500.0, 2000.0
MEMORY_FLOOR_MB = 1024
MATRIX_CASES = 21
ORIGINS = ["hardware_observation", "operator_observation"]
EVENT_FIELDS: dict[str, list[str]] = {
    "button_release": ["button_release_monotonic_ns", "button_release_source", "observed"],
    "first_sound": ["first_sound_monotonic_ns", "first_sound_source", "first_sound_method", "loopback_observed", "observed"],
    "stt": ["stt_exit_code", "stt_false_positive_keywords", "stt_expected_keywords_missed", "stt_recall_ok", "observed"],
    "resources": ["mem_available_min_mb", "swap_before_mb", "swap_after_mb", "swap_delta_mb", "observed"],
    "concurrency": [
        "stt_tts_overlap", "stt_start_monotonic_ns", "stt_end_monotonic_ns", "tts_start_monotonic_ns", "tts_end_monotonic_ns", "observed"],
    "network": ["external_connections", "observed"],
}
#: These set any field.
OPEN_EVENTS = ["run", "complete"]
RUN_FIELDS = ["simulated", "evidence_origin", "path", "button_release_to_first_sound_ms", "tts_pcm_valid", "tts_playback_observed", "tts_engine", "complete"]
FIELDS = sorted({*RUN_FIELDS, *(f for fs in EVENT_FIELDS.values() for f in fs)})
MATRIX_FIELDS = ["stt_cases", "stt_false_positive_keywords", "stt_expected_keywords_missed", "stt_recall_ok", "observed"]
ALLOWED = {event: frozenset(fields) for event, fields in EVENT_FIELDS.items()} | {event: frozenset(FIELDS) for event in OPEN_EVENTS}
MATRIX = frozenset(MATRIX_FIELDS)
_WHOLE_LIMIT = float(1 << 63)


class _Rejected(ValueError):
    pass


def _members(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Rejected("a name is given twice")
    return out


def _constant(name: str) -> None:
    raise _Rejected(name)


_JSON = json.JSONDecoder(object_pairs_hook=_members, parse_constant=_constant)


def _object(payload: bytes | None) -> dict | None:
    """The members of a JSON object; None for anything else. What follows the object is not read."""
    text = "" if payload is None else payload.decode("utf-8", "replace").lstrip(" \t\r\n")
    if not text.startswith("{"):
        return None
    try:
        return _JSON.raw_decode(text)[0]
    except (ValueError, RecursionError):
        return None


def _number(value) -> float | None:
    """A finite number; text and flags are none."""
    if type(value) is not int and type(value) is not float:
        return None
    try:
        value = float(value)
    except OverflowError:
        return None
    return value if math.isfinite(value) else None


def _whole(value) -> float | None:
    n = _number(value)
    return n if n is not None and abs(n) <= _WHOLE_LIMIT and n == math.floor(n) else None


def _read(payload: bytes | None, requested) -> tuple[str | None, int | None, dict | None]:
    """Event, run and members of a payload; without a run it counts for none.

    A payload is a JSON object; without an ``event`` it is a run's; all but the matrix name a whole run from 1 to ``requested``.
    """
    members = _object(payload)
    if members is None:
        return None, None, None
    event = members.get("event")
    if event in (None, "", "false", "0") or (isinstance(event, bool | int | float) and not event):
        event = "run"
    if event == "stt_matrix":
        return event, None, members
    run = _whole(members.get("run"))
    if run is None or requested is None or not 1 <= run <= requested or not isinstance(event, str) or event not in ALLOWED:
        return None, None, None
    return event, int(run), members


def _short(value):
    """A list or object as far as checks look at it: of lists whether they are empty, of objects nothing."""
    return value[:1] and [0] if isinstance(value, list) else {}


def _values(column: pa.Array) -> list:
    plain = pa.types.is_binary(column.type) or (pa.types.is_integer(column.type) and not column.null_count)
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def _gather(keys: list[str], order: str):
    """Folds the events of each batch: a row for each run, and one for what belongs to no run, with the newest given value of each field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, list] = {}
            names = zip(*(_values(batch.column(k)) for k in keys), strict=True)
            for i, (name, at, requested, payload) in enumerate(zip(names, *(_values(batch.column(c)) for c in (order, "requested", "payload")), strict=True)):
                event, number, members = _read(payload, requested)
                own = (name, number)
                group = held.get(own)
                if group is None:
                    group = held[own] = [i, None, 0, {}]
                if requested is not None and (group[1] is None or requested > group[1]):
                    group[1] = requested
                if event is None:
                    group[2] += 1
                    continue
                newest = group[3]
                if event == "complete":
                    newest[""] = (None, True)
                if at is None:
                    continue
                allowed = MATRIX if event == "stt_matrix" else ALLOWED[event]
                for f, value in members.items():
                    if f in allowed and (f not in newest or newest[f][0] < at):
                        newest[f] = (at, _short(value) if value.__class__ is list or value.__class__ is dict else value)
            first = pa.array([g[0] for g in held.values()], pa.int64())
            yield pa.record_batch(
                [*(batch.column(k).take(first) for k in keys), pa.array([number for _, number in held], pa.int64()), pa.array([g[1] for g in held.values()], pa.int64()),
                 pa.array([g[2] for g in held.values()], pa.int64()), pa.array([pickle.dumps(g[3]) for g in held.values()], pa.binary())],
                names=[*keys, "run", "requested", "n_problems", "state"])

    return run


def checks(m: dict, delta: float | None) -> list[tuple[str, bool | None, bool]]:
    """Name, outcome and whether a failure is for want of evidence, of every check on a run's fields and its delay; one that does not apply is None."""
    none = lambda f: m.get(f) is None
    listed = lambda f: isinstance(m.get(f), list)
    true, false, empty = (lambda f: m.get(f) is True), (lambda f: m.get(f) is False), (lambda f: m.get(f) == [])
    text = lambda f, allowed: isinstance(m.get(f), str) and m[f] in allowed
    release, sound = _whole(m.get("button_release_monotonic_ns")), _whole(m.get("first_sound_monotonic_ns"))
    path = m["path"].upper() if isinstance(m.get("path"), str) else ""
    after_release = delta is not None and delta >= 0
    supplied, memory, before, after, swap = (_number(m.get(f)) for f in ("button_release_to_first_sound_ms", "mem_available_min_mb", "swap_before_mb", "swap_after_mb", "swap_delta_mb"))
    ends = [_whole(m.get(f"{x}_monotonic_ns")) for x in ("stt_start", "stt_end", "tts_start", "tts_end")]
    whole = None not in ends
    sides = [None if a is None or b is None else a < b for a, b in ((ends[0], ends[3]), (ends[2], ends[1]))]
    meets = False if False in sides else None if None in sides else True
    exit_code, outside = _whole(m.get("stt_exit_code")), _whole(m.get("external_connections"))
    both = before is not None and after is not None
    return [
        ("observed", true("observed"), True), ("not_simulated", false("simulated"), none("simulated")), ("evidence_origin", text("evidence_origin", ORIGINS), True),
        ("complete", true("complete"), True), ("path", path in ("A", "B"), False),
        ("button_release", release is not None and release > 0, True), ("first_sound", sound is not None and sound > 0, True),
        ("timestamp_order", None if delta is None else after_release, False),
        ("first_sound_budget", delta <= (PATH_A_BUDGET_MS if path == "A" else PATH_B_BUDGET_MS) if after_release else None, False),
        ("timing_consistent", abs(supplied - delta) <= 1.0 if after_release and supplied is not None else None, False),
        ("button_source", text("button_release_source", ["gpio", "operator"]), True), ("loopback_source", text("first_sound_source", ["loopback"]), True),
        ("loopback_method", text("first_sound_method", ["loopback_onset"]), True), ("loopback_observed", true("loopback_observed"), True),
        ("false_positive_zero", empty("stt_false_positive_keywords"), not listed("stt_false_positive_keywords")),
        ("stt_recall", empty("stt_expected_keywords_missed") and true("stt_recall_ok"), not listed("stt_expected_keywords_missed") or none("stt_recall_ok")),
        ("stt_exit", exit_code == 0, none("stt_exit_code")), ("memory_floor", memory is not None and memory >= MEMORY_FLOOR_MB, memory is None),
        ("swap_observed", both, True), ("swap_not_increased", after - before <= 0 if both else None, False),
        ("swap_consistent", abs(swap - (after - before)) <= 0.01 if both and swap is not None else None, False),
        ("stt_tts_non_overlap", false("stt_tts_overlap"), none("stt_tts_overlap")), ("interval_non_overlap", None if meets is None else not meets, False),
        ("overlap_flag_consistent", (true if meets else false)("stt_tts_overlap") if whole else None, False), ("intervals_observed", None if whole else False, True),
        ("external_network_zero", outside == 0, outside is None), ("tts_pcm", true("tts_pcm_valid"), none("tts_pcm_valid")),
        ("tts_playback", true("tts_playback_observed"), none("tts_playback_observed")),
        ("tts_engine", isinstance(m.get("tts_engine"), str) and m["tts_engine"].strip(" ") != "", True),
    ]


def delay(m: dict) -> float | None:
    """Milliseconds from the button's release to the first sound."""
    release, sound = _whole(m.get("button_release_monotonic_ns")), _whole(m.get("first_sound_monotonic_ns"))
    return None if release is None or sound is None else (sound - release) / 1e6


def _matrix(m: dict) -> tuple[bool, bool]:
    """Whether the matrix of cases is flawless, and whether all of it is there."""
    empty = m.get("stt_false_positive_keywords") == [] and m.get("stt_expected_keywords_missed") == []
    return empty and m.get("observed") is True and m.get("stt_recall_ok") is True and _whole(m.get("stt_cases")) == MATRIX_CASES, all(f in m for f in MATRIX_FIELDS)


def _judge(keys: list[str]):
    """Merges the sorted rows of each run and judges it; the row without a run tells of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, merged, requested, problems = None, {}, None, 0
        columns = [*keys, "run", "requested", "n_problems", "status", "delta", "n_checks", "failed", "matrix_ok", "there"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.bool_()]
        out: list[tuple] = []
        #: Keys of the run that goes on into a batch, and the rows of the batch at which those that end in it begin.
        before: pa.RecordBatch | None = None
        where: list[int] = []

        def close() -> None:
            m = {f: value for f, (_, value) in merged.items()}
            if own[-1] is None:
                out.append((None, requested, problems, None, None, None, None, *_matrix(m)))
            else:
                if m.pop("", False):  # the event itself completes the run
                    m["complete"] = True
                delta = delay(m)
                every = checks(m, delta)
                failed = [name for name, ok, _ in every if ok is False]
                status = "pass" if not failed else "unverified" if any(lack for _, ok, lack in every if ok is False) else "fail"
                out.append((own[-1], requested, problems, status, delta, sum(ok is not None for _, ok, _ in every), failed, None, None))

        def flush(ids: pa.RecordBatch) -> pa.RecordBatch:
            named = [ids.take(pa.array(where, pa.int64()))]
            named = pa.Table.from_batches([before, *named] if len(out) > len(where) else named)
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.record_batch([*named.combine_chunks().to_batches()[0].columns, *made], names=columns)

        for batch in batches:
            if not batch.num_rows:
                continue
            names = zip(*(_values(batch.column(k)) for k in [*keys, "run"]), strict=True)
            ids, where, begun = batch.select(keys), [], None
            for i, (key, asked, bad, state) in enumerate(zip(names, *(_values(batch.column(c)) for c in ("requested", "n_problems", "state")), strict=True)):
                if key != own:
                    if own is not None:
                        close()
                        if begun is not None:
                            where.append(begun)
                    own, begun, merged, requested, problems = key, i, {}, None, 0
                problems += bad
                if asked is not None and (requested is None or asked > requested):
                    requested = asked
                newer = pickle.loads(state)
                if not merged:
                    merged = newer
                    continue
                for f, said in newer.items():
                    if f not in merged or (f and merged[f][0] < said[0]):
                        merged[f] = said
            if out:
                yield flush(ids)
            if begun is not None:
                before = ids.slice(begun, 1)
        if own is not None:
            close()
            where = []
            yield flush(before)

    return run


def _judged(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A row a run with its verdict, and one a session, without a run, for the matrix and the events that do not count.

    Events are folded where they are read, so a run of any number of events is a row a batch when it moves.
    """
    rows = events.select(*keys, order, F.col("requested").cast("bigint").alias("requested"), F.col("payload").cast("binary").alias("payload"))
    types = dict(rows.dtypes)
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    folded = rows.mapInArrow(_gather(keys, order), f"{named}, run bigint, requested bigint, n_problems bigint, state binary")
    return folded.repartition(*keys, "run").sortWithinPartitions(*keys, "run").mapInArrow(
        _judge(keys), f"{named}, run bigint, requested bigint, n_problems bigint, status string, delta double, n_checks int, failed array<string>, matrix_ok boolean, there boolean")


def run_verdicts(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A row a run: ``keys, run, status, delay_ms, n_checks, failed``, from rows ``keys, order, requested, payload``.

    A run passes if every check that applies holds; if one fails for want of evidence it is unverified, else it fails. ``order`` is unique
    in a session; the newest given value of a field counts, and an event sets only the fields it may. Keys are plain values.
    """
    return _judged(events, keys, order).filter("run IS NOT NULL").select(*keys, "run", "status", _delay().alias("delay_ms"), "n_checks", "failed")


def _delay():
    return F.when(F.col("delta") >= 0, F.bround("delta", 3))


def session_verdicts(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A row a session: ``keys, requested, n_runs, n_passed, missing, n_problems, matrix_ok, max_delay_ms, status``.

    A session passes if all runs from 1 to ``requested`` are there and pass, every event counts, and the matrix of 21 cases has no false
    positive and no miss. It is unverified if runs or parts of the matrix are missing, or nothing is wrong but a run's evidence.
    """
    df = _judged(events, keys, order).groupBy(*keys).agg(
        F.max("requested").alias("requested"), F.sum("n_problems").alias("n_problems"), F.count("run").alias("n_runs"), F.count_if(F.col("status") == "pass").alias("n_passed"),
        F.count_if(F.col("status") == "unverified").alias("_unverified"), F.max(_delay()).alias("max_delay_ms"), F.collect_set("run").alias("_runs"),
        F.coalesce(F.max("matrix_ok"), F.lit(False)).alias("matrix_ok"), F.coalesce(F.max("there"), F.lit(False)).alias("_there"))
    missing = F.array_sort(F.array_except(F.sequence(F.lit(1).cast("bigint"), F.col("requested")), F.col("_runs")))
    df = df.withColumn("missing", F.when(F.col("requested") > 0, missing).otherwise(F.array().cast("array<bigint>")))
    absent = (F.col("n_runs") == 0) | (F.size("missing") > 0)
    status = (
        F.when(absent | ~F.col("_there"), "unverified").when((F.col("n_problems") > 0) | ~F.col("matrix_ok"), "fail")
        .when(F.col("_unverified") > 0, "unverified").when(F.col("n_passed") == F.col("requested"), "pass").otherwise("fail"))
    return df.select(*keys, F.col("requested").cast(dict(events.dtypes)["requested"]).alias("requested"), "n_runs", "n_passed", "missing", "n_problems", "matrix_ok", "max_delay_ms", status.alias("status"))
