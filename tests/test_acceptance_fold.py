"""Events are read once, folded where they are read, and one row a run moves."""

import pytest

from fieldmarch.operators import acceptance as A

GOOD = '{"event":"stt_matrix","stt_cases":21,"stt_false_positive_keywords":[],"stt_expected_keywords_missed":[],"stt_recall_ok":true,"observed":true}'
ROWS = [
    (1, 2, 1, '{"run":1,"simulated":true,"path":"a"}'),
    (1, 2, 5, '{"event":"complete","run":1.0,"path":null}'),
    (1, 2, 3, '{"event":"run","run":1,"path":"b","tts_engine":"x"}'),
    (1, 2, 2, '{"event":"stt","run":2,"stt_exit_code":0,"path":"b"}'),
    (1, 2, 4, '{"event":"stt","run":2,"stt_exit_code":"0"} trailing'),
    (1, 2, 6, GOOD),
    (2, 1, 1, '{"event":"other","run":1}'),
    (2, 1, 2, '{"run":1,"run":1}'),
    (2, 1, 3, '{"run":NaN}'),
    (2, 1, 4, '{"run":"1"}'),
    (2, 1, 5, "[1]"),
    (2, 1, 6, None),
    (2, 1, 7, '{"event":0e0,"run":1,"path":"B"}'),  # any zero names no event
    (3, None, 1, '{"run":1}'),
    (None, 1, 1, '{"event":"first_sound","run":1,"first_sound_monotonic_ns":1e400,"loopback_observed":true}'),
    (None, 1, 2, '{"event":"first_sound","run":1,"first_sound_monotonic_ns":2500000.0}'),
    (None, 1, 3, '{"event":"button_release","run":1,"button_release_monotonic_ns":999500}'),
]


def events(spark):
    return spark.createDataFrame(ROWS, "session int, requested int, at bigint, payload string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_events_are_read_once_and_not_spread_by_field(spark):
    runs, sessions = A.run_verdicts(events(spark), ["session"], "at"), A.session_verdicts(events(spark), ["session"], "at")
    for df in (runs, sessions):
        assert plan(df).count("Scan ") == 1 and "variant" not in plan(df)


@pytest.mark.parametrize("rows", [1, 2, 3, 10000])
def test_batches_do_not_matter(spark, rows):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        got = {(r.session, r.run): r for r in A.run_verdicts(events(spark), ["session"], "at").collect()}
        sessions = {r.session: r for r in A.session_verdicts(events(spark), ["session"], "at").collect()}
    finally:
        spark.conf.set(name, kept)
    assert set(got) == {(1, 1), (1, 2), (2, 1), (None, 1)}
    assert {"path", "not_simulated"} <= set(got[1, 1].failed) and not {"complete", "tts_engine"} & set(got[1, 1].failed)
    assert {"stt_exit", "path"} <= set(got[1, 2].failed)
    assert "path" not in got[2, 1].failed
    assert got[None, 1].delay_ms == 1.5 and not {"first_sound", "loopback_observed", "first_sound_budget"} & set(got[None, 1].failed)
    one, two, three, none = (sessions[k] for k in (1, 2, 3, None))
    assert (one.n_runs, one.n_problems, one.matrix_ok, one.missing, one.status) == (2, 0, True, [], "unverified")
    assert (two.n_runs, two.n_problems, two.matrix_ok, two.requested) == (1, 6, False, 1)
    assert (three.n_runs, three.n_problems, three.requested, three.missing, three.status) == (0, 1, None, [], "unverified")
    assert (none.n_runs, none.max_delay_ms) == (1, 1.5)


def test_events_are_dealt_to_tasks_by_the_number_of_runs(spark, sf, monkeypatch):
    from fieldmarch.plans import acceptance as P

    monkeypatch.setattr(P, "RUNS_A_TASK", 10)
    # the exchange of the runs is small, and Spark would make few tasks of it
    assert P.observations(spark, sf).rdd.getNumPartitions() >= 150
