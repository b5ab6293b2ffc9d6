"""Wide expressions stay out of fused loops: what would be one method of more than 8000 bytes is never compiled."""

from pyspark.sql import functions as F

from fieldmarch.operators import acceptance as A


def events(spark, rows):
    return spark.createDataFrame(rows, "session int, requested int, at bigint, payload string")


def test_fields_are_read_once_as_members(spark):
    rows = [
        (1, 2, 1, '{"event":"run","run":1,"simulated":true,"path":"a"}'),
        (1, 2, 2, '{"event":"stt","run":1,"simulated":false,"stt_exit_code":0}'),  # may not set simulated
        (1, 2, 3, '{"event":"complete","run":1,"path":null,"other":{"path":"b"}}'),  # a null that is given counts
        (1, 2, 4, '{"event":"stt","run":2}'),  # a run of which nothing else is known
    ]
    out = A.run_verdicts(events(spark, rows), ["session"], "at")
    got = {r.run: r for r in out.collect()}
    assert set(got) == {1, 2} and got[1].status == "unverified"
    assert {"not_simulated", "path"} <= set(got[1].failed) and not {"complete", "stt_exit"} & set(got[1].failed)
    assert {"complete", "stt_exit"} <= set(got[2].failed)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # before, each of the 28 fields read the payload of every event several times
    assert plan.count("try_variant_get") < len(A.FIELDS)
    assert A.session_verdicts(events(spark, rows), ["session"], "at").select("n_runs", "matrix_ok", "n_problems").collect() == [(2, False, 0)]
    assert A.run_verdicts(events(spark, rows).filter(F.lit(False)), ["session"], "at").count() == 0
