"""Chunked operators equal a plain fold, whatever the chunk length, also for one hot device."""

import random

import pytest

from fieldmarch.operators import latch, ordered
from fieldmarch.streaming import steps


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(5)
    rows = []
    for dev, n in ((1, 900), (2, 40), (3, 60), (4, 1)):
        t = 0.0
        for _ in range(n):
            t += rng.choice([1, 1, 2, 5, 9, 10, 11, 40, 200])
            rows.append((dev, t, rng.choice([None, 5.0, 20.0, 29.9, 30.0, 34.0, 35.0, 36.0, 60.0, 100.0]), rng.choice("abcx")))
    return rows, spark.createDataFrame(rows, "dev long, t double, ppm double, sym string").repartition(5).cache()


def by_dev(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out.items()


@pytest.mark.parametrize("chunk", [7.0, 60.0, 1000.0, 1e9])
def test_co_latch(series, chunk):
    rows, df = series
    want = set()
    for dev, items in by_dev(rows):
        state = {}
        for _, t, ppm, _ in items:
            want.add((dev, t, steps.co_level(state, {"t_s": t, "ppm": ppm})[0]["level"]))
    got = {(r.dev, r.t, r.level) for r in latch.co_latch(df, ["dev"], "t", "ppm", chunk).collect()}
    assert got == want and {x[2] for x in got} == {"none", "warning", "alarm"}


@pytest.mark.parametrize("chunk, gap", [(3.0, 10.0), (50.0, 10.0), (50.0, 100.0), (1e9, 33.0)])
def test_throttle(series, chunk, gap):
    rows, df = series
    want = set()
    for dev, items in by_dev(rows):
        last = None
        for _, t, *_ in items:
            if last is None or t >= last + gap:
                last = t
                want.add((dev, t))
    got = [(r.dev, r.t) for r in ordered.throttle(df, ["dev"], "t", gap, chunk_s=chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("chunk", [20.0, 400.0, 1e9])
def test_automaton(series, chunk):
    rows, df = series
    move = {("p", "a"): "q", ("q", "b"): "r", ("r", "a"): "q", ("r", "c"): "p", ("q", "c"): "q"}
    want = set()
    for dev, items in by_dev(rows):
        s = "p"
        for _, t, _, y in items:
            s = move.get((s, y), s)
            want.add((dev, t, s))
    got = {(r.dev, r.t, r.state) for r in ordered.automaton(df, ["dev"], "t", "sym", ["p", "q", "r"], move, chunk_s=chunk).collect()}
    assert got == want


@pytest.mark.parametrize("chunk", [15.0, 1e9])
def test_running_and_previous(series, chunk):
    from pyspark.sql import functions as F

    rows, df = series
    out = ordered.running(ordered.chunked(df, "t", chunk), ["dev"], ["t"], "total", F.col("ppm"), "sum")
    out = ordered.running(out, ["dev"], ["t"], "newest", F.col("ppm"), "last")
    out = ordered.previous(out, ["dev"], ["t"], {"before": "sym"})
    got = {(r.dev, r.t): (r.total, r.newest, r.before) for r in out.collect()}
    for dev, items in by_dev(rows):
        total, newest, before = None, None, None
        for _, t, ppm, sym in items:
            if ppm is not None:
                total, newest = (total or 0) + ppm, ppm
            g = got[(dev, t)]
            assert (round(g[0] or 0, 6), g[1], g[2]) == (round(total or 0, 6), newest, before)
            before = sym


def test_late_rows_cannot_be_kept(spark):
    rows = [(1, 0, 100.0), (1, 1, 95.0), (1, 2, 111.0), (1, 3, 110.5), (1, 4, 121.0)]
    df = spark.createDataFrame(rows, "dev long, arrival long, t double")
    kept = {r.t for r in ordered.drop_late(df, ["dev"], "t", "arrival", 2.0).collect()}
    assert kept == {100.0, 111.0, 121.0}
