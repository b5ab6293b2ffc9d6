"""Rounds of route search write and read their tables; none gathers one on the driver, and one join a round meets the roads."""

from pyspark.sql import functions as F

from fieldmarch.operators import graph
from fieldmarch.plans import tables as T


def test_rounds_are_not_broadcast(spark, sf, monkeypatch):
    plans, real = [], graph.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(graph, "cut", seen)
    req = T.requests(spark, sf).filter("req_id % 10 = 1")
    paths = graph.shortest_paths(req, T.edges(spark, sf), T.nodes(spark, sf))
    assert not any("BroadcastHashJoin" in p for p in plans)
    rounds = [p for p in plans if "haversine" in p.lower() or "REPARTITION_BY_COL" in p]
    assert rounds and max(p.count("SortMergeJoin") for p in rounds if "REPARTITION_BY_COL" in p) == 1
    got = paths.select("start", "goal", F.size("path").alias("n"), "hops", F.get("path", F.lit(0)).alias("a"), F.element_at("path", -1).alias("b")).collect()
    assert got and all(r.a == r.start and r.b == r.goal and r.n == r.hops + 1 for r in got)
