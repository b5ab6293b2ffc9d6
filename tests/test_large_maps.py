"""Joins on tables of a map's size must not gather them on the driver, however small their files are."""

import pytest
from pyspark.sql import functions as F

from fieldmarch.operators import graph, spatial
from fieldmarch.plans import tables as T


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_map_joins_are_not_broadcast(spark, sf):
    nodes, edges = T.nodes(spark, sf), T.edges(spark, sf)
    assert "BroadcastHashJoin" not in plan_of(edges)
    assert "BroadcastHashJoin" not in plan_of(graph.edge_points(edges, nodes))
    ids = graph.dense_ids(nodes)
    assert "BroadcastHashJoin" not in plan_of(graph._numbered(edges, ids, "u", "v"))


def test_points_meet_nodes_without_broadcast(spark, sf):
    nodes = T.nodes(spark, sf).filter("node_id < 40")
    here = nodes.select(F.col("node_id").alias("id"), "map_id", (F.col("lon") + 0.0001).alias("lon"), "lat")
    near = spatial.nearest_node(here, nodes, "id")
    assert "Join" not in plan_of(near)  # all are settled by cells and written
    twice = nodes.unionByName(nodes.withColumn("node_id", F.col("node_id") + 1000).withColumn("node_ord", F.col("node_ord") + 1000))
    away = here.withColumn("lon", F.col("lon") + 1.0)
    for pts in (here, away):
        got = {r.id: (r.node_id, r.snap_m) for r in spatial.nearest_node(pts, twice, "id").collect()}
        d = spatial.haversine_m(F.col("lon"), F.col("lat"), F.col("a"), F.col("b"))
        want = pts.crossJoin(nodes.select("node_id", F.col("lon").alias("a"), F.col("lat").alias("b"), "node_ord")).groupBy("id").agg(
            F.min(F.struct(d.alias("d"), "node_ord", "node_id")).alias("m")).collect()
        assert len(got) == len(want)
        for r in want:
            assert got[r.id] == (r.m.node_id, pytest.approx(r.m.d, abs=1e-6))
