"""Graph and spatial jobs against brute force on small maps."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldmarch.operators import graph, spatial
from fieldmarch.plans import maps, tables as T

R = 6371009.0


def hav(a, b):
    (x1, y1), (x2, y2) = a, b
    p, q = math.radians(y1), math.radians(y2)
    v = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(v)))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    place = {i: (127 + rng.random() * 0.01, 37.5 + rng.random() * 0.01) for i in range(60)}
    links = []
    for i in range(60):
        for j in rng.sample(range(60), 2):
            if i != j and (i < 45) == (j < 45):
                links.append((i, j, hav(place[i], place[j]) * rng.uniform(1.0, 1.6)))
                if rng.random() < 0.4:
                    links.append((j, i, links[-1][2]))
    nodes = spark.createDataFrame([(0, i, i, x, y) for i, (x, y) in place.items()], "map_id long, node_id long, node_ord long, lon double, lat double")
    edges = spark.createDataFrame(
        [(0, k, u, v, 0, w, None) for k, (u, v, w) in enumerate(links)], "map_id long, edge_ord long, u long, v long, key long, length_m double, geometry string")
    return place, links, nodes.cache(), edges.cache()


def dijkstra(links, start):
    out = {}
    for u, v, w in links:
        out.setdefault(u, []).append((v, w))
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for v, w in out.get(u, ()):
            if d + w < best.get(v, math.inf):
                best[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return best


def test_shortest_paths(spark, world):
    place, links, nodes, edges = world
    pairs = [(s, g) for s in (0, 7, 46) for g in range(60)]
    req = spark.createDataFrame([(0, *p) for p in pairs], "map_id long, start long, goal long")
    paths = graph.cut(graph.shortest_paths(req, edges, nodes))
    got = {(r.start, r.goal): r for r in paths.collect()}
    short = {}
    for u, v, w in links:
        short[(u, v)] = min(w, short.get((u, v), math.inf))
    for s, g in pairs:
        want = dijkstra(links, s).get(g)
        if want is None:
            assert (s, g) not in got
            continue
        r = got[(s, g)]
        assert abs(r.distance_m - want) < 1e-6 and r.path[0] == s and r.path[-1] == g
        assert abs(sum(short[h] for h in zip(r.path, r.path[1:])) - want) < 1e-6
    lines = {(r.start, r.goal): r for r in graph.route_geometry(paths, edges, nodes).collect()}
    for k, r in got.items():
        assert abs(lines[k].distance_m - r.distance_m) < 1e-6 and len(lines[k].points) == len(r.path)


def test_components(spark, world):
    place, links, nodes, edges = world
    reach = {i: set(dijkstra(links, i)) for i in place}
    strong = {i: min(j for j in reach[i] if i in reach[j]) for i in place}
    assert {r.node_id: r.scc for r in graph.strong_components(nodes, edges).collect()} == strong
    both = [(u, v, w) for u, v, w in links] + [(v, u, w) for u, v, w in links]
    weak = {i: min(dijkstra(both, i)) for i in place}
    assert {r.node_id: r.component for r in graph.weak_components(nodes, edges).collect()} == weak
    pair = graph.suggested_pair(nodes, graph.strong_components(nodes, edges)).collect()[0]
    groups = {}
    for i in sorted(strong):
        groups.setdefault(strong[i], []).append(i)
    big = max(groups.values(), key=len)
    start = min(big, key=lambda i: (place[i][1], place[i][0]))
    assert (pair.start, pair.goal) == (start, max(big, key=lambda i: hav(place[start], place[i])))


def test_nearest_node_far_and_near(spark, world):
    place, _, nodes, _ = world
    rng = random.Random(3)
    pts = [(i, 0, 127 + rng.uniform(-1, 1) * s, 37.5 + rng.uniform(-1, 1) * s) for i, s in enumerate([0.01] * 40 + [0.2] * 20 + [5] * 20 + [40] * 20)]
    df = spark.createDataFrame(pts, "pid long, map_id long, lon double, lat double")
    got = {r.pid: r for r in spatial.snap(df, nodes, "pid").collect()}
    for pid, _, x, y in pts:
        d = min(hav((x, y), p) for p in place.values())
        assert abs(got[pid].snap_m - d) < 1e-3 and got[pid].snapped == (d <= 250)


def test_even_sample_takes_slots_round_robin(spark, sf):
    n, e = T.nodes(spark, sf), T.edges(spark, sf)
    limit = 60
    place = {r.node_id: (r.lon, r.lat) for r in n.collect()}
    west, east = min(p[0] for p in place.values()), max(p[0] for p in place.values())
    south, north = min(p[1] for p in place.values()), max(p[1] for p in place.values())
    lon_span = max(1e-12, (east - west) * max(0.15, math.cos(math.radians((south + north) / 2))))
    aspect = max(0.25, min(4.0, lon_span / max(1e-12, north - south)))
    cols = max(1, math.ceil(math.sqrt(limit // 2 * aspect)))
    rows = max(1, math.ceil(limit // 2 / cols))
    per = max(1, math.ceil(limit / (cols * rows)))
    seen, cells = set(), {}
    pts = {r.edge_ord: r.points for r in graph.edge_points(e, n).collect()}
    for r in sorted(e.collect(), key=lambda r: r.edge_ord):
        pair = tuple(sorted((r.u, r.v)))
        if pair in seen:
            continue
        seen.add(pair)
        mid = pts[r.edge_ord][len(pts[r.edge_ord]) // 2]
        at = (min(rows - 1, max(0, int((mid.lat - south) / (north - south) * rows))), min(cols - 1, max(0, int((mid.lon - west) / (east - west) * cols))))
        if len(cells.setdefault(at, [])) < per:
            cells[at].append(r.edge_ord)
    want = [cells[k][s] for s in range(per) for k in sorted(cells) if s < len(cells[k])][:limit]
    got = [r.edge_ord for r in maps._sample(spark, sf, limit).orderBy("draw_ord").collect()]
    assert got == want


def test_linestring(spark):
    cases = [
        ("LINESTRING (1 2, 3 4)", 2), ("linestring z (1 2 9, 3 4 9, 5 6 9)", 3), ("LINESTRING (1 2)", None), ("POINT (1 2)", None),
        ("LINESTRING (1 2, x 4)", None), ("LINESTRING (1 2, 3 99)", None), (None, None),
    ]
    df = spark.createDataFrame([(w,) for w, _ in cases], "w string")
    got = [r.n for r in df.select(F.size(graph.linestring(F.col("w"))).alias("n")).collect()]
    assert [None if g in (None, -1) else g for g in got] == [n for _, n in cases]


def test_route_records_reasons(spark, world):
    place, links, nodes, edges = world
    trips = [(1, 0, *place[0], *place[7]), (2, 0, 128.0, 38.0, *place[7]), (3, 0, *place[0], 128.0, 38.0), (4, 0, *place[0], *place[50]), (5, 0, *place[0], *place[0])]
    df = spark.createDataFrame(trips, "req_id long, map_id long, lon double, lat double, to_lon double, to_lat double")
    got = {r.req_id: r for r in graph.route_records(df, edges, nodes).collect()}
    assert [got[i].reason for i in range(1, 6)] == [None, "start_out_of_bounds", "goal_out_of_bounds", "no_path", None]
    assert got[1].distance_m == round(dijkstra(links, 0)[7], 1)
    assert got[5].distance_m == 0 and len(got[5].points) == 1


def test_maps_with_equal_ids_of_any_type(spark):
    """Two maps use the ids 1..3; only the first has a way from 1 to 3."""
    for kind in ("long", "string"):
        cast = int if kind == "long" else str
        at = [(m, cast(i), i, 127 + i * 0.001 + m, 37.5) for m in (0, 1) for i in (1, 2, 3)]
        nodes = spark.createDataFrame(at, f"map_id int, node_id {kind}, node_ord long, lon double, lat double")
        rows = [(0, 0, cast(1), cast(2), 0, 90.0, None), (0, 1, cast(2), cast(3), 0, 90.0, None), (1, 0, cast(2), cast(1), 0, 50.0, None), (1, 1, cast(1), cast(2), 0, 50.0, None)]
        edges = spark.createDataFrame(rows, f"map_id int, edge_ord long, u {kind}, v {kind}, key long, length_m double, geometry string")
        part = lambda df, name: {(r.map_id, int(r.node_id)): int(r[name]) for r in df.collect()}
        assert part(graph.weak_components(nodes, edges), "component") == {(0, 1): 1, (0, 2): 1, (0, 3): 1, (1, 1): 1, (1, 2): 1, (1, 3): 3}
        assert part(graph.strong_components(nodes, edges), "scc") == {(0, 1): 1, (0, 2): 2, (0, 3): 3, (1, 1): 1, (1, 2): 1, (1, 3): 3}
        req = spark.createDataFrame([(m, cast(1), cast(3)) for m in (0, 1)], f"map_id int, start {kind}, goal {kind}")
        paths = graph.cut(graph.shortest_paths(req, edges, nodes))
        assert [(r.map_id, r.distance_m, [int(x) for x in r.path]) for r in paths.collect()] == [(0, 180.0, [1, 2, 3])]
        assert [(r.map_id, r.distance_m, len(r.points)) for r in graph.route_geometry(paths, edges, nodes).collect()] == [(0, 180.0, 3)]
        trips = spark.createDataFrame([(m, m, 127.001 + m, 37.5, 127.003 + m, 37.5) for m in (0, 1)], "req_id long, map_id int, lon double, lat double, to_lon double, to_lat double")
        assert {r.req_id: (r.reason, r.distance_m) for r in graph.route_records(trips, edges, nodes).collect()} == {0: (None, 180.0), 1: ("no_path", None)}
