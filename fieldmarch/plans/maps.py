"""Map build, positions against trails, and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geo import bearing_deg, haversine_m
from ..operators import graph, spatial
from . import tables as T
from .registry import query

H = T.haversine_sql
SEG_SQL = """CASE WHEN l2<=1e-12 THEN sqrt(ax*ax+ay*ay) ELSE sqrt(pow(ax+greatest(0.0,least(1.0,-(ax*dx+ay*dy)/l2))*dx,2)+pow(ay+greatest(0.0,least(1.0,-(ax*dx+ay*dy)/l2))*dy,2)) END"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Trail segments: every undirected edge once per geometry, cut into its vertex pairs."""
    n, e = T.nodes(spark, d), T.edges(spark, d)
    pts = graph.edge_points(graph.undirected(e, ["key"]), n)
    pair = F.arrays_zip(
        F.slice("points", F.lit(1), F.size("points") - 1).alias("a"), F.slice("points", F.lit(2), F.size("points") - 1).alias("b"))
    s = pts.select("map_id", "edge_ord", F.posexplode(pair).alias("part", "s"))
    return s.select("map_id", "edge_ord", "part", F.col("s.a.lon").alias("lon_a"), F.col("s.a.lat").alias("lat_a"),
                    F.col("s.b.lon").alias("lon_b"), F.col("s.b.lat").alias("lat_b"))


T.define("undirected", ["edges"], """SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY map_id, least(u,v), greatest(u,v), key ORDER BY edge_ord)=1""")
T.define("segments", ["undirected", "nodes"], """SELECT e.map_id, e.edge_ord, p.part, CASE WHEN p.part=0 THEN a.lon ELSE round((a.lon+b.lon)/2+0.0001::DOUBLE,7) END AS lon_a,
      CASE WHEN p.part=0 THEN a.lat ELSE round((a.lat+b.lat)/2+0.0001::DOUBLE,7) END AS lat_a,
      CASE WHEN e.key=1 AND p.part=0 THEN round((a.lon+b.lon)/2+0.0001::DOUBLE,7) ELSE b.lon END AS lon_b,
      CASE WHEN e.key=1 AND p.part=0 THEN round((a.lat+b.lat)/2+0.0001::DOUBLE,7) ELSE b.lat END AS lat_b
    FROM undirected e JOIN nodes a ON a.node_id=e.u JOIN nodes b ON b.node_id=e.v CROSS JOIN (VALUES (0),(1)) p(part) WHERE p.part=0 OR e.key=1""")
T.define("snap_n", ["fixes", "nodes"], f"""SELECT event_id, arg_min(node_id, [d, CAST(node_ord AS DOUBLE)]) AS node_id, min(d) AS snap_m FROM (
    SELECT f.event_id, n.node_id, n.node_ord, {H('f.lon', 'f.lat', 'n.lon', 'n.lat')} AS d FROM fixes f JOIN nodes n ON n.map_id=f.map_id) GROUP BY event_id""")
T.define("offsets", ["fixes", "segments", "snap_n"], f"""SELECT f.event_id, s.ring, coalesce(s.offset_m, n.snap_m) AS offset_m FROM fixes f JOIN snap_n n USING (event_id) LEFT JOIN (
    SELECT event_id, r AS ring, min(CASE WHEN ring<=r THEN dist END) AS offset_m FROM (SELECT *, min(ring) OVER (PARTITION BY event_id) AS r FROM (
      SELECT event_id, ring, {SEG_SQL} AS dist FROM (SELECT event_id, ring, ax, ay, bx-ax AS dx, by_-ay AS dy, (bx-ax)*(bx-ax)+(by_-ay)*(by_-ay) AS l2 FROM (
        SELECT event_id, ring, (lon_a-lon)*sc*k AS ax, (lat_a-lat)*k AS ay, (lon_b-lon)*sc*k AS bx, (lat_b-lat)*k AS by_ FROM (
          SELECT f.event_id, f.lon, f.lat, s.*, greatest(0.01, cos(radians(f.lat))) AS sc, radians(1.0)*6371009.0 AS k,
            greatest(1, s.x1-f.x, f.x-s.x2, s.y1-f.y, f.y-s.y2) AS ring
          FROM (SELECT *, CAST(floor((lon+180.0)/0.002::DOUBLE) AS BIGINT) AS x, CAST(floor((lat+90.0)/0.002::DOUBLE) AS BIGINT) AS y FROM fixes) f JOIN (SELECT map_id, lon_a, lat_a, lon_b, lat_b,
            CAST(floor((least(lon_a,lon_b)+180.0)/0.002::DOUBLE) AS BIGINT) AS x1, CAST(floor((greatest(lon_a,lon_b)+180.0)/0.002::DOUBLE) AS BIGINT) AS x2,
            CAST(floor((least(lat_a,lat_b)+90.0)/0.002::DOUBLE) AS BIGINT) AS y1, CAST(floor((greatest(lat_a,lat_b)+90.0)/0.002::DOUBLE) AS BIGINT) AS y2 FROM segments) s ON s.map_id=f.map_id
          WHERE greatest(1, s.x1-f.x, f.x-s.x2, s.y1-f.y, f.y-s.y2)<=5))))) GROUP BY event_id, r) s USING (event_id)""")


@query("map_bounds", T.ctes("nodes") + " SELECT map_id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM nodes GROUP BY map_id")
def map_bounds(spark, d):
    return spatial.bounds(T.nodes(spark, d))


@query("graph_validate", T.ctes("edges") + """ SELECT map_id, n_nodes, 0::BIGINT AS bad_nodes, n_edges, 0::BIGINT AS bad_edges, true AS valid FROM
    (SELECT map_id, count(*) AS n_nodes FROM nodes GROUP BY map_id) JOIN (SELECT map_id, count(*) AS n_edges FROM edges GROUP BY map_id) USING (map_id)""")
def graph_validate(spark, d):
    return graph.check_graph(T.nodes(spark, d), T.edges(spark, d))


@query("edge_dedup", T.ctes("undirected") + " SELECT map_id, edge_ord, least(u,v) AS a, greatest(u,v) AS b, key, round(length_m,4) AS length_m FROM undirected")
def edge_dedup(spark, d):
    e = graph.undirected(T.edges(spark, d), ["key"])
    return e.select("map_id", "edge_ord", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "key", F.round("length_m", 4).alias("length_m"))


@query("segments", T.ctes("segments") + """ SELECT map_id, edge_ord, CAST(part AS INTEGER) AS part, round(lon_a,6) AS lon_a, round(lat_a,6) AS lat_a, round(lon_b,6) AS lon_b, round(lat_b,6) AS lat_b FROM segments""")
def segments_query(spark, d):
    s = segments(spark, d)
    return s.select("map_id", "edge_ord", "part", *[F.round(c, 6).alias(c) for c in ("lon_a", "lat_a", "lon_b", "lat_b")])


@query("geo_haversine", T.ctes("fixes") + f" SELECT event_id, round({H('lon', 'lat', '127.0', '37.5')},3) AS d, round({H('lon', 'lat', '127.0', '37.5', 6371008.8)},3) AS d_voice FROM fixes")
def geo_haversine(spark, d):
    from ..functions.geo import EARTH_R_VOICE_M

    args = (F.col("lon"), F.col("lat"), F.lit(127.0), F.lit(37.5))
    return T.fixes(spark, d).select(
        "event_id", F.round(haversine_m(*args), 3).alias("d"), F.round(haversine_m(*args, EARTH_R_VOICE_M), 3).alias("d_voice"))


@query("geo_bearing", T.ctes("fixes") + """ SELECT event_id, round(fmod(degrees(atan2(sin(radians(127.0-lon))*cos(radians(37.5)), cos(radians(lat))*sin(radians(37.5))
    -sin(radians(lat))*cos(radians(37.5))*cos(radians(127.0-lon))))+360.0, 360.0),4) AS bearing FROM fixes""")
def geo_bearing(spark, d):
    b = bearing_deg(F.col("lon"), F.col("lat"), F.lit(127.0), F.lit(37.5))
    return T.fixes(spark, d).select("event_id", F.round(b, 4).alias("bearing"))


@query("nearest_node", T.ctes("snap_n") + " SELECT event_id, node_id, round(snap_m,3) AS snap_m, snap_m<=250 AS snapped FROM snap_n")
def nearest_node(spark, d):
    return spatial.snap(T.fixes(spark, d), T.nodes(spark, d), "event_id").withColumn("snap_m", F.round("snap_m", 3))


@query("trail_offset", T.ctes("offsets") + " SELECT event_id, CAST(ring AS BIGINT) AS ring, round(offset_m,3) AS offset_m FROM offsets")
def trail_offset(spark, d):
    out = spatial.trail_offset(T.fixes(spark, d), segments(spark, d), T.nodes(spark, d), "event_id")
    return out.select("event_id", F.col("ring").cast("bigint").alias("ring"), F.round("offset_m", 3).alias("offset_m"))


@query("nearest_poi", T.ctes("fixes", "pois") + f""" SELECT event_id, kind, arg_min(poi_id,[dr, CAST(poi_ord AS DOUBLE)]) AS poi_id, min(dr) AS distance_m FROM (
    SELECT event_id, kind, poi_id, poi_ord, d, round_even(d,1) AS dr FROM (SELECT f.event_id, p.kind, p.poi_id, p.poi_ord, {H('f.lon', 'f.lat', 'p.lon', 'p.lat')} AS d
      FROM fixes f JOIN pois p ON p.map_id=f.map_id)) GROUP BY event_id, kind""")
def nearest_poi(spark, d):
    return spatial.nearest_poi(T.fixes(spark, d), T.pois(spark, d), "event_id")


@query("spatial_sample")
def spatial_sample(spark, d):
    return _sample(spark, d, 400)


def _sample(spark: SparkSession, d: str, limit: int) -> DataFrame:
    n = T.nodes(spark, d)
    e = graph.edge_points(graph.undirected(T.edges(spark, d)), n)
    mid = F.get("points", F.floor(F.size("points") / 2).cast("int"))
    e = e.select("map_id", "edge_ord", mid["lon"].alias("mid_lon"), mid["lat"].alias("mid_lat"))
    return spatial.even_sample(e, n, limit)


@query("graph_wcc", T.ctes("edges") + """, lab AS (SELECT node_id, node_id AS c FROM nodes), grow(node_id, c) USING KEY (node_id) AS (
    SELECT node_id, c FROM lab UNION SELECT x.b, min(g.c) FROM grow g JOIN (SELECT u AS a, v AS b FROM edges UNION SELECT v, u FROM edges) x ON x.a=g.node_id
      JOIN recurring.grow o ON o.node_id=x.b WHERE g.c<o.c GROUP BY x.b) SELECT node_id, c AS component FROM grow""")
def graph_wcc(spark, d):
    return graph.weak_components(T.nodes(spark, d), T.edges(spark, d)).select("node_id", "component")


#: Strong parts by plain reachability; feasible where the twin runs, on small tables.
SCC_SQL = T.ctes("edges") + """, steps AS (SELECT DISTINCT u, v FROM edges), reach(s, t) AS (SELECT node_id, node_id FROM nodes
    UNION SELECT r.s, e.v FROM reach r JOIN steps e ON e.u=r.t), parts AS (SELECT a.s AS node_id, min(a.t) AS scc FROM reach a JOIN reach b ON a.s=b.t AND a.t=b.s GROUP BY a.s)"""


@query("graph_scc", SCC_SQL + " SELECT node_id, scc FROM parts")
def graph_scc(spark, d):
    return graph.strong_components(T.nodes(spark, d), T.edges(spark, d)).select("node_id", "scc")


@query("suggested_points", SCC_SQL + f""", inside AS (SELECT n.*, b.scc FROM nodes n JOIN parts p USING (node_id) JOIN (
      SELECT map_id, scc FROM (SELECT map_id, scc, row_number() OVER (PARTITION BY map_id ORDER BY count(*) DESC, min(node_ord)) AS r
        FROM nodes JOIN parts USING (node_id) GROUP BY map_id, scc) WHERE r=1) b ON b.map_id=n.map_id AND b.scc=p.scc),
    here AS (SELECT map_id, node_id AS start, lon AS lon_s, lat AS lat_s FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY lat, lon, node_ord) AS r FROM inside) WHERE r=1)
    SELECT map_id, start, node_id AS goal FROM (SELECT map_id, start, node_id, row_number() OVER (PARTITION BY map_id ORDER BY {H('lon_s', 'lat_s', 'lon', 'lat')} DESC, node_ord) AS r
      FROM inside JOIN here USING (map_id)) WHERE r=1""")
def suggested_points(spark, d):
    n = T.nodes(spark, d)
    return graph.suggested_pair(n, graph.strong_components(n, T.edges(spark, d)))


@query("shortest_path", T.ctes("edges", "requests") + """, steps AS (SELECT u, v, min(length_m) AS w FROM edges GROUP BY u, v),
    best(s, t, d) USING KEY (s, t) AS (SELECT DISTINCT start, start, CAST(0 AS DOUBLE) FROM requests
      UNION SELECT p.s, e.v, min(p.d+e.w) FROM best p JOIN steps e ON e.u=p.t LEFT JOIN recurring.best o ON o.s=p.s AND o.t=e.v WHERE o.d IS NULL OR p.d+e.w<o.d GROUP BY p.s, e.v)
    SELECT req_id, start, goal, round(d,3) AS distance_m, d IS NULL AS no_path FROM requests LEFT JOIN best ON s=start AND t=goal""")
def shortest_path(spark, d):
    req = T.requests(spark, d)
    paths = graph.shortest_paths(req, T.edges(spark, d), T.nodes(spark, d))
    out = req.join(paths.hint("merge"), ["map_id", "start", "goal"], "left")
    return out.select("req_id", "start", "goal", F.round("distance_m", 3).alias("distance_m"), F.col("distance_m").isNull().alias("no_path"))


def trails(spark: SparkSession, d: str) -> DataFrame:
    e = graph.edge_points(graph.undirected(T.edges(spark, d), ["key"]), T.nodes(spark, d))
    return e.select("map_id", "edge_ord", "points")


@query("trail_graph", T.ctes("segments") + f""" SELECT u, v, round(min(l),3) AS length_m FROM (SELECT unnest([a,b]) AS u, unnest([b,a]) AS v, l FROM (
    SELECT CAST(round(lon_a*1e7) AS BIGINT)||','||CAST(round(lat_a*1e7) AS BIGINT) AS a, CAST(round(lon_b*1e7) AS BIGINT)||','||CAST(round(lat_b*1e7) AS BIGINT) AS b, {H('lon_a', 'lat_a', 'lon_b', 'lat_b', 6371008.8)} AS l FROM segments)) GROUP BY u, v""")
def trail_graph(spark, d):
    from ..sources.maps import trail_graph as build

    return build(trails(spark, d)).withColumn("length_m", F.round("length_m", 3))


T.define("crop_box", ["pois"], """SELECT map_id, cx-hw/lm AS w, cx+hw/lm AS e, cy-hh/111320.0 AS s, cy+hh/111320.0 AS n FROM (SELECT map_id, cx, cy, lm, greatest(w0, h0*1024.0::DOUBLE/420.0::DOUBLE) AS hw, greatest(h0, w0/(1024.0::DOUBLE/420.0::DOUBLE)) AS hh FROM (
    SELECT map_id, cx, cy, lm, (e-w)*lm/2+38 AS w0, (n-s)*111320.0/2+38 AS h0 FROM (SELECT map_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n, (min(lon)+max(lon))/2 AS cx, (min(lat)+max(lat))/2 AS cy, 111320.0*cos(radians((min(lat)+max(lat))/2)) AS lm
      FROM pois WHERE lat BETWEEN 37.502 AND 37.503 GROUP BY map_id)))""")


@query("crop_trails", T.ctes("segments", "crop_box") + """ SELECT DISTINCT g.map_id, g.edge_ord FROM segments g JOIN crop_box b USING (map_id)
    WHERE (lon_a BETWEEN w AND e AND lat_a BETWEEN s AND n) OR (lon_b BETWEEN w AND e AND lat_b BETWEEN s AND n)""")
def crop_trails(spark, d):
    focus = T.pois(spark, d).filter(F.col("lat").between(37.502, 37.503))
    out = spatial.crop(trails(spark, d).withColumnRenamed("points", "coords"), focus, aspect=1024 / 420)
    return out.select("map_id", "edge_ord")


@query("graph_roundtrip", T.ctes("edges") + " SELECT edge_ord, u, v, key, round_even(length_m,6) AS length_m, geometry FROM edges")
def graph_roundtrip(spark, d):
    from ..sources.maps import read_graph, write_graph

    _, e = read_graph(spark, write_graph(T.nodes(spark, d), T.edges(spark, d)))
    return e.select("edge_ord", "u", "v", "key", "length_m", "geometry")


T.define("osm_ways", [], """SELECT p_partkey//40 AS way_id, p_partkey AS k, CASE WHEN p_partkey%37=0 THEN p_partkey+1000000000 ELSE p_partkey END AS ref, (['path','footway','motorway','service','steps','track'])[(p_partkey//40)%6+1] AS highway,
    (['','No','designated','','yes'])[(p_partkey//40)%5+1] AS foot, (['','private','',''])[(p_partkey//40)%4+1] AS access, (['','-1','yes','no'])[(p_partkey//40)%7%4+1] AS one FROM part""")


@query("osm_graph", T.ctes("osm_ways", "nodes") + f""", legs AS (SELECT a.way_id, CAST(a.k%40 AS INTEGER) AS pos, a.ref AS u, b.ref AS v, a.one FROM osm_ways a JOIN osm_ways b ON b.way_id=a.way_id AND b.k=a.k+1
      WHERE a.highway<>'motorway' AND NOT (lower(a.foot)='no' OR (a.access='private' AND a.foot NOT IN ('designated','yes')))),
    known AS (SELECT l.*, {H('x.lon', 'x.lat', 'y.lon', 'y.lat')} AS len FROM legs l JOIN nodes x ON x.node_id=l.u JOIN nodes y ON y.node_id=l.v)
    SELECT way_id, pos, u, v, round(len,4) AS length_m FROM known WHERE one<>'-1' UNION ALL SELECT way_id, pos, v, u, round(len,4) FROM known WHERE one<>'yes'""")
def osm_graph(spark, d):
    from ..sources.maps import osm_to_graph

    c = F.col
    way = F.expr("p_partkey div 40")
    pick = lambda items, n: F.get(F.array(*[F.lit(i) for i in items]), n.cast("int"))
    ways = T.read(spark, d, "part").groupBy(way.alias("way_id")).agg(
        F.sort_array(F.collect_list(F.struct(c("p_partkey").alias("k"), F.when(c("p_partkey") % 37 == 0, c("p_partkey") + 1000000000).otherwise(c("p_partkey")).alias("r")))).alias("rs"))
    ways = ways.select(
        "way_id", F.transform("rs", lambda x: x["r"]).alias("refs"), pick(["path", "footway", "motorway", "service", "steps", "track"], c("way_id") % 6).alias("highway"),
        pick(["", "No", "designated", "", "yes"], c("way_id") % 5).alias("foot"), pick(["", "private", "", ""], c("way_id") % 4).alias("access"),
        pick(["", "-1", "yes", "no"], c("way_id") % 7 % 4).alias("oneway_foot"))
    out = osm_to_graph(ways, T.nodes(spark, d).select("node_id", "lon", "lat"))
    return out.withColumn("length_m", F.round("length_m", 4))
