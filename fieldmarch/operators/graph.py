"""Graph jobs on node and edge tables: components, shortest paths, routes.

Each loop is a DataFrame program whose state is written to the shared checkpoint folder every
round, so its lineage stays flat and a lost executor only repeats one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import bearing_deg, haversine_m
from ..session import cut, discard


def mapped(df: DataFrame) -> DataFrame:
    """A table of one map without a ``map_id`` gets 0 for it."""
    return df if "map_id" in df.columns else df.withColumn("map_id", F.lit(0))


def dense_ids(nodes: DataFrame) -> DataFrame:
    """``map_id, node_id, vid``: a number for each node of each map, whatever the type of its id, in the order of the ids.

    Loops run on these numbers, so equal ids of two maps are two nodes. The table is written, so the numbers stay.
    """
    ids = mapped(nodes).select("map_id", "node_id").distinct().orderBy("map_id", "node_id")
    return cut(ids.withColumn("vid", F.monotonically_increasing_id()))


def _numbered(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """``df`` with node ids in ``columns`` replaced by their numbers; rows with an unknown node drop out."""
    df = mapped(df)
    for name in columns:
        own = ids.select("map_id", F.col("node_id").alias(name), F.col("vid").alias("_vid"))
        df = df.join(own.hint("merge"), ["map_id", name]).drop(name).withColumnRenamed("_vid", name)
    return df


def weak_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``map_id, node_id, component`` (the smallest node id of each connected part) of undirected links of any number of maps."""
    return _parts(nodes, links, _weak, "component")


def strong_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``map_id, node_id, scc`` (the smallest node id of each strongly connected part) of directed links of any number of maps."""
    return _parts(nodes, links, _strong, "scc")


def _parts(nodes: DataFrame, links: DataFrame, job, name: str) -> DataFrame:
    ids = dense_ids(nodes)
    found = job(ids.select(F.col("vid").alias("node_id")), _numbered(links.select(*[c for c in ("map_id", "u", "v") if c in links.columns]), ids, "u", "v"))
    least = ids.select(F.col("vid").alias(name), F.col("node_id").alias("_least"))
    out = found.withColumnRenamed("node_id", "vid").join(ids.hint("merge"), "vid").join(least.hint("merge"), name)
    return out.select("map_id", "node_id", F.col("_least").alias(name))


def _weak(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node_id, component`` of undirected links between numbered nodes.

    Contraction: every vertex points to its smallest neighbour, pointers are doubled until they
    reach roots, and links are rewritten to roots and de-duplicated. The number of vertices with
    links at least halves each round, so long trails take logarithmically many rounds.
    """
    label = nodes.select("node_id", F.col("node_id").alias("component"))
    live = _undirected(links)
    live = cut(live)
    held, kept = live, label
    while not live.isEmpty():
        point = live.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        point = _roots(point)
        label = label.join(point.select(F.col("a").alias("component"), "to").hint("merge"), "component", "left").select(
            "node_id", F.coalesce("to", "component").alias("component"))
        left = point.select("a", F.col("to").alias("ra"))
        right = point.select(F.col("a").alias("b"), F.col("to").alias("rb"))
        live = live.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select(F.col("ra").alias("u"), F.col("rb").alias("v"))
        before = (held, kept, point)
        live, label = cut(_undirected(live)), cut(label)
        held, kept = live, label
        for table in before:
            discard(table)
    discard(live)
    return label


def _undirected(links: DataFrame) -> DataFrame:
    links = links.select("u", "v").filter("u <> v")
    both = links.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
        links.select(F.col("v").alias("a"), F.col("u").alias("b")))
    return both.distinct()


def _roots(point: DataFrame, jumps: int = 3) -> DataFrame:
    """Double the pointers ``a -> to`` until each leads to a vertex that points to itself."""
    point = cut(point)
    while True:
        ahead = point
        for _ in range(jumps):
            far = ahead.select(F.col("a").alias("to"), F.col("to").alias("far"))
            ahead = ahead.join(far.hint("merge"), "to", "left").select("a", F.coalesce("far", "to").alias("to"))
        ahead = cut(ahead)
        after = ahead.select(F.col("a").alias("to"), F.col("to").alias("next"))
        discard(point)
        if ahead.join(after.hint("merge"), "to").filter("next <> to").isEmpty():
            return ahead
        point = ahead


def _strong(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node_id, scc`` of directed links between numbered nodes.

    Most walkways go both ways, and such pairs are strongly connected as they stand: they are
    contracted first. On what is left, vertices without a way in or out are peeled off, then
    every vertex takes the largest id that reaches it and the part is what can go back to it.
    """
    links = links.select("u", "v").filter("u <> v").distinct()
    mutual = links.join(links.select(F.col("u").alias("v"), F.col("v").alias("u")).hint("merge"), ["u", "v"])
    block = _weak(nodes, mutual)
    left = block.select(F.col("node_id").alias("u"), F.col("component").alias("cu"))
    right = block.select(F.col("node_id").alias("v"), F.col("component").alias("cv"))
    rest = links.join(left.hint("merge"), "u").join(right.hint("merge"), "v").filter("cu <> cv")
    rest = cut(rest.select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct())
    merged = None
    while True:
        rest = _peel(rest)
        if rest.isEmpty():
            break
        color = _reach(rest)
        by_u = color.select(F.col("node_id").alias("u"), F.col("color").alias("ku"))
        by_v = color.select(F.col("node_id").alias("v"), F.col("color").alias("kv"))
        tinted = cut(rest.join(by_u.hint("merge"), "u").join(by_v.hint("merge"), "v"))
        inside = tinted.filter("ku = kv").select("u", "v", F.col("ku").alias("color"))
        # Walk back from each colour's own vertex along links of that colour.
        back = cut(color.filter("node_id = color"))
        front = back
        while True:
            step = inside.join(front.select(F.col("node_id").alias("v"), "color").hint("merge"), ["v", "color"])
            step = step.select(F.col("u").alias("node_id"), "color").distinct()
            front = cut(step.join(back.hint("merge"), ["node_id", "color"], "left_anti"))
            if front.isEmpty():
                break
            back = cut(back.unionByName(front))
        merged = back if merged is None else merged.unionByName(back)
        done = back.select("node_id")
        rest = cut(
            tinted.filter("ku = kv").select("u", "v")
            .join(done.withColumnRenamed("node_id", "u").hint("merge"), "u", "left_anti")
            .join(done.withColumnRenamed("node_id", "v").hint("merge"), "v", "left_anti")
        )
    out = block
    if merged is not None:
        out = block.join(merged.select(F.col("node_id").alias("component"), "color").hint("merge"), "component", "left").select(
            "node_id", F.coalesce("color", "component").alias("component"))
    least = out.groupBy("component").agg(F.min("node_id").alias("scc"))
    return out.join(least.hint("merge"), "component").select("node_id", "scc")


def _peel(links: DataFrame) -> DataFrame:
    """Drop links into dead ends and out of sources until none is left."""
    while True:
        heads = links.select(F.col("u").alias("v")).distinct()
        tails = links.select(F.col("v").alias("u")).distinct()
        kept = cut(links.join(heads.hint("merge"), "v", "left_semi").join(tails.hint("merge"), "u", "left_semi"))
        settled = kept.count() == links.count()
        discard(links)
        if settled:
            return kept
        links = kept


def _reach(links: DataFrame) -> DataFrame:
    """``node_id, color``: the largest vertex id from which each vertex can be reached."""
    ids = links.select(F.col("u").alias("node_id")).unionByName(links.select(F.col("v").alias("node_id"))).distinct()
    held = color = cut(ids.withColumn("color", F.col("node_id")))
    while True:
        sent = links.join(color.withColumnRenamed("node_id", "u").hint("merge"), "u").groupBy(F.col("v").alias("node_id")).agg(
            F.max("color").alias("got"))
        new = color.join(sent.hint("merge"), "node_id", "left").select(
            "node_id", F.greatest("color", F.coalesce("got", "color")).alias("color"),
            (F.coalesce("got", "color") > F.col("color")).alias("changed"))
        new = cut(new)
        discard(held)
        held, color = new, new.select("node_id", "color")
        if new.filter("changed").isEmpty():
            return color


def shortest_edges(edges: DataFrame) -> DataFrame:
    """The shortest of parallel edges, the first in map order on a tie."""
    best = F.min_by(F.struct("edge_ord", "length_m", "geometry"), F.struct("length_m", "edge_ord"))
    return mapped(edges).groupBy("map_id", "u", "v").agg(best.alias("e")).select("map_id", "u", "v", "e.edge_ord", "e.length_m", "e.geometry")


def reachable(pairs: DataFrame, scc: DataFrame, links: DataFrame) -> DataFrame:
    """The (start, goal) pairs with a directed path, told from strong parts alone.

    Inside a part everything is reachable; between parts a search runs over the links that join
    different parts, from the distinct parts that need it.
    """
    at = scc.select(F.col("node_id").alias("start"), F.col("scc").alias("cs"))
    to = scc.select(F.col("node_id").alias("goal"), F.col("scc").alias("cg"))
    placed = cut(pairs.join(at.hint("merge"), "start").join(to.hint("merge"), "goal"))
    asked = placed.filter("cs <> cg").select("cs", "cg").distinct()
    lu = scc.select(F.col("node_id").alias("u"), F.col("scc").alias("at"))
    lv = scc.select(F.col("node_id").alias("v"), F.col("scc").alias("next"))
    over = cut(links.join(lu.hint("merge"), "u").join(lv.hint("merge"), "v").filter("at <> next").select("at", "next").distinct())
    seen = cut(asked.select("cs", F.col("cs").alias("at")).distinct())
    front = seen
    while not front.isEmpty():
        step = front.join(over.hint("merge"), "at").select("cs", F.col("next").alias("at")).distinct()
        front = cut(step.join(seen.hint("merge"), ["cs", "at"], "left_anti"))
        seen = cut(seen.unionByName(front))
    yes = seen.select("cs", F.col("at").alias("cg"))
    same = placed.filter("cs = cg")
    return same.unionByName(placed.filter("cs <> cg").join(yes.hint("merge"), ["cs", "cg"], "left_semi")).select("start", "goal")


def shortest_paths(requests: DataFrame, edges: DataFrame, nodes: DataFrame, detour: float = 1.5, slack_m: float = 150.0) -> DataFrame:
    """``map_id, start, goal, distance_m, hops, path`` of every distinct pair of a map that has a path.

    All pairs advance together. A pair first gets a length budget somewhat above the straight
    line; labels whose length plus straight line to the goal exceeds it are dropped, which
    keeps the search inside an ellipse. Every path within the budget is considered, so a goal
    that is reached has its exact distance; pairs that are not get twice the budget. Only pairs
    known to be reachable are searched, so the loop ends.
    """
    ids = dense_ids(nodes)
    wanted = mapped(requests).select("map_id", "start", "goal").distinct()
    lengths = mapped(edges).groupBy("map_id", "u", "v").agg(F.min("length_m").alias("length_m"))
    places = _numbered(nodes.select(*[c for c in ("map_id", "node_id", "lon", "lat") if c in nodes.columns]), ids, "node_id")
    paths = _paths(_numbered(wanted, ids, "start", "goal"), _numbered(lengths, ids, "u", "v"), places, detour, slack_m)
    back = ids.select("map_id", "node_id", F.col("vid").alias("node"))
    named = (
        paths.select("start", "goal", F.posexplode("path").alias("pos", "node")).join(back.hint("merge"), "node")
        .groupBy("start", "goal").agg(F.first("map_id").alias("map_id"), F.sort_array(F.collect_list(F.struct("pos", "node_id"))).alias("_p"))
        .select("start", "goal", "map_id", F.col("_p.node_id").alias("path"))
    )
    return paths.drop("path").join(named.hint("merge"), ["start", "goal"]).select(
        "map_id", F.get("path", F.lit(0)).alias("start"), F.element_at("path", -1).alias("goal"), "distance_m", "hops", "path")


def _paths(requests: DataFrame, edges: DataFrame, nodes: DataFrame, detour: float, slack_m: float) -> DataFrame:
    """The same on numbered nodes."""
    links = cut(edges.select("u", "v", "length_m"))
    scc = cut(_strong(nodes.select("node_id"), links))
    pairs = reachable(requests.select("start", "goal").distinct(), scc, links)
    at = nodes.select(F.col("node_id").alias("start"), F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
    to = nodes.select(F.col("node_id").alias("goal"), F.col("lon").alias("g_lon"), F.col("lat").alias("g_lat"))
    straight = haversine_m(F.col("s_lon"), F.col("s_lat"), F.col("g_lon"), F.col("g_lat"))
    pairs = pairs.join(at.hint("merge"), "start").join(to.hint("merge"), "goal").select(
        "start", "goal", "g_lon", "g_lat", (straight * detour + slack_m).alias("budget"))
    pairs = cut(pairs)
    roads = links.join(nodes.select(F.col("node_id").alias("v"), "lon", "lat").hint("merge"), "v").withColumnRenamed("u", "node")
    roads = cut(roads)
    done = None
    while not pairs.isEmpty():
        paths = cut(_search(pairs, roads))
        done = paths if done is None else done.unionByName(paths)
        rest = pairs.join(paths.select("start", "goal").hint("merge"), ["start", "goal"], "left_anti")
        before, pairs = pairs, cut(rest.withColumn("budget", F.col("budget") * 2))
        discard(before)
    if done is None:
        schema = "start bigint, goal bigint, distance_m double, hops int, path array<bigint>"
        return nodes.sparkSession.createDataFrame([], schema)
    return done


def _search(pairs: DataFrame, roads: DataFrame) -> DataFrame:
    """``start, goal, distance_m, hops, path`` of the pairs that have a path within their budget.

    A label holds its pair's goal and budget and its own path, so a round has one join with the roads and one exchange by pair. Once the
    goal has a label, the others count only as far as they may still lead to a shorter one; pairs without a fresh label leave the state.
    """
    keys, own = ["start", "goal"], ["g_lon", "g_lat", "budget"]
    c, w = F.col, Window.partitionBy("start", "goal")
    state = pairs.select(
        *keys, *own, c("start").alias("node"), F.lit(0.0).alias("d"), F.lit(True).alias("fresh"), F.lit(0).alias("hops"), F.lit(None).cast("bigint").alias("parent"),
        F.array("start").alias("path"), F.lit(0.0).alias("ahead"), F.when(c("start") == c("goal"), 0.0).otherwise(c("budget")).alias("limit"))
    held = done = None
    while True:
        step = state.filter("fresh").join(roads.hint("merge"), "node")
        nd = c("d") + c("length_m")
        ahead = haversine_m(c("lon"), c("lat"), c("g_lon"), c("g_lat")) * (1 - 1e-9)
        step = step.select(
            *keys, *own, c("v").alias("node"), nd.alias("d"), F.lit(True).alias("fresh"), (c("hops") + 1).alias("hops"), c("node").alias("parent"),
            F.concat("path", F.array("v")).alias("path"), ahead.alias("ahead"), "limit").filter("d + ahead <= limit + 1e-6").drop("limit")
        # false sorts before true, so a label is fresh only when it is really shorter.
        label = F.min(F.struct("d", "fresh", "hops", "parent", "path", "ahead")).alias("l")
        new = state.drop("limit").withColumn("fresh", F.lit(False)).unionByName(step).repartition(*keys).groupBy(*keys, *own, "node").agg(label)
        new = new.select(*keys, *own, "node", "l.*", F.least("budget", F.min(F.when(c("node") == c("goal"), c("l.d"))).over(w)).alias("limit"))
        new = new.withColumn("_in", c("d") + c("ahead") <= c("limit") + 1e-6).withColumn("live", F.max(c("fresh") & c("_in")).over(w))
        table = cut(new.filter((c("live") & c("_in")) | (c("node") == c("goal"))).drop("_in"))
        ready = cut(table.filter("NOT live AND node = goal").select(*keys, c("d").alias("distance_m"), "hops", "path"))
        done = ready if done is None else done.unionByName(ready)
        if held is not None:
            discard(held)
        held, state = table, table.filter("live").drop("live")
        if state.isEmpty():
            discard(held)
            return done


POINTS = "array<struct<lon:double,lat:double>>"


def linestring(wkt: Column) -> Column:
    """Vertices of a WKT line (a third ordinate is ignored); NULL unless two or more good points."""
    inner = F.regexp_extract(F.trim(wkt), r"(?is)^LINESTRING\s*Z?\s*\((.*)\)$", 1)
    parts = F.transform(F.split(inner, ","), lambda p: F.split(F.trim(p), r"\s+"))
    points = F.transform(
        parts, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("lon"), F.get(p, F.lit(1)).try_cast("double").alias("lat")))
    good = F.forall(points, lambda p: F.coalesce(p["lon"].between(-180, 180) & p["lat"].between(-90, 90), F.lit(False)))
    return F.when((inner != "") & (F.size(points) >= 2) & good, points)


def oriented(points: Column, lon_u, lat_u, lon_v, lat_v) -> Column:
    """Edge vertices from u to v: reversed when the reversed ends are closer, the two ends when unknown."""
    first, last = F.get(points, F.lit(0)), F.element_at(points, -1)
    ahead = haversine_m(lon_u, lat_u, first["lon"], first["lat"]) + haversine_m(lon_v, lat_v, last["lon"], last["lat"])
    back = haversine_m(lon_u, lat_u, last["lon"], last["lat"]) + haversine_m(lon_v, lat_v, first["lon"], first["lat"])
    ends = F.array(F.struct(lon_u.alias("lon"), lat_u.alias("lat")), F.struct(lon_v.alias("lon"), lat_v.alias("lat")))
    return F.when(points.isNull(), ends).when(back < ahead, F.reverse(points)).otherwise(points)


def edge_points(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``points``, their vertices from u to v."""
    edges, nodes = mapped(edges), mapped(nodes)
    u = nodes.select("map_id", F.col("node_id").alias("u"), F.col("lon").alias("lon_u"), F.col("lat").alias("lat_u"))
    v = nodes.select("map_id", F.col("node_id").alias("v"), F.col("lon").alias("lon_v"), F.col("lat").alias("lat_v"))
    at = edges.join(u.hint("merge"), ["map_id", "u"]).join(v.hint("merge"), ["map_id", "v"]).withColumn("_g", linestring(F.col("geometry")))
    pts = oriented(F.col("_g"), *[F.col(c) for c in ("lon_u", "lat_u", "lon_v", "lat_v")])
    return at.select(*edges.columns, pts.alias("points"))


def route_geometry(paths: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vertices and length of node paths: shortest parallel edge per hop, no joint repeated.

    A path of one node gives that node as its only vertex.
    """
    keys = ["map_id", "start", "goal"]
    paths, nodes = mapped(paths), mapped(nodes)
    best = edge_points(shortest_edges(edges), nodes)
    hops = paths.filter(F.size("path") > 1).select(
        *keys, F.posexplode(F.arrays_zip(
            F.slice("path", F.lit(1), F.size("path") - 1).alias("u"), F.slice("path", F.lit(2), F.size("path") - 1).alias("v"))).alias("hop", "e"))
    hops = hops.select(*keys, "hop", "e.u", "e.v").join(best.hint("merge"), ["map_id", "u", "v"])
    tail = F.when(F.col("hop") == 0, F.col("points")).otherwise(F.slice("points", F.lit(2), F.size("points") - 1))
    joined = hops.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("hop", tail.alias("points"), "length_m"))).alias("_h"))
    lines = joined.select(
        *keys, F.flatten(F.transform("_h", lambda h: h["points"])).alias("points"),
        F.aggregate("_h", F.lit(0.0), lambda a, h: a + h["length_m"]).alias("distance_m"))
    place = nodes.select("map_id", F.col("node_id").alias("start"), "lon", "lat")
    single = paths.filter(F.size("path") == 1).join(place.hint("merge"), ["map_id", "start"]).select(
        *keys, F.array(F.struct("lon", "lat")).cast(POINTS).alias("points"), F.lit(0.0).alias("distance_m"))
    return lines.withColumn("points", F.col("points").cast(POINTS)).unionByName(single)


def route_records(trips: DataFrame, edges: DataFrame, nodes: DataFrame, max_snap_m: float = 250.0, speed_mps: float = 1.0) -> DataFrame:
    """Route of every trip (``req_id, map_id, lon, lat, to_lon, to_lat``), or the reason for none."""
    from .spatial import snap

    a = snap(trips, nodes, "req_id", max_snap_m).select("req_id", F.col("node_id").alias("start"), F.col("snap_m").alias("start_snap_m"), F.col("snapped").alias("_a"))
    b = snap(trips.select("req_id", "map_id", F.col("to_lon").alias("lon"), F.col("to_lat").alias("lat")), nodes, "req_id", max_snap_m).select(
        "req_id", F.col("node_id").alias("goal"), F.col("snap_m").alias("goal_snap_m"), F.col("snapped").alias("_b"))
    ends = cut(trips.join(a.hint("merge"), "req_id", "left").join(b.hint("merge"), "req_id", "left"))
    wanted = ends.filter("_a AND _b")
    paths = cut(shortest_paths(wanted, edges, nodes))
    lines = route_geometry(paths, edges, nodes)
    out = ends.join(lines.withColumn("_found", F.lit(True)).hint("merge"), ["map_id", "start", "goal"], "left")
    c = F.col
    reason = (
        F.when(~F.coalesce("_a", F.lit(False)), "start_out_of_bounds").when(~F.coalesce("_b", F.lit(False)), "goal_out_of_bounds")
        .when(c("_found").isNull(), "no_path")
    )
    ahead = F.get(F.filter("points", lambda p: haversine_m(c("lon"), c("lat"), p["lon"], p["lat"]) > 3.0), F.lit(0))
    far = lambda p, lon, lat: haversine_m(c(lon), c(lat), p["lon"], p["lat"]) > 1.0
    here, there = F.struct("lon", "lat"), F.struct(c("to_lon").alias("lon"), c("to_lat").alias("lat"))
    none = F.array().cast(POINTS)
    line = F.concat(
        F.when(far(F.get("points", F.lit(0)), "lon", "lat"), F.array(here).cast(POINTS)).otherwise(none), c("points"),
        F.when(far(F.element_at("points", -1), "to_lon", "to_lat"), F.array(there).cast(POINTS)).otherwise(none))
    total = F.bround(c("distance_m") + c("start_snap_m") + c("goal_snap_m"), 1)
    ok = reason.isNull()
    return out.select(
        "req_id", reason.alias("reason"), F.when(ok, total).alias("distance_m"),
        F.when(ok, F.ceil(total / speed_mps / 60.0)).alias("eta_min"),
        F.when(ok, F.bround(haversine_m(c("lon"), c("lat"), c("to_lon"), c("to_lat")), 1)).alias("straight_m"),
        F.when(ok, F.bround(bearing_deg(c("lon"), c("lat"), F.coalesce(ahead["lon"], c("to_lon")), F.coalesce(ahead["lat"], c("to_lat")))).cast("int")).alias("bearing_deg"),
        F.when(ok, line).alias("points"),
    )


def suggested_pair(nodes: DataFrame, scc: DataFrame) -> DataFrame:
    """Per map: the southernmost (then westernmost) node of the largest strong part, and the node farthest from it."""
    at = mapped(nodes).join(mapped(scc), ["map_id", "node_id"])
    size = at.groupBy("map_id", "scc").agg(F.count(F.lit(1)).alias("n"), F.min("node_ord").alias("first"))
    big = size.groupBy("map_id").agg(F.max_by("scc", F.struct("n", -F.col("first"))).alias("scc"))
    inside = at.join(big, ["map_id", "scc"])
    here = inside.groupBy("map_id").agg(
        F.min_by(F.struct("node_id", "lon", "lat"), F.struct("lat", "lon", "node_ord")).alias("s"))
    d = haversine_m(F.col("s.lon"), F.col("s.lat"), F.col("lon"), F.col("lat"))
    return inside.join(here, "map_id").groupBy("map_id").agg(
        F.first("s.node_id").alias("start"), F.max_by("node_id", F.struct(d, -F.col("node_ord"))).alias("goal"))


def undirected(edges: DataFrame, extra: list[str] = ()) -> DataFrame:
    """One row per unordered node pair (and ``extra`` columns): the first in map order."""
    a, b = F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")
    keep = F.min_by(F.struct(*[c for c in edges.columns if c not in extra and c != "map_id"]), F.col("edge_ord"))
    return edges.groupBy("map_id", a, b, *extra).agg(keep.alias("e")).select("map_id", *extra, "e.*")


def check_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Contract of each map: it has nodes and edges, coordinates in range, finite positive lengths."""
    n = nodes.groupBy("map_id").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(~(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))).alias("bad_nodes"))
    e = edges.groupBy("map_id").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.count_if(~F.coalesce((F.col("length_m") > 0) & (F.col("length_m") < float("inf")), F.lit(False))).alias("bad_edges"))
    both = n.join(e, "map_id", "full")
    cols = ["n_nodes", "bad_nodes", "n_edges", "bad_edges"]
    both = both.select("map_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])
    return both.withColumn(
        "valid", (F.col("n_nodes") > 0) & (F.col("n_edges") > 0) & (F.col("bad_nodes") == 0) & (F.col("bad_edges") == 0))
