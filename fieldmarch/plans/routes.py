"""Routes, progress along them, arrival, and the daylight plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import solar, status
from ..operators import graph, routes, spatial
from . import maps as M, tables as T
from .registry import query

H = T.haversine_sql


def walks(spark: SparkSession, d: str) -> DataFrame:
    """One planned walk a device: zigzag, out and back, or a line, on the device's home row."""
    dev = T.read(spark, d, "events").select(F.col("user_id").alias("route_id")).distinct()
    x = lambda i: F.when(F.col("route_id") % 3 == 1, F.least(i, 12 - i)).otherwise(i)
    y = lambda i: F.when(F.col("route_id") % 3 == 0, i % 2).otherwise(F.lit(0))
    pts = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.struct(
        ((1270000000 + x(i) * 10000) / F.lit(1e7)).alias("lon"),
        ((375000000 + F.expr("route_id * 5000 div 3") + y(i) * 5000) / F.lit(1e7)).alias("lat")))
    return dev.select("route_id", pts.alias("points"))


T.define("walk_pts", [], """SELECT route_id, i, CAST(1270000000+(CASE WHEN route_id%3=1 THEN least(i,12-i) ELSE i END)*10000 AS DOUBLE)/1e7 AS lon,
    CAST(375000000+route_id*5000//3+(CASE WHEN route_id%3=0 THEN i%2 ELSE 0 END)*5000 AS DOUBLE)/1e7 AS lat
    FROM (SELECT DISTINCT user_id AS route_id FROM events) CROSS JOIN range(0,13) r(i)""")
T.define("walk_segs", ["walk_pts"], f"""SELECT *, coalesce(sum(len) OVER (PARTITION BY route_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before,
    coalesce(sum(len) OVER (PARTITION BY route_id ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS after FROM (
    SELECT a.route_id, a.i, a.lon AS lon_a, a.lat AS lat_a, b.lon AS lon_b, b.lat AS lat_b, {H('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS len
    FROM walk_pts a JOIN walk_pts b ON b.route_id=a.route_id AND b.i=a.i+1)""")


@query("path_length", T.ctes("walk_pts") + f""" SELECT route_id, round(sum(l),3) AS length_m FROM (SELECT a.route_id, {H('a.lon', 'a.lat', 'b.lon', 'b.lat', 6371008.8)} AS l
    FROM walk_pts a JOIN walk_pts b ON b.route_id=a.route_id AND b.i=a.i+1) GROUP BY route_id""")
def path_length(spark, d):
    return walks(spark, d).select("route_id", F.round(routes.path_length(F.col("points")), 3).alias("length_m"))


@query("route_progress", T.ctes("walk_segs", "fixes") + """ , cand AS (SELECT event_id, low, i, sqrt(pow(ax+u*dx,2)+pow(ay+u*dy,2)) AS cr, before+len*u AS pr, len*(1-u)+after AS rem FROM (
      SELECT *, greatest(0.0,least(1.0,-(ax*dx+ay*dy)/(dx*dx+dy*dy))) AS u FROM (SELECT *, bx-ax AS dx, by_-ay AS dy FROM (
        SELECT f.event_id, CAST(f.event_id%500 AS DOUBLE) AS low, s.*, (lon_a-lon)*111320.0*greatest(0.15,cos(radians((lat+lat_a+lat_b)/3.0))) AS ax, (lat_a-lat)*111132.0 AS ay,
          (lon_b-lon)*111320.0*greatest(0.15,cos(radians((lat+lat_a+lat_b)/3.0))) AS bx, (lat_b-lat)*111132.0 AS by_
        FROM fixes f JOIN walk_segs s ON s.route_id=f.device_id)))),
    ok AS (SELECT *, min(cr) OVER (PARTITION BY event_id) AS best FROM cand WHERE pr+3>=low),
    ties AS (SELECT event_id, max(pr)-min(pr) AS spread, arg_min(pr,[cr,abs(pr-low)]) AS pr, min(cr) AS cr, arg_min(rem,[cr,abs(pr-low)]) AS rem FROM ok WHERE cr<=best+0.75 GROUP BY event_id)
    SELECT f.event_id, round(CASE WHEN spread<=5 THEN cr END,3) AS cross_m, round(CASE WHEN spread<=5 THEN pr END,3) AS progress_m, round(CASE WHEN spread<=5 THEN rem END,3) AS remaining_m,
      coalesce(spread<=5 AND cr<=8,false) AS keep_route FROM fixes f LEFT JOIN ties USING (event_id)""")
def route_progress(spark, d):
    pos = T.fixes(spark, d).select(
        "event_id", F.col("device_id").alias("route_id"), "lon", "lat", (F.col("event_id") % 500).cast("double").alias("min_progress_m"))
    out = routes.progress(pos, routes.route_profile(walks(spark, d)))
    return out.select(
        "event_id", F.round("at.cross", 3).alias("cross_m"), F.round("at.progress", 3).alias("progress_m"),
        F.round("at.remaining", 3).alias("remaining_m"),
        F.coalesce(F.col("at.cross") <= routes.CACHE_CROSS_TRACK_M, F.lit(False)).alias("keep_route"))


@query("point_along", T.ctes("walk_segs", "fixes") + """ , hit AS (SELECT f.event_id, f.m, min(s.i) FILTER (m<=before+len) AS i FROM (SELECT event_id, device_id, CAST(event_id%2000 AS DOUBLE) AS m FROM fixes) f
      JOIN walk_segs s ON s.route_id=f.device_id GROUP BY f.event_id, f.m)
    SELECT f.event_id, round(CASE WHEN h.i IS NULL THEN l.lon_b ELSE s.lon_a+(s.lon_b-s.lon_a)*((h.m-s.before)/s.len) END,7) AS lon,
      round(CASE WHEN h.i IS NULL THEN l.lat_b ELSE s.lat_a+(s.lat_b-s.lat_a)*((h.m-s.before)/s.len) END,7) AS lat, h.i IS NULL AS done
    FROM fixes f JOIN hit h USING (event_id) LEFT JOIN walk_segs s ON s.route_id=f.device_id AND s.i=h.i JOIN walk_segs l ON l.route_id=f.device_id AND l.i=11""")
def point_along(spark, d):
    pos = T.fixes(spark, d).select("event_id", F.col("device_id").alias("route_id"), (F.col("event_id") % 2000).cast("double").alias("m"))
    out = pos.join(routes.route_profile(walks(spark, d)), "route_id")
    at = routes.point_along(F.col("segs"), F.col("m"))
    out = out.select("event_id", at.alias("at"))
    return out.select("event_id", F.round("at.lon", 7).alias("lon"), F.round("at.lat", 7).alias("lat"), "at.done")


@query("route_deviation", T.ctes("walk_segs", "fixes") + """ SELECT event_id, round(min(dist),3) AS offset_m, min(dist)>30 AS off_route FROM (
    SELECT event_id, sqrt(pow(ax+dx*u,2)+pow(ay+dy*u,2)) AS dist FROM (SELECT *, least(1.0,greatest(0.0,-(ax*dx+ay*dy)/(dx*dx+dy*dy))) AS u FROM (
      SELECT event_id, ax, ay, bx-ax AS dx, by_-ay AS dy FROM (SELECT event_id, (lon_a-lon)*111320.0*cos(radians(lat)) AS ax, (lat_a-lat)*111320.0 AS ay,
        (lon_b-lon)*111320.0*cos(radians(lat)) AS bx, (lat_b-lat)*111320.0 AS by_ FROM fixes f JOIN walk_segs s ON s.route_id=f.device_id)))) GROUP BY event_id""")
def route_deviation(spark, d):
    pos = T.fixes(spark, d).select("event_id", F.col("device_id").alias("route_id"), "lon", "lat")
    out = pos.join(routes.route_profile(walks(spark, d)), "route_id")
    off = routes.deviation_m(F.col("lon"), F.col("lat"), F.col("segs"))
    out = out.select("event_id", off.alias("off"))
    return out.select("event_id", F.round("off", 3).alias("offset_m"), (F.col("off") > routes.DEVIATION_M).alias("off_route"))


@query("trail_status", T.ctes("offsets") + """ SELECT event_id, round_even(offset_m,1) AS offset_m, CASE WHEN NOT fix THEN 'last_fix_only'
    WHEN acc_m IS NULL THEN CASE WHEN offset_m>60 THEN 'off_trail_estimate' ELSE 'accuracy_unknown' END WHEN offset_m-acc_m>30 THEN 'off_trail' WHEN offset_m+acc_m<=30 THEN 'on_trail' ELSE 'uncertain' END AS status,
    offset_m<=greatest(20,coalesce(acc_m,0)) AS on_trail FROM offsets JOIN fixes USING (event_id)""")
def trail_status(spark, d):
    fx = T.fixes(spark, d)
    off = spatial.trail_offset(fx, M.segments(spark, d), T.nodes(spark, d), "event_id")
    j = fx.select("event_id", "fix", "acc_m").join(off, "event_id")
    return j.select(
        "event_id", F.bround("offset_m", 1).alias("offset_m"),
        status.trail_status(F.lit(True), F.col("fix"), F.col("offset_m"), F.col("acc_m")).alias("status"),
        status.on_trail(F.col("offset_m"), F.col("acc_m")).alias("on_trail"))


@query("arrival", T.ctes("fixes") + f""" SELECT event_id, CASE WHEN event_id%11=0 THEN 'route_unavailable' WHEN NOT fix THEN 'gps_fix_required' WHEN acc_m IS NULL THEN 'accuracy_required'
    WHEN acc_m>20 THEN 'accuracy_insufficient' WHEN s<=greatest(10,acc_m) THEN 'arrived' ELSE 'enroute' END AS status FROM (
    SELECT *, {H('lon', 'lat', '127.005', 'lat+0.00005::DOUBLE')}/20.0 AS s FROM fixes)""")
def arrival(spark, d):
    from ..functions.geo import haversine_m

    c = F.col
    s = haversine_m(c("lon"), c("lat"), F.lit(127.005), c("lat") + 0.00005) / 20.0
    return T.fixes(spark, d).select(
        "event_id", status.arrival_status(c("event_id") % 11 != 0, c("fix"), c("acc_m"), s).alias("status"))


@query("eta", "SELECT l_orderkey, l_linenumber, CAST(ceil(l_extendedprice/1.0/60) AS BIGINT) AS eta_min, CAST(ceil(l_extendedprice/0.8/60) AS BIGINT) AS travel_min FROM lineitem")
def eta(spark, d):
    m = F.col("l_extendedprice")
    return T.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", status.eta_min(m).alias("eta_min"), status.eta_min(m, status.RETURN_MPS).alias("travel_min"))


def sun_sql(zenith: float, rising: bool) -> str:
    """Epoch seconds of a sun event for rows with day, doy, lat, lon, off (fixed UTC offset, minutes)."""
    hour = "360.0-degrees(acos(ch))" if rising else "degrees(acos(ch))"
    return f"""(SELECT list_extract(list_filter(t, lambda e: (e+off*60)//86400*86400=mid),1) FROM (SELECT [mid-86400+sec, mid+sec, mid+86400+sec] AS t FROM (
      SELECT CAST(round_even(CASE WHEN ch BETWEEN -1 AND 1 THEN fmod(fmod(({hour})/15.0+(ra+floor(tl/90.0)*90.0-floor(ra/90.0)*90.0)/15.0-0.06571*ap-6.622-lon/15.0,24.0)+24.0,24.0) END*3600.0,0) AS BIGINT) AS sec FROM (
      SELECT *, (cos(radians({zenith}))-0.39782*sin(radians(tl))*sin(radians(lat)))/(cos(asin(0.39782*sin(radians(tl))))*cos(radians(lat))) AS ch,
        fmod(fmod(degrees(atan(0.91764*tan(radians(tl)))),360.0)+360.0,360.0) AS ra FROM (
      SELECT ap, fmod(fmod(ma+1.916*sin(radians(ma))+0.020*sin(radians(2.0*ma))+282.634,360.0)+360.0,360.0) AS tl FROM (
      SELECT ap, 0.9856*ap-3.289 AS ma FROM (SELECT doy+({6.0 if rising else 18.0}-lon/15.0)/24.0 AS ap)))))))"""


T.define("days", [], """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(dayofyear(o_orderdate) AS DOUBLE) AS doy, CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) AS mid,
    CAST(o_custkey*13%140-70 AS DOUBLE) AS lat, CAST(o_custkey*29%360-180 AS DOUBLE) AS lon, (o_custkey*29%360-180)*4 AS off, o_totalprice FROM orders""")
T.define("suns", ["days"], f"SELECT *, {sun_sql(90.833, True)} AS sunrise, {sun_sql(90.833, False)} AS sunset, {sun_sql(96.0, False)} AS civil_end FROM days")


def days(spark: SparkSession, d: str) -> DataFrame:
    """One plan a (date, place): order dates at places all over the globe, with the place's own offset."""
    c = F.col
    off = (c("o_custkey") * 29 % 360 - 180) * 4
    o = T.read(spark, d, "orders").select(
        "o_orderkey", c("o_orderdate").cast("date").alias("day"), (c("o_custkey") * 13 % 140 - 70).cast("double").alias("lat"),
        (c("o_custkey") * 29 % 360 - 180).cast("double").alias("lon"), off.alias("off"), "o_totalprice")
    return solar.sun_events(o, c("day"), c("lat"), c("lon"), c("off"))


@query("sun_times", T.ctes("suns") + """ SELECT o_orderkey, sunrise, sunset, civil_end, CAST(floor((sunset-(mid+43200-off*60))/60.0) AS BIGINT) AS remaining_min FROM suns""")
def sun_times(spark, d):
    noon = F.unix_date("day") * F.lit(86400).cast("bigint") + 43200 - F.col("off") * 60
    return days(spark, d).select(
        "o_orderkey", "sunrise", "sunset", "civil_end", F.floor((F.col("sunset") - noon) / 60.0).alias("remaining_min"))


@query("return_deadline", T.ctes("suns") + """ SELECT o_orderkey, CASE WHEN ok THEN by_ END AS return_by, CASE WHEN ok THEN lft END AS return_in_min, CASE WHEN ok THEN tr END AS travel_min,
    CASE WHEN o_orderkey%13=0 THEN 'last_fix_only' WHEN o_orderkey%7=0 THEN CASE WHEN o_orderkey%2=0 THEN 'route_unavailable' ELSE 'basecamp_required' END WHEN sunset IS NULL THEN 'sun_event_unavailable'
      WHEN lft<=0 THEN 'return_now' WHEN lft<=30 THEN 'caution' ELSE 'scheduled' END AS status,
    CASE WHEN ok THEN CASE WHEN lft<=0 THEN 'danger' WHEN lft<=30 THEN 'caution' ELSE 'normal' END ELSE 'unknown' END AS level FROM (
    SELECT *, o_orderkey%13<>0 AND o_orderkey%7<>0 AND sunset IS NOT NULL AS ok, CAST(floor((by_-(mid+43200-off*60))/60.0) AS BIGINT) AS lft FROM (
      SELECT *, CAST(ceil(o_totalprice/50/0.8/60.0) AS BIGINT) AS tr, sunset-(CAST(ceil(o_totalprice/50/0.8/60.0) AS BIGINT)+30)*60 AS by_ FROM suns))""")
def return_deadline(spark, d):
    c = F.col
    noon = F.unix_date("day") * F.lit(86400).cast("bigint") + 43200 - c("off") * 60
    plan = status.return_plan(
        F.lit(True), c("o_orderkey") % 13 != 0, c("o_orderkey") % 2 == 0, c("o_orderkey") % 7 != 0, c("o_totalprice") / 50, c("sunset"), noon)
    return days(spark, d).select("o_orderkey", *[v.alias(k) for k, v in plan.items()])


@query("route_geometry")
def route_geometry(spark, d):
    n, e = T.nodes(spark, d), T.edges(spark, d)
    paths = graph.cut(graph.shortest_paths(T.requests(spark, d), e, n))
    g = graph.route_geometry(paths, e, n)
    return g.select("start", "goal", F.size("points").alias("n_points"), F.round("distance_m", 3).alias("distance_m"))


@query("route_record")
def route_record(spark, d):
    n, e = T.nodes(spark, d), T.edges(spark, d)
    at = lambda k: n.select(F.col("node_id").alias(k), F.col("lon").alias(f"{k}_lon"), F.col("lat").alias(f"{k}_lat"))
    r = T.requests(spark, d).join(at("start").hint("merge"), "start").join(at("goal").hint("merge"), "goal")
    trips = r.select(
        "req_id", "map_id", (F.col("start_lon") + F.col("req_id") % 50 * 0.0001 - 0.001).alias("lon"), F.col("start_lat").alias("lat"),
        F.col("goal_lon").alias("to_lon"), (F.col("goal_lat") + 0.0001).alias("to_lat"))
    out = graph.route_records(trips, e, n)
    return out.select("req_id", "reason", "distance_m", "eta_min", "straight_m", "bearing_deg", F.size("points").alias("n_points"))


def walkers(spark: SparkSession, d: str) -> DataFrame:
    """Positions of devices that walk their route with time, some metres beside it; some take another one for the last third."""
    c = F.col
    e = T.ev(spark, d)
    route = F.when((c("t_s") > 6000) & (c("device_id") % 5 == 0) & (c("device_id") >= 3), c("device_id") - 3).otherwise(c("device_id"))
    u = c("t_s") / 750.0
    x = F.when(route % 3 == 1, F.least(u, 12.0 - u)).otherwise(u)
    off = c("event_id") * 7919 % 1601 - 800
    return e.select(
        "event_id", "device_id", "t_s", route.alias("route_id"), ((1270000000 + x * 10000) / F.lit(1e7)).alias("lon"),
        ((375000000 + F.floor(route * 5000 / 3) + off) / F.lit(1e7)).alias("lat"))


T.define("walkers", ["ev"], """SELECT *, (1270000000+(CASE WHEN route_id%3=1 THEN least(t_s/750.0::DOUBLE, 12.0::DOUBLE-t_s/750.0::DOUBLE) ELSE t_s/750.0::DOUBLE END)*10000)/1e7 AS lon,
    CAST(375000000+route_id*5000//3+event_id*7919%1601-800 AS DOUBLE)/1e7 AS lat, row_number() OVER (PARTITION BY device_id ORDER BY t_s, event_id) AS rn FROM (
      SELECT event_id, device_id, t_s, CASE WHEN t_s>6000 AND device_id%5=0 AND device_id>=3 THEN device_id-3 ELSE device_id END AS route_id FROM ev)""")
T.define("spots", ["walkers", "walk_segs"], """SELECT event_id, device_id, route_id, rn, list({'cr': sqrt(pow(ax+u*dx,2)+pow(ay+u*dy,2)), 'pr': before+len*u, 'rem': len*(1-u)+after}) AS spots FROM (
      SELECT *, greatest(0.0,least(1.0,-(ax*dx+ay*dy)/(dx*dx+dy*dy))) AS u FROM (SELECT *, bx-ax AS dx, by_-ay AS dy FROM (
        SELECT f.event_id, f.device_id, f.rn, s.*, (lon_a-lon)*111320.0*greatest(0.15,cos(radians((lat+lat_a+lat_b)/3.0))) AS ax, (lat_a-lat)*111132.0 AS ay,
          (lon_b-lon)*111320.0*greatest(0.15,cos(radians((lat+lat_a+lat_b)/3.0))) AS bx, (lat_b-lat)*111132.0 AS by_
        FROM walkers f JOIN walk_segs s USING (route_id)))) GROUP BY event_id, device_id, route_id, rn""")
T.define("followed", ["spots"], """SELECT DISTINCT device_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS route_id, CAST(0 AS DOUBLE) AS p, true AS reroute, CAST(NULL AS DOUBLE) AS rem FROM spots
    UNION ALL SELECT device_id, rn, event_id, route_id, CASE WHEN keep THEN greatest(low, pk.pr) ELSE low END, NOT keep, CASE WHEN keep THEN pk.rem END FROM (
      SELECT *, coalesce(spread<=5 AND pk.cr<=8, false) AS keep FROM (
        SELECT *, list_max(list_transform(ties, lambda x: x.pr))-list_min(list_transform(ties, lambda x: x.pr)) AS spread, list_min(list_transform(ties, lambda x: {'cr': x.cr, 'j': abs(x.pr-low), 'pr': x.pr, 'rem': x.rem})) AS pk FROM (
          SELECT *, list_filter(ok, lambda x: x.cr<=list_min(list_transform(ok, lambda y: y.cr))+0.75) AS ties FROM (
            SELECT *, list_filter(spots, lambda x: x.pr+3>=low) AS ok FROM (
              SELECT b.*, CASE WHEN a.route_id=b.route_id THEN a.p ELSE 0 END AS low FROM followed a JOIN spots b ON b.device_id=a.device_id AND b.rn=a.rn+1)))))""")


@query("route_follow", T.ctes("followed") + " SELECT event_id, reroute, round(p,3) AS progress_m, round(rem,3) AS remaining_m FROM followed WHERE rn>0")
def route_follow(spark, d):
    spots = routes.candidates(walkers(spark, d), routes.route_profile(walks(spark, d))).select("event_id", "device_id", "t_s", "route_id", "spots")
    out = routes.follow(spots, ["device_id"], chunk_s=1000.0)
    return out.select("event_id", "reroute", F.round("progress_m", 3).alias("progress_m"), F.round("remaining_m", 3).alias("remaining_m"))


@query("utc_offset", """SELECT event_id, CAST(CASE WHEN cfg BETWEEN -840 AND 840 THEN cfg WHEN zone IS NOT NULL THEN (epoch(timezone(zone, timezone('UTC', ts)))-epoch(ts))/60 ELSE 540 END AS BIGINT) AS offset_min FROM (
    SELECT event_id, ts, CASE WHEN event_id%3=0 THEN event_id*37%2000-1000 END AS cfg, (['Asia/Seoul','Europe/Paris','America/New_York',NULL])[event_id%4+1] AS zone FROM events)""")
def utc_offset(spark, d):
    c = F.col
    e = T.read(spark, d, "events")
    zone = F.get(F.array(*[F.lit(z) for z in ("Asia/Seoul", "Europe/Paris", "America/New_York", None)]), (c("event_id") % 4).cast("int"))
    cfg = F.when(c("event_id") % 3 == 0, c("event_id") * 37 % 2000 - 1000)
    return e.select("event_id", solar.offset_minutes(cfg, zone, c("ts").cast("timestamp"), 540).cast("bigint").alias("offset_min"))
