"""Engine tables derived from the given tables, each as a Spark plan and as DuckDB SQL.

The SQL twins are common table expressions; ``ctes("fixes")`` gives one with all it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geo import haversine_m


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; how finely files are split is the session's ``spark.sql.files.maxPartitionBytes``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, d: str) -> DataFrame:
    """Device events: one user is one device, ten days are one boot, time runs 300 times faster."""
    return read(spark, d, "events").select(
        "event_id", F.col("user_id").alias("device_id"),
        F.floor((F.dayofmonth("ts") - 1) / 10).cast("bigint").alias("boot_id"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 300").alias("t_us"),
        F.expr("(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 300) / 1000000.0D").alias("t_s"),
        "event_type", "value", "props",
    )


def co_readings(spark: SparkSession, d: str) -> DataFrame:
    ppm = F.when(F.col("event_type") != "error", F.col("value"))
    return ev(spark, d).select("event_id", "device_id", "boot_id", "t_s", ppm.alias("ppm"))


def fixes(spark: SparkSession, d: str) -> DataFrame:
    """GNSS fixes that wander around the device's home row of the map grid."""
    e = ev(spark, d)
    lat = F.expr("375000000 + (device_id * 5000) div 3 + event_id * 7919 % 20001 - 10000")
    lon = F.expr("1270000000 + event_id * 104729 % 600001 - 200000")
    return e.select(
        "event_id", "device_id", "boot_id", "t_us", "t_s", "event_type",
        F.expr("(device_id div 3) div 500").alias("map_id"),
        lat.alias("lat_e7"), lon.alias("lon_e7"),
        (lat / F.lit(1e7)).alias("lat"), (lon / F.lit(1e7)).alias("lon"),
        F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 40).cast("double")).alias("acc_m"),
        (F.col("event_id") % 21).alias("satellites"),
        (F.col("event_type") != "error").alias("fix"), "value",
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Walk graph nodes: a grid 40 wide, 500 rows a map."""
    k = F.col("p_partkey")
    lon = (1270000000 + k % 40 * 5000) / F.lit(1e7)
    lat = (375000000 + F.expr("p_partkey div 40") * 5000) / F.lit(1e7)
    return read(spark, d, "part").select(
        F.expr("p_partkey div 20000").alias("map_id"), k.alias("node_id"), k.alias("node_ord"),
        lon.alias("lon"), lat.alias("lat"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Directed multigraph: right and down neighbours, gaps, one-way edges and longer parallels.

    No vertical edge crosses row 24 to 25, so each map has two large parts without a path.
    """
    n = nodes(spark, d)
    u = n.select("map_id", F.col("node_id").alias("a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"))
    v = n.select("map_id", F.col("node_id").alias("b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"))
    steps = u.withColumn("dir", F.explode(F.array(F.lit(0), F.lit(1))))
    steps = steps.withColumn("b", F.when(F.col("dir") == 0, F.col("a") + 1).otherwise(F.col("a") + 40))
    keep = F.when(F.col("dir") == 0, (F.col("a") % 40 < 39) & (F.col("a") % 11 != 0)).otherwise(
        F.expr("(a div 40) % 500 <> 24")
    )
    pairs = steps.filter(keep).join(v.hint("merge"), ["map_id", "b"])
    variants = F.array(
        F.struct(F.lit(0).alias("rev"), F.lit(0).alias("key")), F.struct(F.lit(1).alias("rev"), F.lit(0).alias("key")),
        F.struct(F.lit(0).alias("rev"), F.lit(1).alias("key")),
    )
    var = pairs.select("*", F.explode(variants).alias("w")).select("*", "w.rev", "w.key")
    var = var.filter(
        ((F.col("rev") == 0) | (F.col("a") % 13 != 0)) & ((F.col("key") == 0) | (F.col("a") % 5 == 0))
    )
    length = haversine_m(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    bend = F.format_string(
        "LINESTRING (%.7f %.7f, %.7f %.7f, %.7f %.7f)", "lon_a", "lat_a",
        (F.col("lon_a") + F.col("lon_b")) / 2 + 0.0001, (F.col("lat_a") + F.col("lat_b")) / 2 + 0.0001, "lon_b", "lat_b",
    )
    return var.select(
        "map_id", (F.col("a") * 8 + F.col("dir") * 4 + F.col("rev") * 2 + F.col("key")).alias("edge_ord"),
        F.when(F.col("rev") == 0, F.col("a")).otherwise(F.col("b")).alias("u"),
        F.when(F.col("rev") == 0, F.col("b")).otherwise(F.col("a")).alias("v"),
        F.col("key").cast("bigint").alias("key"),
        (length * (1 + 0.25 * F.col("key"))).alias("length_m"),
        F.when(F.col("key") == 1, bend).alias("geometry"),
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Route requests: every customer walks from its home node to one at most four rows away."""
    start = F.expr("c_custkey * 4 div 3")
    x = F.greatest(F.lit(0), F.least(F.lit(39), start % 40 + F.col("c_custkey") * 31 % 9 - 4))
    y = F.greatest(F.lit(0), F.expr("(c_custkey * 4 div 3) div 40") + F.col("c_custkey") * 17 % 9 - 4)
    return read(spark, d, "customer").select(
        F.col("c_custkey").alias("req_id"), start.alias("start"), (y * 40 + x).alias("goal"),
        F.expr("(c_custkey * 4 div 3) div 20000").alias("map_id"),
    )


def pois(spark: SparkSession, d: str) -> DataFrame:
    """Points of interest: suppliers spread over the map rows."""
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(
        F.expr("(s_suppkey div 2) div 500").alias("map_id"),
        F.element_at(F.array(F.lit("water"), F.lit("shelter"), F.lit("exit")), F.col("s_nationkey") % 3 + 1).alias("kind"),
        k.alias("poi_id"), k.alias("poi_ord"),
        ((1270000000 + k * 104729 % 200001) / F.lit(1e7)).alias("lon"),
        ((375000000 + k * 2500 + k * 7919 % 5001) / F.lit(1e7)).alias("lat"),
    )


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = 6371009.0) -> str:
    return (
        f"(2*{radius}*asin(least(1.0, sqrt(pow(sin(radians(({lat2})-({lat1}))/2),2)"
        f"+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians(({lon2})-({lon1}))/2),2)))))"
    )


_CTES: dict[str, tuple[list[str], str]] = {
    "ev": ([], """SELECT event_id, user_id AS device_id, CAST((day(ts)-1)//10 AS BIGINT) AS boot_id,
        (epoch_us(ts)-1704067200000000)//300 AS t_us,
        CAST((epoch_us(ts)-1704067200000000)//300 AS DOUBLE)/1000000.0::DOUBLE AS t_s, event_type, value, props FROM events"""),
    "co": (["ev"], """SELECT event_id, device_id, boot_id, t_s,
        CASE WHEN event_type<>'error' THEN value END AS ppm FROM ev"""),
    "fixes": (["ev"], """SELECT *, CAST(lat_e7 AS DOUBLE)/1e7 AS lat, CAST(lon_e7 AS DOUBLE)/1e7 AS lon FROM (
        SELECT event_id, device_id, boot_id, t_s, event_type, (device_id//3)//500 AS map_id,
        375000000+(device_id*5000)//3+event_id*7919%20001-10000 AS lat_e7,
        1270000000+event_id*104729%600001-200000 AS lon_e7,
        CASE WHEN event_id%7<>0 THEN CAST(event_id%40 AS DOUBLE) END AS acc_m,
        event_id%21 AS satellites, event_type<>'error' AS fix FROM ev)"""),
    "nodes": ([], """SELECT p_partkey//20000 AS map_id, p_partkey AS node_id, p_partkey AS node_ord,
        CAST(1270000000+p_partkey%40*5000 AS DOUBLE)/1e7 AS lon, CAST(375000000+(p_partkey//40)*5000 AS DOUBLE)/1e7 AS lat FROM part"""),
    "edges": (["nodes"], f"""SELECT map_id, a*8+dir*4+rev*2+key AS edge_ord,
        CASE WHEN rev=0 THEN a ELSE b END AS u, CASE WHEN rev=0 THEN b ELSE a END AS v, CAST(key AS BIGINT) AS key,
        len*(1+0.25::DOUBLE*key) AS length_m,
        CASE WHEN key=1 THEN printf('LINESTRING (%.7f %.7f, %.7f %.7f, %.7f %.7f)', lon_a, lat_a,
          (lon_a+lon_b)/2+0.0001::DOUBLE, (lat_a+lat_b)/2+0.0001::DOUBLE, lon_b, lat_b) END AS geometry
        FROM (SELECT m.map_id, m.node_id AS a, n.node_id AS b, s.dir, m.lon AS lon_a, m.lat AS lat_a, n.lon AS lon_b, n.lat AS lat_b,
          {haversine_sql('m.lon','m.lat','n.lon','n.lat')} AS len
          FROM nodes m CROSS JOIN (VALUES (0,1),(1,40)) s(dir,step) JOIN nodes n ON n.map_id=m.map_id AND n.node_id=m.node_id+s.step
          WHERE CASE WHEN s.dir=0 THEN m.node_id%40<39 AND m.node_id%11<>0 ELSE (m.node_id//40)%500<>24 END)
        CROSS JOIN (VALUES (0,0),(1,0),(0,1)) w(rev,key) WHERE (rev=0 OR a%13<>0) AND (key=0 OR a%5=0)"""),
    "requests": ([], """SELECT c_custkey AS req_id, c_custkey*4//3 AS start,
        greatest(0,(c_custkey*4//3)//40+c_custkey*17%9-4)*40+greatest(0,least(39,(c_custkey*4//3)%40+c_custkey*31%9-4)) AS goal,
        (c_custkey*4//3)//20000 AS map_id FROM customer"""),
    "pois": ([], """SELECT (s_suppkey//2)//500 AS map_id, (['water','shelter','exit'])[s_nationkey%3+1] AS kind,
        s_suppkey AS poi_id, s_suppkey AS poi_ord, CAST(1270000000+s_suppkey*104729%200001 AS DOUBLE)/1e7 AS lon,
        CAST(375000000+s_suppkey*2500+s_suppkey*7919%5001 AS DOUBLE)/1e7 AS lat FROM supplier"""),
}


def define(name: str, needs: list[str], sql: str) -> None:
    _CTES[name] = (needs, sql)


def sql_of(name: str) -> str:
    return _CTES[name][1]


def ctes(*names: str) -> str:
    """``WITH`` clause holding the named tables and whatever they build on, open for more."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for need in _CTES[name][0]:
            add(need)
        done.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in done)
