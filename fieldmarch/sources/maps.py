"""Walk maps: GraphML and OSM XML in, node and edge tables in and out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.geo import EARTH_R_VOICE_M, haversine_m
from ..session import shared_dir

# Ways one can walk, and access tags that forbid or allow it.
WALKABLE = [
    "bridleway", "corridor", "footway", "living_street", "path", "pedestrian", "residential", "service", "steps", "track", "unclassified",
]
FORBIDDEN, PERMITTED = ["no", "private"], ["designated", "permissive", "yes"]

_DATA = "array<struct<_VALUE:string,_key:string>>"


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").schema(schema).option("rowTag", tag).load(path)


def _has_key(key: str):
    return lambda x: x["_key"] == key


def read_graphml(spark: SparkSession, path: str, map_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` of a GraphML file; an undirected graph gives every edge both ways.

    Files that declare a document type or entities are refused. Data elements are matched to their
    keys by id; the key table is the file's header and is tiny.
    """
    head = spark.read.text(path)
    if not head.filter(F.upper("value").rlike("<!(DOCTYPE|ENTITY)")).isEmpty():
        raise ValueError("document types and entities are not allowed in maps")
    undirected = not head.filter(F.col("value").rlike(r'<graph[^>]*edgedefault="undirected"')).isEmpty()
    keys = _rows(spark, path, "key", "_id string, _for string, `_attr.name` string, default string").select(
        F.col("_id").alias("id"), F.coalesce("_for", F.lit("all")).alias("target"), F.col("`_attr.name`").alias("name"), "default").collect()

    def value(name: str, target: str) -> Column:
        mine = [k for k in keys if k["name"] == name and k["target"] in (target, "all")]
        found = [F.get(F.filter("data", _has_key(k["id"])), F.lit(0))["_VALUE"] for k in mine]
        return F.coalesce(*found, *[F.lit(k["default"]) for k in mine], F.lit(None).cast("string"))

    nodes = _rows(spark, path, "node", f"_id string, data {_DATA}").select(
        F.lit(map_id).cast("bigint").alias("map_id"), F.col("_id").alias("node_id"),
        value("x", "node").try_cast("double").alias("lon"), value("y", "node").try_cast("double").alias("lat"))
    edges = _rows(spark, path, "edge", f"_source string, _target string, _id string, data {_DATA}").select(
        F.lit(map_id).cast("bigint").alias("map_id"), F.col("_source").alias("u"), F.col("_target").alias("v"), F.coalesce("_id", F.lit("0")).alias("key"),
        value("length", "edge").try_cast("double").alias("length_m"), value("geometry", "edge").alias("geometry"))
    if undirected:
        edges = edges.unionByName(edges.select("map_id", F.col("v").alias("u"), F.col("u").alias("v"), "key", "length_m", "geometry"))
    order = F.monotonically_increasing_id()
    return nodes.withColumn("node_ord", order), edges.withColumn("edge_ord", order)


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``ways`` (way_id, refs, and the tags that matter) and ``places`` (node_id, lon, lat) of an OSM XML file."""
    places = _rows(spark, path, "node", "_id string, _lon double, _lat double").select(
        F.col("_id").alias("node_id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))
    ways = _rows(spark, path, "way", "_id string, nd array<struct<_ref:string>>, tag array<struct<_k:string,_v:string>>")
    tag = lambda k: F.get(F.filter("tag", lambda t: t["_k"] == k), F.lit(0))["_v"]
    return ways.select(
        F.col("_id").alias("way_id"), F.col("nd._ref").alias("refs"), tag("highway").alias("highway"), tag("foot").alias("foot"),
        tag("access").alias("access"), tag("oneway:foot").alias("oneway_foot")), places


def walkable(ways: DataFrame) -> DataFrame:
    foot, access = F.lower(F.coalesce("foot", F.lit(""))), F.lower(F.coalesce("access", F.lit("")))
    blocked = foot.isin(FORBIDDEN) | (access.isin(FORBIDDEN) & ~foot.isin(PERMITTED))
    return ways.filter(F.col("highway").isin(WALKABLE) & ~blocked & (F.size("refs") >= 2))


def osm_to_graph(ways: DataFrame, places: DataFrame) -> DataFrame:
    """Directed edges ``way_id, pos, u, v, length_m`` of walkable ways; pairs with an unknown node drop out."""
    pair = F.arrays_zip(
        F.slice("refs", F.lit(1), F.size("refs") - 1).alias("u"), F.slice("refs", F.lit(2), F.size("refs") - 1).alias("v"))
    legs = walkable(ways).select("way_id", F.lower(F.coalesce("oneway_foot", F.lit(""))).alias("one"), F.posexplode(pair).alias("pos", "p"))
    legs = legs.select("way_id", "one", "pos", "p.u", "p.v")
    a = places.select(F.col("node_id").alias("u"), F.col("lon").alias("lon_u"), F.col("lat").alias("lat_u"))
    b = places.select(F.col("node_id").alias("v"), F.col("lon").alias("lon_v"), F.col("lat").alias("lat_v"))
    known = legs.join(a, "u").join(b, "v")
    known = known.withColumn("length_m", haversine_m(*[F.col(c) for c in ("lon_u", "lat_u", "lon_v", "lat_v")]))
    ahead = F.struct("u", "v")
    back = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    ways_out = F.when(F.col("one") == "-1", F.array(back)).when(F.col("one").isin("1", "true", "yes"), F.array(ahead)).otherwise(F.array(ahead, back))
    return known.select("way_id", "pos", "length_m", F.explode(ways_out).alias("e")).select("way_id", "pos", "e.u", "e.v", "length_m")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str | None = None) -> str:
    """Store a map under a new version folder; lengths keep six decimals. Returns the folder.

    A version is never overwritten, so readers see a whole old map or a whole new one.
    """
    path = f"{path or shared_dir(nodes.sparkSession) + '/maps'}/v-{uuid.uuid4().hex}"
    nodes.write.parquet(f"{path}/nodes")
    edges.withColumn("length_m", F.bround("length_m", 6)).write.parquet(f"{path}/edges")
    return path


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def trail_graph(trails: DataFrame) -> DataFrame:
    """Undirected walk graph of polylines (``points``): vertices are coordinates to seven decimals."""
    pts = trails.filter(F.size("points") > 1)
    pair = F.arrays_zip(
        F.slice("points", F.lit(1), F.size("points") - 1).alias("a"), F.slice("points", F.lit(2), F.size("points") - 1).alias("b"))
    legs = pts.select(F.explode(pair).alias("p"))
    key = lambda p: F.concat_ws(",", F.round(F.col(f"p.{p}.lon") * 1e7).cast("bigint"), F.round(F.col(f"p.{p}.lat") * 1e7).cast("bigint"))
    far = haversine_m(*[F.col(f"p.{c}") for c in ("a.lon", "a.lat", "b.lon", "b.lat")], EARTH_R_VOICE_M)
    legs = legs.select(key("a").alias("a"), key("b").alias("b"), far.alias("length_m"))
    both = legs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"), "length_m"), F.struct(F.col("b").alias("u"), F.col("a").alias("v"), "length_m"))).alias("e"))
    return both.groupBy("e.u", "e.v").agg(F.min("e.length_m").alias("length_m"))
