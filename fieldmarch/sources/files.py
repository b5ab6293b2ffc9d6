"""File sources and sinks other than device lines: evaluation cases, measurements, positions, maps, clips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir

# Columns of a measurement row, in file order.
BENCH_SCHEMA = """phase string, label string, dataset string, model string, backend string, clocks string, args string, n bigint,
 gate_pass int, gate_total int, ms_load_med double, ms_encode_med double, ms_total_med double, ms_total_max double, idle_mW double,
 active_mW double, peak_mW double, mWh_per_query double, cpu_temp_c double, power_valid string, note string"""
POSITION_SCHEMA = """version int, boot_id string, monotonic_s double, recorded_at string, lat double, lon double, accuracy_m double,
 satellites int, _corrupt string"""


def bench_rows(spark: SparkSession, path: str) -> DataFrame:
    """Measurement rows; blanks are NULL."""
    return spark.read.csv(path, schema=BENCH_SCHEMA, header=True, nullValue="", enforceSchema=True)


def write_bench(df: DataFrame, path: str | None = None) -> str:
    """Append measurement rows; columns that are not given stay blank. Returns the folder."""
    path = path or f"{shared_dir(df.sparkSession)}/bench-{uuid.uuid4().hex}"
    names = [c.split()[0] for c in BENCH_SCHEMA.replace("\n", " ").split(",")]
    have = set(df.columns)
    rows = df.select(*[F.col(n) if n in have else F.lit(None).cast("string").alias(n) for n in names])
    rows.write.mode("append").csv(path, header=True)
    return path


def position_records(spark: SparkSession, path: str) -> DataFrame:
    """Stored positions, one JSON object a line; lines that are no objects are dropped."""
    raw = spark.read.schema(POSITION_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.filter("_corrupt IS NULL").drop("_corrupt")


def write_positions(df: DataFrame, path: str) -> None:
    """Append positions by day; each task writes a range of devices, and large days are dealt to as many tasks as they need."""
    days = df.withColumn("day", F.to_date("recorded_at"))
    days.repartitionByRange("day", "device_id", "monotonic_s").write.mode("append").partitionBy("day").parquet(path)


def compact_positions(spark: SparkSession, path: str, target: str, since: str, rows_per_file: int = 5_000_000) -> None:
    """Rewrite the days still retained into ``target`` with large files; readers switch to it afterwards."""
    kept = spark.read.parquet(path).filter(F.col("day") >= since)
    kept.repartitionByRange("day", "device_id", "monotonic_s").sortWithinPartitions("day", "device_id", "monotonic_s").write.option(
        "maxRecordsPerFile", rows_per_file).partitionBy("day").parquet(target)


def eval_cases(spark: SparkSession, path: str, schema: str, array: bool = False) -> DataFrame:
    """Evaluation cases from JSON lines or a JSON array; a malformed row is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", array).json(path)


def poi_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Points of interest of a version 1 catalog; anything else gives no rows."""
    schema = """version int, map_sources array<string>, demo boolean,
      pois array<struct<id:string,kind:string,name:string,lat:double,lon:double,potable:boolean,source:string>>"""
    cat = spark.read.schema(schema).option("multiLine", True).json(path).filter("version = 1 AND pois IS NOT NULL")
    return cat.select("map_sources", "demo", F.posexplode("pois").alias("poi_ord", "p")).select("map_sources", "demo", "poi_ord", "p.*")
