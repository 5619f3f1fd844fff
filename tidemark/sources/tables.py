"""Scans: position reports and the tables around them.

Position reports come as CSV of strings (bad coordinates are skipped), zones as GeoJSON, state as
Parquet. ``detections`` makes reports from the ``events`` table by integer arithmetic, which every
engine evaluates alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REPORT = "MMSI string, BaseDateTime string, LAT string, LON string, SOG string, COG string, Heading string"
GEOJSON = "features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """mmsi, t_abs, lat, lon of a CSV of reports; rows without numeric coordinates are left out."""
    raw = spark.read.schema(REPORT).csv(path, header=True)
    at = F.coalesce(F.try_to_timestamp("BaseDateTime"), F.try_to_timestamp("BaseDateTime", F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    rows = raw.select(F.col("MMSI").alias("mmsi"), (F.unix_micros(at) / 1e6).alias("t_abs"), *[F.col(c).try_cast("double").alias(c.lower()) for c in ("LAT", "LON")])
    return rows.where("lat IS NOT NULL AND lon IS NOT NULL")


def polygons(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """zone_id, kind and exterior ring (lon, lat) of each polygon of a GeoJSON file."""
    rows = spark.read.schema(GEOJSON).json(path, multiLine=True).select(F.posexplode("features").alias("i", "f"))
    ring = F.get(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"), F.lit(0))
    name = F.coalesce(F.try_element_at("f.properties", F.lit("id")), F.col("f.id"), F.concat_ws("_", F.lit(kind), F.col("i").cast("string")))
    return rows.where("f.geometry.type = 'Polygon'").select(name.alias("zone_id"), F.lit(kind).alias("kind"), F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))


def detections(events: DataFrame) -> DataFrame:
    """event_id, mmsi, frame_idx, t, t_abs, x, y, source, sigma, speed_kn, event_type, user_id."""
    k = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    u, e, t = F.col("user_id"), F.col("event_id"), F.col("t")
    d = events.withColumn("frame_idx", k.cast("long")).withColumn("t", 30.0 * F.col("frame_idx"))
    return d.select(
        "event_id", (200000000 + u).alias("mmsi"), "frame_idx", "t",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t_abs"),
        (1000 * (u % 12) + (u % 7 - 3) * t + ((e * 7919) % 101 - 50)).alias("x"),
        (800 * (u % 9) + (u % 5 - 2) * t + ((e * 104729) % 101 - 50)).alias("y"),
        F.when(F.col("event_type") == "error", "radar").otherwise("ais").alias("source"),
        F.when(F.col("event_type") == "error", 50.0).otherwise(5.0).alias("sigma"),
        (F.col("value") % 50).alias("speed_kn"), "event_type", "user_id",
    )
