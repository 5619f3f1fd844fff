"""Readers and writers of files beside reports: zones, sanctions, areas, forecasts, places, scenario packs and saved state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHAPES = "type string, id string, properties map<string,string>, geometry struct<type:string,coordinates:string>, features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>, coordinates string"
SANCTIONS = "ent_num string, SDN_Name string, SDN_Type string, Program string, Title string, Call_Sign string, Vess_type string, Tonnage string, GRT string, Vess_flag string, Vess_owner string, Remarks string"
PACK = (
    "id string, name string, seed bigint, origin struct<lat:double,lon:double>, bbox struct<lon_min:double,lat_min:double,lon_max:double,lat_max:double>, time_window struct<start:string,end:string>, "
    "frame_interval_s double, ais_csv string, ais_required boolean, geofence_layers array<struct<file:string,kind:string>>, synthetic_actors array<struct<actor_id:string,track:string,params:map<string,string>>>, "
    "events array<struct<t:double,kind:string,actor:string,params:map<string,string>>>, expected map<string,string>"
)
RING = "array<array<double>>"


def named(properties: str, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(properties, F.lit(n)), F.lit("")) for n in names])


def shapes(spark: SparkSession, path: str, kind: str, layer: str | None = None) -> DataFrame:
    """zone_id, kind, label, buffer_m and parts (array of arrays of rings, or of one line) of a GeoJSON file.

    Collections, single features and bare geometries are read; polygons keep their holes, and a shape of several parts
    is one zone. Lines need a buffer above 0: without one the read fails. Ids that repeat get #1, #2 and so on.
    """
    raw = spark.read.schema(SHAPES).json(path, multiLine=True)
    single = F.struct("id", "properties", F.when(F.col("type") == "Feature", F.col("geometry")).otherwise(F.struct("type", "coordinates").cast("struct<type:string,coordinates:string>")).alias("geometry"))
    f = raw.select(F.posexplode(F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(F.array(single))).alias("i", "f"))
    p, shape, text = "f.properties", F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = (
        F.when(shape == "Polygon", F.array(F.from_json(text, f"array<{RING}>")))
        .when(shape == "MultiPolygon", F.from_json(text, f"array<array<{RING}>>"))
        .when(shape == "LineString", F.array(F.array(F.from_json(text, RING))))
        .when(shape == "MultiLineString", F.transform(F.from_json(text, f"array<{RING}>"), lambda line: F.array(line)))
    )
    buffer = F.coalesce(named(p, "buffer_m", "bufferMeters", "buffer").try_cast("double"), F.when(F.lit(kind) == "cable", 500.0).otherwise(0.0))
    buffer = F.when(shape.endswith("LineString") & (buffer <= 0), F.raise_error(F.lit("a line needs a buffer above 0")).cast("double")).otherwise(buffer)
    name = F.coalesce(named(p, "id", "fence_id", "fenceId"), F.col("f.id"), F.concat_ws("_", F.lit(kind), F.col("i").cast("string")))
    if layer:
        name = F.concat_ws(":", F.regexp_replace(F.lower(F.lit(layer)), "[^a-z0-9]+", "_"), name)
    d = f.where(parts.isNotNull()).select("i", name.alias("zone_id"), F.coalesce(named(p, "kind"), F.lit(kind)).alias("kind"), named(p, "name", "label").alias("label"), buffer.alias("buffer_m"), parts.alias("parts"))
    n = F.row_number().over(W.partitionBy("zone_id").orderBy("i")) - 1
    return d.withColumn("zone_id", F.when(n == 0, F.col("zone_id")).otherwise(F.concat(F.col("zone_id"), F.lit("#"), n.cast("string")))).drop("i")


def sanctions(spark: SparkSession, *paths: str) -> DataFrame:
    """basis, key, match_id of listed vessels: every MMSI and IMO number in the remarks, call sign and name. Of an entry in several files the first file's stays; of a key the last entry's."""
    parts = [spark.read.schema(SANCTIONS).csv(p, header=True, escape='"').withColumn("file", F.lit(k)) for k, p in enumerate(paths)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = F.row_number().over(W.partitionBy("ent_num").orderBy("file"))
    rows = rows.withColumn("rn", first).where("rn = 1").withColumn("match_id", F.col("ent_num").try_cast("bigint"))
    known = lambda c: F.when(~F.trim(c).isin("-0-", ""), F.nullif(F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", ""), F.lit("")))
    of = lambda basis, keys: F.transform(keys, lambda k: F.struct(F.lit(basis).alias("basis"), k.alias("key")))
    every = F.concat(
        of("mmsi", F.regexp_extract_all("Remarks", F.lit(r"MMSI\D{0,3}(\d{9})"), F.lit(1))), of("imo", F.regexp_extract_all("Remarks", F.lit(r"IMO\D{0,3}(\d{7})"), F.lit(1))),
        of("call_sign", F.array_compact(F.array(known(F.col("Call_Sign"))))), of("name", F.array_compact(F.array(known(F.col("SDN_Name"))))),
    )
    long = rows.withColumn("Remarks", F.coalesce("Remarks", F.lit(""))).select("match_id", F.explode(every).alias("k")).select("k.basis", "k.key", "match_id")
    return long.groupBy("basis", "key").agg(F.max("match_id").alias("match_id"))


def protected_areas(spark: SparkSession, path: str) -> DataFrame:
    """site_id, name and designation of a register of areas; the English columns win, else the native ones."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in raw.columns], F.lit(None).cast("string"))
    return raw.select(pick("SITE_ID").alias("site_id"), pick("NAME_ENG", "NAME").alias("name"), pick("DESIG_ENG", "DESIG").alias("designation")).where("site_id IS NOT NULL")


def wind(spark: SparkSession, path: str) -> DataFrame:
    """time, lat, lon, east_mps, north_mps of a forecast's CSV, without its row of units."""
    raw = spark.read.csv(path, header=True).where("time <> 'UTC'")
    return raw.select(F.to_timestamp("time").alias("time"), *[F.col(a).try_cast("double").alias(b) for a, b in (("latitude", "lat"), ("longitude", "lon"), ("ugrd10m", "east_mps"), ("vgrd10m", "north_mps"))])


def places(spark: SparkSession, path: str) -> DataFrame:
    """name, lat, lon, kind and bounds (west, south, east, north) of a geocoder's answers; malformed ones are left out. The box comes as south, north, west, east."""
    raw = spark.read.schema("display_name string, lat string, lon string, boundingbox array<string>, type string, category string").json(path, multiLine=True)
    number = lambda k: F.get("boundingbox", F.lit(k)).try_cast("double")
    d = raw.select(F.col("display_name").alias("name"), F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), F.coalesce("type", "category").alias("kind"), F.array(number(2), number(0), number(3), number(1)).alias("bounds"))
    return d.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.exists("bounds", lambda b: b.isNull()))


def packs(spark: SparkSession, path: str) -> DataFrame:
    """Scenario packs, one row a file, with the file's path."""
    return spark.read.schema(PACK).json(path, multiLine=True).withColumn("file", F.input_file_name())


def save_state(contacts: DataFrame, path: str, now: float, keep_s: float = 86_400.0, most: int = 100_000) -> None:
    """Writes the contacts (last_seen, ...) seen within keep_s, the newest ``most`` of them, without private columns."""
    public = contacts.select(*[c for c in contacts.columns if not c.startswith("_")])
    public.where(F.col("last_seen") >= now - keep_s).orderBy(F.desc("last_seen"), "mmsi").limit(most).write.mode("overwrite").option("compression", "gzip").json(path)


def restore_state(spark: SparkSession, path: str, schema: str, now: float, silent_s: float = 45.0, keep_s: float = 86_400.0) -> DataFrame:
    """The saved contacts that are young enough, with age_s and dark as of now."""
    d = spark.read.schema(schema).json(path, mode="DROPMALFORMED").withColumn("age_s", now - F.col("last_seen"))
    return d.where(F.col("age_s") <= keep_s).withColumn("dark", F.col("age_s") >= silent_s)


def rates(spark: SparkSession, path: str) -> DataFrame:
    """unit, resource, usd, schedule and effective of rate files: JSON objects whose members named ..._hourly_usd map resources to dollars an hour. Rates that are no numbers are null."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    d = raw.select(F.explode("m").alias("group", "members"), F.from_json(F.try_element_at("m", F.lit("source")), "map<string,string>").alias("s")).where(F.col("group").endswith("_hourly_usd"))
    d = d.select("s", F.regexp_extract("group", "^(.*)_hourly_usd$", 1).alias("unit"), F.explode(F.from_json("members", "map<string,string>")).alias("resource", "usd"))
    said = lambda name: F.try_element_at("s", F.lit(name))
    return d.select("unit", "resource", F.col("usd").try_cast("double").alias("usd"), said("rate_schedule").alias("schedule"), said("effective_date").alias("effective"))
