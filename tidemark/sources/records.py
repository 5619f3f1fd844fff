"""Readers of JSON answers (port indexes, vessel registries, activity feeds) and checks of origins and boxes.

Each takes JSON texts in a column, so the same code reads files, a queue or a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo

PORTS = (
    "features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<INDEX_NO:string,PORT_NAME:string,COUNTRY:string,HARBORSIZE:string,HARBORTYPE:string,"
    "PORTOFENTR:string,PILOT_REQD:string,TUG_ASSIST:string,MAX_VESSEL:string>>>"
)
IDENTITY = "id:string,ssvid:string,shipname:string,imo:string,callsign:string,flag:string,positionsCounter:bigint,transmissionDateFrom:string,transmissionDateTo:string,sourceCode:array<string>"
REGISTRY = (
    f"entries array<struct<dataset:string,selfReportedInfo:array<struct<{IDENTITY}>>,registryInfo:array<struct<{IDENTITY}>>,"
    "combinedSourcesInfo:array<struct<vesselId:string,shiptypes:array<struct<name:string>>,geartypes:array<struct<name:string>>>>>>"
)
#: The names under which an origin may carry its coordinates, the first that is there counts; the corners of a box.
LATITUDE, LONGITUDE = ("lat", "latitude"), ("lon", "longitude", "lng", "long")
CORNERS = ("lon_min", "lat_min", "lon_max", "lat_max")


def ports(raw: DataFrame, centre: tuple[float, float] | None = None) -> DataFrame:
    """One row per port of a port index with two coordinates; with a centre (lat, lon), its distance in km to one decimal."""
    p = raw.select(F.explode(F.from_json("value", PORTS)["features"]).alias("f")).where(F.size("f.geometry.coordinates") >= 2)
    given, yes = F.col("f.properties"), lambda name: F.coalesce(F.col("f.properties")[name] == "Y", F.lit(False))
    lon, lat = F.col("f.geometry.coordinates")[0], F.col("f.geometry.coordinates")[1]
    out = p.select(
        given["INDEX_NO"].alias("port_id"), F.coalesce(F.nullif(given["PORT_NAME"], F.lit("")), F.lit("Unnamed port")).alias("name"), given["COUNTRY"].alias("country"), lat.alias("lat"), lon.alias("lon"),
        given["HARBORSIZE"].alias("harbor_size"), given["HARBORTYPE"].alias("harbor_type"), yes("PORTOFENTR").alias("port_of_entry"), yes("PILOT_REQD").alias("pilot_required"), yes("TUG_ASSIST").alias("tug_assist"), given["MAX_VESSEL"].alias("max_vessel"),
    )
    return out if centre is None else out.withColumn("distance_km", F.round(geo.haversine_km(F.lit(centre[0]), F.lit(centre[1]), F.col("lat"), F.col("lon")), 1))


def newest(records: Column, ssvid: Column) -> Column:
    """The record that was sent last among those of that number, or among all if none has it; of equal dates the first."""
    own = F.filter(records, lambda x: x["ssvid"] == ssvid)
    dated = F.transform(F.when(F.size(own) > 0, own).otherwise(records), lambda x, i: F.struct(F.coalesce(x["transmissionDateTo"], F.lit("")).alias("at"), (-i).alias("i"), x.alias("x")))
    return F.array_max(dated)["x"]


def registry(raw: DataFrame) -> DataFrame:
    """What a registry's answer (value) to a search for mmsi says, from its first entry; matched is false if it has none."""
    d = raw.select("mmsi", F.get(F.from_json("value", REGISTRY)["entries"], F.lit(0)).alias("e"))
    number = F.col("mmsi").cast("string")
    d = d.select("mmsi", "e", newest(F.col("e.selfReportedInfo"), number).alias("own"), newest(F.col("e.registryInfo"), number).alias("reg"))
    either = lambda name: F.coalesce(F.nullif(F.col("own")[name], F.lit("")), F.col("reg")[name])
    kinds = lambda name: F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("e.combinedSourcesInfo", lambda c: F.coalesce(c[name]["name"], F.array().cast("array<string>")))), lambda x: x != "")))
    return d.select(
        "mmsi", F.col("e").isNotNull().alias("matched"), F.col("e.dataset").alias("dataset"), F.coalesce(F.nullif(F.col("own.id"), F.lit("")), F.get("e.combinedSourcesInfo", F.lit(0))["vesselId"]).alias("vessel_id"),
        either("shipname").alias("name"), either("imo").alias("imo"), either("callsign").alias("call_sign"), either("flag").alias("flag"), F.col("own.positionsCounter").alias("positions_count"),
        F.col("own.transmissionDateFrom").alias("transmission_from"), F.col("own.transmissionDateTo").alias("transmission_to"), kinds("shiptypes").alias("ship_types"), kinds("geartypes").alias("gear_types"), F.col("reg.sourceCode").alias("registry_sources"),
    )


def activity(raw: DataFrame) -> DataFrame:
    """One row per event with a position; a duration that isn't given is the time from start to end, null if either can't be read. Fishing is modelled, all else observed."""
    e = raw.select(F.explode(F.from_json("value", "entries array<map<string,string>>")["entries"]).alias("e"))
    field = lambda name: F.try_element_at("e", F.lit(name) if isinstance(name, str) else name)
    number = lambda c, path: F.get_json_object(c, path).try_cast("double")
    kind = F.upper(F.coalesce(field("type"), F.lit("")))
    moment = lambda name: F.unix_micros(F.try_to_timestamp(field(name)))
    hours = F.coalesce(number(field(F.lower(kind)), "$.averageDurationHours"), (moment("end") - moment("start")) / 3.6e9)
    d = e.select(
        field("id").alias("id"), kind.alias("type"), field("start").alias("start"), field("end").alias("end"), number(field("position"), "$.lat").alias("lat"), number(field("position"), "$.lon").alias("lon"),
        F.round(hours, 2).alias("duration_hours"), field("regions").alias("regions"), F.coalesce(field("port"), F.get_json_object(field(F.lower(kind)), "$.port")).alias("port"), F.when(kind == "FISHING", "modelled").otherwise("observed").alias("classification"),
    )
    return d.where("lat IS NOT NULL AND lon IS NOT NULL")


def number(c: Column) -> Column:
    """A finite number or null."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def within(lon: Column, lat: Column) -> Column:
    return (F.abs(lon) <= 180) & (F.abs(lat) <= 90)


def coordinates(d: DataFrame, column: str, names: tuple[tuple[str, ...], ...]) -> DataFrame:
    """d with _in_order (the JSON text isn't an object), _numbers (finite ones, in the order of names) and problem, null if all are there. Each step is a column of its own, so that JSON is read once."""
    d = d.withColumns({"_in_order": ~F.coalesce(F.ltrim(F.col(column)).startswith("{"), F.lit(True)), "_named": F.from_json(column, "map<string,string>"), "_listed": F.from_json(column, "array<string>")})
    raw = [F.when(F.col("_in_order"), F.get("_listed", F.lit(i))).otherwise(F.coalesce(*[F.try_element_at("_named", F.lit(n)) for n in some])) for i, some in enumerate(names)]
    d = d.withColumn("_raw", F.array(*raw)).withColumn("_numbers", F.transform("_raw", number))
    problem = (
        F.when(F.when(F.col("_in_order"), F.col("_listed").isNull()).otherwise(F.col("_named").isNull()), "unreadable")
        .when(F.col("_in_order") & (F.size("_listed") != len(names)), "length")
        .when(F.exists("_raw", lambda x: x.isNull()), "missing")
        .when(F.exists("_numbers", lambda x: x.isNull()), "not a number")
    )
    return d.withColumn("problem", problem).drop("_named", "_listed", "_raw")


def origins(d: DataFrame, column: str) -> DataFrame:
    """d with lon, lat and problem of the origin that column holds as JSON text: an object that names its coordinates, or an array in the order lon, lat.

    problem is null if it can be used; an array that only reads as lat, lon is never turned round: its problem is ``swapped``.
    """
    d = coordinates(d, column, (LONGITUDE, LATITUDE)).withColumns({"lon": F.get("_numbers", F.lit(0)), "lat": F.get("_numbers", F.lit(1))})
    lon, lat = F.col("lon"), F.col("lat")
    outside = F.when(~within(lon, lat), F.when(F.col("_in_order") & within(lat, lon), "swapped").otherwise("out of range"))
    d = d.withColumn("problem", F.coalesce("problem", outside))
    good = F.col("problem").isNull()
    return d.withColumns({"lon": F.when(good, lon), "lat": F.when(good, lat)}).drop("_in_order", "_numbers")


def boxes(d: DataFrame, column: str) -> DataFrame:
    """d with lon_min, lat_min, lon_max, lat_max and problem of the box that column holds as JSON text: an object, or an array in that order. A box without area is ``degenerate``; corners are never put in order."""
    d = coordinates(d, column, tuple((n,) for n in CORNERS)).withColumns({n: F.get("_numbers", F.lit(i)) for i, n in enumerate(CORNERS)})
    west, south, east, north = map(F.col, CORNERS)
    d = d.withColumn("problem", F.coalesce("problem", F.when(~within(west, south) | ~within(east, north), "out of range").when((west >= east) | (south >= north), "degenerate")))
    return d.withColumns({n: F.when(F.col("problem").isNull(), F.col(n)) for n in CORNERS}).drop("_in_order", "_numbers")


def required(checked: DataFrame, what: str) -> DataFrame:
    """The checked origins or boxes; a problem ends the query with what it concerns and which it is. Without this, a bad one is a row with nulls."""
    return checked.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit(what + ": "), F.col("problem")))))


def leaks(rows: DataFrame, actors: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of anonymous measurements that give an identity away: (column, value) equal to an actor_id, or beginning with ``mmsi:``. Other columns than the given ones are an error."""
    if set(rows.columns) != set(columns):
        raise ValueError(f"unexpected columns: {sorted(set(rows.columns) ^ set(columns))}")
    texts = [n for n, t in rows.dtypes if t == "string"]
    values = rows.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("value")) for n in texts])))
    told = values.where(F.col("value").startswith("mmsi:"))
    return told.unionByName(values.where(~F.col("value").startswith("mmsi:")).join(actors.select(F.col("actor_id").alias("value")).distinct(), "value", "left_semi"))


def united(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """The rows of all frames; a key that is there twice ends the query."""
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    twice = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    checked = twice.withColumn("_ok", F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("key is there twice: "), F.concat_ws(",", *[F.col(k).cast("string") for k in key])))))
    return rows.join(checked.where("_ok").drop("_n", "_ok"), key)
