"""Parsers of feeds: pushed position and static messages, polled locations and metadata. They work on batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of messages that carry names rather than positions.
STATIC = ("ShipStaticData", "StaticDataReport")
REPORT = "struct<Cog:double,Sog:double,TrueHeading:double,NavigationalStatus:int,RateOfTurn:double,Latitude:double,Longitude:double>"
NAMES = "struct<Name:string,ShipName:string,ImoNumber:bigint,IMONumber:bigint,Imo:bigint,CallSign:string,Callsign:string,Type:int,ShipType:int,Destination:string,MaximumStaticDraught:double,Draught:double,UserID:bigint,UserId:bigint>"
PUSHED = (
    "MessageType string, MetaData struct<MMSI:bigint,Mmsi:bigint,ShipName:string,latitude:double,longitude:double>, "
    f"Message struct<PositionReport:{REPORT},StandardClassBPositionReport:{REPORT},ShipStaticData:{NAMES},StaticDataReport:{NAMES}>"
)
LOCATION = (
    "features array<struct<mmsi:bigint,geometry:struct<coordinates:array<double>>,"
    "properties:struct<sog:double,cog:double,navStat:int,rot:double,heading:double,timestampExternal:bigint>>>"
)
VESSEL = "mmsi bigint, name string, imo bigint, callSign string, shipType int, destination string, draught double"


def within(c: Column, lo: float, hi: float) -> Column:
    """The value if it is a number from lo to hi, else null."""
    return F.when(~F.isnan(c) & c.between(lo, hi), c)


def parsed(raw: DataFrame) -> DataFrame:
    """Messages of the column value, JSON text or bytes of it. Field names that differ by case only are kept apart by aliases."""
    spark = raw.sparkSession
    if spark.conf.get("spark.sql.caseSensitive") != "true":
        # Without case sensitivity one spelling of each name reads all spellings.
        schema = PUSHED.replace("MMSI:bigint,Mmsi:bigint", "MMSI:bigint").replace("ImoNumber:bigint,IMONumber:bigint", "ImoNumber:bigint").replace("CallSign:string,Callsign:string", "CallSign:string").replace("UserID:bigint,UserId:bigint", "UserID:bigint")
    else:
        schema = PUSHED
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def first_of(d: DataFrame, base: str, *names: str) -> Column:
    """The first field of a struct that exists and isn't null."""
    fields = set(d.select(f"{base}.*").columns)
    return F.coalesce(*[F.col(f"{base}.{n}") for n in names if n in fields])


def positions(raw: DataFrame) -> DataFrame:
    """mmsi, name, lat, lon, course, speed_kn, heading, navigation_status, rate_of_turn of the messages that carry a position."""
    d = parsed(raw).where(~F.col("MessageType").isin(*STATIC))
    d = d.withColumn("r", F.coalesce("Message.PositionReport", "Message.StandardClassBPositionReport"))
    mmsi = first_of(d, "MetaData", "MMSI", "Mmsi")
    lat, lon = F.coalesce("MetaData.latitude", "r.Latitude"), F.coalesce("MetaData.longitude", "r.Longitude")
    named = F.trim("MetaData.ShipName")
    name = F.coalesce(F.when(named != "", named), F.concat(F.lit("MMSI "), mmsi.cast("string")))
    return d.where(mmsi.isNotNull() & lat.isNotNull() & lon.isNotNull()).select(
        mmsi.alias("mmsi"), name.alias("name"), F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon"), F.col("r.Cog").alias("course"), F.col("r.Sog").alias("speed_kn"),
        F.col("r.TrueHeading").alias("heading"), F.col("r.NavigationalStatus").alias("navigation_status"), F.col("r.RateOfTurn").alias("rate_of_turn"),
    )


def statics(raw: DataFrame) -> DataFrame:
    """mmsi, name, imo, call_sign, ship_type, destination, draught_m of the messages that carry names."""
    d = parsed(raw).where(F.col("MessageType").isin(*STATIC)).withColumn("s", F.coalesce("Message.ShipStaticData", "Message.StaticDataReport"))
    mmsi = F.coalesce(first_of(d, "MetaData", "MMSI", "Mmsi"), first_of(d, "s", "UserID", "UserId"))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return d.where(mmsi.isNotNull()).select(
        mmsi.alias("mmsi"), text(F.coalesce(first_of(d, "s", "Name", "ShipName"), F.col("MetaData.ShipName"))).alias("name"), first_of(d, "s", "ImoNumber", "IMONumber", "Imo").alias("imo"),
        text(first_of(d, "s", "CallSign", "Callsign")).alias("call_sign"), first_of(d, "s", "Type", "ShipType").alias("ship_type"), text(F.col("s.Destination")).alias("destination"),
        F.coalesce(first_of(d, "s", "MaximumStaticDraught", "Draught"), F.lit(0.0)).alias("draught_m"),
    )


def polled_locations(raw: DataFrame, now: Column) -> DataFrame:
    """mmsi, lat, lon, source_time and checked fields of polled snapshots (column value). Times beyond now + 5 s count as now + 5 s; of equal times one row stays."""
    f = raw.select(F.explode(F.from_json("value", LOCATION)["features"]).alias("f"))
    lon, lat, p = F.get("f.geometry.coordinates", F.lit(0)), F.get("f.geometry.coordinates", F.lit(1)), F.col("f.properties")
    d = f.select(
        F.col("f.mmsi").alias("mmsi"), F.round(within(lat, -90, 90), 5).alias("lat"), F.round(within(lon, -180, 180), 5).alias("lon"), F.least(p["timestampExternal"] / 1000.0, now + 5.0).alias("source_time"),
        within(p["cog"], 0, 359.9).alias("course"), within(p["sog"], 0, 80).alias("speed_kn"), within(p["heading"], 0, 359).alias("heading"), p["navStat"].alias("navigation_status"), within(p["rot"], -127, 127).alias("rate_of_turn"),
    )
    return d.where("mmsi BETWEEN 100000000 AND 999999999 AND lat IS NOT NULL AND lon IS NOT NULL").dropDuplicates(["mmsi", "source_time"])


def polled_metadata(raw: DataFrame) -> DataFrame:
    """mmsi, name, imo, call_sign, ship_type, destination, draught_m of polled metadata; draughts come in decimetres."""
    v = raw.select(F.explode(F.from_json("value", f"array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in VESSEL.split(','))}>>")).alias("v")).select("v.*")
    return v.select("mmsi", F.trim(F.coalesce("name", F.lit(""))).alias("name"), "imo", F.trim(F.coalesce("callSign", F.lit(""))).alias("call_sign"), F.col("shipType").alias("ship_type"), F.trim(F.coalesce("destination", F.lit(""))).alias("destination"), F.coalesce(F.col("draught") / 10, F.lit(0.0)).alias("draught_m"))
