"""Paths of contacts: what lies before a fix, unbroken stretches, places along a path, fewer fixes of one.

fixes: a key (the contact), an order (columns that no two fixes of a key share and along which t never falls), t in
seconds, lat and lon in degrees. A key may hold any share of all fixes: windows run within a key's slices of time, of
which only the ends meet by key. Lengths are whole micrometres, so sums don't depend on how rows are dealt. Fixes with a
null key, order, t, lat or lon are no part of any path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators.history import KNOT
from tidemark.operators.staging import staged

#: Fixed value: knots from which a way between two fixes isn't believed.
MOST_KN = 50.0
#: Seconds of a slice.
SLICE = 86_400.0
MICRO = 1e6

Distance = Callable[[Column, Column, Column, Column], Column]


def zero() -> Column:
    return F.lit(0).cast("long")


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return geo.haversine_km(lat1, lon1, lat2, lon2) * 1000


def flat_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres of a short way by minutes of latitude, which are nautical miles."""
    return F.hypot((lat2 - lat1) * 60, (lon2 - lon1) * 60 * F.cos(F.radians(lat1))) * 1852


def whole(fixes: DataFrame, key: str, order: list[str], seconds: float) -> DataFrame:
    d = fixes.na.drop(subset=[key, *order, "t", "lat", "lon"])
    return d.withColumn("_slice", F.floor(F.col("t") / seconds).cast("long"))


def inner(key: str, order: list[str]):
    return W.partitionBy(key, "_slice").orderBy(*order)


def preceded(d: DataFrame, key: str, order: list[str], carried: dict[str, Column]) -> DataFrame:
    """d with _before: the struct of carried of the fix before, null for a key's first. Slices must follow the order."""
    here = F.struct(*[c.alias(n) for n, c in carried.items()])
    ends = d.groupBy(key, "_slice").agg(F.max_by(here, F.struct(*order)).alias("_last"))
    ends = ends.select(key, "_slice", F.lag("_last").over(W.partitionBy(key).orderBy("_slice")).alias("_carry"))
    return d.join(ends, [key, "_slice"]).withColumn("_before", F.coalesce(F.lag(here).over(inner(key, order)), "_carry")).drop("_carry")


def summed(d: DataFrame, key: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """d with each name of values: the sum of whole numbers from the key's first fix to this one, and {name}_total over all of them."""
    some = d.withColumns({f"_v_{n}": c for n, c in values.items()})
    parts = some.groupBy(key, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in values])
    earlier, every = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(key)
    parts = parts.select(key, "_slice", *[F.coalesce(F.sum(f"_p_{n}").over(earlier), zero()).alias(f"_c_{n}") for n in values], *[F.sum(f"_p_{n}").over(every).alias(f"{n}_total") for n in values])
    so_far = inner(key, order).rowsBetween(W.unboundedPreceding, 0)
    out = some.join(parts, [key, "_slice"]).withColumns({n: F.col(f"_c_{n}") + F.sum(f"_v_{n}").over(so_far) for n in values})
    return out.drop(*[f"{p}{n}" for n in values for p in ("_v_", "_c_")])


def connectors(fixes: DataFrame, key: str, order: list[str], seconds: float = SLICE) -> DataFrame:
    """The way to each fix of a key but its first: key, the order's columns, and lat1, lon1, t1, lat2, lon2, t2 of both ends."""
    d = preceded(whole(fixes, key, order, seconds), key, order, {n: F.col(n) for n in ("lat", "lon", "t")}).where("_before IS NOT NULL")
    ends = [F.col(f"_before.{n}").alias(f"{n}1") for n in ("lat", "lon", "t")] + [F.col(n).alias(f"{n}2") for n in ("lat", "lon", "t")]
    return d.select(key, *order, *ends)


def stretched(fixes: DataFrame, key: str, order: list[str], over_land: DataFrame | None = None, most_kn: float = MOST_KN, distance: Distance = great_circle_m, seconds: float = SLICE) -> DataFrame:
    """fixes with part (from 0), broken and leg_um: broken if the way to it isn't believed, so that a new part begins.

    A way isn't believed if it takes most_kn or more or is among over_land (key and order of the fix that it leads to). Ways
    that take no time have no speed. leg_um is the way from the fix before, 0 where it is broken or there is none.
    """
    d = preceded(whole(fixes, key, order, seconds), key, order, {n: F.col(n) for n in ("lat", "lon", "t")})
    if over_land is None:
        d = d.withColumn("_land", F.lit(False))
    else:
        d = d.join(over_land.select(key, *order, F.lit(True).alias("_land")).distinct(), [key, *order], "left")
    leg, took = distance(F.col("_before.lat"), F.col("_before.lon"), F.col("lat"), F.col("lon")), F.col("t") - F.col("_before.t")
    d = d.withColumn("_leg", leg).withColumn("broken", F.col("_before").isNotNull() & (F.coalesce("_land", F.lit(False)) | F.coalesce((took > 0) & (F.try_divide(F.col("_leg"), took) / KNOT >= most_kn), F.lit(False))))
    d = d.withColumn("leg_um", F.when(F.col("broken"), 0).otherwise(F.coalesce(F.round(F.col("_leg") * MICRO).cast("long"), zero())))
    out = summed(d, key, order, {"part": F.col("broken").cast("long")})
    return out.drop("_slice", "_before", "_land", "_leg", "part_total")


def stretches(rows: DataFrame, key: str) -> DataFrame:
    """(key, part, n, duration_min, length_m) of each part of stretched rows with two fixes or more."""
    d = rows.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"), ((F.max("t") - F.min("t")) / 60).alias("duration_min"), (F.sum("leg_um") / MICRO).alias("length_m"))
    return d.where("n > 1")


def told(rows: DataFrame, key: str) -> DataFrame:
    """(key, n_fixes, n_shown, n_stretches, omitted) of each key of stretched rows: fixes, those in stretches, stretches, and ways that were left out."""
    parts = rows.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"), F.count_if("broken").alias("broken"))
    long = F.col("n") > 1
    return parts.groupBy(key).agg(F.sum("n").alias("n_fixes"), F.coalesce(F.sum(F.when(long, F.col("n"))), zero()).alias("n_shown"), F.count_if(long).alias("n_stretches"), F.sum("broken").alias("omitted"))


def measured(fixes: DataFrame, key: str, order: list[str], distance: Distance = flat_m, seconds: float = SLICE) -> DataFrame:
    """fixes with at (from 0), n, leg_um, way_um, total_um and before: a fix's place among its key's, their number, the way from the one before, how far along the path it is, how long that is, and lat and lon of the one before."""
    d = preceded(whole(fixes, key, order, seconds), key, order, {"lat": F.col("lat"), "lon": F.col("lon")})
    leg = F.round(distance(F.col("_before.lat"), F.col("_before.lon"), F.col("lat"), F.col("lon")) * MICRO).cast("long")
    d = d.withColumn("leg_um", F.coalesce(leg, zero()))
    d = summed(d, key, order, {"way_um": F.col("leg_um"), "at": F.lit(1).cast("long")})
    return d.withColumn("at", F.col("at") - 1).withColumnsRenamed({"way_um_total": "total_um", "at_total": "n", "_before": "before"}).drop("_slice")


def places(fixes: DataFrame, asked: DataFrame, key: str, order: list[str], distance: Distance = flat_m, seconds: float = SLICE) -> DataFrame:
    """asked (key, ask, which is the key's own, share) with segment, lat, lon and bearing: the place at a share of the path's length, shares outside 0 to 1 held at its ends.

    segment is the number of the fix that the way there begins at. Where several fixes are equally far along, the first way
    that reaches the place counts. A path of one fix is that fix, without a bearing, as is a way of no length. Null shares
    and keys without fixes have no place. Ways are dealt to bins of their path's mean length, so each meets the shares near
    it only, and there are at most twice as many as fixes. The measured path is written once, as all that follows reads it.
    """
    m = staged(measured(fixes, key, order, distance, seconds).select(key, "at", "n", "lat", "lon", "before", "leg_um", "way_um", "total_um"))
    bin_of = lambda um: F.least(F.col("n") - 1, F.floor(um * F.col("n") / F.greatest(F.col("total_um"), F.lit(1)))).cast("long")
    begin = F.col("way_um") - F.col("leg_um")
    ways = m.where("at > 0 AND (at = 1 OR leg_um > 0)").withColumn("_bin", F.explode(F.sequence(bin_of(begin.cast("double")), bin_of(F.col("way_um").cast("double")))))
    ways = ways.select(key, "_bin", F.struct("at", "before", "lat", "lon", begin.alias("begin"), F.col("way_um").alias("end")).alias("_w"))
    alone = F.when(F.col("n") == 1, F.struct(zero().alias("segment"), "lat", "lon", F.lit(None).cast("double").alias("bearing")))
    a = asked.select(key, "ask", "share").join(m.where("at = 0").select(key, "n", "total_um", alone.alias("_alone")), key, "left")
    a = a.withColumn("_goal", F.when(F.col("share").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "share")) * F.col("total_um"))).withColumn("_bin", bin_of(F.col("_goal")))
    goal, w = F.col("_goal"), F.col("_w")
    hit = (goal <= w["end"]) & ((goal > w["begin"]) | (w["at"] == 1))
    part = (goal - w["begin"]) / F.greatest(w["end"] - w["begin"], F.lit(1))
    along = lambda n: w["before"][n] + (w[n] - w["before"][n]) * part
    north, east = w["lat"] - w["before"]["lat"], (w["lon"] - w["before"]["lon"]) * F.cos(F.radians(w["before"]["lat"]))
    bearing = F.when(F.hypot(north, east) >= 1e-9, F.degrees(F.atan2(east, north)))
    there = F.struct((w["at"] - 1).alias("segment"), along("lat").alias("lat"), along("lon").alias("lon"), bearing.alias("bearing"))
    found = a.where("n > 1").join(ways, [key, "_bin"]).where(hit).select(key, "ask", there.alias("_found"))
    got = F.coalesce("_found", F.when(F.col("share").isNotNull(), F.col("_alone")))
    return a.join(found, [key, "ask"], "left").withColumn("_p", got).select(key, "ask", "share", "_p.*")


def thinned(fixes: DataFrame, key: str, order: list[str], most: int, keep: Column | None = None, seconds: float = SLICE) -> DataFrame:
    """At most ``most`` fixes (two or more) of each key, spread evenly over its path with both ends, and those to keep besides.

    The k-th of them is fix k * (n - 1) / (most - 1), rounded half to even. A fix is looked up among the three k that can round to it.
    """
    d = whole(fixes, key, order, seconds)
    d = summed(d, key, order, {"_at": F.lit(1).cast("long")}).withColumn("_at", F.col("_at") - 1)
    step = (F.col("_at_total") - 1) / F.lit(float(most - 1))
    near = F.round(F.try_divide(F.col("_at"), step)).cast("long")
    taken = F.lit(False)
    for k in (near - 1, near, near + 1):
        taken = taken | (F.bround(k * (F.col("_at_total") - 1) / F.lit(float(most - 1))).cast("long") == F.col("_at"))
    wanted = (F.col("_at_total") <= most) | taken
    if keep is not None:
        wanted = wanted | F.coalesce(keep, F.lit(False))
    return d.where(wanted).drop("_slice", "_at", "_at_total")
