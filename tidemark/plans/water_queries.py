"""Queries of contacts against water in map tiles, which lie where the tables' contacts are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import water
from tidemark.plans.registry import det, query, r

#: Each zoom with the share of tiles that are missing: one of so many.
GONE = {11: 4, 10: 7, 8: 1000}


def bounds(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """West, east, south and north of a tile in degrees."""
    n = F.pow(F.lit(2.0), z)
    lat = lambda row: F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * row / n))))
    return x / n * 360 - 180, (x + 1) / n * 360 - 180, lat(y + 1), lat(y)


def degrees_of(spark, sf_dir) -> DataFrame:
    return det(spark, sf_dir).select("mmsi", "frame_idx", (F.col("x") / 4000 - 121.95).alias("lon"), (F.col("y") / 4000 + 36.75).alias("lat"))


def water_tiles(spark, sf_dir) -> DataFrame:
    """The tiles around every report, water but for an island in the middle of some of them."""
    at = lambda z: F.struct(F.lit(z).alias("z"), *[c.alias(n) for n, c in zip("xy", geo.tile(F.col("lat"), F.col("lon"), z))])
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    t = degrees_of(spark, sf_dir).select(F.explode(F.array(*map(at, water.ZOOMS))).alias("t")).select("t.*").distinct()
    t = t.withColumn("a", F.explode(around)).select("z", (F.col("x") + F.col("a.i")).alias("x"), (F.col("y") + F.col("a.j")).alias("y")).distinct()
    west, east, south, north = bounds(F.col("z"), F.col("x"), F.col("y"))
    t = t.withColumns({"w": west, "e": east, "s": south, "n": north})
    box = lambda a: F.array(*[F.array(F.col("w") + (F.col("e") - F.col("w")) * i, F.col("s") + (F.col("n") - F.col("s")) * j) for i, j in ((a, a), (1 - a, a), (1 - a, 1 - a), (a, 1 - a))])
    missing = F.coalesce(*[F.when(F.col("z") == z, (F.col("x") * 31 + F.col("y") * 17) % k == 0) for z, k in GONE.items()])
    island = (F.col("x") * 7 + F.col("y") * 13) % 3 == 0
    parts = F.when(~missing, F.array(F.when(island, F.array(box(0.0), box(0.4))).otherwise(F.array(box(0.0)))))
    return t.select("z", "x", "y", parts.alias("parts"))


STEPS = """{DET}, p AS (SELECT mmsi, frame_idx, x / 4000 - 121.95 AS lon, y / 4000 + 36.75 AS lat FROM det), s AS (SELECT mmsi, frame_idx, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY mmsi ORDER BY frame_idx)),
g AS (SELECT * FROM s WHERE x2 IS NOT NULL), z(place, z, k) AS (VALUES (0, 11, 4), (1, 10, 7), (2, 8, 1000)),
c AS (SELECT g.*, z.*, floor((x1 + 180) / 360 * 2 ** z)::BIGINT AS ax, floor((x2 + 180) / 360 * 2 ** z)::BIGINT AS bx, floor((1 - asinh(tan(radians(y1))) / pi()) / 2 * 2 ** z)::BIGINT AS ay, floor((1 - asinh(tan(radians(y2))) / pi()) / 2 * 2 ** z)::BIGINT AS b2 FROM g, z),
t AS (SELECT *, unnest(generate_series(least(ax, bx), greatest(ax, bx))) AS tx FROM c), u AS (SELECT *, unnest(generate_series(least(ay, b2), greatest(ay, b2))) AS ty FROM t),
near AS (SELECT DISTINCT z.z, floor((lon + 180) / 360 * 2 ** z)::BIGINT + i AS tx, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 2 ** z)::BIGINT + j AS ty FROM p, z, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
l AS (SELECT mmsi, frame_idx, place, u.z, bool_and(near.z IS NOT NULL AND (u.tx * 31 + u.ty * 17) % k <> 0) AS whole FROM u LEFT JOIN near ON near.z = u.z AND near.tx = u.tx AND near.ty = u.ty GROUP BY ALL),
b AS (SELECT mmsi, frame_idx, min(place) AS place FROM l WHERE whole GROUP BY ALL),
h AS (SELECT u.*, (tx + 0.4) / 2 ** z * 360 - 180 AS hw, (tx + 0.6) / 2 ** z * 360 - 180 AS he, degrees(atan(sinh(pi() * (1 - 2 * (ty + 1) / 2 ** z)))) AS s0, degrees(atan(sinh(pi() * (1 - 2 * ty / 2 ** z)))) AS n0 FROM u JOIN b USING (mmsi, frame_idx, place) WHERE (tx * 7 + ty * 13) % 3 = 0),
i AS (SELECT *, s0 + (n0 - s0) * 0.4 AS hs, s0 + (n0 - s0) * 0.6 AS hn FROM h),
m AS (SELECT mmsi, frame_idx, greatest(0, CASE WHEN x2 <> x1 THEN least((hw - x1) / (x2 - x1), (he - x1) / (x2 - x1)) WHEN x1 > hw AND x1 < he THEN 0 ELSE 2 END, CASE WHEN y2 <> y1 THEN least((hs - y1) / (y2 - y1), (hn - y1) / (y2 - y1)) WHEN y1 > hs AND y1 < hn THEN 0 ELSE 2 END) AS t0,
  least(1, CASE WHEN x2 <> x1 THEN greatest((hw - x1) / (x2 - x1), (he - x1) / (x2 - x1)) ELSE 1 END, CASE WHEN y2 <> y1 THEN greatest((hs - y1) / (y2 - y1), (hn - y1) / (y2 - y1)) ELSE 1 END) AS t1 FROM i)"""


@query(STEPS + """, land AS (SELECT DISTINCT mmsi, frame_idx FROM m WHERE t1 - t0 > 1e-9)
SELECT g.mmsi, g.frame_idx, z.z::INT AS z, CASE WHEN b.place IS NOT NULL THEN land.mmsi IS NULL END AS covered FROM g LEFT JOIN b USING (mmsi, frame_idx) LEFT JOIN z ON z.place = b.place LEFT JOIN land ON land.mmsi = g.mmsi AND land.frame_idx = g.frame_idx""")
def water_coverage(spark, sf_dir):
    """Whether water covers all of each contact's way from one report to the next."""
    w = W.partitionBy("mmsi").orderBy("frame_idx")
    d = degrees_of(spark, sf_dir).withColumns({"x2": F.lead("lon").over(w), "y2": F.lead("lat").over(w)}).where("x2 IS NOT NULL")
    s = d.select(F.struct("mmsi", "frame_idx").alias("segment_id"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), "x2", "y2")
    return water.covered(s, water_tiles(spark, sf_dir)).select("segment_id.mmsi", "segment_id.frame_idx", "z", "covered")


@query()
def hulls_on_water(spark, sf_dir):
    """The water in a rhomb around each contact's last place, as wide as its history is long."""
    last = degrees_of(spark, sf_dir).groupBy("mmsi").agg(F.max_by(F.struct("lon", "lat"), "frame_idx").alias("p"), F.max("frame_idx").alias("n"))
    a = 0.02 + F.col("n") % 40 * 0.02
    corner = lambda i, j: F.array(F.col("p.lon") + a * i, F.col("p.lat") + a * j)
    hulls = last.select(F.col("mmsi").alias("hull_id"), F.array(corner(-1, 0), corner(0, -0.7), corner(1, 0), corner(0, 0.7)).alias("hull"))
    c = water.clipped(hulls, water_tiles(spark, sf_dir))
    return c.select(F.col("hull_id").alias("mmsi"), "z", "state", "n_polygons", r("area", 8).alias("area"))
