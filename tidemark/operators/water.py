"""Segments and hulls against water polygons in map tiles.

tiles: z, x, y, parts (array of polygons of rings of [lon, lat], the first ring of each its shell); null parts are a tile
that isn't available. What is asked of several zooms is answered by the finest one all of whose tiles are available.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators.zones import edges, enclosed

#: Zooms from fine to coarse, and the most tiles that a hull is clipped to.
ZOOMS = (11, 10, 8)
MOST_TILES = 36
KM_PER_DEGREE = 111.32
#: Stretches of a segment that are shorter, as a share of it, are rounding errors.
TINY = 1e-9
CELLS = "array<struct<x:bigint,y:bigint>>"


def chosen_zoom(asked: DataFrame, tiles: DataFrame, key: str) -> DataFrame:
    """(key, z): the first zoom of each key for which all its cells are available. asked: key, place (0 is the first), z, cells."""
    e = asked.where(F.size("cells") > 0).select(key, "place", "z", F.size("cells").alias("_n"), F.explode("cells").alias("_c")).select(key, "place", "z", "_n", "_c.x", "_c.y")
    there = tiles.where("parts IS NOT NULL").select("z", "x", "y").distinct()
    whole = e.join(there, ["z", "x", "y"]).groupBy(key, "place", "z", "_n").count().where("count = _n")
    return whole.groupBy(key).agg(F.min(F.struct("place", "z")).alias("_p")).select(key, "_p.z")


def segment_cells(zoom: int, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The tiles of the segment's box."""
    (ax, ay), (bx, by) = geo.tile(y1, x1, zoom), geo.tile(y2, x2, zoom)
    last = F.lit(2**zoom - 1).cast("long")
    rows = F.sequence(F.greatest(F.lit(0).cast("long"), F.least(ay, by)), F.least(last, F.greatest(ay, by)))
    cols = F.sequence(F.least(ax, bx), F.greatest(ax, bx))
    return F.flatten(F.transform(rows, lambda y: F.transform(cols, lambda x: F.struct(F.pmod(x, F.lit(2**zoom)).cast("long").alias("x"), y.alias("y"))))).cast(CELLS)


def inner_stretches(x1: Column, y1: Column, x2: Column, y2: Column, lines: Column) -> Column:
    """Where a segment is inside a polygon of the given edges: array of (start, end), as shares of its length."""
    dx, dy = x2 - x1, y2 - y1

    def met(e: Column) -> Column:
        ex, ey = e["x2"] - e["x1"], e["y2"] - e["y1"]
        det = dx * ey - dy * ex
        t = ((e["x1"] - x1) * ey - (e["y1"] - y1) * ex) / det
        u = ((e["x1"] - x1) * dy - (e["y1"] - y1) * dx) / det
        return F.when((det != 0) & u.between(-TINY, 1 + TINY) & (t > 0) & (t < 1), t)

    at = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.array_compact(F.transform(lines, met)))))
    pairs = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    middle = lambda p: (p["start"] + p["end"]) / 2
    return F.filter(pairs, lambda p: enclosed(x1 + dx * middle(p), y1 + dy * middle(p), lines))


def covered(segments: DataFrame, tiles: DataFrame, key: str = "segment_id") -> DataFrame:
    """(key, z, covered) of each segment (x1, y1, x2, y2 in degrees): whether the water of its tiles covers all of it; null if no zoom has all of them.

    The stretches that are inside any polygon are laid end to end; a gap or a missing end is land. Each is found from its
    tile alone, so what meets by segment are a few numbers, not geometry.
    """
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    cells = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(z).alias("z"), segment_cells(z, *ends).alias("cells")) for k, z in enumerate(ZOOMS)])
    asked = segments.select(key, F.inline(cells))
    zoom = chosen_zoom(asked, tiles, key)
    wanted = asked.join(zoom, [key, "z"]).select(key, "z", F.inline("cells"))
    polygons = tiles.where("parts IS NOT NULL").select("z", "x", "y", F.explode("parts").alias("_rings")).select("z", "x", "y", edges(F.array("_rings")).alias("_edges"))
    near = wanted.join(polygons, ["z", "x", "y"]).join(segments.select(key, *ends), key)
    inside = near.select(key, F.inline(inner_stretches(*ends, F.col("_edges"))))
    reach = F.max("end").over(W.partitionBy(key).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    gaps = inside.withColumn("_gap", F.col("start") > F.coalesce(reach, F.lit(0.0)) + TINY)
    whole = gaps.groupBy(key).agg((~F.bool_or("_gap") & (F.max("end") >= 1 - TINY)).alias("_whole"))
    out = segments.select(key).join(zoom, key, "left").join(whole, key, "left")
    return out.select(key, "z", F.when(F.col("z").isNotNull(), F.coalesce("_whole", F.lit(False))).alias("covered"))


def signed_area(ring: Column) -> Column:
    """Of a ring of structs (x, y), open or closed; above zero if counter-clockwise."""
    ahead = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, ahead, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, c: s + c) / 2


def clipped_ring(ring: Column, hull: Column) -> Column:
    """The part of a ring inside a convex hull (counter-clockwise, open): cut by each of the hull's edges in turn. Where it falls apart its pieces stay joined along the hull, which adds no area."""
    sides = F.zip_with(hull, F.concat(F.slice(hull, 2, F.size(hull) - 1), F.slice(hull, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def cut(points: Column, side: Column) -> Column:
        a, b = side["a"], side["b"]
        left = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
        ahead = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))

        def step(s: Column) -> Column:
            p, q, sp, sq = s["p"], s["q"], s["sp"], s["sq"]
            share = sp / (sp - sq)
            on = F.struct((p["x"] + (q["x"] - p["x"]) * share).alias("x"), (p["y"] + (q["y"] - p["y"]) * share).alias("y"))
            return F.when((sp >= 0) & (sq >= 0), F.array(q)).when(sp >= 0, F.array(on)).when(sq >= 0, F.array(on, q)).otherwise(F.slice(F.array(q), 1, 0))

        steps = F.zip_with(points, ahead, lambda p, q: F.struct(p.alias("p"), q.alias("q"), left(p).alias("sp"), left(q).alias("sq")))
        return F.flatten(F.transform(steps, step))

    return F.aggregate(sides, ring, cut)


def ring_of(points: Column) -> Column:
    """[x, y] pairs as an open ring of structs."""
    pairs = F.transform(points, lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y")))
    return F.when((F.size(pairs) > 1) & (pairs[0] == F.element_at(pairs, -1)), F.slice(pairs, 1, F.size(pairs) - 1)).otherwise(pairs)


def clipped(hulls: DataFrame, tiles: DataFrame, key: str = "hull_id", hull: str = "hull") -> DataFrame:
    """(key, z, state, n_polygons, area, rings) of each convex hull (array of [lon, lat]): its water.

    state is ``clipped``; ``large`` if even the coarsest zoom needs more than MOST_TILES tiles, which leaves nothing; or
    ``unknown`` without a zoom whose tiles are all there, or for fewer than three corners. Finer zooms that need more tiles
    are passed over. area is in square degrees, shells less holes. rings has (shell, points) of each ring that is left.
    """
    open_ = ring_of(F.col(hull))
    h = hulls.where(F.size(hull) >= 3).select(key, F.when(signed_area(open_) < 0, F.reverse(open_)).otherwise(open_).alias("_hull"))
    low, high = [[pick(F.transform("_hull", lambda p: p[a])) for a in "xy"] for pick in (F.array_min, F.array_max)]  # noqa: B023
    lon, lat = [(a + b) / 2 for a, b in zip(low, high)]
    radius = F.greatest((high[1] - low[1]) * KM_PER_DEGREE / 2, (high[0] - low[0]) * KM_PER_DEGREE * F.greatest(F.lit(0.08), F.cos(F.radians(lat))) / 2, F.lit(1.0))
    h = h.select(key, "_hull", lon.alias("_lon"), lat.alias("_lat"), radius.alias("_radius"))
    cells = [F.struct(F.lit(k).alias("place"), F.lit(z).alias("z"), tiles_around(F.col("_lat"), F.col("_lon"), F.col("_radius"), z).alias("cells")) for k, z in enumerate(ZOOMS)]
    asked = h.select(key, F.inline(F.array(*cells)))
    large = asked.where((F.col("place") == len(ZOOMS) - 1) & (F.size("cells") > MOST_TILES)).select(key, F.lit(True).alias("_large"))
    asked = asked.where(F.size("cells") <= MOST_TILES)
    zoom = chosen_zoom(asked, tiles, key)
    wanted = asked.join(zoom, [key, "z"]).select(key, "z", F.inline("cells"))
    polygons = tiles.where("parts IS NOT NULL").select("z", "x", "y", F.posexplode("parts").alias("_polygon", "_rings"))
    rings = wanted.join(polygons, ["z", "x", "y"]).select(key, "z", "x", "y", "_polygon", F.posexplode("_rings").alias("_at", "_ring")).join(h.select(key, "_hull"), key)
    cut = rings.withColumn("points", clipped_ring(ring_of(F.col("_ring")), F.col("_hull"))).withColumn("_area", F.abs(signed_area(F.col("points")))).where("_area > 0")
    shell = F.col("_at") == 0
    made = cut.groupBy(key).agg(F.count_if(shell).alias("n_polygons"), F.sum(F.when(shell, F.col("_area")).otherwise(-F.col("_area"))).alias("area"), F.collect_list(F.struct(shell.alias("shell"), "points")).alias("rings"))
    out = hulls.select(key).join(zoom, key, "left").join(large, key, "left").join(made, key, "left")
    state = F.when(F.col("z").isNotNull(), "clipped").when(F.col("_large"), "large").otherwise("unknown")
    none = F.array().cast("array<struct<shell:boolean,points:array<struct<x:double,y:double>>>>")
    return out.select(key, "z", state.alias("state"), F.coalesce("n_polygons", F.lit(0)).alias("n_polygons"), F.coalesce("area", F.lit(0.0)).alias("area"), F.coalesce("rings", none).alias("rings"))


def tiles_around(lat: Column, lon: Column, radius_km: Column, zoom: int) -> Column:
    """The tiles that the square around a point touches, whatever its radius."""
    return geo.cover(lat, lon, radius_km, zoom).cast(CELLS)
