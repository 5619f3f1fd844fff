"""Resampling, as-of joins, crossings, zones and silences over position reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geo

MAX_GAP_S, SILENT_S, NEAR_M, CELL_M = 600.0, 45.0, 500.0, 500.0
#: Zones in metres: (id, kind, corners).
ZONES = (
    ("sanctuary_a", "mpa", [(0.0, 0.0), (5000.0, 0.0), (5000.0, 5000.0), (0.0, 5000.0)]),
    ("sanctuary_b", "mpa", [(4000.0, 3000.0), (9000.0, 3000.0), (9000.0, 7000.0), (4000.0, 7000.0)]),
    ("harbour", "port", [(-4000.0, -2000.0), (0.0, -2000.0), (-2000.0, 2000.0)]),
    ("range", "danger", [(-9000.0, 3000.0), (-3000.0, 3000.0), (-6000.0, 8000.0)]),
)
CABLES = (("north", -10000.0, 8000.0, 12000.0, 6000.0), ("south", -8000.0, -3000.0, 12000.0, 500.0), ("east", 7000.0, -5000.0, 9000.0, 9000.0), ("west", -7000.0, -6000.0, -6000.0, 9000.0))


def resample(fixes: DataFrame, key: str, t: str, step: float, max_gap: float = MAX_GAP_S, least_points: int = 4) -> DataFrame:
    """key, t_grid, x, y at every multiple of step between fixes that are at most max_gap apart; keys with fewer points go.

    Each fix makes the grid points up to the next one: no range join, one shuffle by key.
    """
    w = W.partitionBy(key).orderBy(t, "event_id")
    d = fixes.select(key, t, "x", "y", *[F.lead(c).over(w).alias(f"next_{c}") for c in (t, "x", "y")])
    d = d.where((F.col(f"next_{t}") > F.col(t)) & (F.col(f"next_{t}") - F.col(t) <= max_gap))
    lo, hi = F.ceil(F.col(t) / step), F.ceil(F.col(f"next_{t}") / step) - 1
    grid = d.where(lo <= hi).withColumn("g", F.explode(F.sequence(lo, hi)))
    share = (F.col("g") * step - F.col(t)) / (F.col(f"next_{t}") - F.col(t))
    blend = lambda c: (F.col(c) + share * (F.col(f"next_{c}") - F.col(c))).alias(c)
    points = grid.select(key, (F.col("g") * step).alias("t_grid"), blend("x"), blend("y"))
    return points.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(key))).where(F.col("n") >= least_points).drop("n")


def as_of(rows: DataFrame, key: str, order: list[str], value: Column, default: Column) -> Column:
    """The last non-null value at or before a row."""
    return F.coalesce(F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(*order)), default)


def close_pairs(points: DataFrame, near: float = NEAR_M) -> DataFrame:
    """a < b of the same frame at most near apart. Points are joined by frame and cell; only one side is copied to the neighbouring cells."""
    cell = lambda c: F.floor(F.col(c) / near).cast("long")
    p = points.select("frame_idx", "mmsi", "x", "y", "next_x", "next_y", cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = p.select("frame_idx", *[F.col(c).alias(f"{c}_a") for c in ("mmsi", "x", "y", "next_x", "next_y")], "cx", "cy", F.explode(around).alias("o"))
    a = a.withColumn("cx", F.col("cx") + F.col("o.i")).withColumn("cy", F.col("cy") + F.col("o.j")).drop("o")
    b = p.select("frame_idx", "cx", "cy", *[F.col(c).alias(f"{c}_b") for c in ("mmsi", "x", "y", "next_x", "next_y")])
    pairs = a.join(b, ["frame_idx", "cx", "cy"]).where("mmsi_a < mmsi_b").withColumn("distance", F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")))
    return pairs.where(F.col("distance") <= near)


def crossings(points: DataFrame, step: float = 30.0, least_closing: float = 0.5) -> DataFrame:
    """mmsi_a, mmsi_b, t_start, t_end, min_distance, max_closing of each spell in which two contacts close in on each other."""
    w = W.partitionBy("mmsi").orderBy("frame_idx")
    then = F.lead("frame_idx").over(w) == F.col("frame_idx") + 1
    p = points.select("mmsi", "frame_idx", "x", "y", *[F.when(then, F.lead(c).over(w)).alias(f"next_{c}") for c in ("x", "y")])
    after = F.hypot(F.col("next_x_a") - F.col("next_x_b"), F.col("next_y_a") - F.col("next_y_b"))
    pairs = close_pairs(p).withColumn("closing", F.coalesce((F.col("distance") - after) / step, F.lit(0.0))).where(F.col("closing") > least_closing)
    spell = W.partitionBy("mmsi_a", "mmsi_b").orderBy("frame_idx")
    new = F.when(F.col("frame_idx") - F.lag("frame_idx").over(spell) <= 1.5, 0).otherwise(1)
    pairs = pairs.withColumn("new", new).withColumn("spell", F.sum("new").over(spell))
    return pairs.groupBy("mmsi_a", "mmsi_b", "spell").agg(
        (F.min("frame_idx") * step).alias("t_start"), (F.max("frame_idx") * step).alias("t_end"), F.min("distance").alias("min_distance"), F.max("closing").alias("max_closing")
    )


def inside(points: DataFrame, zones=ZONES) -> DataFrame:
    """points with zones_in: the ids of the zones they are strictly inside, sorted. Zones are a fixed list, so this is a projection."""
    x, y = F.col("x"), F.col("y")
    ids = []
    for name, _, ring in zones:
        box = x.between(min(p[0] for p in ring), max(p[0] for p in ring)) & y.between(min(p[1] for p in ring), max(p[1] for p in ring))
        ids.append(F.when(box & geo.strictly_inside(x, y, ring), F.lit(name)))
    return points.withColumn("zones_in", F.sort_array(F.array_compact(F.array(*ids))))


def transitions(points: DataFrame) -> DataFrame:
    """mmsi, frame_idx, kind (enter or exit), zone_id: what changed since the contact's previous report."""
    w = W.partitionBy("mmsi").orderBy("frame_idx")
    d = inside(points).withColumn("before", F.coalesce(F.lag("zones_in").over(w), F.array().cast("array<string>")))
    change = lambda kind, a, b: F.transform(F.array_except(a, b), lambda z: F.struct(F.lit(kind).alias("kind"), z.alias("zone_id")))
    both = F.concat(change("exit", "before", "zones_in"), change("enter", "zones_in", "before"))
    return d.select("mmsi", "frame_idx", F.explode(both).alias("c")).select("mmsi", "frame_idx", "c.kind", "c.zone_id")


def stays(points: DataFrame) -> DataFrame:
    """mmsi, zone_id, since, until, n of each unbroken stay in a zone."""
    d = inside(points).select("mmsi", "frame_idx", F.explode("zones_in").alias("zone_id"))
    w = W.partitionBy("mmsi", "zone_id").orderBy("frame_idx")
    d = d.withColumn("island", F.col("frame_idx") - F.row_number().over(w))
    return d.groupBy("mmsi", "zone_id", "island").agg(F.min("frame_idx").alias("since"), F.max("frame_idx").alias("until"), F.count(F.lit(1)).alias("n")).drop("island")


def silences(points: DataFrame, threshold: float) -> DataFrame:
    """mmsi, dark_at, resumed_at, silent_s of each gap longer than the threshold."""
    gap = F.lead("t_abs").over(W.partitionBy("mmsi").orderBy("t_abs", "event_id"))
    d = points.select("mmsi", "t_abs", gap.alias("resumed_at")).where(F.col("resumed_at") - F.col("t_abs") > threshold)
    return d.select("mmsi", (F.col("t_abs") + threshold).alias("dark_at"), "resumed_at", (F.col("resumed_at") - F.col("t_abs")).alias("silent_s"))


def latest(points: DataFrame, now: float, threshold: float) -> DataFrame:
    """The last report of each contact with its age and whether it is silent; reduced before the shuffle."""
    last = points.groupBy("mmsi").agg(F.max_by(F.struct("x", "y", "t_abs", "speed_kn", "frame_idx"), F.struct("t_abs", "event_id")).alias("l"), F.count(F.lit(1)).alias("n_reports"))
    return last.select("mmsi", "l.*", "n_reports", (now - F.col("l.t_abs")).alias("age_s")).withColumn("dark", F.col("age_s") >= threshold)
