"""What a contact's own history tells: interpolated positions, course, unbroken paths, hulls, reach and synthetic tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geo

#: Fixed value: metres a second of a knot.
KNOT = 0.514444


def between_fixes(reports: DataFrame, known: Column) -> DataFrame:
    """reports with tx, ty: the position at t_abs on the line from the contact's last known report before to its next known one; null without both."""
    order = W.partitionBy("mmsi").orderBy("frame_idx")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    fix = F.when(known, F.struct("t_abs", "x", "y"))
    d = reports.withColumn("_a", F.last(fix, ignorenulls=True).over(before)).withColumn("_b", F.first(fix, ignorenulls=True).over(after))
    share = F.when(F.col("_b.t_abs") > F.col("_a.t_abs"), (F.col("t_abs") - F.col("_a.t_abs")) / (F.col("_b.t_abs") - F.col("_a.t_abs")))
    at = lambda c: F.col(f"_a.{c}") + share * (F.col(f"_b.{c}") - F.col(f"_a.{c}"))
    return d.withColumns({"tx": at("x"), "ty": at("y")}).drop("_a", "_b")


def navigation(reports: DataFrame) -> DataFrame:
    """mmsi, course, speed_kn, turn (degrees a minute) from the last three reports (mmsi, t, lat, lon, frame_idx) of each contact."""
    w = W.partitionBy("mmsi").orderBy("frame_idx")
    last = F.row_number().over(W.partitionBy("mmsi").orderBy(F.desc("frame_idx")))
    back = lambda c, k: F.lag(c, k).over(w)
    d = reports.withColumns({f"{c}{k}": back(c, k) for c in ("t", "lat", "lon") for k in (1, 2)}).withColumn("rn", last).where("rn = 1 AND t1 IS NOT NULL")
    at = lambda k: (F.col(f"lat{k}"), F.col(f"lon{k}"))
    course, prior = geo.bearing(*at(1), F.col("lat"), F.col("lon")), geo.bearing(*at(2), *at(1))
    per_degree = 111_320.0
    east = (F.col("lon") - F.col("lon1")) * per_degree * F.greatest(F.lit(0.1), F.cos(F.radians((F.col("lat") + F.col("lat1")) / 2)))
    north = (F.col("lat") - F.col("lat1")) * per_degree
    elapsed, span = F.col("t") - F.col("t1"), F.col("t") - F.col("t2")
    speed = F.when(elapsed > 1, F.hypot(east, north) / elapsed / KNOT)
    return d.select("mmsi", course.alias("course"), speed.alias("speed_kn"), F.when(span > 0, geo.angle_delta(course, prior) / (span / 120)).alias("turn"))


def unbroken(reports: DataFrame, most_kn: float) -> DataFrame:
    """mmsi, part, n, duration_min, length_m of each stretch of two reports or more between jumps that are faster than most_kn."""
    w = W.partitionBy("mmsi").orderBy("frame_idx")
    d = reports.select("mmsi", "frame_idx", "t", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)).alias("leg"), (F.col("t") - F.lag("t").over(w)).alias("dt"))
    jump = F.coalesce((F.col("dt") > 0) & (F.col("leg") / F.col("dt") / KNOT >= most_kn), F.lit(False))
    d = d.withColumn("jump", jump).withColumn("part", F.sum(F.col("jump").cast("int")).over(w))
    legs = F.coalesce(F.sum(F.when(~F.col("jump"), F.col("leg"))), F.lit(0.0))
    out = d.groupBy("mmsi", "part").agg(F.count(F.lit(1)).alias("n"), ((F.max("t") - F.min("t")) / 60).alias("duration_min"), legs.alias("length_m"))
    return out.where("n > 1")


def thinned(reports: DataFrame, most: int) -> DataFrame:
    """At most ``most`` reports of each contact, evenly spread over its path with both ends."""
    i = F.row_number().over(W.partitionBy("mmsi").orderBy("frame_idx")) - 1
    d = reports.withColumn("_i", i).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("mmsi")))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / F.lit(float(most - 1))).cast("int"))
    return d.where((F.col("_n") <= most) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")


def miss_runs(looks: DataFrame) -> DataFrame:
    """mmsi, since, until, n of each run of frames without a hit. looks: mmsi, frame_idx, hit."""
    w = W.partitionBy("mmsi").orderBy("frame_idx")
    d = looks.withColumn("hits", F.sum(F.col("hit").cast("int")).over(w)).where("NOT hit")
    return d.groupBy("mmsi", "hits").agg(F.min("frame_idx").alias("since"), F.max("frame_idx").alias("until"), F.count(F.lit(1)).alias("n")).drop("hits")


def corners(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise, without points on its edges: lower and upper chain of the sorted points."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(run: list[tuple[float, float]]) -> list[tuple[float, float]]:
        kept: list[tuple[float, float]] = []
        for x, y in run:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (y - kept[-2][1]) <= (kept[-1][1] - kept[-2][1]) * (x - kept[-2][0]):
                kept.pop()
            kept.append((x, y))
        return kept[:-1]

    return chain(points) + chain(points[::-1])


def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The corners (mmsi, x, y) of each contact's rows of a batch; those of a batch's last contact go on to the next. What a batch holds of a contact's points is all that stands in memory."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b])
        b = b.sort_values("mmsi", kind="stable")
        who, xs, ys = b["mmsi"].to_numpy(), b["x"].tolist(), b["y"].tolist()
        edges = [0, *(np.flatnonzero(np.diff(who)) + 1).tolist(), len(who)]
        ids, out = [], []
        for lo, hi in zip(edges, edges[1:]) if len(who) else []:
            found = corners(list(zip(xs[lo:hi], ys[lo:hi], strict=True)))
            ids += [who[lo]] * len(found)
            out += found
        last = len(found) if len(who) else 0
        made = pd.DataFrame({"mmsi": np.array(ids, who.dtype), "x": [p[0] for p in out], "y": [p[1] for p in out]})
        rest = made[len(made) - last :]
        if len(made) > last:
            yield made[: len(made) - last]
    if rest is not None and len(rest):
        yield rest


def hulls(points: DataFrame) -> DataFrame:
    """mmsi, x, y: the hull's corners of each contact. The hull of partial hulls is the hull, so each task sends on the corners of what it reads only; rows without a contact are left out."""
    shape = "mmsi long, x double, y double"
    own = points.select(F.col("mmsi").cast("long").alias("mmsi"), "x", "y").where("mmsi IS NOT NULL").mapInPandas(partial, shape)
    return own.repartition("mmsi").sortWithinPartitions("mmsi").mapInPandas(partial, shape)


def crosses(x1: Column, y1: Column, x2: Column, y2: Column, ring: list[tuple[float, float]], step: float) -> Column:
    """Whether any of the points every step metres (at most) along a segment, its end included, is inside the ring."""
    n = F.greatest(F.lit(1), F.ceil(F.hypot(x2 - x1, y2 - y1) / step).cast("int"))
    return F.exists(F.sequence(F.lit(1), n), lambda k: geo.strictly_inside(x1 + (x2 - x1) * k / n, y1 + (y2 - y1) * k / n, ring))


def reachable(plots: DataFrame, tracks: DataFrame, reach: float) -> DataFrame:
    """plots (frame_idx, det_id, x, y) with reachable: whether some track (frame_idx, px, py) of the frame is at most reach away. Joined by cell, as a semi-join."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    t = tracks.select("frame_idx", "px", "py", F.explode(around).alias("o")).select("frame_idx", "px", "py", (cell("px") + F.col("o.i")).alias("cx"), (cell("py") + F.col("o.j")).alias("cy"))
    near = plots.withColumn("cx", cell("x")).withColumn("cy", cell("y")).join(t, ["frame_idx", "cx", "cy"]).where(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) <= reach)
    hit = near.select("det_id").distinct().withColumn("hit", F.lit(True))
    return plots.join(hit, "det_id", "left").withColumn("reachable", F.coalesce("hit", F.lit(False))).drop("hit")


def transit(x0: Column, y0: Column, speed: Column, heading: Column, t: Column) -> tuple[Column, Column]:
    """Position after t seconds on a straight line; heading is clockwise from north in degrees."""
    h = F.radians(heading)
    return x0 + F.sin(h) * speed * t, y0 + F.cos(h) * speed * t


def transit_then_loiter(x0: Column, y0: Column, speed: Column, heading: Column, t: Column, transit_s: Column, radius: float = 150.0, loiter_mps: float = 2.0) -> tuple[Column, Column]:
    """A straight line for transit_s seconds, then a circle that begins at the point reached."""
    lx, ly = transit(x0, y0, speed, heading, F.least(t, transit_s))
    angle = loiter_mps / max(radius, 1.0) * F.greatest(t - transit_s, F.lit(0.0))
    return lx + radius * F.sin(angle), ly - radius * (1 - F.cos(angle))


def synthetic_tracks(actors: DataFrame, frames: int, step: float) -> DataFrame:
    """actor, frame_idx, x, y of every actor (actor, kind, x0, y0, speed, heading, transit_s) in every frame."""
    t = F.col("frame_idx") * step
    args = (F.col("x0"), F.col("y0"), F.col("speed"), F.col("heading"), t)
    straight, circle = transit(*args), transit_then_loiter(*args, F.col("transit_s"))
    d = actors.withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    pick = lambda k: F.when(F.col("kind") == "transit", straight[k]).otherwise(circle[k])
    return d.select("actor", F.col("frame_idx").cast("long").alias("frame_idx"), pick(0).alias("x"), pick(1).alias("y"))


def zipped_rows(spark, path: str, columns: str) -> DataFrame:
    """Rows of the first CSV in each zip archive, as strings named by columns (of its header). Archives are read as streams of batches, never whole tables."""
    import csv
    import io
    import zipfile

    names = [c.strip() for c in columns.split(",")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                    if member is None:
                        continue
                    with z.open(member) as f:
                        part = []
                        for r in csv.DictReader(io.TextIOWrapper(f, "utf-8-sig")):
                            part.append([r.get(n) for n in names])
                            if len(part) == 10_000:
                                yield pd.DataFrame(part, columns=names)
                                part = []
                        yield pd.DataFrame(part, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, ", ".join(f"{n} string" for n in names))
