"""Where a silent contact may be: deterministic Monte Carlo samples and their confidence regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geo

SAMPLES, LEVELS = 600, (50, 80, 95)
BEHAVIOURS = ("continue", "turn", "slow", "drift")
SAMPLED = "mmsi long, sample int, x double, y double, behaviour string"


#: Sampled points that leave Python at once, or those of one contact.
PART = 30_000


def drawn(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """The samples of each contact, those of a few contacts at a time, so that a batch of many contacts doesn't stand in memory n times as large."""
    for b in batches:
        parts = []
        for c in b.itertuples():
            rng = np.random.default_rng(int(c.mmsi))
            kind = rng.choice(len(BEHAVIOURS), n, p=(0.55, 0.2, 0.15, 0.1))
            step = 120.0 if c.age_s <= 7200 else 300.0 if c.age_s <= 43200 else 900.0
            heading, speed = np.radians(c.course_deg + rng.normal(0, 4, n)), np.maximum(0, c.speed_mps + rng.normal(0, 0.35, n))
            heading = heading + np.where(kind == 1, rng.normal(0, 1, n), 0)
            speed = np.where(kind == 2, speed * 0.5, np.where(kind == 3, np.minimum(speed, 0.5), speed))
            x, y, t = np.full(n, c.x), np.full(n, c.y), 0.0
            while t < c.age_s:
                dt = min(step, c.age_s - t)
                heading = heading + rng.normal(0, 0.02, n) * np.sqrt(dt / 120)
                x, y, t = x + speed * dt * np.sin(heading), y + speed * dt * np.cos(heading), t + dt
            parts.append(pd.DataFrame({"mmsi": c.mmsi, "sample": np.arange(n, dtype=np.int32), "x": x, "y": y, "behaviour": np.array(BEHAVIOURS)[kind]}))
            if len(parts) * n >= PART:
                yield pd.concat(parts)
                parts = []
        if parts:
            yield pd.concat(parts)


def samples(contacts: DataFrame, n: int = SAMPLES) -> DataFrame:
    """contacts: mmsi, x, y, course_deg, speed_mps, age_s. n end points of each, from a generator seeded by contact and nothing else."""
    return contacts.select("mmsi", "x", "y", "course_deg", "speed_mps", "age_s").mapInPandas(lambda batches: drawn(batches, n), SAMPLED)


def regions(points: DataFrame, key: str = "mmsi", levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """key, level, n, radius, cx, cy: the share of points nearest to the centre (the middle of the sorted values of each axis)."""
    order = lambda c: F.row_number().over(W.partitionBy(key).orderBy(c, "sample"))
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    d = points.select(key, "sample", "x", "y", n.alias("total"), order("x").alias("rx"), order("y").alias("ry"))
    at = lambda c, r: F.max(F.when(F.col(r) == F.floor(F.col("total") / 2) + 1, F.col(c))).over(W.partitionBy(key))
    d = d.withColumn("cx", at("x", "rx")).withColumn("cy", at("y", "ry")).withColumn("d", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    d = d.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("d", "sample"))).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    d = d.where(F.col("rank") <= F.greatest(F.lit(3), F.ceil(F.col("total") * F.col("level") / 100)))
    return d.groupBy(key, "level").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius"), F.first("cx").alias("cx"), F.first("cy").alias("cy"))


#: Speed (knots) without any knowledge.
UNKNOWN_SPEED = 5.0
#: The history's course counts with this share, if it is no further off than this.
COURSE_SHARE = 0.2
COURSE_REACH = 45.0
#: Reported turns (degrees a minute) beyond this aren't possible; shares of the reported and the past turn; the largest that a forecast takes.
POSSIBLE_TURN = 20.0
REPORTED_TURN = 0.7
PAST_TURN = 0.3
MOST_TURN = 1.5
#: Statuses that hold a contact, the speed below which they do and what they leave of it.
HELD = (1, 5, 6)
HELD_BELOW = 3.0
HELD_SPEED = 0.5
#: Spread of the heading, what a holding status adds to it; spread of the speed, its share of the speed, and what each missing input adds.
HEADING_SPREAD = 4.0
HELD_HEADING = 8.0
SPEED_SPREAD = 0.35
SPEED_SHARE = 0.1
MISSING_SPEED = 0.3


def navigation(course: Column, heading: Column, speed: Column, turn: Column, status: Column, past_course: Column, past_speed: Column, past_turn: Column, n_points: Column, silent_min: Column) -> dict[str, Column]:
    """What a forecast starts from: bearing, speed, turn, the missing inputs, the spreads and how many branches are wanted.

    What was reported counts if it is possible, then what the history says; the bearing leans to the history's course where they agree.
    """
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    possible = lambda c: F.when(c.between(-POSSIBLE_TURN, POSSIBLE_TURN), c)  # NaN is above all
    in_range = lambda c, top: F.when(~F.isnan(c) & (c >= 0) & (c < top), c)
    course, heading, speed, past_speed, turn, past_turn = in_range(course, 360), in_range(heading, 360), in_range(speed, 50), in_range(past_speed, 50), possible(turn), finite(past_turn)
    told = F.coalesce(course, heading)
    off = geo.angle_delta(past_course, told)
    bearing = F.coalesce(F.when(F.abs(off) <= COURSE_REACH, F.pmod(told + off * COURSE_SHARE, F.lit(360.0))), told, past_course, F.lit(0.0))
    held = F.coalesce(status.isin(*HELD), F.lit(False))
    knots = F.coalesce(speed, past_speed, F.lit(UNKNOWN_SPEED))
    knots = F.when(held & (knots < HELD_BELOW), F.least(knots, F.lit(HELD_SPEED))).otherwise(knots)
    turning = F.coalesce(turn * REPORTED_TURN + past_turn * PAST_TURN, turn, past_turn, F.lit(0.0))
    known = {"course_over_ground": course, "true_heading": heading, "speed_over_ground": speed, "rate_of_turn": F.coalesce(turn, past_turn), "track_history": F.when(n_points >= 3, 1)}
    missing = F.array_compact(F.array(*[F.when(c.isNull(), name) for name, c in known.items()]))
    n = F.size(missing)
    spread = F.greatest(F.lit(SPEED_SPREAD), knots * SPEED_SHARE) + n * MISSING_SPEED
    return {
        "bearing": bearing, "speed_kn": knots, "turn": F.greatest(F.lit(-MOST_TURN), F.least(F.lit(MOST_TURN), turning)), "missing": missing,
        "heading_sigma": HEADING_SPREAD * (n + 1) + F.when(held, HELD_HEADING).otherwise(0.0), "speed_sigma": F.when(held, F.least(spread, F.lit(HELD_SPEED))).otherwise(spread),
        "n_branches": F.greatest(F.lit(5), F.least(F.lit(6), 5 + n + F.floor(silent_min / 15).cast("int"))),
    }


def branches(points: DataFrame, wanted: int = 6, rounds: int = 8) -> DataFrame:
    """points (key, sample, x, y, behaviour) with cluster (from 0 within a behaviour): the k-means of each behaviour's points.

    Clusters beyond one per behaviour go where size per cluster is largest, which is the order of the quotients
    size / 1, size / 2 and so on. Centres start at points evenly spread by angle. Each round joins the few centres of
    a key and averages, so no group meets in one task.
    """
    by = ["key", "behaviour"]
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc(F.col("n") / F.col("k")), "behaviour", "k"))
    extra = sizes.withColumn("many", F.count(F.lit(1)).over(W.partitionBy("key"))).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(wanted)))).withColumn("rank", rank)
    extra = extra.groupBy(*by).agg(F.count_if(F.col("rank") <= wanted - F.col("many")).alias("more"))
    shares = sizes.join(extra, by).withColumn("k", F.least(F.col("more") + 1, F.col("n"))).select(*by, "n", "k")
    starts = shares.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    starts = starts.select(*by, F.col("c").cast("int").alias("c"), F.least(F.col("n") - 1, F.floor((F.col("c") + 0.5) * F.col("n") / F.col("k"))).alias("place"))
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.atan2("x", "y"), "sample")) - 1
    centres = points.withColumn("place", place.cast("long")).join(starts, [*by, "place"]).select(*by, "c", "x", "y")

    at = centres.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("c", "x", "y"))).alias("at"))  # at most ``wanted`` centres

    def nearest(at: DataFrame) -> DataFrame:
        away = lambda p: F.pow(F.col("x") - p["x"], 2) + F.pow(F.col("y") - p["y"], 2)
        return points.join(at, by).withColumn("cluster", F.array_min(F.transform("at", lambda p: F.struct(away(p).alias("d"), p["c"].alias("c"))))["c"])

    for _ in range(rounds - 1):
        means = nearest(at).groupBy(*by, F.col("cluster").alias("c")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.any_value("at").alias("at"))
        new = means.groupBy(*by).agg(F.collect_list(F.struct("c", "x", "y")).alias("new"), F.any_value("at").alias("at"))
        moved = lambda p: F.coalesce(F.get(F.filter("new", lambda m: m["c"] == p["c"]), F.lit(0)), p)
        at = new.select(*by, F.transform("at", moved).alias("at"))
    return nearest(at).drop("at")


def branch_summaries(clustered: DataFrame) -> DataFrame:
    """key, behaviour, cluster, n, probability, cx, cy, sample, radius of points (key, sample, x, y, behaviour, cluster).

    sample is the point nearest to the centre, radius that within which nine in ten lie, at least 100.
    """
    by = ["key", "behaviour", "cluster"]
    centres = clustered.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    totals = centres.groupBy("key").agg(F.sum("n").alias("total"))
    d = clustered.join(centres.join(totals, "key"), by).withColumn("d", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    d = d.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("d", "sample")))
    nine = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.9)) + 1
    out = d.groupBy(*by, "n", "total", "cx", "cy").agg(F.max(F.when(F.col("rank") == 1, F.col("sample"))).alias("sample"), F.max(F.when(F.col("rank") == nine, F.col("d"))).alias("d"))
    return out.select(*by, "n", F.round(F.col("n") / F.col("total"), 4).alias("probability"), "cx", "cy", "sample", F.greatest(F.lit(100.0), F.col("d")).alias("radius"))
