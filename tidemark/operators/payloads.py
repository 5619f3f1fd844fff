"""What clients are sent of each frame: tracks, measurements, alerts, removed tracks and zones as nested rows, in parts of bounded size.

Rows are keyed by mission and frame_idx. A message is a row that ``write.json`` makes a line of.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo

#: Statuses that are shown, the one that is dark, knots of a metre a second, and an ellipse's deviations and corners.
SHOWN = ("tentative", "confirmed", "coasting")
DARK = "coasting"
KNOTS = 1.94384
DEVIATIONS, CORNERS = 2.0, 24
#: Items of a message; more make more parts.
MOST = 1000
KINDS = ("tracks", "measurements", "alerts", "removed", "zones")


def rounded(pairs: Column, digits: int) -> Column:
    return F.transform(pairs, lambda p: F.array(F.round(p["a"], digits), F.round(p["b"], digits)))


def tracks(states: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """mission, frame_idx, track_id, x, y, lat, lon, heading_deg, speed_mps, speed_kn, status, dark, ellipse, ellipse_latlon, zones, last_source, label of each state that is shown.

    states: mission, frame_idx, track_id, x, y, vx, vy, p00, p01, p11, status, zones (array, null for none), last_source. The
    ellipse is a closed ring; what isn't positive definite has a flat one. Null numbers give null fields.
    """
    x, y = F.col("x"), F.col("y")
    lla = lambda a, b: geo.to_lla(a, b, lat0, lon0)
    speed = F.hypot("vx", "vy")
    corners = geo.ring_of_ellipse(x, y, F.col("p00"), F.col("p01"), F.col("p11"), CORNERS, DEVIATIONS**2)
    ring = F.transform(corners, lambda p: F.struct(p["x"].alias("a"), p["y"].alias("b")))
    d = states.where(F.col("status").isin(*SHOWN)).withColumn("_ring", F.concat(ring, F.slice(ring, 1, 1)))
    (lat, lon), knots = lla(x, y), F.round(speed * KNOTS, 1)
    on_globe = F.transform("_ring", lambda p: F.struct(*[c.alias(n) for c, n in zip(lla(p["a"], p["b"]), "ab", strict=True)]))
    return d.select(
        "mission", "frame_idx", "track_id", F.round(x, 1).alias("x"), F.round(y, 1).alias("y"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"),
        F.round(F.pmod(F.degrees(F.atan2("vx", "vy")), F.lit(360.0)), 1).alias("heading_deg"), F.round(speed, 2).alias("speed_mps"), knots.alias("speed_kn"), "status", (F.col("status") == DARK).alias("dark"),
        rounded(F.col("_ring"), 1).alias("ellipse"), rounded(on_globe, 6).alias("ellipse_latlon"), F.coalesce("zones", F.array().cast("array<string>")).alias("zones"), "last_source",
        F.concat(F.col("track_id").cast("string"), F.format_string(" · %.1f kn", knots)).alias("label"),
    )


def removed(shown: DataFrame) -> DataFrame:
    """mission, frame_idx, track_id of tracks that were shown in the frame before and aren't in this one, also in the frame after a mission's last."""
    before = shown.select("mission", (F.col("frame_idx") + 1).alias("frame_idx"), "track_id")
    return before.join(shown.select("mission", "frame_idx", "track_id"), ["mission", "frame_idx", "track_id"], "left_anti")


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def messages(shown: DataFrame, plots: DataFrame, alerts: DataFrame, zones: DataFrame, step: float, most: int = MOST) -> DataFrame:
    """mission, frame_idx, part (from 0), n_parts, t, clock, tracks, measurements, alerts, removed, zones, stats: the messages of each frame.

    shown: rows of ``tracks``. plots: mission, frame_idx, meas_id, x, y, source, suppressed, matched; suppressed ones are
    counted, not sent. alerts: mission, frame_idx, alert_id and what else is told. zones: mission, zone_id and what else is
    told, sent with frame 0. Ids are unique within their frame and kind, and rows of a null id or mission aren't sent.

    A frame's items are dealt to as many parts as it takes for about ``most`` of each, by their ids alone, so that a frame of
    any size is many small rows and a rerun makes the same ones. Within a part items are sorted by id. stats count the whole
    frame in every part: n_tracks, n_dark, n_meas, n_suppressed and n_matched. A frame of which nothing is told has no message.
    """
    hidden = F.coalesce("suppressed", F.lit(False))
    sent = plots.select("mission", "frame_idx", "meas_id", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), "source", hidden.alias("_hidden"), F.coalesce("matched", F.lit(False)).alias("_matched"))
    rows = {
        "tracks": (shown, "track_id"), "measurements": (sent, "meas_id"), "alerts": (alerts, "alert_id"),
        "removed": (removed(shown), "track_id"), "zones": (zones.withColumn("frame_idx", F.lit(0).cast("long")), "zone_id"),
    }
    parts = []
    for kind in KINDS:
        d, name = rows[kind]
        told = [c for c in d.columns if c not in ("mission", "frame_idx", name) and not c.startswith("_")]
        item = F.struct(F.col(name), *[F.col(c) for c in told])
        flag = {"tracks": F.col("dark"), "measurements": F.col("_hidden")}.get(kind, F.lit(False))
        matched = F.col("_matched") if kind == "measurements" else F.lit(False)
        d = d.na.drop(subset=["mission", "frame_idx", name])
        parts.append(d.select("mission", F.col("frame_idx").cast("long").alias("frame_idx"), F.lit(kind).alias("_kind"), F.col(name).cast("string").alias("_id"), F.coalesce(flag, F.lit(False)).alias("_flag"), matched.alias("_matched"), item.alias(kind)))
    items = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    kind, flag = F.col("_kind"), F.col("_flag")
    hides = (kind == "measurements") & flag
    counts = items.groupBy("mission", "frame_idx").agg(
        F.greatest(F.lit(1).cast("long"), F.ceil(F.count_if(~hides) / most)).cast("long").alias("n_parts"),
        F.struct(
            F.count_if(kind == "tracks").alias("n_tracks"), F.count_if((kind == "tracks") & flag).alias("n_dark"), F.count_if((kind == "measurements") & ~flag).alias("n_meas"),
            F.count_if(hides).alias("n_suppressed"), F.count_if((kind == "measurements") & F.col("_matched")).alias("n_matched"),
        ).alias("stats"),
    )
    place = F.conv(F.substring(F.md5(F.concat_ws("#", "_kind", "_id")), 1, 8), 16, 10).cast("long") % F.col("n_parts")
    dealt = items.join(counts, ["mission", "frame_idx"]).withColumn("part", F.when(hides, 0).otherwise(place))
    lists = [F.sort_array(F.collect_list(F.when(F.col(k).isNotNull() & ~hides, F.struct("_id", F.col(k).alias("item"))))) for k in KINDS]
    out = dealt.groupBy("mission", "frame_idx", "part").agg(F.first("n_parts").alias("n_parts"), F.first("stats").alias("stats"), *[c.alias(k) for k, c in zip(KINDS, lists, strict=True)])
    t = F.col("frame_idx") * step
    plain = [F.transform(k, lambda s: s["item"]).alias(k) for k in KINDS]
    return out.select("mission", "frame_idx", "part", "n_parts", t.alias("t"), clock(t).alias("clock"), *plain, "stats")
