"""Queries of contacts' paths and of what clients are told of a frame, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import movement, paths, payloads, water
from tidemark.plans.registry import det, query, r
from tidemark.plans.water_queries import STEPS, water_tiles

#: Reports lie where the water tiles do; a nominal minute passes from one to the next.
FIXES = "f AS (SELECT event_id, event_type, mmsi, frame_idx, frame_idx * 60.0::DOUBLE AS t, x / 4000 - 121.95 AS lon, y / 4000 + 36.75 AS lat FROM det)"
MOST_KN = 700.0


def fixes(spark, sf_dir):
    return det(spark, sf_dir).select("event_id", "event_type", "mmsi", "frame_idx", (F.col("frame_idx") * 60.0).alias("t"), (F.col("x") / 4000 - 121.95).alias("lon"), (F.col("y") / 4000 + 36.75).alias("lat"))


def over_land(spark, sf_dir):
    """The ways between reports that water is known not to cover."""
    c = paths.connectors(fixes(spark, sf_dir), "mmsi", ["frame_idx"])
    s = c.select(F.struct("mmsi", "frame_idx").alias("segment_id"), F.col("lon1").alias("x1"), F.col("lat1").alias("y1"), F.col("lon2").alias("x2"), F.col("lat2").alias("y2"))
    return water.covered(s, water_tiles(spark, sf_dir)).where("NOT covered").select("segment_id.mmsi", "segment_id.frame_idx")


STRETCHED = STEPS + f""", land AS (SELECT DISTINCT mmsi, frame_idx FROM m WHERE t1 - t0 > 1e-9), {FIXES},
b0 AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lag(frame_idx) OVER w AS before FROM f WINDOW w AS (PARTITION BY mmsi ORDER BY frame_idx)),
b1 AS (SELECT *, CASE WHEN la IS NOT NULL THEN 2000 * 6371.0088 * asin(sqrt(least(1, sin(radians(lat - la) / 2) ** 2 + cos(radians(la)) * cos(radians(lat)) * sin(radians(lon - lo) / 2) ** 2))) END AS leg FROM b0),
b2 AS (SELECT b1.*, before IS NOT NULL AND (land.mmsi IS NOT NULL OR leg / 60 / 0.514444 >= {MOST_KN}) AS broken FROM b1 LEFT JOIN land ON land.mmsi = b1.mmsi AND land.frame_idx = b1.before),
b3 AS (SELECT *, sum(broken::INT) OVER (PARTITION BY mmsi ORDER BY frame_idx) AS part FROM b2),
b4 AS (SELECT mmsi, part::BIGINT AS part, count(*) AS n, (max(t) - min(t)) / 60 AS duration_min, sum(CASE WHEN broken THEN 0 ELSE coalesce(leg, 0) END) AS length_m, count(*) FILTER (WHERE broken) AS gaps FROM b3 GROUP BY 1, 2)"""


@query(STRETCHED + " SELECT mmsi, part, n, duration_min, round(length_m, 2) AS length_m FROM b4 WHERE n > 1")
def stretches_on_water(spark, sf_dir):
    """What is left of each contact's path without the ways that lead over land or are too fast."""
    rows = paths.stretched(fixes(spark, sf_dir), "mmsi", ["frame_idx"], over_land(spark, sf_dir), MOST_KN)
    return paths.stretches(rows, "mmsi").select("mmsi", "part", "n", "duration_min", r("length_m", 2).alias("length_m"))


@query(STRETCHED + " SELECT mmsi, sum(n)::BIGINT AS n_fixes, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS n_shown, count(*) FILTER (WHERE n > 1) AS n_stretches, sum(gaps)::BIGINT AS omitted FROM b4 GROUP BY 1")
def omitted_connectors(spark, sf_dir):
    """How much of each contact's path is shown, and how many of its ways are left out."""
    return paths.told(paths.stretched(fixes(spark, sf_dir), "mmsi", ["frame_idx"], over_land(spark, sf_dir), MOST_KN), "mmsi")


@query(f"""{{DET}}, {FIXES}, p0 AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY mmsi) AS n FROM f WINDOW w AS (PARTITION BY mmsi ORDER BY frame_idx)),
p1 AS (SELECT *, coalesce(round(1852 * sqrt(((lat - la) * 60) ** 2 + ((lon - lo) * 60 * cos(radians(la))) ** 2) * 1e6)::BIGINT, 0) AS leg FROM p0),
p2 AS (SELECT *, sum(leg) OVER (PARTITION BY mmsi ORDER BY frame_idx)::DOUBLE AS way, sum(leg) OVER (PARTITION BY mmsi)::DOUBLE AS total FROM p1), k(ask) AS (SELECT unnest(generate_series(0, 12))),
g AS (SELECT p2.*, ask, greatest(0, least(1, (ask - 1) / 10.0::DOUBLE)) * total AS goal FROM p2, k WHERE n > 1 AND i > 0),
h AS (SELECT * FROM g WHERE goal <= way QUALIFY row_number() OVER (PARTITION BY mmsi, ask ORDER BY i) = 1),
s AS (SELECT *, (goal - (way - leg)) / greatest(leg, 1) AS part, lat - la AS north, (lon - lo) * cos(radians(la)) AS east FROM h)
SELECT mmsi, ask, i - 1 AS segment, round(la + (lat - la) * part, 6) AS lat, round(lo + (lon - lo) * part, 6) AS lon, round(CASE WHEN sqrt(north ** 2 + east ** 2) >= 1e-9 THEN degrees(atan2(east, north)) END, 4) AS bearing FROM s
UNION ALL SELECT mmsi, ask, 0, round(lat, 6), round(lon, 6), NULL FROM p2, k WHERE n = 1""")
def places_on_paths(spark, sf_dir):
    """Where each contact is at every tenth of its path, and where it heads there; shares before and after it are held at its ends."""
    f = fixes(spark, sf_dir)
    asked = f.select("mmsi").distinct().select("mmsi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(12).cast("long"))).alias("ask")).withColumn("share", (F.col("ask") - 1) / 10.0)
    p = paths.places(f, asked, "mmsi", ["frame_idx"])
    return p.select("mmsi", "ask", "segment", r("lat", 6).alias("lat"), r("lon", 6).alias("lon"), r("bearing").alias("bearing"))


@query(f"""{{DET}}, {FIXES}, n AS (SELECT event_id, mmsi, event_type, row_number() OVER (PARTITION BY mmsi ORDER BY frame_idx) - 1 AS i, count(*) OVER (PARTITION BY mmsi) AS n FROM f)
SELECT event_id, mmsi FROM n WHERE n <= 24 OR event_type = 'error' OR list_contains(list_transform(generate_series(0, 23), lambda k: round_even(k * (n - 1) / 23.0::DOUBLE, 0)::BIGINT), i)""")
def thinned_with_marks(spark, sf_dir):
    """At most 24 reports of each path, evenly spread, and every radar plot besides."""
    return paths.thinned(fixes(spark, sf_dir), "mmsi", ["frame_idx"], 24, F.col("event_type") == "error").select("event_id", "mmsi")


STATES = """{DET}, s0 AS (SELECT user_id // 12 AS mission, frame_idx, mmsi, x, y, sigma, source, event_id, event_type, coalesce(x - lag(x) OVER w, 0) / 30 AS vx, coalesce(y - lag(y) OVER w, 0) / 30 AS vy FROM det WINDOW w AS (PARTITION BY mmsi ORDER BY frame_idx)),
s1 AS (SELECT *, CASE event_type WHEN 'error' THEN 'coasting' WHEN 'view' THEN 'tentative' WHEN 'signup' THEN 'deleted' ELSE 'confirmed' END AS status, sigma * sigma + (mmsi % 3) * 40 AS p00, (mmsi % 5 - 2) * 5.0 AS p01, sigma * sigma + 30.0::DOUBLE AS p11 FROM s0), shown AS (SELECT * FROM s1 WHERE status <> 'deleted')"""


def states(spark, sf_dir):
    """Every report as a track's state, whose status and spread its kind tells."""
    d, k = det(spark, sf_dir), F.col("mmsi")
    w = W.partitionBy("mmsi").orderBy("frame_idx")
    moved = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) / 30
    status = F.when(F.col("event_type") == "error", "coasting").when(F.col("event_type") == "view", "tentative").when(F.col("event_type") == "signup", "deleted").otherwise("confirmed")
    s2 = F.col("sigma") * F.col("sigma")
    return movement.inside(d).select(
        F.floor(F.col("user_id") / 12).cast("long").alias("mission"), "frame_idx", k.alias("track_id"), "x", "y", moved("x").alias("vx"), moved("y").alias("vy"), (s2 + k % 3 * 40).alias("p00"), ((k % 5 - 2) * 5.0).alias("p01"), (s2 + 30).alias("p11"),
        status.alias("status"), F.col("zones_in").alias("zones"), F.col("source").alias("last_source"), "event_id", "event_type",
    )


AXES = """e AS (SELECT *, sqrt(4 * ((p00 + p11) / 2 + sqrt(((p00 - p11) / 2) ** 2 + p01 * p01))) AS major, sqrt(4 * greatest((p00 + p11) / 2 - sqrt(((p00 - p11) / 2) ** 2 + p01 * p01), 0)) AS minor, atan2(2 * p01, p00 - p11) / 2 AS turn FROM shown),
c AS (SELECT *, x + major * cos(2 * pi() * 5 / 24) * cos(turn) - minor * sin(2 * pi() * 5 / 24) * sin(turn) AS cx, y + major * cos(2 * pi() * 5 / 24) * sin(turn) + minor * sin(2 * pi() * 5 / 24) * cos(turn) AS cy FROM e)"""


@query(f"""{STATES}, {AXES} SELECT event_id, round(x, 1) AS x, round(36.75 + degrees(y / 6371000.0), 6) AS lat, round((degrees(atan2(vx, vy)) + 360) % 360, 1) AS heading_deg, round(sqrt(vx * vx + vy * vy), 2) AS speed_mps, status = 'coasting' AS dark,
 mmsi || printf(' · %.1f kn', round(sqrt(vx * vx + vy * vy) * 1.94384, 1)) AS label, 25::INT AS n_corners, round(cx, 1) AS corner_x, round(36.75 + degrees(cy / 6371000.0), 6) AS corner_lat, round(-121.95 + degrees(cx / (6371000.0 * cos(radians(36.75)))), 6) AS corner_lon FROM c""")
def shown_tracks(spark, sf_dir):
    """What clients are told of each track, with the sixth corner of its ellipse."""
    s = states(spark, sf_dir)
    t = payloads.tracks(s, 36.75, -121.95).join(s.select("event_id", "mission", "frame_idx", "track_id"), ["mission", "frame_idx", "track_id"])
    at = lambda ring, k: F.col(ring)[5][k]
    return t.select("event_id", "x", "lat", "heading_deg", "speed_mps", "dark", "label", F.size("ellipse").alias("n_corners"), at("ellipse", 0).alias("corner_x"), at("ellipse_latlon", 0).alias("corner_lat"), at("ellipse_latlon", 1).alias("corner_lon"))


@query(STATES + """, g AS (SELECT a.mission, a.frame_idx + 1 AS frame_idx, a.mmsi FROM shown a LEFT JOIN shown b ON b.mission = a.mission AND b.frame_idx = a.frame_idx + 1 AND b.mmsi = a.mmsi WHERE b.mmsi IS NULL),
i AS (SELECT mission, frame_idx, 'tracks' AS kind, mmsi::VARCHAR AS id, status = 'coasting' AS flag, false AS hit FROM shown UNION ALL SELECT mission, frame_idx, 'measurements', event_id::VARCHAR, event_type = 'signup', event_type = 'click' FROM s1
 UNION ALL SELECT mission, frame_idx, 'alerts', 'A-' || event_id, false, false FROM s1 WHERE event_type = 'purchase' UNION ALL SELECT mission, frame_idx, 'removed', mmsi::VARCHAR, false, false FROM g
 UNION ALL SELECT mission, 0, 'zones', z, false, false FROM (SELECT DISTINCT mission FROM s1), (VALUES ('sanctuary_a'), ('sanctuary_b'), ('harbour'), ('range')) v(z)),
n AS (SELECT mission, frame_idx, greatest(1, ceil(count(*) FILTER (WHERE NOT (kind = 'measurements' AND flag)) / 16.0))::BIGINT AS n_parts, count(*) FILTER (WHERE kind = 'tracks') AS n_tracks, count(*) FILTER (WHERE kind = 'tracks' AND flag) AS n_dark, count(*) FILTER (WHERE kind = 'measurements' AND NOT flag) AS n_meas,
 count(*) FILTER (WHERE kind = 'measurements' AND flag) AS n_suppressed, count(*) FILTER (WHERE kind = 'measurements' AND hit) AS n_matched FROM i GROUP BY ALL),
p AS (SELECT i.*, n.* EXCLUDE (mission, frame_idx), CASE WHEN kind = 'measurements' AND flag THEN 0 ELSE ('0x' || substr(md5(kind || '#' || id), 1, 8))::BIGINT % n_parts END AS part, kind = 'measurements' AND flag AS hides FROM i JOIN n USING (mission, frame_idx))
SELECT mission, frame_idx, part::BIGINT AS part, n_parts, printf('%d:%02d:%02d', frame_idx * 30 // 3600, frame_idx * 30 % 3600 // 60, frame_idx * 30 % 60) AS clock, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE kind = 'tracks'), '') AS tracks, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE kind = 'measurements' AND NOT hides), '') AS measurements,
 coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE kind = 'alerts'), '') AS alerts, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE kind = 'removed'), '') AS removed, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE kind = 'zones'), '') AS zones, n_tracks, n_dark, n_meas, n_suppressed, n_matched
FROM p GROUP BY mission, frame_idx, part, n_parts, n_tracks, n_dark, n_meas, n_suppressed, n_matched""")
def frame_messages(spark, sf_dir):
    """Every frame's messages of sixteen items or so: what each part holds, and the counts of the whole frame."""
    s = states(spark, sf_dir)
    kind = F.col("event_type")
    plots = s.select("mission", "frame_idx", F.col("event_id").alias("meas_id"), "x", "y", F.col("last_source").alias("source"), (kind == "signup").alias("suppressed"), (kind == "click").alias("matched"))
    alerts = s.where(kind == "purchase").select("mission", "frame_idx", F.concat(F.lit("A-"), F.col("event_id").cast("string")).alias("alert_id"), "track_id", F.lit("intrusion").alias("kind"))
    rings = F.array(*[F.struct(F.lit(z).alias("zone_id"), F.lit(k).alias("kind"), F.array(*[F.array(*map(F.lit, p)) for p in ring]).alias("ring")) for z, k, ring in movement.ZONES])
    zones = s.select("mission").distinct().select("mission", F.inline(rings))
    m = payloads.messages(payloads.tracks(s, 36.75, -121.95), plots, alerts, zones, 30.0, 16)
    ids = {"tracks": "track_id", "measurements": "meas_id", "alerts": "alert_id", "removed": "track_id", "zones": "zone_id"}
    listed = [F.array_join(F.transform(k, lambda v: v[n].cast("string")), ",", "?").alias(k) for k, n in ids.items()]  # noqa: B023
    return m.select("mission", "frame_idx", "part", "n_parts", "clock", *listed, "stats.*")
