"""Queries about single contacts' histories and about geometry, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import history, movement
from tidemark.plans.registry import IN_H, LATEST, NOW, SILENT, det, query, r
from tidemark.sources.tables import table

#: Positions in degrees of the reports, for SQL.
LLA = "{DET}, lla AS (SELECT *, 36.75 + degrees(y / 6371000.0) AS lat, -121.95 + degrees(x / (6371000.0 * cos(radians(36.75)))) AS lon FROM det)"
BEARING = "(degrees(atan2(sin(radians({b} - {a})) * cos(radians({q})), cos(radians({p})) * sin(radians({q})) - sin(radians({p})) * cos(radians({q})) * cos(radians({b} - {a})))) + 360) % 360"


def bearing_sql(p: str, a: str, q: str, b: str) -> str:
    return BEARING.format(p=p, a=a, q=q, b=b)


def lla(spark, sf_dir):
    lat, lon = geo.to_lla(F.col("x"), F.col("y"), 36.75, -121.95)
    return det(spark, sf_dir).withColumns({"lat": lat, "lon": lon})


@query("""{DET}, a AS (SELECT *, last_value(CASE WHEN source = 'ais' THEN t_abs END IGNORE NULLS) OVER p AS t0, last_value(CASE WHEN source = 'ais' THEN x END IGNORE NULLS) OVER p AS x0, last_value(CASE WHEN source = 'ais' THEN y END IGNORE NULLS) OVER p AS y0,
 first_value(CASE WHEN source = 'ais' THEN t_abs END IGNORE NULLS) OVER n AS t1, first_value(CASE WHEN source = 'ais' THEN x END IGNORE NULLS) OVER n AS x1, first_value(CASE WHEN source = 'ais' THEN y END IGNORE NULLS) OVER n AS y1
 FROM det WINDOW p AS (PARTITION BY mmsi ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY mmsi ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT 'r' || event_id AS meas_id, frame_idx, round(x0 + (t_abs - t0) / (t1 - t0) * (x1 - x0), 3) AS x, round(y0 + (t_abs - t0) / (t1 - t0) * (y1 - y0), 3) AS y FROM a WHERE source = 'radar' AND t1 > t0""")
def radar_injection(spark, sf_dir):
    """Radar plots at the true position, which lies between the reports before and after."""
    d = history.between_fixes(det(spark, sf_dir), F.col("source") == "ais").where("source = 'radar' AND tx IS NOT NULL")
    return d.select(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("meas_id"), "frame_idx", r("tx", 3).alias("x"), r("ty", 3).alias("y"))


@query("""{DET}, s AS (SELECT mmsi, t_abs, x, y, lead(t_abs) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM det WINDOW w AS (PARTITION BY mmsi ORDER BY t_abs, event_id)),
g AS (SELECT *, unnest(generate_series(ceil(t_abs / 86400)::BIGINT, ceil(nt / 86400)::BIGINT - 1)) AS g FROM s WHERE nt > t_abs)
SELECT mmsi, (g * 86400)::DOUBLE AS t, round(x + (g * 86400.0::DOUBLE - t_abs) / (nt - t_abs) * (nx - x), 3) AS x, round(y + (g * 86400.0::DOUBLE - t_abs) / (nt - t_abs) * (ny - y), 3) AS y FROM g""")
def true_position(spark, sf_dir):
    """Each contact's position at every midnight within its span."""
    p = movement.resample(det(spark, sf_dir), "mmsi", "t_abs", 86400.0, max_gap=1e15, least_points=1)
    return p.select("mmsi", F.col("t_grid").cast("double").alias("t"), r("x", 3).alias("x"), r("y", 3).alias("y"))


@query("""{DET}, c(name, x1, y1, x2, y2) AS (VALUES ('north', -10000.0::DOUBLE, 8000.0::DOUBLE, 12000.0::DOUBLE, 6000.0::DOUBLE), ('south', -8000, -3000, 12000, 500), ('east', 7000, -5000, 9000, 9000), ('west', -7000, -6000, -6000, 9000)),
s AS (SELECT event_id, name, x, y, x1, y1, x2, y2, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS u FROM det, c)
SELECT event_id, string_agg(name, ',' ORDER BY name) AS corridors FROM s WHERE sqrt((x - (x1 + u * (x2 - x1))) ** 2 + (y - (y1 + u * (y2 - y1))) ** 2) <= 500 GROUP BY 1""")
def corridor_containment(spark, sf_dir):
    """Reports within 500 m of a cable: a corridor is a distance, so it needs no buffered shape."""
    near = F.sort_array(F.array_compact(F.array(*[F.when(geo.segment_distance(F.col("x"), F.col("y"), *xy) <= 500, F.lit(name)) for name, *xy in movement.CABLES])))
    return det(spark, sf_dir).select("event_id", near.alias("c")).where(F.size("c") > 0).select("event_id", F.array_join("c", ",").alias("corridors"))


@query(f"""{LLA}, s AS (SELECT *, lag(t) OVER w AS t1, lag(lat) OVER w AS lat1, lag(lon) OVER w AS lon1, lag(t, 2) OVER w AS t2, lag(lat, 2) OVER w AS lat2, lag(lon, 2) OVER w AS lon2 FROM lla WINDOW w AS (PARTITION BY mmsi ORDER BY frame_idx)),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY frame_idx DESC) = 1),
c AS (SELECT *, {bearing_sql('lat1', 'lon1', 'lat', 'lon')} AS course, {bearing_sql('lat2', 'lon2', 'lat1', 'lon1')} AS prior FROM l WHERE t1 IS NOT NULL)
SELECT mmsi, round(course, 4) AS course, round(CASE WHEN t - t1 > 1 THEN sqrt(((lon - lon1) * 111320 * greatest(0.1, cos(radians((lat + lat1) / 2)))) ** 2 + ((lat - lat1) * 111320) ** 2) / (t - t1) / 0.514444 END, 4) AS speed_kn,
 round(CASE WHEN t - t2 > 0 THEN ((course - prior + 540) % 360 - 180) / ((t - t2) / 120) END, 4) AS turn FROM c""")
def course_speed(spark, sf_dir):
    return history.navigation(lla(spark, sf_dir)).select("mmsi", r("course").alias("course"), r("speed_kn").alias("speed_kn"), r("turn").alias("turn"))


@query("""{DET}, l AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS leg, t - lag(t) OVER w AS dt FROM det WINDOW w AS (PARTITION BY mmsi ORDER BY frame_idx)),
j AS (SELECT *, coalesce(dt > 0 AND leg / dt / 0.514444 >= 8, false) AS jump FROM l), p AS (SELECT *, sum(jump::INT) OVER (PARTITION BY mmsi ORDER BY frame_idx) AS part FROM j)
SELECT mmsi, part::BIGINT AS part, count(*) AS n, round((max(t) - min(t)) / 60, 4) AS duration_min, round(coalesce(sum(leg) FILTER (WHERE NOT jump), 0), 3) AS length_m FROM p GROUP BY 1, 2 HAVING count(*) > 1""")
def history_segments(spark, sf_dir):
    """Stretches of a history between jumps of 8 knots or more."""
    return history.unbroken(det(spark, sf_dir), 8.0).select("mmsi", "part", "n", r("duration_min").alias("duration_min"), r("length_m", 3).alias("length_m"))


@query("""{DET}, l AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS leg FROM det WINDOW w AS (PARTITION BY mmsi ORDER BY frame_idx)), s AS (SELECT *, sum(leg) OVER (PARTITION BY mmsi ORDER BY frame_idx) AS way, sum(leg) OVER (PARTITION BY mmsi) AS total FROM l)
SELECT event_id, round(way, 2) AS way, round(way / nullif(total, 0), 6) AS progress FROM s""")
def path_progress(spark, sf_dir):
    """How far along its path a contact is at each report."""
    w, every = W.partitionBy("mmsi").orderBy("frame_idx"), W.partitionBy("mmsi")
    leg = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    d = det(spark, sf_dir).withColumn("leg", leg).withColumn("way", F.sum("leg").over(w)).withColumn("total", F.sum("leg").over(every))
    return d.select("event_id", r("way", 2).alias("way"), F.round(F.try_divide("way", "total"), 6).alias("progress"))


@query("""{DET}, n AS (SELECT event_id, mmsi, row_number() OVER (PARTITION BY mmsi ORDER BY frame_idx) - 1 AS i, count(*) OVER (PARTITION BY mmsi) AS n FROM det)
SELECT event_id, mmsi FROM n WHERE n <= 24 OR list_contains(list_transform(generate_series(0, 23), lambda k: round_even(k * (n - 1) / 23.0::DOUBLE, 0)::BIGINT), i)""")
def path_downsample(spark, sf_dir):
    return history.thinned(det(spark, sf_dir), 24).select("event_id", "mmsi")


@query("{DET} SELECT event_id, count(*) OVER w AS n_trail, round(avg(x) OVER w, 4) AS mean_x, round(avg(y) OVER w, 4) AS mean_y FROM det WINDOW w AS (PARTITION BY mmsi ORDER BY frame_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def track_trail(spark, sf_dir):
    """The middle of the last 20 positions at each report."""
    w = W.partitionBy("mmsi").orderBy("frame_idx").rowsBetween(-19, 0)
    return det(spark, sf_dir).select("event_id", F.count(F.lit(1)).over(w).alias("n_trail"), F.round(F.avg("x").over(w), 4).alias("mean_x"), F.round(F.avg("y").over(w), 4).alias("mean_y"))


@query("""{DET}, h AS (SELECT mmsi, frame_idx, event_type <> 'view' AS hit, sum((event_type <> 'view')::INT) OVER (PARTITION BY mmsi ORDER BY frame_idx) AS hits FROM det)
SELECT mmsi, min(frame_idx) AS since, max(frame_idx) AS until, count(*) AS n FROM h WHERE NOT hit GROUP BY mmsi, hits""")
def miss_runs(spark, sf_dir):
    return history.miss_runs(det(spark, sf_dir).select("mmsi", "frame_idx", (F.col("event_type") != "view").alias("hit")))


@query(f"""{LLA}, d AS (SELECT event_id, lat, lon, (speed_kn * 7) % 360 AS b, speed_kn * 1.852 AS km FROM lla), e AS (SELECT *, asin(sin(radians(lat)) * cos(km / 6371.0088) + cos(radians(lat)) * sin(km / 6371.0088) * cos(radians(b))) AS p2 FROM d)
SELECT event_id, round(degrees(p2), 6) AS lat, round((lon + degrees(atan2(sin(radians(b)) * sin(km / 6371.0088) * cos(radians(lat)), cos(km / 6371.0088) - sin(radians(lat)) * sin(p2))) + 540) % 360 - 180, 6) AS lon,
 round({bearing_sql('lat', 'lon', '36.8', '-122.0')}, 5) AS to_port, round(({bearing_sql('lat', 'lon', '36.8', '-122.0')} - b + 540) % 360 - 180, 5) AS turn,
 round(sqrt((6378.137 / sqrt(1 - 0.0066943799901413165 * sin(radians((lat + 36.8) / 2)) ** 2) * cos(radians((lat + 36.8) / 2)) * radians(-122.0 - lon)) ** 2 + (6378.137 * (1 - 0.0066943799901413165) / (1 - 0.0066943799901413165 * sin(radians((lat + 36.8) / 2)) ** 2) ** 1.5 * radians(36.8 - lat)) ** 2), 5) AS port_km FROM e""")
def dead_reckoning(spark, sf_dir):
    """Where a contact is after an hour at its speed, the bearing to a port, the turn towards it and the distance on the ellipsoid."""
    b, km = F.col("speed_kn") * 7 % 360, F.col("speed_kn") * 1.852
    at = (F.col("lat"), F.col("lon"))
    port = (F.lit(36.8), F.lit(-122.0))
    lat, lon = geo.destination(*at, b, km)
    to = geo.bearing(*at, *port)
    return lla(spark, sf_dir).select("event_id", r(lat, 6).alias("lat"), r(lon, 6).alias("lon"), r(to, 5).alias("to_port"), r(geo.angle_delta(to, b), 5).alias("turn"), r(geo.local_radius_km(*at, *port), 5).alias("port_km"))


TILE_Y = "floor((1 - asinh(tan(radians({0}))) / pi()) / 2 * {1})::BIGINT"


@query(f"""{LLA}, l AS (SELECT mmsi, lat, lon, 25 / 111.32 AS dy, 25 / 111.32 / greatest(0.08, cos(radians(lat))) AS dx FROM lla QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY t_abs DESC, event_id DESC) = 1),
x AS (SELECT *, unnest(generate_series(floor((lon - dx + 180) / 360 * 1024)::BIGINT, floor((lon + dx + 180) / 360 * 1024)::BIGINT)) AS tx FROM l)
SELECT mmsi, tx AS tile_x, unnest(generate_series({TILE_Y.format('lat + dy', 1024)}, {TILE_Y.format('lat - dy', 1024)})) AS tile_y FROM x""")
def tile_cover(spark, sf_dir):
    """The tiles of zoom 10 within 25 km of each contact's last position."""
    last = movement.latest(det(spark, sf_dir), NOW, 0.0)
    lat, lon = geo.to_lla(F.col("x"), F.col("y"), 36.75, -121.95)
    d = last.select("mmsi", lat.alias("lat"), lon.alias("lon"))
    return d.select("mmsi", F.inline(geo.cover(F.col("lat"), F.col("lon"), 25.0, 10)).alias("tile_x", "tile_y"))


@query(f"""{LLA}, p AS (SELECT event_id, event_type, value, (lon + 180) / 360 AS u, (1 - asinh(tan(radians(lat))) / pi()) / 2 AS v FROM lla JOIN (SELECT event_id, value FROM events) USING (event_id)),
k AS (SELECT event_id, event_type, value, floor(u * 32768)::BIGINT AS x15, floor(v * 32768)::BIGINT AS y15, floor(u * 8192)::BIGINT AS x13, floor(v * 8192)::BIGINT AS y13, floor(u * 2048)::BIGINT AS x11, floor(v * 2048)::BIGINT AS y11 FROM p),
t AS (SELECT DISTINCT 15 AS z, x15 AS x, y15 AS y FROM k WHERE event_type = 'purchase' AND value > 90 UNION SELECT DISTINCT 13, x13, y13 FROM k WHERE event_type = 'signup' AND value > 90 UNION SELECT DISTINCT 11, x11, y11 FROM k WHERE event_type = 'click' AND value > 99)
SELECT event_id, CASE WHEN EXISTS (FROM t WHERE z = 15 AND x = x15 AND y = y15) THEN 15 WHEN EXISTS (FROM t WHERE z = 13 AND x = x13 AND y = y13) THEN 13 WHEN EXISTS (FROM t WHERE z = 11 AND x = x11 AND y = y11) THEN 11 END AS zoom FROM k""")
def tile_fallback(spark, sf_dir):
    """The finest zoom that has a tile under each report: one join over its keys of all zooms, then the best.

    Which tiles exist is made from some reports, as there is no table of them.
    """
    zooms = (15, 13, 11)
    d = lla(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    keys = d.select("event_id", "event_type", "value", *[F.struct(*[c.alias(n) for c, n in zip(geo.tile(F.col("lat"), F.col("lon"), z), "xy", strict=True)]).alias(f"k{z}") for z in zooms])
    some = {15: "event_type = 'purchase' AND value > 90", 13: "event_type = 'signup' AND value > 90", 11: "event_type = 'click' AND value > 99"}
    tiles = None
    for z in zooms:
        part = keys.where(some[z]).select(F.lit(z).alias("z"), F.col(f"k{z}").alias("k"))
        tiles = part if tiles is None else tiles.unionByName(part)
    long = keys.select("event_id", F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.col(f"k{z}").alias("k")) for z in zooms])).alias("c")).select("event_id", "c.z", "c.k")
    best = long.join(tiles.distinct(), ["z", "k"]).groupBy("event_id").agg(F.max("z").alias("zoom"))
    return keys.select("event_id").join(best, "event_id", "left")


@query("""{DET}, e AS (SELECT mmsi, count(*)::DOUBLE * 100 AS a, (mmsi % 7 * 20)::DOUBLE AS b, max(frame_idx)::DOUBLE * 90 + 500 AS c FROM det GROUP BY 1),
x AS (SELECT mmsi, sqrt(5.991 * ((a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b))) AS major, sqrt(5.991 * greatest((a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b), 0)) AS minor, radians(degrees(atan2(2 * b, a - c) / 2)) AS t, unnest(generate_series(0, 63)) AS k FROM e)
SELECT mmsi, k::INT AS k, round(major * cos(2 * pi() * k / 64) * cos(t) - minor * sin(2 * pi() * k / 64) * sin(t), 3) + 0.0::DOUBLE AS x, round(major * cos(2 * pi() * k / 64) * sin(t) + minor * sin(2 * pi() * k / 64) * cos(t), 3) + 0.0::DOUBLE AS y FROM x""")
def ellipse_points(spark, sf_dir):
    e = det(spark, sf_dir).groupBy("mmsi").agg((F.count(F.lit(1)) * 100.0).alias("a"), (F.max("frame_idx") * 90.0 + 500).alias("c")).withColumn("b", (F.col("mmsi") % 7 * 20).cast("double"))
    ring = geo.ring_of_ellipse(F.lit(0.0), F.lit(0.0), F.col("a"), F.col("b"), F.col("c"))
    return e.select("mmsi", F.inline(ring)).select("mmsi", "k", (r("x", 3) + 0.0).alias("x"), (r("y", 3) + 0.0).alias("y"))


@query("""{DET}, p AS (SELECT DISTINCT mmsi, x, y FROM det), e AS (SELECT a.mmsi, a.x, a.y, b.x AS bx, b.y AS byy FROM p a JOIN p b ON a.mmsi = b.mmsi AND (a.x <> b.x OR a.y <> b.y))
SELECT DISTINCT e.mmsi, e.x, e.y FROM e WHERE NOT EXISTS (FROM p c WHERE c.mmsi = e.mmsi AND ((e.bx - e.x) * (c.y - e.y) - (e.byy - e.y) * (c.x - e.x) < 0 OR (e.bx - e.x) * (c.y - e.y) - (e.byy - e.y) * (c.x - e.x) = 0 AND ((c.x - e.x) * (c.x - e.bx) + (c.y - e.y) * (c.y - e.byy) > 0)))
UNION SELECT mmsi, min(x), min(y) FROM p GROUP BY mmsi HAVING count(*) = 1""")
def convex_hull(spark, sf_dir):
    return history.hulls(det(spark, sf_dir))


@query(f"""{{DET}}, {LATEST}, a AS (SELECT event_id AS det_id, frame_idx, x, y FROM det WHERE source = 'radar'), b AS (SELECT frame_idx, x AS px, y AS py FROM last WHERE dark)
SELECT det_id, EXISTS (FROM b WHERE b.frame_idx = a.frame_idx AND sqrt((x - px) ** 2 + (y - py) ** 2) <= 600) AS reachable FROM a""")
def reachable_plots(spark, sf_dir):
    """Which radar plots some silent contact can have reached since its last frame, at 20 m/s."""
    d = det(spark, sf_dir)
    plots = d.where("source = 'radar'").select(F.col("event_id").alias("det_id"), "frame_idx", "x", "y")
    silent = movement.latest(d, NOW, SILENT).where("dark")
    return history.reachable(plots, silent.select("frame_idx", F.col("x").alias("px"), F.col("y").alias("py")), 600.0).select("det_id", "reachable")


@query("""{DET}, q AS (SELECT a.frame_idx, a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM det a JOIN det b ON a.frame_idx = b.frame_idx AND a.mmsi < b.mmsi)
SELECT frame_idx, mmsi_a, mmsi_b, round(d, 4) AS distance FROM q WHERE d <= 500 QUALIFY row_number() OVER (PARTITION BY frame_idx ORDER BY d, mmsi_a, mmsi_b) = 1""")
def closest_pair(spark, sf_dir):
    """The two contacts of each frame that are nearest to each other, within 500 m."""
    none = F.lit(None).cast("double")
    pairs = movement.close_pairs(det(spark, sf_dir).withColumns({"next_x": none, "next_y": none}))
    best = pairs.groupBy("frame_idx").agg(F.min(F.struct("distance", "mmsi_a", "mmsi_b")).alias("b"))
    return best.select("frame_idx", "b.mmsi_a", "b.mmsi_b", r("b.distance").alias("distance"))


@query(f"""{{DET}}, s AS (SELECT event_id, x AS x2, y AS y2, lag(x) OVER w AS x1, lag(y) OVER w AS y1 FROM det WINDOW w AS (PARTITION BY mmsi ORDER BY frame_idx)), n AS (SELECT *, greatest(1, ceil(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 25))::INT AS n FROM s WHERE x1 IS NOT NULL),
u AS (SELECT *, unnest(generate_series(1, n)) AS k FROM n), p AS (SELECT event_id, x1 + (x2 - x1) * k / n AS x, y1 + (y2 - y1) * k / n AS y FROM u) SELECT event_id, bool_or({IN_H}) AS crosses FROM p GROUP BY 1""")
def land_crossing(spark, sf_dir):
    """Whether the way from a contact's report before crosses the harbour, looked at every 25 m."""
    w = W.partitionBy("mmsi").orderBy("frame_idx")
    d = det(spark, sf_dir).select("event_id", "x", "y", F.lag("x").over(w).alias("x1"), F.lag("y").over(w).alias("y1")).where("x1 IS NOT NULL")
    ring = next(ring for name, _, ring in movement.ZONES if name == "harbour")
    return d.select("event_id", history.crosses(F.col("x1"), F.col("y1"), F.col("x"), F.col("y"), ring, 25.0).alias("crosses"))


@query("""WITH a AS (SELECT c_custkey AS actor, c_custkey % 2 = 0 AS straight, (c_custkey % 100)::DOUBLE * 50 AS x0, (c_nationkey * 70)::DOUBLE AS y0, 1 + (c_custkey % 8)::DOUBLE AS speed, (c_custkey * 7 % 360)::DOUBLE AS heading, (c_custkey % 5)::DOUBLE * 120 AS ts FROM customer),
f AS (SELECT *, unnest(generate_series(0, 20)) AS k FROM a), p AS (SELECT *, 30.0::DOUBLE * k AS t FROM f),
l AS (SELECT *, CASE WHEN straight THEN t ELSE least(t, ts) END AS run, CASE WHEN straight THEN 0 ELSE 2.0::DOUBLE / 150 * greatest(t - ts, 0) END AS g FROM p)
SELECT actor, k AS frame_idx, round(x0 + sin(radians(heading)) * speed * run + 150 * sin(g), 4) + 0.0::DOUBLE AS x, round(y0 + cos(radians(heading)) * speed * run - 150 * (1 - cos(g)), 4) + 0.0::DOUBLE AS y FROM l""")
def synthetic_tracks(spark, sf_dir):
    """A straight or a loitering track for every customer."""
    k = F.col("c_custkey")
    a = table(spark, sf_dir, "customer").select(
        k.alias("actor"), F.when(k % 2 == 0, "transit").otherwise("transit_then_loiter").alias("kind"), ((k % 100) * 50.0).alias("x0"), (F.col("c_nationkey") * 70.0).alias("y0"),
        (1.0 + k % 8).alias("speed"), (k * 7 % 360).cast("double").alias("heading"), ((k % 5) * 120.0).alias("transit_s"),
    )
    return history.synthetic_tracks(a, 21, 30.0).select("actor", "frame_idx", (r("x") + 0.0).alias("x"), (r("y") + 0.0).alias("y"))


@query(f"""{LLA} SELECT round_even(lat * 4, 0)::BIGINT AS lat_key, round_even(lon * 4, 0)::BIGINT AS lon_key, floor(t_abs / 86400)::BIGINT AS day, count(*) AS n FROM lla GROUP BY 1, 2, 3""")
def forcing_buckets(spark, sf_dir):
    """How many reports share a forecast of currents: quarter degrees and days."""
    key = lambda c: F.bround(F.col(c) * 4).cast("long").alias(f"{c}_key")
    return lla(spark, sf_dir).groupBy(key("lat"), key("lon"), F.floor(F.col("t_abs") / 86400).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{LLA}, v AS (SELECT n_nationkey AS k, 36.5 + (n_nationkey % 5) * 0.1 AS vlat, -122.2 + (n_nationkey // 5) * 0.1 AS vlon FROM nation)
SELECT event_id, k::INT AS vector, round(d, 7) AS d2 FROM (SELECT event_id, k, (lat - vlat) ** 2 + (lon - vlon) ** 2 AS d FROM lla, v) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, k) = 1""")
def nearest_vector(spark, sf_dir):
    """The nearest of the current vectors (one for each nation, 25 in all) to each report: the list is one broadcast row, so nothing is joined by pairs."""
    k = F.col("n_nationkey")
    vectors = table(spark, sf_dir, "nation").agg(F.collect_list(F.struct(k.alias("k"), (36.5 + (k % 5) * 0.1).alias("lat"), (-122.2 + F.floor(k / 5) * 0.1).alias("lon"))).alias("v"))
    square = lambda c: c * c
    d = lla(spark, sf_dir).select("event_id", "lat", "lon").join(F.broadcast(vectors))
    best = F.array_min(F.transform("v", lambda v: F.struct((square(F.col("lat") - v["lat"]) + square(F.col("lon") - v["lon"])).alias("d"), v["k"].alias("k"))))
    return d.select("event_id", best.alias("b")).select("event_id", F.col("b.k").alias("vector"), r("b.d", 7).alias("d2"))


@query(f"{{DET}}, n AS (SELECT event_type, arg_min(frame_idx, (abs(t - 900), frame_idx)) AS f FROM det GROUP BY 1) SELECT d.event_id, d.event_type, d.frame_idx FROM det d JOIN n ON d.event_type = n.event_type AND d.frame_idx = n.f")
def nearest_time(spark, sf_dir):
    """All rows of the frame nearest to a moment, by kind: the frame by aggregation, its rows by a join on that small list."""
    d = det(spark, sf_dir)
    best = d.groupBy("event_type").agg(F.min_by("frame_idx", F.struct(F.abs(F.col("t") - 900), "frame_idx")).alias("frame_idx"))
    return d.join(best, ["event_type", "frame_idx"]).select("event_id", "event_type", "frame_idx")


@query(f"""{LLA}, l AS (SELECT mmsi, lat, lon FROM lla QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY t_abs DESC, event_id DESC) = 1), v AS (SELECT n_name AS port, 36.5 + (n_nationkey % 5) * 0.1 AS vlat, -122.2 + (n_nationkey // 5) * 0.1 AS vlon FROM nation),
d AS (SELECT mmsi, port, 2 * 6371.0088 * asin(sqrt(sin(radians(vlat - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(vlat)) * sin(radians(vlon - lon) / 2) ** 2)) AS km FROM l, v)
SELECT mmsi, port, round(km, 4) AS km FROM d WHERE km <= 40 QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY km, port) <= 12""")
def ports_near_contacts(spark, sf_dir):
    """Up to twelve ports within 40 km of each contact's last position, nearest first; ports are 25 rows, sent as one."""
    k = F.col("n_nationkey")
    ports = table(spark, sf_dir, "nation").agg(F.collect_list(F.struct(F.col("n_name").alias("port"), (36.5 + (k % 5) * 0.1).alias("lat"), (-122.2 + F.floor(k / 5) * 0.1).alias("lon"))).alias("v"))
    lat, lon = geo.to_lla(F.col("x"), F.col("y"), 36.75, -121.95)
    d = movement.latest(det(spark, sf_dir), NOW, 0.0).select("mmsi", lat.alias("lat"), lon.alias("lon")).join(F.broadcast(ports))
    far = F.transform("v", lambda p: F.struct(geo.haversine_km(F.col("lat"), F.col("lon"), p["lat"], p["lon"]).alias("km"), p["port"].alias("port")))
    d = d.select("mmsi", F.explode(F.slice(F.sort_array(F.filter(far, lambda p: p["km"] <= 40)), 1, 12)).alias("p"))
    return d.select("mmsi", "p.port", r("p.km").alias("km"))
