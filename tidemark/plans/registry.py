"""All registered queries over the given tables and the DuckDB SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import decisions, forecast, movement, replay, tracking
from tidemark.sources.tables import detections, table
from tidemark.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The moment "now" of queries about silence, and their thresholds in seconds.
NOW, SILENT = 1706745600.0, 43200.0

DET = """WITH ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
det AS (SELECT event_id, 200000000 + user_id AS mmsi, k AS frame_idx, 30.0::DOUBLE * k AS t, epoch_us(ts) / 1e6 AS t_abs,
  (1000 * (user_id % 12) + (user_id % 7 - 3) * (30.0::DOUBLE * k) + ((event_id * 7919) % 101 - 50))::DOUBLE AS x,
  (800 * (user_id % 9) + (user_id % 5 - 2) * (30.0::DOUBLE * k) + ((event_id * 104729) % 101 - 50))::DOUBLE AS y,
  CASE WHEN event_type = 'error' THEN 'radar' ELSE 'ais' END AS source, CASE WHEN event_type = 'error' THEN 50.0::DOUBLE ELSE 5.0::DOUBLE END AS sigma,
  value % 50 AS speed_kn, event_type, user_id FROM ev)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("{DET}", DET)
        return f

    return register


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(table(spark, sf_dir, "events"))


def r(c, digits: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


IN_A = "(x > 0 AND x < 5000 AND y > 0 AND y < 5000)"
IN_B = "(x > 4000 AND x < 9000 AND y > 3000 AND y < 7000)"
#: Triangles: strictly on the same side of all edges.
IN_H = "((0 - -4000) * (y - -2000) - (-2000 - -2000) * (x - -4000) > 0 AND (-2000 - 0) * (y - -2000) - (2000 - -2000) * (x - 0) > 0 AND (-4000 - -2000) * (y - 2000) - (-2000 - 2000) * (x - -2000) > 0)"
IN_R = "((-3000 - -9000) * (y - 3000) - 0 * (x - -9000) > 0 AND (-6000 - -3000) * (y - 3000) - (8000 - 3000) * (x - -3000) > 0 AND (-9000 - -6000) * (y - 8000) - (3000 - 8000) * (x - -6000) > 0)"
ZONED = f"""zoned AS (SELECT *, list_filter([CASE WHEN {IN_H} THEN 'harbour' END, CASE WHEN {IN_R} THEN 'range' END, CASE WHEN {IN_A} THEN 'sanctuary_a' END, CASE WHEN {IN_B} THEN 'sanctuary_b' END], lambda z: z IS NOT NULL) AS zones FROM det)"""
LATEST = f"""last AS (SELECT *, {NOW} - t_abs AS age_s, {NOW} - t_abs >= {SILENT} AS dark FROM det QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY t_abs DESC, event_id DESC) = 1)"""


@query(f"""{{DET}}, {LATEST}, z AS (SELECT *, {IN_A} OR {IN_B} AS mpa, {IN_R} AS danger FROM last)
SELECT mmsi, round(x, 4) AS x, round(y, 4) AS y, dark, array_to_string(list_filter([CASE WHEN dark THEN 'ais_silent' END, CASE WHEN mpa THEN 'protected_area' END, CASE WHEN danger THEN 'danger_area' END], lambda s: s IS NOT NULL), ',') AS signals,
CASE WHEN dark AND mpa THEN 'critical' ELSE 'warning' END AS severity,
CASE WHEN dark OR mpa OR danger THEN 192 ELSE 0 END::BIGINT AS low_usd,
CASE WHEN dark AND mpa THEN 90078 WHEN dark THEN 27963 WHEN mpa OR danger THEN 589 ELSE 0 END::BIGINT AS high_usd FROM z""")
def flagship(spark, sf_dir):
    """Each contact's last position, whether it is silent, its risk and the range of what a response costs."""
    last = movement.inside(movement.latest(det(spark, sf_dir), NOW, SILENT))
    kinds = {z: k for z, k, _ in movement.ZONES}
    of = F.transform("zones_in", lambda z: F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), z))
    signals, severity = decisions.risk(F.col("dark"), F.col("kinds"), F.lit(False))
    last = last.withColumn("kinds", of).withColumn("signals", signals).withColumn("severity", severity)
    low, high = decisions.response(F.col("signals"), F.col("dark"), F.col("dark") & F.array_contains("kinds", "mpa"))
    return last.select("mmsi", r("x").alias("x"), r("y").alias("y"), "dark", F.array_join("signals", ",").alias("signals"), "severity", low.alias("low_usd"), high.alias("high_usd"))


@query("{DET} SELECT event_id, mmsi, frame_idx FROM det WHERE x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 5000 AND t_abs BETWEEN 1704672000 AND 1705708800")
def bbox_time_filter(spark, sf_dir):
    d = det(spark, sf_dir)
    return d.where(F.col("x").between(0, 5000) & F.col("y").between(0, 5000) & F.col("t_abs").between(1704672000, 1705708800)).select("event_id", "mmsi", "frame_idx")


@query("{DET} SELECT frame_idx, count(*) AS n_meas, count(DISTINCT mmsi) AS n_tracks, count(*) FILTER (WHERE source = 'radar') AS n_radar FROM det GROUP BY 1")
def frame_stats(spark, sf_dir):
    return det(spark, sf_dir).groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n_meas"), F.count_distinct("mmsi").alias("n_tracks"), F.count_if(F.col("source") == "radar").alias("n_radar"))


@query("""{DET}, s AS (SELECT mmsi, t_abs, x, y, lead(t_abs) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM det WINDOW w AS (PARTITION BY mmsi ORDER BY t_abs, event_id)),
g AS (SELECT *, unnest(generate_series(ceil(t_abs / 600)::BIGINT, ceil(nt / 600)::BIGINT - 1)) AS g FROM s WHERE nt > t_abs AND nt - t_abs <= 36000),
p AS (SELECT mmsi, g * 600.0 AS t_grid, x + (g * 600.0 - t_abs) / (nt - t_abs) * (nx - x) AS x, y + (g * 600.0 - t_abs) / (nt - t_abs) * (ny - y) AS y, count(*) OVER (PARTITION BY mmsi) AS n FROM g)
SELECT mmsi, t_grid::DOUBLE AS t_grid, round(x, 4) AS x, round(y, 4) AS y FROM p WHERE n >= 4""")
def resample_asof(spark, sf_dir):
    p = movement.resample(det(spark, sf_dir), "mmsi", "t_abs", 600.0, max_gap=36000.0)
    return p.select("mmsi", F.col("t_grid").cast("double").alias("t_grid"), r("x").alias("x"), r("y").alias("y"))


@query("""{DET} SELECT event_id, mmsi, coalesce(last_value(CASE WHEN event_type = 'click' THEN 'id-' || event_id END IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 'mmsi:' || mmsi) AS display_id FROM det""")
def display_identity(spark, sf_dir):
    d = det(spark, sf_dir)
    changed = F.when(F.col("event_type") == "click", F.concat(F.lit("id-"), F.col("event_id").cast("string")))
    return d.select("event_id", "mmsi", movement.as_of(d, "mmsi", ["frame_idx"], changed, F.concat(F.lit("mmsi:"), F.col("mmsi").cast("string"))).alias("display_id"))


@query("""{DET}, s AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN 'off' WHEN event_type = 'purchase' THEN 'on' END IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS st FROM det)
SELECT event_id, mmsi, frame_idx FROM s WHERE coalesce(st, 'on') = 'on'""")
def ais_suppression(spark, sf_dir):
    d = det(spark, sf_dir)
    state = F.when(F.col("event_type") == "signup", "off").when(F.col("event_type") == "purchase", "on")
    return d.withColumn("st", movement.as_of(d, "mmsi", ["frame_idx"], state, F.lit("on"))).where("st = 'on'").select("event_id", "mmsi", "frame_idx")


@query("""{DET}, p AS (SELECT mmsi, frame_idx, x, y, CASE WHEN lead(frame_idx) OVER w = frame_idx + 1 THEN lead(x) OVER w END AS nx, CASE WHEN lead(frame_idx) OVER w = frame_idx + 1 THEN lead(y) OVER w END AS ny FROM det WINDOW w AS (PARTITION BY mmsi ORDER BY frame_idx)),
q AS (SELECT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, a.frame_idx, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, coalesce((sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - sqrt((a.nx - b.nx) ** 2 + (a.ny - b.ny) ** 2)) / 30.0, 0) AS c FROM p a JOIN p b ON a.frame_idx = b.frame_idx AND a.mmsi < b.mmsi),
f AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY mmsi_a, mmsi_b ORDER BY frame_idx) <= 1.5 THEN 0 ELSE 1 END AS new FROM q WHERE d <= 500 AND c > 0.5),
i AS (SELECT *, sum(new) OVER (PARTITION BY mmsi_a, mmsi_b ORDER BY frame_idx) AS spell FROM f)
SELECT mmsi_a, mmsi_b, min(frame_idx) * 30.0::DOUBLE AS t_start, max(frame_idx) * 30.0::DOUBLE AS t_end, round(min(d), 4) AS min_distance, round(max(c), 4) AS max_closing FROM i GROUP BY mmsi_a, mmsi_b, spell""")
def crossings(spark, sf_dir):
    c = movement.crossings(det(spark, sf_dir))
    return c.select("mmsi_a", "mmsi_b", "t_start", "t_end", r("min_distance").alias("min_distance"), r("max_closing").alias("max_closing"))


@query(f"{{DET}}, {ZONED} SELECT event_id, array_to_string(zones, ',') AS zones FROM zoned WHERE len(zones) > 0")
def zone_containment(spark, sf_dir):
    return movement.inside(det(spark, sf_dir)).where(F.size("zones_in") > 0).select("event_id", F.array_join("zones_in", ",").alias("zones"))


@query(f"""{{DET}}, {ZONED}, b AS (SELECT mmsi, frame_idx, zones, coalesce(lag(zones) OVER (PARTITION BY mmsi ORDER BY frame_idx), []) AS before FROM zoned)
SELECT mmsi, frame_idx, 'enter' AS kind, unnest(list_filter(zones, lambda z: NOT list_contains(before, z))) AS zone_id FROM b UNION ALL SELECT mmsi, frame_idx, 'exit', unnest(list_filter(before, lambda z: NOT list_contains(zones, z))) FROM b""")
def zone_transitions(spark, sf_dir):
    return movement.transitions(det(spark, sf_dir))


@query(f"""{{DET}}, {ZONED}, u AS (SELECT mmsi, frame_idx, unnest(zones) AS zone_id FROM zoned), i AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY mmsi, zone_id ORDER BY frame_idx) AS island FROM u)
SELECT mmsi, zone_id, min(frame_idx) AS since, max(frame_idx) AS until, count(*) AS n FROM i GROUP BY mmsi, zone_id, island""")
def zone_intervals(spark, sf_dir):
    return movement.stays(det(spark, sf_dir))


@query("""{DET}, c(name, x1, y1, x2, y2) AS (VALUES ('north', -10000.0::DOUBLE, 8000.0::DOUBLE, 12000.0::DOUBLE, 6000.0::DOUBLE), ('south', -8000, -3000, 12000, 500), ('east', 7000, -5000, 9000, 9000), ('west', -7000, -6000, -6000, 9000)),
s AS (SELECT event_id, name, x, y, x1, y1, x2, y2, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS u FROM det, c),
d AS (SELECT event_id, name, sqrt((x - (x1 + u * (x2 - x1))) ** 2 + (y - (y1 + u * (y2 - y1))) ** 2) AS d FROM s)
SELECT event_id, name, round(d, 3) AS distance FROM d WHERE d <= 2500 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, name) <= 3""")
def nearby_cables(spark, sf_dir):
    """Up to three cables within 2.5 km, nearest first; cables are a fixed list, so nothing is joined."""
    far = F.array(*[F.struct(geo.segment_distance(F.col("x"), F.col("y"), *xy).alias("distance"), F.lit(name).alias("name")) for name, *xy in movement.CABLES])
    d = det(spark, sf_dir).select("event_id", F.explode(F.slice(F.sort_array(F.filter(far, lambda c: c["distance"] <= 2500)), 1, 3)).alias("c"))
    return d.select("event_id", "c.name", r("c.distance", 3).alias("distance"))


@query(f"""{{DET}}, g AS (SELECT mmsi, t_abs, lead(t_abs) OVER (PARTITION BY mmsi ORDER BY t_abs, event_id) AS n FROM det)
SELECT mmsi, round(t_abs + {SILENT}, 3) AS dark_at, round(n, 3) AS resumed_at, round(n - t_abs, 3) AS silent_s FROM g WHERE n - t_abs > {SILENT}""")
def dark_edges(spark, sf_dir):
    s = movement.silences(det(spark, sf_dir), SILENT)
    return s.select("mmsi", *[r(c, 3).alias(c) for c in ("dark_at", "resumed_at", "silent_s")])


@query("""{DET}, g AS (SELECT mmsi, t_abs, CASE WHEN t_abs - lag(t_abs) OVER (PARTITION BY mmsi ORDER BY t_abs) < 21600 THEN 0 ELSE 1 END AS new FROM det), i AS (SELECT *, sum(new) OVER (PARTITION BY mmsi ORDER BY t_abs ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT mmsi, round(min(t_abs), 3) AS started, round(max(t_abs) + 21600, 3) AS ended, count(*) AS n FROM i GROUP BY mmsi, s""")
def silence_sessions(spark, sf_dir):
    d = table(spark, sf_dir, "events").select((200000000 + F.col("user_id")).alias("mmsi"), F.col("ts").cast("timestamp").alias("ts"))
    s = live.spells(d)
    return s.select("mmsi", *[r(F.unix_micros(c) / 1e6, 3).alias(c) for c in ("started", "ended")], "n")


@query(f"{{DET}}, {LATEST} SELECT mmsi, frame_idx, round(x, 4) AS x, round(y, 4) AS y, round(age_s, 3) AS age_s, dark FROM last")
def latest_state_merge(spark, sf_dir):
    return movement.latest(det(spark, sf_dir), NOW, SILENT).select("mmsi", "frame_idx", r("x").alias("x"), r("y").alias("y"), r("age_s", 3).alias("age_s"), "dark")


@query("""{DET}, n AS (SELECT mmsi, frame_idx, event_type, lag(event_type) OVER (PARTITION BY mmsi ORDER BY frame_idx) AS before FROM det WHERE event_type <> 'view')
SELECT mmsi, count(*) FILTER (WHERE before IS NOT NULL AND before <> event_type) AS n_switches FROM n GROUP BY 1""")
def identity_switches_live(spark, sf_dir):
    """Changes of a contact's name; a view carries none."""
    d = det(spark, sf_dir).where("event_type <> 'view'")
    before = F.lag("event_type").over(W.partitionBy("mmsi").orderBy("frame_idx"))
    return d.withColumn("before", before).groupBy("mmsi").agg(F.count_if(F.col("before").isNotNull() & (F.col("before") != F.col("event_type"))).alias("n_switches"))


@query("""{DET}, c AS (SELECT mmsi, frame_idx, floor(x / 100) AS cx, floor(y / 100) AS cy FROM det), k AS (SELECT *, lag(cx) OVER w AS bx, lag(cy) OVER w AS b2 FROM c WINDOW w AS (PARTITION BY mmsi ORDER BY frame_idx))
SELECT mmsi, frame_idx, cx::BIGINT AS cx, cy::BIGINT AS cy FROM k WHERE bx IS NULL OR bx <> cx OR b2 <> cy QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY frame_idx DESC) <= 20""")
def history_ring(spark, sf_dir):
    """The last 20 positions that differ from the one before, on a grid of 100 m."""
    w = W.partitionBy("mmsi").orderBy("frame_idx")
    d = det(spark, sf_dir).select("mmsi", "frame_idx", F.floor(F.col("x") / 100).alias("cx"), F.floor(F.col("y") / 100).alias("cy"))
    d = d.withColumn("b", F.lag(F.struct("cx", "cy")).over(w)).where(F.col("b").isNull() | (F.col("b") != F.struct("cx", "cy")))
    return d.withColumn("rn", F.row_number().over(W.partitionBy("mmsi").orderBy(F.desc("frame_idx")))).where("rn <= 20").select("mmsi", "frame_idx", "cx", "cy")


@query("SELECT 200000000 + user_id AS mmsi, max(event_id) AS revision, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events) GROUP BY 1")
def snapshot_delta(spark, sf_dir):
    """The contacts that changed since a revision, each with its last change."""
    e = table(spark, sf_dir, "events")
    since = e.agg(F.floor(F.max("event_id") / 2).alias("since"))
    d = e.join(F.broadcast(since), F.col("event_id") > F.col("since"))  # one row
    return d.groupBy((200000000 + F.col("user_id")).alias("mmsi")).agg(F.max("event_id").alias("revision"), F.max_by("event_type", "event_id").alias("event_type"))


@query("{DET}, m AS (SELECT event_id, mmsi, t_abs, max(t_abs) OVER (PARTITION BY mmsi ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM det) SELECT event_id, mmsi FROM m WHERE top IS NULL OR t_abs > top")
def source_time_dedup(spark, sf_dir):
    """Reports in order of arrival, without those that aren't newer than all before."""
    top = F.max("t_abs").over(W.partitionBy("mmsi").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1))
    return det(spark, sf_dir).withColumn("top", top).where("top IS NULL OR t_abs > top").select("event_id", "mmsi")


@query("{DET}, l AS (SELECT mmsi, max(t_abs) AS last_seen FROM det GROUP BY 1) SELECT mmsi, round(last_seen, 3) AS last_seen FROM l ORDER BY l.last_seen DESC, mmsi LIMIT 100")
def capacity_topk(spark, sf_dir):
    """The contacts that a table of 100 keeps."""
    d = det(spark, sf_dir).groupBy("mmsi").agg(F.max("t_abs").alias("last_seen"))
    return d.orderBy(F.desc("last_seen"), "mmsi").limit(100).select("mmsi", r("last_seen", 3).alias("last_seen"))


@query("{DET}, c AS (SELECT frame_idx, count(*) AS n FROM det GROUP BY 1) SELECT frame_idx, n, sum(n) OVER (ORDER BY frame_idx)::BIGINT AS log_end FROM c")
def prefix_history(spark, sf_dir):
    """Running totals of reports by frame: one row a frame, so the window over all of them is small."""
    c = det(spark, sf_dir).groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("log_end", F.sum("n").over(W.orderBy("frame_idx").rowsBetween(W.unboundedPreceding, 0)))


@query("""{DET}, m AS (SELECT mmsi AS truth_id, frame_idx AS frame, event_id AS ord, CASE WHEN event_id % 17 = 0 THEN mmsi + 1 ELSE mmsi END AS track_id FROM det WHERE event_type <> 'view'), l AS (SELECT *, lag(track_id) OVER (PARTITION BY truth_id ORDER BY frame, ord) AS b FROM m)
SELECT truth_id, count(*) AS n_matches, count(*) FILTER (WHERE b IS NOT NULL AND b <> track_id) AS n_switches, count(DISTINCT track_id) AS n_tracks FROM l GROUP BY 1""")
def clear_mot(spark, sf_dir):
    m = det(spark, sf_dir).where("event_type <> 'view'").select(F.col("mmsi").alias("truth_id"), F.col("frame_idx").alias("frame"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 17 == 0, F.col("mmsi") + 1).otherwise(F.col("mmsi")).alias("track_id"))
    return tracking.switches(m)


def tracks_and_plots(spark, sf_dir):
    """Tracks are the even contacts' positions, plots those of the odd ones."""
    d = det(spark, sf_dir)
    even = d.where("mmsi % 2 = 0").select("frame_idx", F.col("mmsi").alias("track_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.lit(40000.0).alias("p00"), F.lit(5000.0).alias("p01"), F.lit(90000.0).alias("p11"))
    return even, d.where("mmsi % 2 = 1").select("frame_idx", F.col("event_id").alias("meas_id"), "x", "y", "sigma")


PAIRS = """{DET}, q AS (SELECT a.frame_idx, a.mmsi AS track_id, b.event_id AS meas_id, b.x - a.x AS dx, b.y - a.y AS dy, 40000 + b.sigma * b.sigma AS p, 5000::DOUBLE AS q, 90000 + b.sigma * b.sigma AS s FROM det a JOIN det b ON a.frame_idx = b.frame_idx AND a.mmsi % 2 = 0 AND b.mmsi % 2 = 1),
d AS (SELECT *, (s * dx * dx - 2 * q * dx * dy + p * dy * dy) / (p * s - q * q) AS d2 FROM q),
c AS (SELECT *, 0.5 * d2 + ln(2 * pi()) + 0.5 * ln(p * s - q * q) - ln(0.9) AS cost FROM d WHERE d2 <= 9.21034)"""


@query(PAIRS + " SELECT frame_idx, track_id, meas_id, round(d2, 5) AS d2, round(cost, 5) AS cost FROM c")
def gate_cost_matrix(spark, sf_dir):
    return tracking.pair_costs(*tracks_and_plots(spark, sf_dir)).select("frame_idx", "track_id", "meas_id", r("d2", 5).alias("d2"), r("cost", 5).alias("cost"))


@query()
def global_assign(spark, sf_dir):
    return tracking.assign(tracking.pair_costs(*tracks_and_plots(spark, sf_dir)))


@query()
def greedy_assign(spark, sf_dir):
    return tracking.assign_greedily(tracking.pair_costs(*tracks_and_plots(spark, sf_dir)))


@query()
def ambiguity_margin(spark, sf_dir):
    tracks, plots = tracks_and_plots(spark, sf_dir)
    return tracking.margins(tracking.pair_costs(tracks, plots), tracks, plots)


@query()
def assignment_costs(spark, sf_dir):
    """What each frame's optimal assignment costs beside a greedy one."""
    tracks, plots = tracks_and_plots(spark, sf_dir)
    pairs = tracking.pair_costs(tracks, plots)
    best, greedy = (tracking.total_costs(f(pairs), tracks, plots) for f in (tracking.assign, tracking.assign_greedily))
    return best.join(greedy.select("frame_idx", F.col("cost").alias("greedy_cost")), "frame_idx").select("frame_idx", r("cost").alias("cost"), r("greedy_cost").alias("greedy_cost"), "n_assigned", "n_tracks", "n_plots")


@query("""WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
z AS (SELECT 200000000 + user_id AS mmsi, k, 30.0::DOUBLE * k AS t, (1000 * (user_id % 12) + (user_id % 7 - 3) * (30.0::DOUBLE * k) + ((event_id * 7919) % 101 - 50))::DOUBLE AS x,
  (800 * (user_id % 9) + (user_id % 5 - 2) * (30.0::DOUBLE * k) + ((event_id * 104729) % 101 - 50))::DOUBLE AS y, CASE WHEN event_type = 'error' THEN 2500.0::DOUBLE ELSE 25.0::DOUBLE END AS r FROM ev),
f AS (SELECT b.mmsi, b.k, b.x, (b.x - a.x) / 30 AS vx, b.y, (b.y - a.y) / 30 AS vy, b.r AS p00, b.r / 30 AS p01, 2 * b.r / 900 AS p11 FROM z a JOIN z b ON a.mmsi = b.mmsi AND a.k = 0 AND b.k = 1
UNION ALL SELECT mmsi, k, px + k0 * (zx - px), vx + k1 * (zx - px), py + k0 * (zy - py), vy + k1 * (zy - py), (1 - k0) * (1 - k0) * p00 + k0 * k0 * r, (1 - k0) * (p01 - k1 * p00) + k0 * k1 * r, p11 - 2 * k1 * p01 + k1 * k1 * (p00 + r)
 FROM (SELECT *, p00 / (p00 + r) AS k0, p01 / (p00 + r) AS k1 FROM (SELECT z.mmsi, z.k, z.x AS zx, z.y AS zy, z.r, f.x + 30 * f.vx AS px, f.y + 30 * f.vy AS py, f.vx, f.vy, f.p00 + 60 * f.p01 + 900 * f.p11 + 0.5 * 810000 / 4 AS p00, f.p01 + 30 * f.p11 + 0.5 * 27000 / 2 AS p01, f.p11 + 0.5 * 900 AS p11 FROM f JOIN z ON f.mmsi = z.mmsi AND z.k = f.k + 1)))
SELECT mmsi, (k + 1)::BIGINT AS n, round(x, 3) AS x, round(vx, 4) AS vx, round(y, 3) AS y, round(vy, 4) AS vy, round(p00, 3) AS p00 FROM f QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY k DESC) = 1""")
def kalman_fold(spark, sf_dir):
    f = tracking.filtered(det(spark, sf_dir))
    return f.select("mmsi", "n", r("x", 3).alias("x"), r("vx").alias("vx"), r("y", 3).alias("y"), r("vy").alias("vy"), r("p00", 3).alias("p00"))


@query("{DET}, h AS (SELECT mmsi, frame_idx, sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hits FROM det) SELECT mmsi, min(frame_idx) AS confirmed_at FROM h WHERE hits >= 3 GROUP BY 1")
def confirm_m_of_n(spark, sf_dir):
    hits = F.sum(F.when(F.col("event_type") != "view", 1).otherwise(0)).over(W.partitionBy("mmsi").orderBy("frame_idx").rowsBetween(-4, 0))
    return det(spark, sf_dir).withColumn("hits", hits).where("hits >= 3").groupBy("mmsi").agg(F.min("frame_idx").alias("confirmed_at"))


@query("""{DET}, h AS (SELECT mmsi AS track_id, frame_idx, event_type <> 'view' AS hit, (event_id % 9)::DOUBLE AS d2 FROM det),
g AS (SELECT *, sum(CASE WHEN hit THEN ln(0.9 / 1e-6::DOUBLE) - ln(2 * pi()) - 0.5 * d2 - 4 ELSE ln(0.1::DOUBLE) END) OVER w AS llr, row_number() OVER w AS n, max(CASE WHEN hit THEN frame_idx END) OVER w AS last_hit, list(hit) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS five FROM h WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, frame_idx - coalesce(last_hit, -1) AS misses, hit AND len(list_filter(five, lambda x: x)) >= 3 AS enough FROM g),
d AS (SELECT *, min(CASE WHEN misses >= 10 OR llr < -20 THEN frame_idx END) OVER (PARTITION BY track_id) AS died, min(CASE WHEN enough THEN frame_idx END) OVER (PARTITION BY track_id) AS sure FROM m)
SELECT a.track_id, a.frame_idx, CASE WHEN a.frame_idx >= a.died THEN 'dead' WHEN a.sure IS NULL OR a.sure > a.frame_idx THEN 'tentative' WHEN a.misses >= 2 THEN 'coasting' ELSE 'confirmed' END AS status,
  coalesce(b.misses, a.misses)::INT AS misses, round(coalesce(b.llr, a.llr), 4) AS llr FROM d a LEFT JOIN d b ON a.track_id = b.track_id AND b.frame_idx = a.died AND a.frame_idx >= a.died""")
def track_lifecycle(spark, sf_dir):
    d = det(spark, sf_dir).select(F.col("mmsi").alias("track_id"), "frame_idx", (F.col("event_type") != "view").alias("hit"), (F.col("event_id") % 9).cast("double").alias("d2"), F.lit(8.0).alias("logdet"))
    return tracking.lifecycles(d).withColumn("llr", r("llr"))


@query(f"""{{DET}}, {LATEST}, q AS (SELECT b.event_id AS det_id, a.mmsi AS track_id, b.x - a.x AS dx, b.y - a.y AS dy, 300 * 300 + b.sigma * b.sigma AS s FROM last a JOIN det b ON a.frame_idx = b.frame_idx AND a.dark AND b.source = 'radar' AND a.mmsi <> b.mmsi),
d AS (SELECT *, (dx * dx + dy * dy) / s AS d2 FROM q WHERE (dx * dx + dy * dy) / s <= 4 * 9.21034), l AS (SELECT *, CASE WHEN d2 <= 9.21034 THEN exp(-0.5 * d2) / (2 * pi() * s) ELSE 0 END AS lik FROM d)
SELECT det_id, track_id, d2 > 9.21034 AS gated_out, round(d2, 5) AS d2, round(lik / (sum(lik) OVER (PARTITION BY det_id) + 1e-9), 6) AS p FROM l""")
def reassociate(spark, sf_dir):
    """Radar plots against every contact that is silent now, at its last place; candidates up to four times the gate, so that those it shuts out are seen."""
    d = det(spark, sf_dir)
    silent = movement.latest(d, NOW, SILENT).where("dark")
    tracks = silent.select("frame_idx", F.col("mmsi").alias("track_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.lit(90000.0).alias("p00"), F.lit(0.0).alias("p01"), F.lit(90000.0).alias("p11"))
    plots = d.where("source = 'radar'").select("frame_idx", F.col("event_id").alias("meas_id"), "x", "y", "sigma", F.col("mmsi").alias("own"))
    c = tracking.reattributed(tracking.candidates(tracks, plots, 4 * tracking.GATE).where("track_id <> own").withColumnRenamed("meas_id", "det_id"))
    return c.select("det_id", "track_id", "gated_out", r("d2", 5).alias("d2"), r("p", 6).alias("p"))


WIDE = """{DET}, q AS (SELECT a.frame_idx, a.mmsi AS track_id, b.event_id AS meas_id, b.x - a.x AS dx, b.y - a.y AS dy, 100.0::DOUBLE * (1 + a.mmsi % 5 * 300) ** 2 + b.sigma * b.sigma AS p, 2500.0::DOUBLE * (1 + a.mmsi % 3 * 20) ** 2 + b.sigma * b.sigma AS s FROM det a JOIN det b ON a.frame_idx = b.frame_idx AND a.mmsi % 2 = 0 AND b.mmsi % 2 = 1),
d AS (SELECT *, dx * dx / p + dy * dy / s AS d2 FROM q)"""


@query(WIDE + " SELECT frame_idx, track_id, meas_id, round(d2, 5) AS d2 FROM d WHERE d2 <= 9.21034")
def gate_wide_tracks(spark, sf_dir):
    """Gated pairs of tracks whose deviation is 10 m to 12 km."""
    tracks, plots = tracks_and_plots(spark, sf_dir)
    deviation = lambda step, k, far: (step * (1 + F.col("track_id") % k * far)).cast("double")
    wide = tracks.withColumns({"p00": deviation(10, 5, 300) * deviation(10, 5, 300), "p01": F.lit(0.0), "p11": deviation(50, 3, 20) * deviation(50, 3, 20)})
    return tracking.candidates(wide, plots).select("frame_idx", "track_id", "meas_id", r("d2", 5).alias("d2"))


@query("""{DET}, e AS (SELECT mmsi, count(*)::DOUBLE * 100 AS a, (mmsi % 7 * 20)::DOUBLE AS b, max(frame_idx)::DOUBLE * 90 + 500 AS c FROM det GROUP BY 1)
SELECT mmsi, round(sqrt(5.991 * ((a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b))), 4) AS major, round(sqrt(5.991 * greatest((a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b), 0)), 4) AS minor, round(degrees(atan2(2 * b, a - c) / 2), 4) AS angle FROM e""")
def ellipse_axes(spark, sf_dir):
    e = det(spark, sf_dir).groupBy("mmsi").agg((F.count(F.lit(1)) * 100.0).alias("a"), (F.max("frame_idx") * 90.0 + 500).alias("c")).withColumn("b", (F.col("mmsi") % 7 * 20).cast("double"))
    major, minor, angle = geo.ellipse(F.col("a"), F.col("b"), F.col("c"))
    return e.select("mmsi", r(major).alias("major"), r(minor).alias("minor"), r(angle).alias("angle"))


@query("""{DET}, p AS (SELECT event_id, 36.75 + degrees(y / 6371000.0) AS lat, -121.95 + degrees(x / (6371000.0 * cos(radians(36.75)))) AS lon FROM det)
SELECT event_id, round(2 * 6371.0088 * asin(sqrt(sin(radians(36.8 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(36.8)) * sin(radians(-122.0 - lon) / 2) ** 2)), 5) AS port_km,
 floor((lon + 180) / 360 * 2048)::BIGINT AS tile_x, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 2048)::BIGINT AS tile_y FROM p""")
def geo_functions(spark, sf_dir):
    lat, lon = geo.to_lla(F.col("x"), F.col("y"), 36.75, -121.95)
    p = det(spark, sf_dir).select("event_id", lat.alias("lat"), lon.alias("lon"))
    tx, ty = geo.tile(F.col("lat"), F.col("lon"), 11)
    return p.select("event_id", r(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(36.8), F.lit(-122.0)), 5).alias("port_km"), tx.alias("tile_x"), ty.alias("tile_y"))


@query("""{DET}, v AS (SELECT mmsi AS row_id, frame_idx % 100 AS imo, 'Supplier#' || lpad((mmsi % 200)::VARCHAR, 9, '0') AS name FROM det QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY frame_idx DESC) = 1)
SELECT row_id, CASE WHEN a.s_suppkey IS NOT NULL THEN a.s_suppkey ELSE b.s_suppkey END AS match_id, CASE WHEN a.s_suppkey IS NOT NULL THEN 'imo' WHEN b.s_suppkey IS NOT NULL THEN 'name' END AS basis FROM v LEFT JOIN supplier a ON a.s_suppkey = v.imo AND v.imo % 3 = 0 LEFT JOIN supplier b ON upper(b.s_name) = upper(v.name)""")
def sanctions_match(spark, sf_dir):
    """A contact's number decides if the list knows it, else its name."""
    d = det(spark, sf_dir).groupBy("mmsi").agg(F.max("frame_idx").alias("f"))
    v = d.select(F.col("mmsi").alias("row_id"), (F.col("f") % 100).alias("imo"), F.concat(F.lit("Supplier#"), F.lpad((F.col("mmsi") % 200).cast("string"), 9, "0")).alias("name"))
    s = table(spark, sf_dir, "supplier")
    known = s.select(F.lit("imo").alias("basis"), F.col("s_suppkey").cast("string").alias("key"), F.col("s_suppkey").alias("match_id")).unionByName(s.select(F.lit("name").alias("basis"), F.upper("s_name").alias("key"), F.col("s_suppkey").alias("match_id")))
    keys = (("imo", F.when(F.col("imo") % 3 == 0, F.col("imo").cast("string"))), ("name", F.upper("name")))
    return decisions.first_match(v, known, keys).select("row_id", "match_id", "basis")


@query("""SELECT c.c_custkey AS customer, n.n_name AS port, round(c_acctbal, 2) AS distance FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c_acctbal BETWEEN 0 AND 5000 QUALIFY row_number() OVER (PARTITION BY n.n_nationkey ORDER BY c_acctbal, c_custkey) <= 12""")
def port_topk(spark, sf_dir):
    """The twelve nearest of each port within range."""
    c = table(spark, sf_dir, "customer").where(F.col("c_acctbal").between(0, 5000)).select("c_custkey", "c_nationkey", "c_acctbal")
    c = c.withColumn("rn", F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey"))).where("rn <= 12")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("port"))
    return c.join(n, "c_nationkey").select(F.col("c_custkey").alias("customer"), "port", r("c_acctbal", 2).alias("distance"))


@query("""{DET}, w AS (SELECT mmsi, unnest([floor(t_abs / 1800) - 3, floor(t_abs / 1800) - 2, floor(t_abs / 1800) - 1, floor(t_abs / 1800)]) AS k FROM det)
SELECT (k * 1800)::BIGINT AS window_start, count(*) AS n_reports, count(DISTINCT mmsi) AS n_vessels FROM w GROUP BY 1""")
def window_scan(spark, sf_dir):
    """Reports and contacts in windows of two hours that begin every half hour."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    w = e.groupBy(F.window("ts", "120 minutes", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n_reports"), F.count_distinct("user_id").alias("n_vessels"))
    return w.select(F.unix_seconds("w.start").alias("window_start"), "n_reports", "n_vessels")


@query("{DET}, g AS (SELECT floor(x / 500)::BIGINT AS cx, floor(y / 500)::BIGINT AS cy, count(*) AS n FROM det GROUP BY 1, 2) SELECT cx, cy, n, round(pow(n::DOUBLE / (SELECT max(n) FROM g), 0.55), 6) AS intensity FROM g")
def density_grid(spark, sf_dir):
    g = det(spark, sf_dir).groupBy(F.floor(F.col("x") / 500).alias("cx"), F.floor(F.col("y") / 500).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    top = g.agg(F.max("n").alias("top"))
    return g.join(F.broadcast(top)).select("cx", "cy", "n", r(F.pow(F.col("n").cast("double") / F.col("top"), F.lit(0.55)), 6).alias("intensity"))  # one row


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value BETWEEN 0 AND 50) AS n_sane, round(avg(CASE WHEN value BETWEEN 0 AND 50 THEN value END), 6) AS mean_sane FROM events GROUP BY 1")
def field_sanity(spark, sf_dir):
    sane = F.when(F.col("value").between(0, 50) & ~F.isnan("value"), F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(sane).alias("n_sane"), F.round(F.avg(sane), 6).alias("mean_sane"))


@query("SELECT user_id, count(*) AS n, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def json_fields(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@query()
def mc_prediction(spark, sf_dir):
    """Confidence regions of all silent contacts from 600 samples each."""
    last = movement.latest(det(spark, sf_dir), NOW, SILENT).where("dark")
    c = last.select("mmsi", "x", "y", F.pmod(F.col("mmsi") * 37, F.lit(360)).cast("double").alias("course_deg"), (F.col("speed_kn") * 0.514444).alias("speed_mps"), F.least("age_s", F.lit(86400.0)).alias("age_s"))
    return forecast.regions(forecast.samples(c))


@query("""{DET}, p AS (SELECT mmsi, event_id AS sample, x, y, count(*) OVER (PARTITION BY mmsi) AS n, row_number() OVER (PARTITION BY mmsi ORDER BY x, event_id) AS rx, row_number() OVER (PARTITION BY mmsi ORDER BY y, event_id) AS ry FROM det),
c AS (SELECT *, max(CASE WHEN rx = n // 2 + 1 THEN x END) OVER (PARTITION BY mmsi) AS cx, max(CASE WHEN ry = n // 2 + 1 THEN y END) OVER (PARTITION BY mmsi) AS cy FROM p),
d AS (SELECT *, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS d FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY d, sample) AS rk FROM d), l AS (SELECT *, unnest([50, 80, 95]) AS level FROM k)
SELECT mmsi, level::INT AS level, count(*) AS n, round(max(d), 4) AS radius FROM l WHERE rk <= greatest(3, ceil(n * level / 100.0)) GROUP BY 1, 2""")
def mc_regions(spark, sf_dir):
    return forecast.regions(det(spark, sf_dir).withColumn("sample", F.col("event_id"))).select("mmsi", "level", "n", r("radius").alias("radius"))


@query()
def full_replay(spark, sf_dir):
    """Missions of twelve contacts each, replayed without their identities."""
    d = det(spark, sf_dir).select(F.floor(F.col("user_id") / 12).cast("long").alias("mission"), "frame_idx", "t", F.col("event_id").alias("meas_id"), "x", "y", "sigma")
    return replay.replay(d)


@query("""{DET}, h AS (SELECT frame_idx AS g, mmsi AS id, value_ AS w FROM (SELECT frame_idx, mmsi, speed_kn + 1 AS value_ FROM det WHERE source = 'radar')), n AS (SELECT *, w / sum(w) OVER (PARTITION BY g) AS q FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY q DESC, id) AS rk FROM n), s AS (SELECT * FROM k WHERE (q >= 0.01 OR rk = 1) AND rk <= 8) SELECT g AS frame_idx, id AS hyp_id, round(q / sum(q) OVER (PARTITION BY g), 6) AS weight FROM s""")
def hypothesis_maintain(spark, sf_dir):
    h = det(spark, sf_dir).where("source = 'radar'").select(F.col("frame_idx").alias("group"), F.col("mmsi").alias("hyp_id"), (F.col("speed_kn") + 1).alias("weight"))
    return decisions.pruned(h).select(F.col("group").alias("frame_idx"), "hyp_id", r("weight", 6).alias("weight"))


FACTS_SQL = "{DET}, f AS (SELECT mmsi, bool_or(event_type = 'error') AS jump, bool_or(event_type = 'click') AS two, bool_or(event_type = 'purchase') AS reg FROM det GROUP BY 1)"


def facts_by_contact(spark, sf_dir):
    """What each contact's reports say, all of them."""
    said = lambda kind: F.bool_or(F.col("event_type") == kind)
    return det(spark, sf_dir).groupBy("mmsi").agg(*[said(kind).alias(name) for name, kind in zip(decisions.FACTS, ("error", "click", "purchase"), strict=True)])


@query(FACTS_SQL + " SELECT mmsi, jump AND two AS spoofed, reg AND NOT (jump AND two) AS genuine, (jump AND two) OR (two AND NOT reg) AS alert FROM f")
def beliefs_by_contact(spark, sf_dir):
    """Each contact's own belief graph, solved for all contacts at once."""
    found = decisions.believed(facts_by_contact(spark, sf_dir))
    return found.select("mmsi", *[F.col(f"c_{c}").alias(c) for c in ("spoofed", "genuine", "alert")])


@query(FACTS_SQL + """ SELECT mmsi, CASE WHEN jump AND two THEN 'justification j3 satisfied: c_spoofed is believed' WHEN two AND NOT reg THEN 'justification j4 satisfied: f_two_emitters is believed and f_registry_match is not believed'
  ELSE 'justification j3 not satisfied: c_spoofed is no longer believed; no alternate justification holds (1 other(s) also unsatisfied)' END AS alert,
 CASE WHEN reg AND NOT (jump AND two) THEN 'justification j2 satisfied: f_registry_match is believed and c_spoofed is not believed' ELSE 'justification j2 not satisfied: ' || concat_ws(' and ', CASE WHEN NOT reg THEN 'f_registry_match is no longer believed' END, CASE WHEN jump AND two THEN 'c_spoofed is now believed' END) END AS genuine FROM f""")
def belief_reasons(spark, sf_dir):
    found = decisions.believed(facts_by_contact(spark, sf_dir))
    return found.select("mmsi", decisions.reason("c_alert").alias("alert"), decisions.reason("c_genuine").alias("genuine"))
