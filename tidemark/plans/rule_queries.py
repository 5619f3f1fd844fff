"""Queries about zone tables, hypotheses, evaluation rules, alert rows and orders of rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import alerts, decisions, evaluation, movement, tracking, zones
from tidemark.operators.staging import staged
from tidemark.plans.alert_queries import KIND, RAISED, STATE, watched
from tidemark.plans.registry import LATEST, NOW, SILENT, det, query, r, tracks_and_plots
from tidemark.sources.tables import table
from tidemark.streaming import live

#: Zones of the suppliers: a diamond around a place with a diamond as a hole, and a small square apart from it as a second part.
AREAS = "areas AS (SELECT 's' || s_suppkey AS zone_id, (s_suppkey * 37 % 120) * 100 - 3000 AS zx, (s_suppkey * 53 % 90) * 100 - 2000 AS zy, 200 + s_suppkey % 9 * 150 AS r FROM supplier)"
TRIAL = "{DET}, " + AREAS + ", m AS (SELECT event_id, zone_id, abs(x - zx) + abs(y - zy) AS d, r, greatest(abs(x - zx - 2 * r), abs(y - zy)) AS e FROM det JOIN areas ON abs(x - zx) <= 3 * r AND abs(y - zy) <= r)"


def areas(spark, sf_dir):
    k = F.col("s_suppkey")
    z = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("zone_id"), (k * 37 % 120 * 100 - 3000).cast("double").alias("zx"), (k * 53 % 90 * 100 - 2000).cast("double").alias("zy"), (200 + k % 9 * 150).cast("double").alias("r"))
    at = lambda dx, dy: F.array(F.col("zx") + dx, F.col("zy") + dy)
    diamond = lambda s: F.array(at(s, F.lit(0)), at(F.lit(0), s), at(-s, F.lit(0)), at(F.lit(0), -s))
    size, side = F.col("r"), F.col("r") / 4
    square = F.array(at(2 * size - side, -side), at(2 * size + side, -side), at(2 * size + side, side), at(2 * size - side, side), at(2 * size - side, -side))
    return z.select("zone_id", F.array(F.array(diamond(size), diamond(size / 2)), F.array(square)).alias("parts"))


@query(TRIAL + " SELECT event_id, zone_id FROM m WHERE d < r AND d > r / 2.0 OR e < r / 4.0")
def zone_table_containment(spark, sf_dir):
    """Reports strictly inside zones that come as a table, with parts and holes."""
    return zones.contained(det(spark, sf_dir).select("event_id", "x", "y"), areas(spark, sf_dir)).select("event_id", "zone_id")


@query(TRIAL + " SELECT event_id, zone_id FROM m WHERE d <= r AND d >= r / 2.0 OR e <= r / 4.0")
def covers_containment(spark, sf_dir):
    """The same with edges as part of a zone."""
    return zones.contained(det(spark, sf_dir).select("event_id", "x", "y"), areas(spark, sf_dir), covers=True).select("event_id", "zone_id")


@query(AREAS.join(("WITH ", "")) + """, n AS (SELECT 'n' || n_nationkey AS zone_id, 'port' AS kind FROM nation) SELECT 'area:' || zone_id AS zone_id, 'mpa' AS kind FROM areas UNION ALL SELECT 'port:' || zone_id, kind FROM n""")
def zone_layers(spark, sf_dir):
    """Layers of zones as one index whose ids carry their layer and are unique."""
    ports = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("zone_id"), F.lit("port").alias("kind"))
    return zones.union_of({"area": areas(spark, sf_dir).select("zone_id", F.lit("mpa").alias("kind")), "port": ports})


@query("""{DET}, m AS (SELECT mmsi AS truth_id, frame_idx AS frame, event_id AS ord, CASE WHEN event_id % 17 = 0 THEN 7 ELSE mmsi END AS track_id FROM det WHERE event_type <> 'view'),
l AS (SELECT *, lag(track_id) OVER (PARTITION BY truth_id ORDER BY frame, ord) AS b FROM m), g AS (SELECT count(DISTINCT truth_id) - 1 AS more FROM m GROUP BY frame, track_id)
SELECT count(*) FILTER (WHERE b IS NOT NULL AND b <> track_id) AS id_switches, (SELECT sum(more)::BIGINT FROM g) AS merges, (SELECT count(DISTINCT frame_idx) FROM det) AS frames, count(*) AS total_matches, count(DISTINCT truth_id) AS truths_seen, count(DISTINCT track_id) AS tracks_seen FROM l""")
def clear_mot_totals(spark, sf_dir):
    d = det(spark, sf_dir)
    m = d.where("event_type <> 'view'").select(F.col("mmsi").alias("truth_id"), F.col("frame_idx").alias("frame"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 17 == 0, F.lit(7)).otherwise(F.col("mmsi")).alias("track_id"))
    return tracking.clear_mot_totals(m, d.select(F.col("frame_idx").alias("frame")))


MUTUAL = """{DET}, q AS (SELECT a.frame_idx, a.mmsi AS track_id, b.event_id AS meas_id, b.x - a.x AS dx, b.y - a.y AS dy, 40000 + b.sigma * b.sigma AS p, 5000::DOUBLE AS q, 90000 + b.sigma * b.sigma AS s FROM det a JOIN det b ON a.frame_idx = b.frame_idx AND a.mmsi % 2 = 0 AND b.mmsi % 2 = 1),
d AS (SELECT *, (s * dx * dx - 2 * q * dx * dy + p * dy * dy) / (p * s - q * q) AS d2 FROM q), c AS (SELECT *, 0.5 * d2 + 0.5 * ln(p * s - q * q) AS cost FROM d WHERE d2 <= 9.21034),
b AS (SELECT frame_idx, track_id, meas_id FROM c QUALIFY row_number() OVER (PARTITION BY frame_idx, track_id ORDER BY cost, meas_id) = 1 AND row_number() OVER (PARTITION BY frame_idx, meas_id ORDER BY cost, track_id) = 1)"""


@query(MUTUAL + " SELECT frame_idx, track_id, meas_id FROM b")
def mutual_best(spark, sf_dir):
    return tracking.mutual_best(tracking.cheapest_pairs(*tracks_and_plots(spark, sf_dir))).select("frame_idx", "track_id", "meas_id")


@query(MUTUAL + """ SELECT frame_idx, 'track' AS side, mmsi AS id FROM det WHERE mmsi % 2 = 0 AND (frame_idx, mmsi) NOT IN (SELECT (frame_idx, track_id) FROM b)
 UNION ALL SELECT frame_idx, 'plot', event_id FROM det WHERE mmsi % 2 = 1 AND (frame_idx, event_id) NOT IN (SELECT (frame_idx, meas_id) FROM b)""")
def left_over(spark, sf_dir):
    """Tracks and plots without a partner: with the pairs, an exact partition of both sides."""
    tracks, plots = tracks_and_plots(spark, sf_dir)
    t, p = tracking.left_over(tracks, plots, staged(mutual_best(spark, sf_dir)))
    return t.select("frame_idx", F.lit("track").alias("side"), F.col("track_id").alias("id")).unionByName(p.select("frame_idx", F.lit("plot").alias("side"), F.col("meas_id").alias("id")))


LEAVES = """{DET}, h AS (SELECT frame_idx AS g, mmsi % 5 AS root, 'h_' || mmsi AS id, speed_kn + 1 AS w, (mmsi % 4)::INT AS depth FROM det WHERE source = 'radar'), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY w DESC, id) AS rk FROM h),
s AS (SELECT g, root, id, w, depth + 1 AS depth FROM k WHERE g % 2 = 1 UNION ALL SELECT g, root, id, w, depth FROM k WHERE g % 2 = 0 AND rk > 1 UNION ALL SELECT g, root, id || 'a', w * 0.6::DOUBLE, depth + 1 FROM k WHERE g % 2 = 0 AND rk = 1 UNION ALL SELECT g, root, id || 'b', w * 0.4::DOUBLE, depth + 1 FROM k WHERE g % 2 = 0 AND rk = 1)"""


def leaves(spark, sf_dir):
    h = det(spark, sf_dir).where("source = 'radar'").select(F.col("frame_idx").alias("group"), (F.col("mmsi") % 5).alias("root"), F.concat(F.lit("h_"), F.col("mmsi").cast("string")).alias("hyp_id"), (F.col("speed_kn") + 1).alias("weight"), (F.col("mmsi") % 4).cast("int").alias("depth"))
    return decisions.stepped(h, F.col("group") % 2 == 0, 0.6, 0.4)


@query(LEAVES + " SELECT g AS frame_idx, id AS hyp_id, depth, round(w, 6) AS weight FROM s")
def hypothesis_split(spark, sf_dir):
    """Frames that are ambiguous split their heaviest hypothesis; in others all grow one deeper."""
    return leaves(spark, sf_dir).select(F.col("group").alias("frame_idx"), "hyp_id", "depth", r("weight", 6).alias("weight"))


@query(LEAVES + """, n AS (SELECT *, w / sum(w) OVER (PARTITION BY g) AS q FROM s), c AS (SELECT *, count(*) OVER (PARTITION BY g, root) > 1 AND max(depth) OVER (PARTITION BY g, root) >= 3 AS many, row_number() OVER (PARTITION BY g, root ORDER BY q DESC, id) AS rr FROM n),
z AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY q DESC, id) AS rk FROM c WHERE NOT many OR rr = 1), l AS (SELECT * FROM z WHERE (q >= 0.01 OR rk = 1) AND rk <= 8) SELECT g AS frame_idx, id AS hyp_id, depth, round(q / sum(q) OVER (PARTITION BY g), 6) AS weight FROM l""")
def hypothesis_step(spark, sf_dir):
    """A whole frame: split or deepen, then collapse roots, drop light ones, cap."""
    return decisions.maintained(leaves(spark, sf_dir)).select(F.col("group").alias("frame_idx"), "hyp_id", "depth", r("weight", 6).alias("weight"))


EXPECTED = """{DET}, a AS (SELECT user_id // 12 AS mission, list(DISTINCT mmsi::VARCHAR) AS actors, list(DISTINCT event_type) AS fences, list(DISTINCT (event_id % 50)::VARCHAR) AS sent, count(*) FILTER (WHERE event_id % 17 = 0) AS switches, avg(speed_kn) / 50 AS p, min(mmsi)::VARCHAR AS least, (max(x) - min(x)) / 10 AS off,
  list(DISTINCT event_type) FILTER (WHERE event_id % 7 = 0) AS fired FROM det GROUP BY 1),
e AS (SELECT mission, unnest([{key: 'dark_actor', value: (200000000 + 12 * mission + mission % 14)::VARCHAR}, {key: 'actors', value: least || CASE WHEN mission % 3 = 0 THEN ',nobody' ELSE '' END}, {key: 'intrusion_fence', value: CASE mission % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'reef' ELSE 'error' END}, {key: 'spoof_mmsi', value: (mission % 60)::VARCHAR},
  {key: 'id_switches_max', value: CASE WHEN mission % 5 = 0 THEN 'few' ELSE (mission % 10)::VARCHAR END}, {key: 'reassoc_p_min', value: '0.5'}, {key: 'reassoc_correct', value: 'true'}, {key: 'geofence_alert', value: CASE WHEN mission % 4 = 0 THEN 'false' ELSE 'true' END}, {key: 'predicted_vs_true_offset_verified_m', value: '4000'},
  {key: 'ofac_hit', value: 'true'}, {key: 'min_vessels', value: '3'}, {key: 'notes', value: 'text'}], recursive := true) FROM a),
j AS (SELECT e.mission, key, value, a.* EXCLUDE (mission), 200000000 + 12 * mission + mission % 14 AS dark FROM e JOIN a USING (mission) WHERE key <> 'notes')"""


@query(EXPECTED + """ SELECT mission, key, CASE key WHEN 'dark_actor' THEN CASE WHEN list_contains(actors, value) THEN 'PASS' ELSE 'FAIL' END WHEN 'actors' THEN CASE WHEN mission % 3 = 0 THEN 'FAIL' ELSE 'PASS' END WHEN 'intrusion_fence' THEN CASE WHEN list_contains(fences, value) THEN 'PASS' ELSE 'FAIL' END
 WHEN 'spoof_mmsi' THEN CASE WHEN list_contains(sent, value) THEN 'PASS' ELSE 'FAIL' END WHEN 'id_switches_max' THEN CASE WHEN mission % 6 = 5 THEN 'SKIP' WHEN coalesce(switches <= TRY_CAST(value AS DOUBLE), false) THEN 'PASS' ELSE 'FAIL' END WHEN 'reassoc_p_min' THEN CASE WHEN mission % 6 = 5 THEN 'SKIP' WHEN p >= 0.5 THEN 'PASS' ELSE 'FAIL' END
 WHEN 'reassoc_correct' THEN CASE WHEN mission % 6 = 5 THEN 'SKIP' WHEN least = dark::VARCHAR THEN 'PASS' ELSE 'FAIL' END WHEN 'geofence_alert' THEN CASE WHEN mission % 6 = 5 THEN 'SKIP' WHEN mission % 4 = 0 THEN CASE WHEN fired IS NULL THEN 'PASS' ELSE 'FAIL' END WHEN list_contains(coalesce(fired, []), CASE mission % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'reef' ELSE 'error' END) THEN 'PASS' ELSE 'FAIL' END
 WHEN 'predicted_vs_true_offset_verified_m' THEN CASE WHEN mission % 6 = 5 THEN 'SKIP' WHEN abs(off - 4000) <= 800 THEN 'PASS' ELSE 'FAIL' END ELSE 'SKIP' END AS outcome FROM j""")
def eval_checks(spark, sf_dir):
    """Expectations of each mission against its definition and results; every sixth mission was not run."""
    d = det(spark, sf_dir).withColumn("mission", F.floor(F.col("user_id") / 12).cast("long"))
    texts = lambda c: F.collect_set(c.cast("string"))
    packs = d.groupBy("mission").agg(texts(F.col("mmsi")).alias("actors"), texts(F.col("event_type")).alias("fences"), texts(F.col("event_id") % 50).alias("broadcast"))
    results = d.groupBy("mission").agg(
        F.count_if(F.col("event_id") % 17 == 0).alias("id_switches"), (F.avg("speed_kn") / 50).alias("reassoc_p"), F.min("mmsi").cast("string").alias("reassoc_track_id"),
        ((F.max("x") - F.min("x")) / 10).alias("offset_m"), texts(F.when(F.col("event_id") % 7 == 0, F.col("event_type"))).alias("geofence_alerts"),
    ).where("mission % 6 <> 5")
    m = F.col("mission")
    text = lambda c: c.cast("string")
    values = {
        "dark_actor": text(200000000 + 12 * m + m % 14), "actors": F.concat(text(F.col("least")), F.when(m % 3 == 0, ",nobody").otherwise("")), "intrusion_fence": F.when(m % 3 == 0, "click").when(m % 3 == 1, "reef").otherwise("error"),
        "spoof_mmsi": text(m % 60), "id_switches_max": F.when(m % 5 == 0, "few").otherwise(text(m % 10)), "reassoc_p_min": F.lit("0.5"), "reassoc_correct": F.lit("true"), "geofence_alert": F.when(m % 4 == 0, "false").otherwise("true"),
        "predicted_vs_true_offset_verified_m": F.lit("4000"), "ofac_hit": F.lit("true"), "min_vessels": F.lit("3"), "notes": F.lit("text"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    expected = d.groupBy("mission").agg(F.min("mmsi").alias("least")).select("mission", F.inline(rows))
    return evaluation.checks(expected, packs, results)


@query(f"""{{DET}}, s AS (SELECT event_id, user_id // 12 AS mission, mmsi, t, {KIND} AS kind, {STATE} AS dark FROM det), a AS (SELECT *, CASE WHEN kind = 'intrusion' THEN CASE WHEN dark THEN 'critical' ELSE 'info' END WHEN kind IN ('went_dark', 'identity_change') THEN 'warning' WHEN kind = 'reacquired' AND dark THEN 'warning' ELSE 'info' END AS severity FROM s WHERE kind IS NOT NULL)
SELECT mission, CASE WHEN n < 1000 THEN printf('A-%03d', n) ELSE 'A-' || n END AS alert_id, event_id, severity, printf('[%d:%02d:%02d] ', t::BIGINT // 3600, t::BIGINT % 3600 // 60, t::BIGINT % 60) || upper(severity) || ': ' || CASE kind WHEN 'intrusion' THEN mmsi || CASE WHEN dark THEN ' (DARK, position predicted) entered ' ELSE ' (tracked) entered ' END || 'zone ' || event_id % 9
 WHEN 'went_dark' THEN mmsi || ' stopped transmitting; coasting on prediction, uncertainty growing' WHEN 'reacquired' THEN 'unlabelled detection fused into ' || mmsi || ' after dark period' ELSE 'displayed identity of ' || mmsi || ' changed' END AS headline
 FROM (SELECT *, row_number() OVER (PARTITION BY mission ORDER BY t, event_id) AS n FROM a)""")
def alert_rows(spark, sf_dir):
    """Every alert with its id within the mission, severity and line."""
    d = watched(spark, sf_dir).withColumn("kind", alerts.lookup(F.col("event_type"), RAISED)).where("kind IS NOT NULL").withColumn("mission", F.floor(F.col("user_id") / 12).cast("long"))
    d = alerts.raised(d, "mission", ["t", "event_id"]).withColumn("severity", alerts.severity(F.col("kind"), F.lit(False), F.col("dark")))
    zone = F.concat(F.lit("zone "), (F.col("event_id") % 9).cast("string"))
    return d.select("mission", "alert_id", "event_id", "severity", alerts.detail(F.col("kind"), F.col("severity"), F.col("mmsi").cast("string"), F.col("dark"), zone, F.col("t")).alias("headline"))


@query("""{DET}, e AS (SELECT event_id, mmsi, t + (event_id % 41 - 20) AS moment FROM det), g AS (SELECT DISTINCT frame_idx FROM det) SELECT event_id, frame_idx FROM e JOIN g ON frame_idx = round_even(moment / 30, 0)""")
def events_to_frames(spark, sf_dir):
    """Scripted moments fall on the frame whose time is nearest, halves on the even one."""
    d = det(spark, sf_dir)
    e = d.select("event_id", F.bround((F.col("t") + (F.col("event_id") % 41 - 20)) / 30).cast("long").alias("frame_idx"))
    return e.join(d.select("frame_idx").distinct(), "frame_idx").select("event_id", "frame_idx")


@query("{DET} SELECT event_id, printf('m%06d', row_number() OVER (ORDER BY frame_idx, mmsi) - 1) AS meas_id FROM det WHERE source = 'radar'")
def measurement_ids(spark, sf_dir):
    """Ids in the order of frames and actors: counts of the frames before are added to the place within the frame, so no task holds all rows."""
    d = det(spark, sf_dir).where("source = 'radar'").select("event_id", "frame_idx", "mmsi")
    before = d.groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("frame_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("frame_idx").orderBy("mmsi")) - 1
    return d.withColumn("place", place).join(before, "frame_idx").select("event_id", F.format_string("m%06d", F.col("before") + F.col("place")).alias("meas_id"))


@query("{DET} SELECT mmsi, frame_idx FROM det WHERE frame_idx <= 40 QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY frame_idx DESC) <= 15")
def history_upto(spark, sf_dir):
    """The last fifteen reports of each contact up to a frame."""
    d = det(spark, sf_dir).where("frame_idx <= 40")
    return d.withColumn("n", F.row_number().over(W.partitionBy("mmsi").orderBy(F.desc("frame_idx")))).where("n <= 15").select("mmsi", "frame_idx")


@query("""{DET}, o AS (SELECT mmsi, list(event_type ORDER BY frame_idx) AS l FROM det GROUP BY 1) SELECT mmsi, list_reduce(list_prepend('', list_transform(list_filter(list_transform(l, lambda x, i: CASE WHEN list_position(l, x) = i THEN x END), lambda x: x IS NOT NULL), lambda x: x)), lambda a, b: CASE WHEN a = '' THEN b ELSE a || ',' || b END) AS signals FROM o""")
def signals_in_order(spark, sf_dir):
    """What a contact's reports said, each once, in the order of first occurrence: the first frame of each is kept before anything is gathered."""
    first = det(spark, sf_dir).groupBy("mmsi", "event_type").agg(F.min("frame_idx").alias("at"))
    signals = F.sort_array(F.collect_list(F.struct("at", "event_type")))
    return first.groupBy("mmsi").agg(F.array_join(F.transform(signals, lambda x: x["event_type"]), ",").alias("signals"))


@query("""{DET}, b AS (SELECT mmsi, event_type, count(*) AS reports FROM det GROUP BY 1, 2) SELECT event_type AS behaviour, count(*) AS n_samples, sum(reports)::BIGINT AS n_steps FROM b GROUP BY 1""")
def behaviour_counts(spark, sf_dir):
    """How many contacts' sequences contain each behaviour, and how many steps show it."""
    b = det(spark, sf_dir).groupBy("mmsi", F.col("event_type").alias("behaviour")).agg(F.count(F.lit(1)).alias("reports"))
    return b.groupBy("behaviour").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("reports").alias("n_steps"))


@query("""{DET}, l AS (SELECT user_id // 12 AS mission, 36.75 + degrees(y / 6371000.0) AS lat, x FROM det) SELECT mission, round(min(lat), 8) AS lat_min, round(max(lat), 8) AS lat_max, min(x) AS x_min, max(x) AS x_max FROM l GROUP BY 1""")
def sample_bounds(spark, sf_dir):
    d = det(spark, sf_dir).select(F.floor(F.col("user_id") / 12).cast("long").alias("mission"), (36.75 + F.degrees(F.col("y") / 6371000.0)).alias("lat"), "x")
    return d.groupBy("mission").agg(r(F.min("lat"), 8).alias("lat_min"), r(F.max("lat"), 8).alias("lat_max"), F.min("x").alias("x_min"), F.max("x").alias("x_max"))


@query("""{DET}, v AS (SELECT event_id, speed_kn, CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 = 0 THEN 'Infinity'::DOUBLE ELSE speed_kn END AS v FROM det) SELECT event_id, CASE WHEN isfinite(v) THEN round(v, 2) END AS shown FROM v""")
def finite_or_null(spark, sf_dir):
    v = F.when(F.col("event_id") % 11 == 0, float("nan")).when(F.col("event_id") % 13 == 0, float("inf")).otherwise(F.col("speed_kn"))
    shown = F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(F.round(v, 2))
    return det(spark, sf_dir).select("event_id", shown.alias("shown"))


@query(f"""{{DET}}, {LATEST}, a AS (SELECT mmsi, t_abs FROM last WHERE age_s < {20 * SILENT} AND mmsi NOT IN (200000003, 200000010)), h AS (SELECT count(*) AS n FROM last WHERE age_s < {20 * SILENT} AND mmsi IN (200000003, 200000010))
SELECT mmsi, t_abs FROM a QUALIFY row_number() OVER (ORDER BY t_abs DESC, mmsi) > 20 - (SELECT n FROM h)""")
def capacity_eviction(spark, sf_dir):
    """Whom a store of twenty active contacts gives up, with two pinned."""
    return live.evicted(movement.latest(det(spark, sf_dir), NOW, 20 * SILENT), 20, (200000003, 200000010)).select("mmsi", "t_abs")
