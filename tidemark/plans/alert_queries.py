"""Queries about alerts, evaluation, vocabulary, registries and clients' views, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import alerts, decisions, movement
from tidemark.plans.registry import IN_A, IN_B, LATEST, NOW, SILENT, ZONED, det, query, r
from tidemark.sources import messages
from tidemark.sources.tables import table

STATE = "coalesce(last_value(CASE WHEN event_type = 'signup' THEN true WHEN event_type = 'purchase' THEN false END IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), false)"
#: Kinds of alerts that events stand for.
RAISED = {"signup": "went_dark", "click": "identity_change", "error": "reacquired", "purchase": "intrusion"}
KIND = "CASE event_type WHEN 'signup' THEN 'went_dark' WHEN 'click' THEN 'identity_change' WHEN 'error' THEN 'reacquired' WHEN 'purchase' THEN 'intrusion' END"


def watched(spark, sf_dir):
    """Reports with dark: switched off by the last scripted event."""
    d = det(spark, sf_dir)
    off = F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "purchase", False)
    return d.withColumn("dark", movement.as_of(d, "mmsi", ["frame_idx"], off, F.lit(False)))


@query(f"""{{DET}}, {ZONED}, s AS (SELECT mmsi, frame_idx, zones, {STATE} AS dark FROM zoned), b AS (SELECT *, coalesce(lag(zones) OVER w, []) AS was, coalesce(lag(dark) OVER w, false) AS was_dark FROM s WINDOW w AS (PARTITION BY mmsi ORDER BY frame_idx)),
e AS (SELECT mmsi, frame_idx, 'geofence_exit' AS type, unnest(list_filter(was, lambda z: NOT list_contains(zones, z))) AS zone_id FROM b UNION ALL SELECT mmsi, frame_idx, 'geofence_enter', unnest(list_filter(zones, lambda z: NOT list_contains(was, z))) FROM b
 UNION ALL SELECT mmsi, frame_idx, 'ais_dark', '' FROM b WHERE dark AND NOT was_dark AND len(zones) = 0 UNION ALL SELECT mmsi, frame_idx, 'ais_resume', '' FROM b WHERE was_dark AND NOT dark
 UNION ALL SELECT mmsi, frame_idx, 'dark_inside_protected_area', unnest(list_filter(zones, lambda z: NOT (was_dark AND list_contains(was, z)))) FROM b WHERE dark)
SELECT mmsi, frame_idx, type, zone_id, CASE type WHEN 'geofence_exit' THEN 'info' WHEN 'ais_resume' THEN 'info' WHEN 'ais_dark' THEN 'warning' WHEN 'geofence_enter' THEN CASE WHEN zone_id = 'harbour' THEN 'info' ELSE 'warning' END ELSE CASE WHEN zone_id LIKE 'sanctuary%' THEN 'emergency' ELSE 'critical' END END AS severity FROM e""")
def geofence_watch(spark, sf_dir):
    return alerts.watch(watched(spark, sf_dir))


@query(f"""{{DET}}, {ZONED}, s AS (SELECT mmsi, frame_idx, zones, {STATE} AS dark FROM zoned), b AS (SELECT *, coalesce(lag(zones) OVER (PARTITION BY mmsi ORDER BY frame_idx), []) AS was FROM s), e AS (SELECT mmsi, unnest(list_filter(zones, lambda z: NOT list_contains(was, z))) AS zone_id FROM b)
SELECT zone_id, count(*) AS n_entries, count(DISTINCT mmsi) AS n_contacts FROM e GROUP BY 1""")
def event_log_counts(spark, sf_dir):
    """How often and by how many contacts each zone was entered."""
    e = alerts.watch(watched(spark, sf_dir)).where("type = 'geofence_enter'")
    return e.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n_entries"), F.count_distinct("mmsi").alias("n_contacts"))


@query(f"""{{DET}}, s AS (SELECT event_id, {KIND} AS kind, {IN_A} OR {IN_B} AS protected, {STATE} AS dark FROM det)
SELECT event_id, kind, CASE WHEN kind = 'intrusion' THEN CASE WHEN dark THEN 'critical' WHEN protected THEN 'warning' ELSE 'info' END WHEN kind IN ('went_dark', 'identity_change') THEN 'warning' WHEN kind = 'reacquired' AND dark THEN 'warning' ELSE 'info' END AS severity FROM s WHERE kind IS NOT NULL""")
def alert_severity(spark, sf_dir):
    d = movement.inside(watched(spark, sf_dir), [z for z in movement.ZONES if z[1] == "mpa"]).withColumn("kind", alerts.lookup(F.col("event_type"), RAISED)).where("kind IS NOT NULL")
    return d.select("event_id", "kind", alerts.severity(F.col("kind"), F.size("zones_in") > 0, F.col("dark")).alias("severity"))


@query(f"""{{DET}}, s AS (SELECT mmsi, frame_idx, {KIND} AS kind, {STATE} AS dark, {IN_A} OR {IN_B} AS mpa FROM det), c AS (SELECT frame_idx, mmsi, bool_or(kind IN ('intrusion', 'went_dark')) OR bool_or(dark) AS water, bool_or(kind = 'intrusion' AND mpa) AS air FROM s WHERE kind IS NOT NULL OR dark GROUP BY 1, 2)
SELECT frame_idx, count(*) AS n_contacts, 192::BIGINT AS low_usd, max(CASE WHEN air THEN 90078 WHEN water THEN 27963 ELSE 589 END)::BIGINT AS high_usd FROM c GROUP BY 1""")
def response_cost(spark, sf_dir):
    """Per frame, the range of what a response to its alerts and silent contacts costs: alternatives, so least and most, never sums."""
    mpa = [z for z in movement.ZONES if z[1] == "mpa"]
    d = movement.inside(watched(spark, sf_dir), mpa).withColumn("kind", alerts.lookup(F.col("event_type"), RAISED)).where("kind IS NOT NULL OR dark")
    c = d.groupBy("frame_idx", "mmsi").agg(F.collect_set("kind").alias("kinds"), F.bool_or("dark").alias("dark"), F.bool_or(F.coalesce((F.col("kind") == "intrusion") & (F.size("zones_in") > 0), F.lit(False))).alias("air"))
    signals = F.concat("kinds", F.when(F.col("dark"), F.array(F.lit("dark_monitoring"))).otherwise(F.array().cast("array<string>")))
    water = F.array_contains("kinds", "intrusion") | F.array_contains("kinds", "went_dark") | F.col("dark")
    low, high = decisions.response(signals, water, water & F.col("air"))
    return c.select("frame_idx", low.alias("low"), high.alias("high")).groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n_contacts"), F.min("low").alias("low_usd"), F.max("high").alias("high_usd"))


MOMENTS = f"""{{DET}}, {ZONED}, m AS (SELECT mmsi, min(CASE WHEN len(zones) > 0 THEN t END) AS entry, min(CASE WHEN event_type = 'signup' THEN t END) AS dark, min(CASE WHEN event_type = 'error' THEN t END) AS contact, max(t) AS duration FROM zoned GROUP BY 1),
c AS (SELECT mmsi, 'sanctuary_entry_s' AS key, CASE WHEN entry IS NULL THEN 'SKIP' ELSE 'PASS' END AS outcome FROM m UNION ALL SELECT mmsi, 'dark_at_s', CASE WHEN dark IS NULL THEN 'SKIP' WHEN coalesce(dark > entry, true) THEN 'PASS' ELSE 'FAIL' END FROM m UNION ALL SELECT mmsi, 'radar_contact_at_s', CASE WHEN contact IS NULL THEN 'SKIP' WHEN coalesce(contact > dark, true) THEN 'PASS' ELSE 'FAIL' END FROM m)"""


@query(MOMENTS + " SELECT mmsi, key, outcome FROM c")
def eval_timing(spark, sf_dir):
    """Whether each contact enters a zone, goes silent and is seen again in that order, inside its window, at an event."""
    d = movement.inside(det(spark, sf_dir))
    first = lambda c: F.min(F.when(c, F.col("t")))
    kind = F.col("event_type")
    m = d.groupBy("mmsi").agg(
        first(F.size("zones_in") > 0).alias("entry"), first(kind == "signup").alias("dark"), first(kind == "error").alias("contact"), F.max("t").alias("duration"),
        F.collect_list(F.when(kind == "signup", F.col("t"))).alias("offs"),
    )
    c = F.col
    checks = (("sanctuary_entry_s", alerts.timing(c("entry"), c("duration"))), ("dark_at_s", alerts.timing(c("dark"), c("duration"), c("entry"), c("offs"))), ("radar_contact_at_s", alerts.timing(c("contact"), c("duration"), c("dark"))))
    return m.select("mmsi", F.inline(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("outcome")) for k, v in checks])))


@query(MOMENTS + " SELECT key, count(*) FILTER (WHERE outcome = 'PASS') AS passed, count(*) FILTER (WHERE outcome = 'FAIL') AS failed, count(*) FILTER (WHERE outcome = 'SKIP') AS skipped, count(*) FILTER (WHERE outcome = 'FAIL') = 0 AS ok FROM c GROUP BY 1")
def eval_rollup(spark, sf_dir):
    n = lambda o: F.count_if(F.col("outcome") == o)
    return eval_timing(spark, sf_dir).groupBy("key").agg(n("PASS").alias("passed"), n("FAIL").alias("failed"), n("SKIP").alias("skipped"), (n("FAIL") == 0).alias("ok"))


@query("""{DET}, s AS (SELECT user_id // 12 AS mission, frame_idx, mmsi, x, y FROM det), p AS (SELECT a.mission, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM s a JOIN s b ON a.mission = b.mission AND a.frame_idx = b.frame_idx AND a.mmsi < b.mmsi GROUP BY 1)
SELECT mission, round(d, 3) AS separation, CASE WHEN d < 900 THEN 'FAIL' WHEN d - 900 < 9 THEN 'MARGIN' ELSE 'PASS' END AS outcome FROM p""")
def min_separation(spark, sf_dir):
    """The nearest two contacts of each mission in any frame. Missions have twelve contacts, so pairs of a frame stay few."""
    s = det(spark, sf_dir).select(F.floor(F.col("user_id") / 12).alias("mission"), "frame_idx", "mmsi", "x", "y")
    side = lambda k: s.select("mission", "frame_idx", *[F.col(c).alias(f"{c}_{k}") for c in ("mmsi", "x", "y")])
    p = side("a").join(side("b"), ["mission", "frame_idx"]).where("mmsi_a < mmsi_b").groupBy("mission").agg(F.min(F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b"))).alias("d"))
    return p.select("mission", r("d", 3).alias("separation"), alerts.separation(F.col("d"), 900.0).alias("outcome"))


@query("""WITH l AS (SELECT l_orderkey, max(l_shipdate) AS until, avg(CASE WHEN l_linenumber = 7 THEN l_quantity END) AS given FROM lineitem GROUP BY 1)
SELECT o_orderkey AS event_id, round(coalesce(given, date_diff('second', o_orderdate, until) / 3600.0::DOUBLE), 2) AS duration_hours FROM orders JOIN l ON o_orderkey = l_orderkey""")
def event_duration(spark, sf_dir):
    """Hours of an event: those it states, else from its start to its end (an order's date and its last shipment)."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("until"), F.avg(F.when(F.col("l_linenumber") == 7, F.col("l_quantity"))).alias("given"))  # noqa: E741
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    seconds = F.unix_seconds(F.col("until").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return d.select(F.col("o_orderkey").alias("event_id"), F.round(F.coalesce("given", seconds / 3600.0), 2).alias("duration_hours"))


@query("""WITH a AS (SELECT l_orderkey, l_suppkey AS k FROM lineitem UNION SELECT l_orderkey, l_partkey % 150 FROM lineitem UNION SELECT l_orderkey, l_partkey % 77 FROM lineitem)
SELECT l_orderkey AS event_id, string_agg(s_name, ',' ORDER BY s_suppkey) AS areas FROM a JOIN supplier ON s_suppkey = k GROUP BY 1""")
def protected_area_join(spark, sf_dir):
    """The areas of each event from three lists of ids: distinct, sorted, those that the register knows."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(F.array_distinct(F.array("l_suppkey", F.col("l_partkey") % 150, F.col("l_partkey") % 77))).alias("s_suppkey")).distinct()  # noqa: E741
    j = l.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    names = F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda s: s["s_name"])
    return j.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.array_join(names, ",").alias("areas"))


@query("SELECT c_nationkey AS registry, arg_max(c_custkey, (c_mktsegment = 'BUILDING', c_acctbal, c_custkey)) AS record FROM customer GROUP BY 1")
def registry_match(spark, sf_dir):
    """The latest record of the wanted kind, or of any kind where there is none."""
    best = F.max_by("c_custkey", F.struct(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"), F.col("c_custkey")))
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("registry")).agg(best.alias("record"))


@query(f"""{{DET}}, {LATEST}, z AS (SELECT *, {IN_A} OR {IN_B} AS mpa FROM last), c AS (SELECT count(*) FILTER (WHERE NOT dark) AS active, count(*) FILTER (WHERE dark) AS dark, count(*) AS total, count(*) FILTER (WHERE dark AND mpa) AS critical, count(*) FILTER (WHERE mpa) AS protected FROM z)
SELECT *, active + dark = total AS consistent, CASE WHEN active = 0 THEN 'DEGRADED' WHEN critical > 0 THEN 'ELEVATED' ELSE 'NORMAL' END AS status FROM c""")
def client_status(spark, sf_dir):
    """What a client's header shows of all contacts."""
    mpa = [z for z in movement.ZONES if z[1] == "mpa"]
    d = movement.inside(movement.latest(det(spark, sf_dir), NOW, SILENT), mpa).withColumn("mpa", F.size("zones_in") > 0)
    c = d.agg(F.count_if(~F.col("dark")).alias("active"), F.count_if("dark").alias("dark"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("dark") & F.col("mpa")).alias("critical"), F.count_if("mpa").alias("protected"))
    status = F.when(F.col("active") == 0, "DEGRADED").when(F.col("critical") > 0, "ELEVATED").otherwise("NORMAL")
    return c.withColumns({"consistent": F.col("active") + F.col("dark") == F.col("total"), "status": status})


@query("SELECT upper(event_type) AS tag, count(*) AS n, sum((event_id % 36000)::BIGINT)::BIGINT AS seconds FROM events GROUP BY 1")
def log_lines(spark, sf_dir):
    """Log lines "[h:mm:ss] TAG text", written and parsed again, added up by tag."""
    s = F.col("event_id") % 36000
    e = table(spark, sf_dir, "events").select(F.format_string("[%d:%02d:%02d] %s contact %d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, F.upper("event_type"), F.col("user_id")).alias("line"))
    part = lambda k: F.regexp_extract("line", r"^\[(\d+):(\d\d):(\d\d)\] (\w+) (.*)$", k)
    seconds = part(1).cast("long") * 3600 + part(2).cast("long") * 60 + part(3).cast("long")
    return e.groupBy(part(4).alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("seconds"))


@query("WITH n AS (SELECT event_id, event_type || '-' || user_id AS name, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS n FROM events) SELECT event_id, CASE WHEN n = 0 THEN name ELSE name || '#' || n END AS uid FROM n")
def dedupe_ids(spark, sf_dir):
    named = table(spark, sf_dir, "events").select("event_id", F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("name"))
    return alerts.unique_ids(named, "name", "event_id").select("event_id", "uid")


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT event_id, [NULL, 'mpa', 'cable', 'danger', 'port', 'land', 'mpa'][event_id % 7 + 1] AS kind FROM events")
def zone_vocabulary(spark, sf_dir):
    """Free spellings of kinds of zones, one for each event."""
    spelt = F.array(*map(F.lit, ("elsewhere", " Marine Sanctuary", "SUBMARINE-CABLE", "exclusion  zone ", "harbour", "Coast.", "marine/protected--area")))
    return table(spark, sf_dir, "events").select("event_id", alerts.zone_kind(F.get(spelt, (F.col("event_id") % 7).cast("int"))).alias("kind"))


@query("{DET}, e AS (SELECT event_id AS alert_id, unnest([event_id - 1, event_id, event_id + 1]) AS meas_id FROM det WHERE event_type = 'click') SELECT alert_id, meas_id, mmsi FROM e JOIN det ON det.event_id = meas_id WHERE source = 'radar'")
def alert_evidence(spark, sf_dir):
    """The contacts behind each alert; only radar plots are kept as contacts, so other evidence leads nowhere."""
    d = det(spark, sf_dir)
    e = d.where("event_type = 'click'").select(F.col("event_id").alias("alert_id"), F.explode(F.array(F.col("event_id") - 1, F.col("event_id"), F.col("event_id") + 1)).alias("meas_id"))
    return e.join(d.where("source = 'radar'").select(F.col("event_id").alias("meas_id"), "mmsi"), "meas_id").select("alert_id", "meas_id", "mmsi")


@query("""WITH h AS (SELECT max(event_id) // 2 AS h FROM events), s AS (SELECT user_id, max(event_id) AS revision FROM events, h WHERE event_id <= h GROUP BY 1), d AS (SELECT user_id, max(event_id) AS revision, arg_max(event_type, event_id) = 'error' AS gone FROM events, h WHERE event_id > h GROUP BY 1)
SELECT coalesce(d.user_id, s.user_id) AS user_id, coalesce(d.revision, s.revision) AS revision FROM s FULL JOIN d ON s.user_id = d.user_id WHERE NOT coalesce(gone, false)""")
def delta_merge(spark, sf_dir):
    """A client's contacts after a delta with removals."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    e = e.join(F.broadcast(e.agg(F.floor(F.max("event_id") / 2).alias("h"))))  # one row
    state = e.where("event_id <= h").groupBy("user_id").agg(F.max("event_id").alias("revision"))
    delta = e.where("event_id > h").groupBy("user_id").agg(F.max("event_id").alias("revision"), (F.max_by("event_type", "event_id") == "error").alias("gone"))
    return alerts.merged(state, delta, "user_id")


@query(f"""{{DET}}, s AS (SELECT frame_idx, event_id, event_type, {STATE} AS dark FROM det) SELECT frame_idx, count(*) FILTER (WHERE NOT dark) AS n_live, count(*) FILTER (WHERE dark) AS n_dark, coalesce(string_agg(event_id::VARCHAR, ';' ORDER BY event_id) FILTER (WHERE event_type = 'error'), '') AS lines FROM s GROUP BY 1""")
def situation_digest(spark, sf_dir):
    """A frame's contacts by state and its alerts in order."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("event_type") == "error", F.col("event_id")))), lambda i: i.cast("string")), ";")
    return watched(spark, sf_dir).groupBy("frame_idx").agg(F.count_if(~F.col("dark")).alias("n_live"), F.count_if("dark").alias("n_dark"), lines.alias("lines"))


@query("""{DET}, v AS (SELECT *, (x - lag(x) OVER w) / 30 AS vx, (y - lag(y) OVER w) / 30 AS vy FROM det WINDOW w AS (PARTITION BY mmsi ORDER BY frame_idx))
SELECT event_id, 'T-' || lpad((mmsi - 200000000)::VARCHAR, 3, '0') AS track_id, round(x, 1) AS x, round(y, 1) AS y, round(36.75 + degrees(y / 6371000.0), 6) AS lat, round(sqrt(vx * vx + vy * vy), 2) AS speed, round((degrees(atan2(vx, vy)) + 360) % 360, 1) AS heading FROM v WHERE vx IS NOT NULL AND vx * vx + vy * vy > 0""")
def track_payload(spark, sf_dir):
    """What a client gets of each report of a moving contact: rounded position, speed and heading clockwise from north."""
    w = W.partitionBy("mmsi").orderBy("frame_idx")
    d = det(spark, sf_dir).withColumns({"vx": (F.col("x") - F.lag("x").over(w)) / 30, "vy": (F.col("y") - F.lag("y").over(w)) / 30}).where("vx IS NOT NULL AND vx * vx + vy * vy > 0")
    lat = 36.75 + F.degrees(F.col("y") / 6371000.0)
    return d.select(
        "event_id", F.format_string("T-%03d", F.col("mmsi") - 200000000).alias("track_id"), r("x", 1).alias("x"), r("y", 1).alias("y"), r(lat, 6).alias("lat"),
        F.round(F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")), 2).alias("speed"), F.round(F.pmod(F.degrees(F.atan2("vx", "vy")), F.lit(360.0)), 1).alias("heading"),
    )


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = (user_id % 10)::VARCHAR")
def spoof_broadcasters(spark, sf_dir):
    """Events of which any parameter is the contact's id, whatever the parameter's name."""
    e = table(spark, sf_dir, "events")
    return e.where(F.exists(F.map_values(F.from_json("props", "map<string,string>")), lambda v: v == (F.col("user_id") % 10).cast("string"))).select("event_id")


@query("""{DET}, h AS (SELECT frame_idx AS g, mmsi % 3 AS root, mmsi, speed_kn + 1 AS w, event_id % 5 AS depth FROM det WHERE source = 'radar'), k AS (SELECT *, row_number() OVER (PARTITION BY g, root ORDER BY w DESC, mmsi) AS rk, max(depth) OVER (PARTITION BY g, root) >= 3 AS deep FROM h)
SELECT g AS frame_idx, root, mmsi AS hyp_id FROM k WHERE NOT deep OR rk = 1""")
def hypothesis_nscan(spark, sf_dir):
    """Leaves of branches that are three deep collapse to the heaviest."""
    h = det(spark, sf_dir).where("source = 'radar'").select(F.col("frame_idx").alias("group"), (F.col("mmsi") % 3).alias("root"), F.col("mmsi").alias("hyp_id"), (F.col("speed_kn") + 1).alias("weight"), (F.col("event_id") % 5).alias("depth"))
    return alerts.scan_collapsed(h).select(F.col("group").alias("frame_idx"), "root", "hyp_id")


@query(f"""{{DET}}, {LATEST}, i AS (SELECT mmsi, age_s, speed_kn AS v, mmsi % 9 AS status, (mmsi % 31 - 15) / 10.0::DOUBLE AS turn, mmsi % 3 AS missing, mmsi % 100 AS kind, mmsi % 13 AS draught FROM last),
u AS (SELECT *, least(1.0, age_s / 3600 + missing / 8) AS u, least(1.0, abs(turn) / 1.5) AS o FROM i), w AS (SELECT *, 0.18 + u * 0.12 + o * 0.12 AS man, 0.035 + u * 0.045 AS rev, 0.035 + u * 0.04 AS dri, 0.025 + u * 0.035 AS sto, 0.04 + o * 0.04 AS slo FROM u),
m AS (SELECT *, greatest(0.2, 1 - man - rev - dri - sto - slo) AS mai FROM w), s AS (SELECT *, man + rev + dri + sto + slo + mai AS total, status IN (1, 5, 6) OR v < 0.8 AS rest FROM m)
SELECT mmsi, round(CASE WHEN rest THEN 0.12 ELSE mai / total END, 6) AS maintain_course, round(CASE WHEN rest THEN 0 ELSE man / total END, 6) AS maneuver, round(CASE WHEN rest THEN 0.2 ELSE slo / total END, 6) AS slow_maneuver, round(CASE WHEN rest THEN 0.05 ELSE rev / total END, 6) AS course_reversal, round(CASE WHEN rest THEN 0.43 ELSE dri / total END, 6) AS drift, round(CASE WHEN rest THEN 0.2 ELSE sto / total END, 6) AS stopped,
 CASE WHEN kind BETWEEN 70 AND 89 OR draught >= 7 THEN 0.012::DOUBLE WHEN kind BETWEEN 30 AND 39 OR kind BETWEEN 60 AND 69 THEN 0.02::DOUBLE ELSE 0.015::DOUBLE END AS wind_lo, CASE WHEN kind BETWEEN 70 AND 89 OR draught >= 7 THEN 0.025::DOUBLE ELSE 0.04::DOUBLE END AS wind_hi,
 (ceil(least(least(1440, age_s / 60), 60) / 2) + greatest(0, ceil((least(least(1440, age_s / 60), 360) - 60) / 5)) + greatest(0, ceil((least(1440, age_s / 60) - 360) / 15)) + 15)::INT AS n_steps,
 round(least(700.0, greatest(35.0, (greatest(0.0, v) * (least(24.0, greatest(0.0, age_s / 3600)) + 0.5) + 20) * 1.852)), 4) AS radius_km, CASE WHEN age_s >= 21600 THEN 'low' WHEN age_s >= 3600 THEN 'moderate' ELSE 'higher' END AS confidence FROM s""")
def forecast_inputs(spark, sf_dir):
    """Priors of behaviours, windage, time steps, radius and confidence of each contact's forecast."""
    i = movement.latest(det(spark, sf_dir), NOW, SILENT)
    k, age = F.col("mmsi"), F.col("age_s")
    priors = alerts.behaviour_priors(F.col("speed_kn"), k % 9, (k % 31 - 15) / 10.0, age, k % 3)
    lo, hi = alerts.windage(k % 100, k % 13)
    confidence = F.when(age >= 21600, "low").when(age >= 3600, "moderate").otherwise("higher")
    return i.select("mmsi", *[r(c, 6).alias(n) for n, c in priors.items()], lo.alias("wind_lo"), hi.alias("wind_hi"), F.size(alerts.time_steps(age / 60)).alias("n_steps"), r(alerts.forecast_radius_km(age, F.col("speed_kn"))).alias("radius_km"), confidence.alias("confidence"))


@query("""{DET} SELECT event_id, mmsi, round(36.75 + degrees(y / 6371000.0), 4) AS lat, CASE WHEN event_type = 'view' THEN 'MMSI ' || mmsi ELSE event_type END AS name, round(speed_kn, 4) AS speed_kn FROM det WHERE event_type <> 'signup'""")
def push_messages(spark, sf_dir):
    """Reports as a feed's JSON messages, parsed again; static reports are another kind of message and carry no position."""
    d = det(spark, sf_dir)
    static = F.col("event_type") == "signup"
    lat = 36.75 + F.degrees(F.col("y") / 6371000.0)
    meta = F.struct(F.col("mmsi").alias("MMSI"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("ShipName"), F.when(~static, lat).alias("latitude"), F.when(~static, F.lit(-121.9)).alias("longitude"))
    body = F.struct(F.when(~static, F.struct(F.col("speed_kn").alias("Sog"), F.col("event_id").alias("RateOfTurn"))).alias("PositionReport"))
    raw = d.select(F.to_json(F.struct(F.when(static, "ShipStaticData").otherwise("PositionReport").alias("MessageType"), meta.alias("MetaData"), body.alias("Message"))).alias("value"))
    p = messages.positions(raw)
    return p.select(F.col("rate_of_turn").cast("long").alias("event_id"), "mmsi", "lat", "name", r("speed_kn").alias("speed_kn"))
