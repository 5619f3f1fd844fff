"""Queries over responses: signals of contacts, options by rates, ranges, risk where a contact is, and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import alerts, movement, responses
from tidemark.plans.alert_queries import KIND, RAISED, STATE, watched
from tidemark.plans.registry import IN_A, IN_B, IN_H, IN_R, LATEST, NOW, SILENT, det, query, r
from tidemark.sources.tables import table

#: Tiers that use parts as resources, whose retail prices are the rates.
TIERS = (("desk_review", "1", 2.0, 0.0), ("desk_review", "2", 0.0, 4.0), ("desk_review", "3", 0.0, 1.0), ("on_water_verification", "4", 4.0, 0.0), ("on_water_verification", "5", 0.0, 9.0), ("air_support", "6", 30.0, 0.0), ("air_support", "7", 0.0, 70.0))
TIERS_SQL = """rate AS (SELECT p_partkey::VARCHAR AS resource, p_retailprice::DOUBLE AS usd FROM part), use(tier, resource, lo, hi) AS (VALUES ('desk_review', '1', 2, 0), ('desk_review', '2', 0, 4), ('desk_review', '3', 0, 1), ('on_water_verification', '4', 4, 0), ('on_water_verification', '5', 0, 9), ('air_support', '6', 30, 0), ('air_support', '7', 0, 70)),
tiers AS (SELECT tier, sum(lo * usd) AS low_usd, sum(hi * usd) AS high_usd FROM use JOIN rate USING (resource) GROUP BY 1)"""
SIGNALS_SQL = f"""{{DET}}, s AS (SELECT event_id, frame_idx // 10 AS spell, mmsi::VARCHAR AS track_id, {KIND} AS kind, {STATE} AS dark, {IN_A} OR {IN_B} AS mpa FROM det),
a AS (SELECT *, CASE WHEN kind = 'intrusion' THEN CASE WHEN dark THEN 'critical' WHEN mpa THEN 'warning' ELSE 'info' END WHEN kind IN ('went_dark', 'identity_change') THEN 'warning' WHEN kind = 'reacquired' AND dark THEN 'warning' ELSE 'info' END AS severity,
 CASE kind WHEN 'intrusion' THEN 'Protected-water alert' WHEN 'went_dark' THEN 'AIS transmission lost' WHEN 'reacquired' THEN 'AIS transmission resumed' WHEN 'identity_change' THEN 'Vessel identity changed' END AS signal FROM s),
p AS (SELECT spell, track_id, signal, min(event_id) AS o FROM a WHERE kind IS NOT NULL GROUP BY 1, 2, 3 UNION ALL SELECT spell, track_id, 'AIS-silent contact', 1000000000000 FROM a WHERE dark GROUP BY 1, 2),
c AS (SELECT spell, track_id, CASE coalesce(max(CASE WHEN kind IS NOT NULL THEN CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END END), 1) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity,
 bool_or(dark) OR bool_or(coalesce(kind IN ('intrusion', 'went_dark'), false)) AS on_water, bool_or(coalesce(kind = 'intrusion' AND severity = 'critical', false)) AS air FROM a WHERE kind IS NOT NULL OR dark GROUP BY 1, 2)"""


def signals(spark, sf_dir):
    """Signals of each contact in spells of ten frames."""
    mpa = [z for z in movement.ZONES if z[1] == "mpa"]
    d = movement.inside(watched(spark, sf_dir), mpa).withColumns({"spell": F.floor(F.col("frame_idx") / 10), "kind": alerts.lookup(F.col("event_type"), RAISED), "track_id": F.col("mmsi").cast("string")})
    told = d.where("kind IS NOT NULL").select("spell", F.col("event_id").alias("ord"), "track_id", "kind", alerts.severity(F.col("kind"), F.size("zones_in") > 0, F.col("dark")).alias("severity"))
    return responses.contact_signals(told, d.where("dark").select("spell", "track_id"), "spell")


def tiers(spark, sf_dir):
    rates = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("resource"), F.col("p_retailprice").alias("usd"))
    return responses.priced_tiers(responses.uses(spark, TIERS), rates)


@query(SIGNALS_SQL + " SELECT spell, track_id, severity, on_water, air, string_agg(signal, ',' ORDER BY o) AS signals FROM c JOIN p USING (spell, track_id) GROUP BY ALL")
def contact_signals(spark, sf_dir):
    return signals(spark, sf_dir).select("spell", "track_id", "severity", "on_water", "air", F.array_join("signals", ",").alias("signals"))


OFFERED = SIGNALS_SQL + f""", {TIERS_SQL}, o AS (SELECT c.*, unnest(list_filter(['desk_review', CASE WHEN on_water THEN 'on_water_verification' END, CASE WHEN air THEN 'air_support' END], lambda t: t IS NOT NULL)) AS tier FROM c)"""


@query(OFFERED + """ SELECT spell, track_id, severity, tier, CASE tier WHEN 'desk_review' THEN 'Desk review' WHEN 'air_support' THEN 'Aircraft support, if authorized' ELSE 'On-water verification, if dispatched' END || ' · ' || track_id AS label, tier <> 'desk_review' AS conditional,
 round(low_usd, 2) AS low_usd, round(high_usd, 2) AS high_usd FROM o JOIN tiers USING (tier)""")
def response_options(spark, sf_dir):
    """Every option for every contact with signals, priced by rates."""
    o = responses.options(signals(spark, sf_dir), tiers(spark, sf_dir))
    return o.select("spell", "track_id", "severity", "tier", "label", "conditional", r("low_usd", 2).alias("low_usd"), r("high_usd", 2).alias("high_usd"))


@query(OFFERED + " SELECT spell, count(DISTINCT track_id) AS n_contacts, count(*) AS n_options, round(min(low_usd), 2) AS low_usd, round(max(high_usd), 2) AS high_usd FROM o JOIN tiers USING (tier) GROUP BY 1")
def response_ranges(spark, sf_dir):
    o = responses.options(signals(spark, sf_dir), tiers(spark, sf_dir))
    return responses.ranges(o, "spell").select("spell", "n_contacts", "n_options", r("low_usd", 2).alias("low_usd"), r("high_usd", 2).alias("high_usd"))


@query(f"""{{DET}}, {LATEST}, z AS (SELECT *, {IN_A} OR {IN_B} AS mpa, {IN_H} AS port, {IN_R} AS land, mmsi % 10 = 3 AS listed, abs(x) < 400 AS cable FROM last)
SELECT mmsi, CASE WHEN listed OR dark AND mpa THEN 'critical' ELSE 'warning' END AS severity, dark OR land AS on_water, dark AND mpa AS air, array_to_string(list_filter([CASE WHEN listed THEN 'Sanctions-list identity match' END, CASE WHEN dark AND mpa THEN 'AIS-silent contact in protected water' WHEN dark THEN 'AIS-silent contact' END,
 CASE WHEN port THEN 'Contact near a monitored port' END, CASE WHEN cable THEN 'Contact near submarine infrastructure' END, CASE WHEN land THEN 'Reported position plots on land' END], lambda s: s IS NOT NULL), ',') AS signals FROM z""")
def live_risk(spark, sf_dir):
    """Risk of each contact at its last place."""
    last = movement.inside(movement.latest(det(spark, sf_dir), NOW, SILENT))
    within = lambda *names: F.arrays_overlap("zones_in", F.array(*[F.lit(n) for n in names]))
    risk = responses.live_risk(F.col("dark"), F.col("mmsi") % 10 == 3, within("sanctuary_a", "sanctuary_b"), within("harbour"), F.abs("x") < 400, within("range"))
    return last.select("mmsi", "x", *[c.alias(n) for n, c in risk.items()]).select("mmsi", "severity", "on_water", "air", F.array_join("signals", ",").alias("signals"))


@query("""{DET}, a AS (SELECT frame_idx // 10 AS spell, t, event_id, 'contact ' || mmsi || ' ' || event_type AS detail FROM det WHERE event_type IN ('signup', 'error')), s AS (SELECT frame_idx // 10 AS spell, mmsi, CASE arg_max(event_type, frame_idx) WHEN 'purchase' THEN 'dead' WHEN 'signup' THEN 'coasting' ELSE 'confirmed' END AS status FROM det GROUP BY 1, 2),
n AS (SELECT spell, count(*) FILTER (WHERE status <> 'dead') AS live, count(*) FILTER (WHERE status = 'coasting') AS quiet FROM s GROUP BY 1), l AS (SELECT spell, string_agg(detail, ' | ' ORDER BY t, event_id) AS lines, count(*) AS n FROM a GROUP BY 1)
SELECT spell, 'Situation at T+' || (spell * 300) || ': ' || live || ' tracks held, ' || quiet || ' coasting without AIS.' || coalesce(' Alerts: ' || lines, ' No alerts raised.') AS text, coalesce(l.n, 0) AS n_alerts FROM n LEFT JOIN l USING (spell)""")
def situation_digests(spark, sf_dir):
    """What is held, coasts and was raised in each spell of ten frames, the details by time."""
    d = det(spark, sf_dir).withColumn("spell", F.floor(F.col("frame_idx") / 10))
    told = d.where("event_type IN ('signup', 'error')").select("spell", "t", F.col("event_id").alias("ord"), F.concat(F.lit("contact "), F.col("mmsi").cast("string"), F.lit(" "), "event_type").alias("detail"))
    status = F.max_by("event_type", "frame_idx")
    tracks = d.groupBy("spell", "mmsi").agg(F.when(status == "purchase", "dead").when(status == "signup", "coasting").otherwise("confirmed").alias("status"))
    clocks = d.select("spell").distinct().withColumn("clock", F.concat(F.lit("T+"), (F.col("spell") * 300).cast("string")))
    return responses.digests(told, tracks, clocks, "spell")
