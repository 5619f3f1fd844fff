"""Queries about answers of other services, checks of inputs, branches of forecasts, frames and texts for clients, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geo, labels
from tidemark.operators import cells, decisions, forecast, movement
from tidemark.plans.alert_queries import STATE, watched
from tidemark.plans.registry import LATEST, NOW, SILENT, det, query, r
from tidemark.sources import records
from tidemark.sources.tables import table

LAT, LON = "(36.75 + degrees(y / 6371000.0))", "(-121.95 + degrees(x / (6371000.0 * cos(radians(36.75)))))"
KM = "2 * 6371.0088 * asin(sqrt(sin(radians({b} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({b})) * sin(radians({d} - ({c})) / 2) ** 2))"


def text(c):
    return c.cast("string")


def mission():
    return F.floor(F.col("user_id") / 12).cast("long")


def placed(spark, sf_dir):
    d = det(spark, sf_dir)
    lat, lon = geo.to_lla(F.col("x"), F.col("y"), 36.75, -121.95)
    return d.withColumns({"lat": lat, "lon": lon})


@query("""SELECT s_suppkey::VARCHAR AS port_id, CASE WHEN s_suppkey % 10 = 0 THEN 'Unnamed port' ELSE s_name END AS name, s_suppkey % 3 = 0 AS pilot_required, s_suppkey % 2 = 0 AS tug_assist, round("""
       + KM.format(a="36.8", b="(30 + s_suppkey % 20)", c="-122.0", d="(-130.0 + s_suppkey % 15)") + """, 1) AS distance_km FROM supplier WHERE s_suppkey % 9 <> 4""")
def port_index(spark, sf_dir):
    """Suppliers as a port index in JSON, read again; one in nine has no coordinates."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    at = F.when(k % 9 == 4, F.array(F.lit(1.0))).otherwise(F.array((-130 + k % 15).cast("double"), (30 + k % 20).cast("double")))
    told = F.struct(text(k).alias("INDEX_NO"), F.when(k % 10 == 0, "").otherwise(F.col("s_name")).alias("PORT_NAME"), F.when(k % 3 == 0, "Y").when(k % 3 == 1, "N").alias("PILOT_REQD"), F.when(k % 2 == 0, "Y").alias("TUG_ASSIST"))
    raw = s.select(F.to_json(F.struct(F.array(F.struct(F.struct(at.alias("coordinates")).alias("geometry"), told.alias("properties"))).alias("features"))).alias("value"))
    return records.ports(raw, (36.8, -122.0)).select("port_id", "name", "pilot_required", "tug_assist", "distance_km")


@query("""SELECT c_custkey AS mmsi, c_custkey % 7 <> 0 AS matched, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'own' ELSE 'other' END END AS vessel_id, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'REG' || c_custkey END END AS name,
 CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'cargo' WHEN lower(c_mktsegment) < 'cargo' THEN lower(c_mktsegment) || ',cargo' ELSE 'cargo,' || lower(c_mktsegment) END END AS ship_types FROM customer""")
def vessel_registry(spark, sf_dir):
    """Customers as a registry's answers: an even number has a record of its own, older than a foreign one; without it the newest counts, which has no name."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    rec = lambda i, number, name, at: F.struct(F.lit(i).alias("id"), text(number).alias("ssvid"), name.alias("shipname"), F.lit(at).alias("transmissionDateTo"))
    none = F.lit(None).cast("string")
    own = F.array(rec("own", F.when(k % 2 == 0, k).otherwise(k + 1000000), F.col("c_name"), "2023-01-01"), rec("other", k + 2000000, none, "2024-01-01"))
    kinds = F.array(F.struct(F.lower("c_mktsegment").alias("name")), F.struct(F.lit("cargo").alias("name")), F.struct(F.when(k % 3 == 0, "").otherwise("cargo").alias("name")))
    kinds = F.when(k % 3 == 0, F.slice(kinds, 2, 2)).otherwise(kinds)
    entry = F.struct(own.alias("selfReportedInfo"), F.array(rec("reg", k, F.concat(F.lit("REG"), text(k)), "2022-01-01")).alias("registryInfo"), F.array(F.struct(F.lit("combined").alias("vesselId"), kinds.alias("shiptypes"))).alias("combinedSourcesInfo"))
    raw = c.select(k.alias("mmsi"), F.to_json(F.struct(F.when(k % 7 != 0, F.array(entry)).alias("entries"))).alias("value"))
    return records.registry(raw).select("mmsi", "matched", "vessel_id", "name", F.array_join("ship_types", ",").alias("ship_types"))


ACTIVITY = "CASE event_type WHEN 'view' THEN 'FISHING' WHEN 'click' THEN 'GAP' WHEN 'error' THEN 'LOITERING' WHEN 'signup' THEN 'ENCOUNTER' ELSE 'PORT_VISIT' END"


@query(f"""SELECT event_id, {ACTIVITY} AS type, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS start, round(CASE WHEN event_id % 3 = 0 THEN (event_id % 50) / 4.0 WHEN event_id % 5 <> 0 THEN (event_id % 500) / 60.0 END::DOUBLE, 2) AS duration_hours,
 CASE WHEN event_type = 'view' THEN 'modelled' ELSE 'observed' END AS classification FROM events WHERE event_id % 7 <> 0""")
def activity_events(spark, sf_dir):
    """Events of an activity feed in JSON, read again: those without a position go, durations come from the detail or from start and end."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "fishing").when(F.col("event_type") == "click", "gap").when(F.col("event_type") == "error", "loitering").when(F.col("event_type") == "signup", "encounter").otherwise("port_visit")
    ts = F.col("ts").cast("timestamp")
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    detail = [F.when((kind == n) & (k % 3 == 0), F.struct((k % 50 / 4).alias("averageDurationHours"))).alias(n) for n in ("fishing", "gap", "loitering", "encounter", "port_visit")]
    end = F.when(k % 5 != 0, stamp(ts + F.make_dt_interval(mins=(k % 500).cast("int"))))
    position = F.struct(F.when(k % 7 != 0, 36 + k % 100 / 100).alias("lat"), F.lit(-122.5).alias("lon"))
    raw = e.select(F.to_json(F.struct(F.array(F.struct(text(k).alias("id"), kind.alias("type"), stamp(ts).alias("start"), end.alias("end"), position.alias("position"), *detail)).alias("entries"))).alias("value"))
    a = records.activity(raw)
    return a.select(F.col("id").cast("long").alias("event_id"), "type", "start", "duration_hours", "classification")


@query("""SELECT l_orderkey AS option_id, round(coalesce(sum(l_quantity * p_retailprice), 0), 2) AS low_usd, round(coalesce(sum(3 * l_quantity * p_retailprice), 0), 2) AS high_usd, count(*) AS n_inputs, count(DISTINCT l_partkey) FILTER (WHERE p_partkey IS NULL) AS n_missing
 FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 50 <> 3) p ON l_partkey = p_partkey GROUP BY 1""")
def rate_lookup(spark, sf_dir):
    """Options priced by an hourly rate for each resource they use; one resource in fifty has no rate."""
    rates = table(spark, sf_dir, "part").where("p_partkey % 50 <> 3").select(F.col("p_partkey").alias("resource"), F.col("p_retailprice").alias("usd"))
    options = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("option_id"), F.col("l_partkey").alias("resource"), F.col("l_quantity").alias("low_hours"), (3 * F.col("l_quantity")).alias("high_hours"))
    return decisions.priced(options, rates, "option_id").select("option_id", r("low_usd", 2).alias("low_usd"), r("high_usd", 2).alias("high_usd"), "n_inputs", F.size("missing").cast("long").alias("n_missing"))


@query("""WITH e AS (SELECT event_id, event_id % 8 AS k, 36 + (event_id % 100) / 100.0::DOUBLE AS lat, -121 - (event_id % 90) / 100.0::DOUBLE AS lon FROM events)
SELECT event_id, CASE WHEN k IN (0, 1) THEN round(lon, 6) WHEN k = 7 THEN round(lat, 6) END AS lon, CASE WHEN k IN (0, 1) THEN round(lat, 6) WHEN k = 7 THEN 20.0 END AS lat, CASE k WHEN 2 THEN 'swapped' WHEN 3 THEN 'out of range' WHEN 4 THEN 'missing' WHEN 5 THEN 'not a number' WHEN 6 THEN 'length' END AS problem FROM e""")
def checked_origins(spark, sf_dir):
    """Origins by name or in order: those that only read turned round are refused, those that read both ways are lon, lat."""
    k = F.col("event_id")
    lat, lon = text(36 + k % 100 / 100.0), text(-121 - k % 90 / 100.0)
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = (join('{"latitude": ', lat, ', "lng": ', lon, "}"), join("[", lon, ", ", lat, "]"), join("[", lat, ", ", lon, "]"), join("[200.0, 100.0]"), join('{"lat": ', lat, "}"), join('{"lat": "north", "lon": ', lon, "}"), join("[", lat, "]"), join("[", lat, ", 20]"))
    value = F.element_at(F.array(*forms), (k % 8 + 1).cast("int"))
    d = records.origins(table(spark, sf_dir, "events").select("event_id", value.alias("value")), "value")
    return d.select("event_id", r("lon", 6).alias("lon"), r("lat", 6).alias("lat"), "problem")


@query("""WITH e AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, (o_orderkey % 60)::DOUBLE AS w FROM orders) SELECT id, CASE WHEN k < 2 AND w < 50 THEN w + 60 END AS lon_min, CASE WHEN k < 2 AND w < 50 THEN 110.0 END AS lon_max, CASE WHEN k = 2 THEN 'missing' WHEN k = 3 THEN 'out of range' WHEN k = 4 THEN 'length' WHEN w >= 50 THEN 'degenerate' END AS problem FROM e""")
def checked_boxes(spark, sf_dir):
    """Boxes by name or in order; a box whose west isn't west of its east is refused."""
    k = F.col("o_orderkey")
    west = text((k % 60 + 60).cast("double"))
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = (join('{"lon_min": ', west, ', "lat_min": 1, "lon_max": 110, "lat_max": 2}'), join("[", west, ", 1, 110, 2]"), join('{"lon_min": ', west, ', "lat_min": 1, "lon_max": 110}'), join("[", west, ", 1, 110, 92]"), join("[", west, ", 1]"))
    value = F.element_at(F.array(*forms), (k % 5 + 1).cast("int"))
    return records.boxes(table(spark, sf_dir, "orders").select(k.alias("id"), value.alias("value")), "value").select("id", "lon_min", "lon_max", "problem")


@query("""{DET}, v AS (SELECT CASE WHEN event_id % 97 = 0 THEN 'mmsi:' || mmsi WHEN event_id % 89 = 0 THEN mmsi::VARCHAR ELSE 'm' || event_id END AS meas_id, source FROM det) SELECT 'meas_id' AS "column", meas_id AS "value" FROM v WHERE meas_id LIKE 'mmsi:%' OR meas_id IN (SELECT mmsi::VARCHAR FROM det)""")
def identity_leaks(spark, sf_dir):
    """Measurements that carry an identity, some of which are made to."""
    d, k = det(spark, sf_dir), F.col("event_id")
    m = d.select(F.when(k % 97 == 0, F.concat(F.lit("mmsi:"), text(F.col("mmsi")))).when(k % 89 == 0, text(F.col("mmsi"))).otherwise(F.concat(F.lit("m"), text(k))).alias("meas_id"), "source", "x", "y", "sigma")
    return records.leaks(m, d.select(text(F.col("mmsi")).alias("actor_id")), ("meas_id", "source", "x", "y", "sigma"))


@query("{DET} SELECT mmsi, frame_idx, CASE WHEN mmsi % 2 = 0 THEN 'real' ELSE 'synthetic' END AS origin FROM det")
def tracks_united(spark, sf_dir):
    """Real and synthetic tracks as one table, in which a contact's frame may be there once only."""
    d = det(spark, sf_dir).select("mmsi", "frame_idx")
    return records.united([d.where(F.col("mmsi") % 2 == k).withColumn("origin", F.lit(name)) for k, name in enumerate(("real", "synthetic"))], ["mmsi", "frame_idx"])


@query("""{DET}, g AS (SELECT DISTINCT frame_idx, 30.0::DOUBLE * frame_idx AS ft FROM det), p AS (SELECT mmsi, t + CASE WHEN event_id % 5 = 0 THEN 0.5 WHEN event_id % 5 = 1 THEN 0.0000001 ELSE 0 END AS t, x FROM det) SELECT mmsi, frame_idx, x FROM p JOIN g ON abs(t - ft) <= 0.000001""")
def truth_at_frames(spark, sf_dir):
    """True positions that fall on a frame's time to a millionth of a second: joined by the nearest frame's number, then compared."""
    d, k = det(spark, sf_dir), F.col("event_id") % 5
    p = d.select("mmsi", "x", (F.col("t") + F.when(k == 0, 0.5).when(k == 1, 1e-7).otherwise(0.0)).alias("t")).withColumn("frame_idx", F.round(F.col("t") / 30).cast("long"))
    return p.join(d.select("frame_idx").distinct(), "frame_idx").where(F.abs(F.col("t") - 30.0 * F.col("frame_idx")) <= 1e-6).select("mmsi", "frame_idx", "x")


@query(f"""{{DET}}, p AS (SELECT s_suppkey, 36.75 + (s_suppkey % 40 - 20) / 200.0::DOUBLE AS plat, -121.95 + (s_suppkey % 30 - 15) / 200.0::DOUBLE AS plon FROM supplier), l AS (SELECT event_id, {LAT} AS lat, {LON} AS lon FROM det),
j AS (SELECT event_id, s_suppkey, sqrt((lat - plat) ** 2 + (lon - plon) ** 2) * 111.32 AS km FROM l JOIN p ON true WHERE lat BETWEEN 34.5 AND 38.5 AND lon BETWEEN -126 AND -120.5)
SELECT event_id, round(min(km), 6) AS port_km, count(*) AS n_ports FROM j WHERE km <= 12 GROUP BY 1""")
def ports_within_reach(spark, sf_dir):
    """Reports in the extent that are at most 12 km (of flat degrees) from a port, joined by cells; ports in one place are met once and counted."""
    k, reach = F.col("s_suppkey"), 12 / 111.32
    p = table(spark, sf_dir, "supplier").select(k, (36.75 + (k % 40 - 20) / 200.0).alias("plat"), (-121.95 + (k % 30 - 15) / 200.0).alias("plon"))
    p = p.groupBy("plat", "plon").agg(F.count(F.lit(1)).alias("n"))
    d = placed(spark, sf_dir).where("lat BETWEEN 34.5 AND 38.5 AND lon BETWEEN -126 AND -120.5").select("event_id", "lat", "lon")
    near = cells.in_cells(p, d, [], (F.col("plon") - reach, F.col("plat") - reach), (F.col("plon") + reach, F.col("plat") + reach), (F.col("lon"), F.col("lat")), base=2 * reach)
    near = near.withColumn("km", F.hypot(F.col("lat") - F.col("plat"), F.col("lon") - F.col("plon")) * 111.32).where("km <= 12")
    return near.groupBy("event_id").agg(r(F.min("km"), 6).alias("port_km"), F.sum("n").alias("n_ports"))


@query(f"""{{DET}}, l AS (SELECT event_id, t_abs, {LAT} AS lat, {LON} AS lon FROM det WHERE abs(t_abs - 1705708800) <= 10800)
SELECT event_id, round({KM.format(a="36.75", b="lat", c="-121.95", d="lon")}, 6) AS km FROM l WHERE abs(lat - 36.75) <= 0.35 AND abs(lon + 121.95) <= 0.35 ORDER BY km, event_id LIMIT 25""")
def grid_in_box(spark, sf_dir):
    """The 25 nearest values of a grid in a box of 0.35 degrees and three hours on either side."""
    d = placed(spark, sf_dir).where(F.abs(F.col("t_abs") - 1705708800) <= 10800).where((F.abs(F.col("lat") - 36.75) <= 0.35) & (F.abs(F.col("lon") + 121.95) <= 0.35))
    km = geo.haversine_km(F.lit(36.75), F.lit(-121.95), F.col("lat"), F.col("lon"))
    return d.select("event_id", r(km, 6).alias("km")).orderBy("km", "event_id").limit(25)


@query("""SELECT s_suppkey, trim(regexp_replace(v, '[ \\t]+', ' ', 'g')) AS text, length(trim(regexp_replace(v, '[ \\t]+', ' ', 'g'))) BETWEEN 2 AND 160 AS accepted FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '  ' || s_name || '   bay ' WHEN 1 THEN ' x ' WHEN 2 THEN repeat(s_name || ' ', 12) ELSE s_name END AS v FROM supplier)""")
def place_queries(spark, sf_dir):
    """Texts of place searches with white space made single; those of 2 to 160 characters are accepted."""
    k, name = F.col("s_suppkey") % 4, F.col("s_name")
    v = F.when(k == 0, F.concat(F.lit("  "), name, F.lit("   bay "))).when(k == 1, " x ").when(k == 2, F.repeat(F.concat(name, F.lit(" ")), 12)).otherwise(name)
    tidy = F.trim(F.regexp_replace(v, r"\s+", " "))
    return table(spark, sf_dir, "supplier").select("s_suppkey", tidy.alias("text"), F.length(tidy).between(2, 160).alias("accepted"))


@query("""{DET}, c AS (SELECT user_id // 12 AS key, event_type AS behaviour, (mmsi % 2)::INT AS cluster, event_id AS sample, x, y FROM det), m AS (SELECT key, behaviour, cluster, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM c GROUP BY ALL),
d AS (SELECT c.*, n, cx, cy, sum(1) OVER (PARTITION BY key) AS total, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS d FROM c JOIN m USING (key, behaviour, cluster)), k AS (SELECT *, row_number() OVER (PARTITION BY key, behaviour, cluster ORDER BY d, sample) AS rk FROM d)
SELECT key AS mission, behaviour, cluster, n, round(n / total, 4) AS probability, round(cx, 4) AS cx, round(cy, 4) AS cy, round(greatest(100, max(d) FILTER (WHERE rk = least(n - 1, floor(n * 0.9::DOUBLE)) + 1)), 4) AS radius FROM k GROUP BY key, behaviour, cluster, n, total, cx, cy""")
def branch_summaries(spark, sf_dir):
    """Share, centre and radius of nine in ten of each cluster of a mission's positions."""
    p = det(spark, sf_dir).select(mission().alias("key"), F.col("event_type").alias("behaviour"), (F.col("mmsi") % 2).cast("int").alias("cluster"), F.col("event_id").alias("sample"), "x", "y")
    return forecast.branch_summaries(p).select(F.col("key").alias("mission"), "behaviour", "cluster", "n", "probability", r("cx").alias("cx"), r("cy").alias("cy"), r("radius").alias("radius"))


@query()
def forecast_branches(spark, sf_dir):
    """The k-means branches of each mission's positions, each with its summary."""
    p = det(spark, sf_dir).select(mission().alias("key"), F.col("event_type").alias("behaviour"), F.col("event_id").alias("sample"), "x", "y")
    return forecast.branch_summaries(forecast.branches(p)).withColumnRenamed("key", "mission")


NAV = f"""{{DET}}, {LATEST}, i AS (SELECT mmsi, age_s / 60 AS silent_min, CASE WHEN mmsi % 4 <> 0 THEN (mmsi % 400)::DOUBLE END AS co, CASE WHEN mmsi % 3 <> 0 THEN (mmsi * 7 % 360)::DOUBLE END AS he, CASE WHEN mmsi % 5 <> 0 THEN (mmsi % 60)::DOUBLE END AS sp, CASE WHEN mmsi % 13 = 0 THEN 127.0::DOUBLE WHEN mmsi % 7 <> 0 THEN (mmsi % 9 - 4) * 6.0::DOUBLE END AS raw_turn, mmsi % 11 AS st,
 CASE WHEN mmsi % 6 <> 0 THEN (mmsi * 3 % 360)::DOUBLE END AS pc, CASE WHEN mmsi % 6 <> 0 THEN (mmsi % 30)::DOUBLE END AS ps, CASE WHEN mmsi % 8 <> 0 THEN (mmsi % 5 - 2) / 1.0::DOUBLE END AS pt, mmsi % 5 AS pts FROM last),
a AS (SELECT *, CASE WHEN raw_turn BETWEEN -20 AND 20 THEN raw_turn END AS tu, CASE WHEN co < 360 THEN co END AS c, CASE WHEN sp < 50 THEN sp END AS s, coalesce(CASE WHEN co < 360 THEN co END, he) AS told FROM i), b AS (SELECT *, (pc - told + 540) % 360 - 180 AS off, coalesce(s, ps, 5.0) AS k0, st IN (1, 5, 6) AS held, (c IS NULL)::INT + (he IS NULL)::INT + (s IS NULL)::INT + (coalesce(tu, pt) IS NULL)::INT + (pts < 3)::INT AS n FROM a),
d AS (SELECT *, CASE WHEN held AND k0 < 3 THEN least(k0, 0.5) ELSE k0 END AS kn, coalesce(tu * 0.7 + pt * 0.3, tu, pt, 0) AS t0 FROM b)"""


@query(NAV + """ SELECT mmsi, round(CASE WHEN abs(off) <= 45 THEN (told + off * 0.2 + 360) % 360 ELSE coalesce(told, pc, 0) END, 6) AS bearing, round(kn, 6) AS speed_kn, round(greatest(-1.5, least(1.5, t0)), 6) AS turn, n::BIGINT AS n_missing, round((4 + 4 * n + CASE WHEN held THEN 8 ELSE 0 END)::DOUBLE, 6) AS heading_sigma,
 round(CASE WHEN held THEN least(0.5, greatest(0.35, kn * 0.1) + n * 0.3) ELSE greatest(0.35, kn * 0.1) + n * 0.3 END, 6) AS speed_sigma, greatest(5, least(6, 5 + n + floor(least(silent_min, 1440) / 15)))::BIGINT AS n_branches FROM d""")
def forecast_navigation(spark, sf_dir):
    """What each contact's forecast starts from, with inputs missing or impossible here and there."""
    k = F.col("mmsi")
    some = lambda every, v: F.when(k % every != 0, v.cast("double"))
    i = movement.latest(det(spark, sf_dir), NOW, SILENT)
    nav = forecast.navigation(some(4, k % 400), some(3, k * 7 % 360), some(5, k % 60), F.when(k % 13 == 0, 127.0).otherwise(some(7, (k % 9 - 4) * 6)), k % 11, some(6, k * 3 % 360), some(6, k % 30), some(8, k % 5 - 2), k % 5, F.least(F.col("age_s") / 60, F.lit(1440.0)))
    return i.select("mmsi", *[r(nav[n], 6).alias(n) for n in ("bearing", "speed_kn", "turn", "heading_sigma", "speed_sigma")], F.size(nav["missing"]).cast("long").alias("n_missing"), nav["n_branches"].cast("long").alias("n_branches"))


@query("""{DET}, m AS (SELECT mmsi, event_type, sum(value % 15) AS minutes FROM det JOIN (SELECT event_id, value FROM events) USING (event_id) GROUP BY 1, 2), b AS (SELECT mmsi, event_type, minutes FROM m QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY round(minutes, 6) DESC, event_type) = 1) SELECT mmsi, CASE WHEN event_type = 'error' THEN 'drift' ELSE event_type END AS behaviour, round(minutes, 4) AS minutes FROM b""")
def dominant_behaviour(spark, sf_dir):
    """The behaviour with most minutes in each contact's sequence; a stop is the still end of a drift."""
    minutes = F.round(F.sum(F.pmod(F.col("value"), F.lit(15.0))), 6)
    m = table(spark, sf_dir, "events").groupBy((200000000 + F.col("user_id")).alias("mmsi"), "event_type").agg(minutes.alias("minutes"))
    best = m.groupBy("mmsi").agg(F.min(F.struct((-F.col("minutes")).alias("less"), "event_type")).alias("b"))
    return best.select("mmsi", F.when(F.col("b.event_type") == "error", "drift").otherwise(F.col("b.event_type")).alias("behaviour"), F.round(-F.col("b.less"), 4).alias("minutes"))


@query(f"""{{DET}}, {LATEST}, s AS (SELECT mmsi, (frame_idx * 37 % 100) / 100.0::DOUBLE AS draw, (mmsi % 5 + 1)::DOUBLE AS a, (mmsi % 3 + 1)::DOUBLE AS b, (mmsi % 7)::DOUBLE AS c FROM last) SELECT mmsi, CASE WHEN draw * (a + b + c) <= a THEN 'maintain_course' WHEN draw * (a + b + c) <= a + b THEN 'maneuver' ELSE 'drift' END AS behaviour FROM s""")
def weighted_choice(spark, sf_dir):
    """The behaviour that a draw picks from weights, by their running sums in order."""
    k = F.col("mmsi")
    weights = {"maintain_course": (k % 5 + 1).cast("double"), "maneuver": (k % 3 + 1).cast("double"), "drift": (k % 7).cast("double")}
    return movement.latest(det(spark, sf_dir), NOW, SILENT).select("mmsi", labels.chosen(weights, F.col("frame_idx") * 37 % 100 / 100).alias("behaviour"))


@query(f"""{{DET}}, s AS (SELECT *, user_id // 12 AS mission, {STATE} AS dark FROM det), f AS (SELECT mission, frame_idx, count(*) AS n_tracks, count(*) FILTER (WHERE dark) AS n_dark, count(*) FILTER (WHERE NOT (dark AND source = 'ais')) AS n_meas, count(*) FILTER (WHERE dark AND source = 'ais') AS n_suppressed, count(*) FILTER (WHERE NOT dark) AS n_matched FROM s GROUP BY 1, 2),
g AS (SELECT a.mission, a.frame_idx + 1 AS frame_idx, count(*) AS n_removed, min(a.mmsi) AS first_removed FROM s a LEFT JOIN s b ON a.mmsi = b.mmsi AND b.frame_idx = a.frame_idx + 1 WHERE b.mmsi IS NULL GROUP BY 1, 2)
SELECT f.*, printf('%d:%02d:%02d', f.frame_idx * 30 // 3600, f.frame_idx * 30 % 3600 // 60, f.frame_idx * 30 % 60) AS clock, coalesce(n_removed, 0) AS n_removed, coalesce(first_removed, 0) AS first_removed FROM f LEFT JOIN g ON f.mission = g.mission AND f.frame_idx = g.frame_idx""")
def frame_deltas(spark, sf_dir):
    """What a frame's message to clients counts, its clock and the contacts that are gone since the frame before."""
    d = watched(spark, sf_dir).withColumn("mission", mission())
    hidden = F.col("dark") & (F.col("source") == "ais")
    f = d.groupBy("mission", "frame_idx").agg(F.count(F.lit(1)).alias("n_tracks"), F.count_if("dark").alias("n_dark"), F.count_if(~hidden).alias("n_meas"), F.count_if(hidden).alias("n_suppressed"), F.count_if(~F.col("dark")).alias("n_matched"))
    gone = d.groupBy("mission", "mmsi").agg((F.max("frame_idx") + 1).alias("frame_idx")).groupBy("mission", "frame_idx").agg(F.count(F.lit(1)).alias("n_removed"), F.min("mmsi").alias("first_removed"))
    s = F.col("frame_idx") * 30
    clock = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return f.join(gone, ["mission", "frame_idx"], "left").withColumn("clock", clock).withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in ("n_removed", "first_removed")})


@query("""{DET} SELECT user_id // 12 AS mission, max(frame_idx) + 1 AS n_frames, 30.0 * (max(frame_idx) + 1) AS duration_s, count(DISTINCT mmsi) AS n_vessels FROM det GROUP BY 1""")
def mission_properties(spark, sf_dir):
    """Frames, duration and contacts of each mission, counted from one row per contact."""
    c = det(spark, sf_dir).groupBy(mission().alias("mission"), "mmsi").agg(F.max("frame_idx").alias("f"))
    return c.groupBy("mission").agg((F.max("f") + 1).alias("n_frames"), (30.0 * (F.max("f") + 1)).alias("duration_s"), F.count(F.lit(1)).alias("n_vessels"))


@query("""{DET}, h AS (SELECT frame_idx AS g, 'h_0' || mmsi % 3 || repeat('a', (mmsi % 4)::INT) || CASE WHEN mmsi % 2 = 0 THEN 'b' ELSE '' END AS id, event_type <> 'view' AS live FROM det), r AS (SELECT *, regexp_replace(id, '[ab]+$', '') AS root, length(id) - 4 AS depth FROM h)
SELECT g AS frame_idx, root, count(DISTINCT id) FILTER (WHERE live) AS n_live, max(depth)::BIGINT AS max_depth, min(id) FILTER (WHERE live) AS first_live FROM r GROUP BY 1, 2""")
def hypothesis_roots(spark, sf_dir):
    """Live leaves, depth and first leaf of each root: an id is its root's with a letter for each split."""
    m = F.col("mmsi")
    name = F.concat(F.lit("h_0"), text(m % 3), F.repeat(F.lit("a"), (m % 4).cast("int")), F.when(m % 2 == 0, "b").otherwise(""))
    h = det(spark, sf_dir).select("frame_idx", name.alias("id"), (F.col("event_type") != "view").alias("live"))
    root = F.regexp_replace("id", "[ab]+$", "")
    h = h.withColumn("root", root).groupBy("frame_idx", "root", "id").agg(F.bool_or("live").alias("live"))
    leaf = F.when(F.col("live"), F.col("id"))
    return h.groupBy("frame_idx", "root").agg(F.count(leaf).alias("n_live"), F.max(F.length("id") - F.length("root")).cast("long").alias("max_depth"), F.min(leaf).alias("first_live"))


@query("""{DET}, a AS (SELECT mmsi, min(t_abs) AS t0, max(t_abs) - min(t_abs) AS total FROM det GROUP BY 1), m AS (SELECT det.mmsi, t_abs - t0 AS t, total, total * (det.mmsi % 11) / 10.0 AS goal FROM det JOIN a USING (mmsi) WHERE total > 0),
s AS (SELECT mmsi, any_value(goal) AS goal, any_value(total) AS total, coalesce(max(t) FILTER (WHERE t < goal AND t < total), 0) AS lo, coalesce(min(t) FILTER (WHERE t >= goal AND t > 0), any_value(total)) AS hi FROM m GROUP BY 1) SELECT mmsi, round(lo, 3) AS seg_start, round(hi, 3) AS seg_end, round(greatest(0, least(1, (goal - lo) / greatest(0.0001, hi - lo))), 5) AS fraction FROM s""")
def timeline_position(spark, sf_dir):
    """The segment of each contact's timeline, and the place in it, at a share of its whole length."""
    d = det(spark, sf_dir).select("mmsi", "t_abs")
    ends = d.groupBy("mmsi").agg(F.min("t_abs").alias("t0"), (F.max("t_abs") - F.min("t_abs")).alias("total")).where("total > 0").withColumn("at", F.col("total") * (F.col("mmsi") % 11) / 10)
    t, at = F.col("t_abs") - F.col("t0"), F.col("at")
    s = d.join(ends, "mmsi").groupBy("mmsi", "at", "total").agg(F.coalesce(F.max(F.when((t < at) & (t < F.col("total")), t)), F.lit(0.0)).alias("lo"), F.min(F.when((t >= at) & (t > 0), t)).alias("hi"))
    hi = F.coalesce("hi", "total")
    fraction = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - F.col("lo")) / F.greatest(F.lit(0.0001), hi - F.col("lo"))))
    return s.select("mmsi", r("lo", 3).alias("seg_start"), F.round(hi, 3).alias("seg_end"), r(fraction, 5).alias("fraction"))


@query(f"""{{DET}}, {LATEST}, l AS (SELECT mmsi, mmsi % 100 AS code, age_s / 40 AS age, {LAT} AS lat, {LON} AS lon, abs(x) * CASE WHEN mmsi % 5 = 0 THEN 90 ELSE 1 END AS m FROM last)
SELECT mmsi, CASE WHEN code <= 0 THEN NULL WHEN code = 30 THEN 'Fishing' WHEN code IN (31, 32) THEN 'Towing' WHEN code = 33 THEN 'Dredging' WHEN code = 34 THEN 'Diving operations' WHEN code = 35 THEN 'Military operations' WHEN code = 36 THEN 'Sailing' WHEN code = 37 THEN 'Pleasure craft' WHEN code BETWEEN 40 AND 49 THEN 'High-speed craft' WHEN code = 50 THEN 'Pilot vessel' WHEN code = 51 THEN 'Search and rescue'
 WHEN code = 52 THEN 'Tug' WHEN code = 53 THEN 'Port tender' WHEN code = 55 THEN 'Law enforcement' WHEN code = 58 THEN 'Medical transport' WHEN code BETWEEN 60 AND 69 THEN 'Passenger' WHEN code BETWEEN 70 AND 79 THEN 'Cargo' WHEN code BETWEEN 80 AND 89 THEN 'Tanker' WHEN code BETWEEN 90 AND 99 THEN 'Other' ELSE 'AIS type ' || code END AS ship_type,
 CASE WHEN age < 120 THEN floor(age + 0.5)::BIGINT || ' seconds' WHEN age < 3600 THEN floor(age / 60)::BIGINT || ' minutes' ELSE floor(age / 3600)::BIGINT || 'h' || CASE WHEN floor(age / 60)::BIGINT % 60 > 0 THEN ' ' || floor(age / 60)::BIGINT % 60 || 'm' ELSE '' END END AS silent,
 printf('%.4f° ', abs(lat)) || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS lat, printf('%.4f° ', abs(lon)) || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END AS lon, CASE WHEN m / 1852 < 1 THEN format('{{:,}}', floor(m + 0.5)::BIGINT) || ' m' WHEN m / 1852 >= 100 THEN printf('%.0f NM', m / 1852) ELSE printf('%.1f NM', m / 1852) END AS distance FROM l""")
def display_labels(spark, sf_dir):
    """Each contact's type, silence, position and distance as clients show them."""
    d = movement.latest(det(spark, sf_dir), NOW, SILENT)
    lat, lon = geo.to_lla(F.col("x"), F.col("y"), 36.75, -121.95)
    far = F.abs("x") * F.when(F.col("mmsi") % 5 == 0, 90).otherwise(1)
    return d.select("mmsi", labels.ship_type(F.col("mmsi") % 100).alias("ship_type"), labels.silence(F.col("age_s") / 40).alias("silent"), labels.degrees(lat, "N", "S").alias("lat"), labels.degrees(lon, "E", "W").alias("lon"), labels.distance(far).alias("distance"))


@query("""SELECT event_id, concat_ws(' · ', CASE WHEN event_id % 5 = 0 THEN event_type WHEN event_id % 3 = 0 THEN 'no-take MPA reference' WHEN event_id % 2 = 0 THEN 'marine protected area' END, CASE WHEN event_id % 4 = 0 THEN 'EEZ' END, CASE event_id % 4 WHEN 1 THEN 'RFMO a' WHEN 2 THEN 'RFMO a, b' WHEN 3 THEN 'RFMO a, b' END) AS regions FROM events""")
def region_texts(spark, sf_dir):
    """What the regions of each event are called."""
    k = F.col("event_id")
    some = lambda c, *names: F.when(c, F.array(*[F.lit(n) for n in names]))
    protected = F.when(k % 5 == 0, F.array(F.lit(""), F.col("event_type")))
    rfmo = F.slice(F.array(*map(F.lit, "abc")), 1, (k % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", labels.region(protected, some(k % 3 == 0, "x"), some(k % 2 == 0, "x"), some(k % 4 == 0, "x"), rfmo).alias("regions"))


@query("""SELECT p_partkey, CASE WHEN length(v) <= 132 THEN v ELSE rtrim(left(v, 129)) || '...' END AS detail FROM (SELECT p_partkey, trim(repeat(p_name || ' ', (1 + p_partkey % 20)::INT)) AS v FROM part)""")
def elided_details(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", labels.elided(F.repeat(F.concat("p_name", F.lit("  ")), (1 + F.col("p_partkey") % 20).cast("int"))).alias("detail"))


@query(f"""{{DET}}, l AS (SELECT event_id, mmsi, frame_idx, {LAT} AS lat, {LON} AS lon FROM det), o AS (SELECT mmsi, lat AS lat0, lon AS lon0 FROM l WHERE frame_idx = 0) SELECT event_id, round((lon - lon0) * 111320 * cos(radians(lat0)) * cos(radians(95)) - (lat - lat0) * 111320 * sin(radians(95)), 3) + 0.0 AS cross_m FROM l JOIN o USING (mmsi)""")
def cross_track(spark, sf_dir):
    """How far each report lies across the bearing 95 through its contact's first one."""
    d = placed(spark, sf_dir).select("event_id", "mmsi", "frame_idx", "lat", "lon")
    o = d.groupBy("mmsi").agg(F.min_by(F.struct("lat", "lon"), "frame_idx").alias("o"))
    d = d.join(o, "mmsi")
    east, north, b = (F.col("lon") - F.col("o.lon")) * 111320 * F.cos(F.radians("o.lat")), (F.col("lat") - F.col("o.lat")) * 111320, F.radians(F.lit(95.0))
    return d.select("event_id", (r(east * F.cos(b) - north * F.sin(b), 3) + 0.0).alias("cross_m"))


@query(f"""{{DET}}, l AS (SELECT event_id, {LAT} AS lat, {LON} AS lon FROM det) SELECT event_id, CASE WHEN event_id % 4 = 0 THEN true ELSE lon BETWEEN -121.97 AND -121.9 AND lat BETWEEN 36.7 AND 36.8 END AS available, CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 WHEN lon BETWEEN -121.97 AND -121.9 AND lat BETWEEN 36.7 AND 36.8 THEN lat > 36.76 ELSE false END AS on_land FROM l""")
def terrain_status(spark, sf_dir):
    """Land or water by global tiles where there are any, else by the local coast inside its extent, else unknown."""
    k = F.col("event_id")
    local = F.col("lon").between(-121.97, -121.9) & F.col("lat").between(36.7, 36.8)
    told = lambda available, land: F.struct(available.alias("available"), land.alias("on_land"))
    found = F.coalesce(F.when(k % 4 == 0, told(F.lit(True), k % 8 == 0)), told(local, local & (F.col("lat") > 36.76)))
    return placed(spark, sf_dir).select("event_id", found.alias("f")).select("event_id", "f.*")


@query(f"""{{DET}}, s AS (SELECT *, {STATE} AS dark FROM det), h AS (SELECT frame_idx, count(*) FILTER (WHERE event_type IN ('signup', 'click')) AS n_open, count(*) FILTER (WHERE event_type IN ('signup', 'click', 'view')) AS n_live, count(*) FILTER (WHERE dark) AS n_silent FROM s GROUP BY 1)
SELECT * FROM h ORDER BY frame_idx DESC LIMIT 400""")
def fusion_log(spark, sf_dir):
    """The newest 400 frames of the log: tracks that are open, live in any status, and silent."""
    d, kind = watched(spark, sf_dir), F.col("event_type")
    f = d.groupBy("frame_idx").agg(F.count_if(kind.isin("signup", "click")).alias("n_open"), F.count_if(kind.isin("signup", "click", "view")).alias("n_live"), F.count_if("dark").alias("n_silent"))
    return f.orderBy(F.desc("frame_idx")).limit(400)
