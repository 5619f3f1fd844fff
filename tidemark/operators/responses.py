"""What responses to alerts and silent contacts would cost, by tables of tiers and of hourly rates.

Options are alternatives: their costs are never added up, so a range runs from the least of the lows to the most of the
highs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours of each resource in the cheapest and the dearest form of each tier.
TIERS = (
    ("desk_review", "E-5", 2.0, 0.0),
    ("desk_review", "E-6", 0.0, 4.0),
    ("desk_review", "O-3", 0.0, 1.0),
    ("on_water_verification", "Response Boat - Small (II)", 1.0, 0.0),
    ("on_water_verification", "Response Boat - Medium", 0.0, 3.0),
    ("air_support", "MH-65 Dolphin", 1.0, 0.0),
    ("air_support", "MH-60 Jayhawk", 0.0, 3.0),
)
#: In what order the tiers are shown and how.
LABELS = {"desk_review": "Desk review", "on_water_verification": "On-water verification, if dispatched", "air_support": "Aircraft support, if authorized"}
#: What each kind of alert is called as a signal; other kinds are none.
SIGNALS = {
    "intrusion": "Protected-water alert",
    "went_dark": "AIS transmission lost",
    "dark_monitoring": "AIS-silent contact",
    "reacquired": "AIS transmission resumed",
    "identity_change": "Vessel identity changed",
}
#: Ranks of severities; others rank lowest.
RANKS = {"info": 0, "warning": 1, "critical": 2}
NONE = "CAST(array() AS array<string>)"


def looked_up(value: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def uses(spark, tiers=TIERS) -> DataFrame:
    """tier, resource, low_hours, high_hours as a table."""
    return spark.createDataFrame(list(tiers), "tier string, resource string, low_hours double, high_hours double")


def priced_tiers(tiers: DataFrame, rates: DataFrame) -> DataFrame:
    """tier, low_usd, high_usd, missing: the costs of each tier (tier, resource, low_hours, high_hours) by the rates (resource, usd) an hour.

    A tier any of whose resources has no rate, a null one included, has null costs and names them in missing. A resource with several different
    rates is an error, as the price would depend on the order of the rows; equal ones count once.
    """
    rate = rates.where(F.col("resource").isNotNull()).groupBy("resource").agg(F.min("usd").cast("double").alias("usd"), F.max("usd").cast("double").alias("_most"))
    clash = F.raise_error(F.concat(F.lit("several rates of "), F.col("resource"))).cast("double")
    rate = rate.withColumn("usd", F.when(F.col("usd") != F.col("_most"), clash).otherwise(F.col("usd"))).drop("_most")
    d = tiers.join(rate, "resource", "left")
    whole = F.count_if(F.col("usd").isNull()) == 0
    cost = lambda c: F.when(whole, F.sum(F.col(c) * F.col("usd")))
    missing = F.sort_array(F.collect_set(F.when(F.col("usd").isNull(), F.coalesce("resource", F.lit("")))))
    return d.groupBy("tier").agg(cost("low_hours").alias("low_usd"), cost("high_hours").alias("high_usd"), missing.alias("missing"))


def contact_signals(alerts: DataFrame, silent: DataFrame, group: str) -> DataFrame:
    """(group, track_id, signals, severity, on_water, air) of each contact with an alert that is a signal, or that is silent.

    alerts: group, ord, track_id, kind, severity; silent: group, track_id, once or more. Signals stand in the order of their first alert
    (equal ord: by kind), each once, silence last. Severity is the gravest of the alerts, which begin as info; a contact
    that is only silent has warning. A null track is the contact without a name. Rows of a null group go.
    """
    rank = F.coalesce(looked_up(F.col("severity"), RANKS), F.lit(0))
    a = alerts.select(group, "ord", F.coalesce(F.col("track_id").cast("string"), F.lit("")).alias("track_id"), "kind", rank.alias("_rank"), looked_up(F.col("kind"), SIGNALS).alias("_signal"))
    a = a.where(F.col(group).isNotNull() & F.col("_signal").isNotNull())
    # One row a signal first, so that a contact of many alerts is never one array of them all.
    per = a.groupBy(group, "track_id", "_signal", "kind").agg(F.min("ord").alias("_ord"), F.max("_rank").alias("_rank"))
    told = per.groupBy(group, "track_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_ord", "kind", "_signal"))), lambda s: s["_signal"]).alias("_signals"), F.max("_rank").alias("_rank"),
        F.bool_or(F.col("kind").isin("intrusion", "went_dark")).alias("_water"), F.bool_or((F.col("kind") == "intrusion") & (F.col("_rank") == RANKS["critical"])).alias("_air"),
    )
    quiet = silent.where(F.col(group).isNotNull()).select(group, F.coalesce(F.col("track_id").cast("string"), F.lit("")).alias("track_id"), F.lit(True).alias("_silent")).distinct()
    d = told.join(quiet, [group, "track_id"], "full")
    names = {n: s for s, n in RANKS.items()}
    is_silent = F.coalesce("_silent", F.lit(False))
    signals = F.concat(F.coalesce("_signals", F.expr(NONE)), F.when(is_silent, F.array(F.lit(SIGNALS["dark_monitoring"]))).otherwise(F.expr(NONE)))
    severity = F.coalesce(looked_up(F.col("_rank"), names), F.lit("warning"))
    return d.select(group, "track_id", F.array_distinct(signals).alias("signals"), severity.alias("severity"), (is_silent | F.coalesce("_water", F.lit(False))).alias("on_water"), F.coalesce("_air", F.lit(False)).alias("air"))


def options(contacts: DataFrame, tiers: DataFrame) -> DataFrame:
    """contacts (signals, severity, on_water, air and others) with tier, ord, label, conditional, low_usd, high_usd: a row for each option that applies.

    A contact with signals gets a desk review, with on_water a boat and with air an aircraft too; one without any gets no
    row. tiers (of priced_tiers) has one row a tier, so Spark may broadcast it.
    """
    some = F.size("signals") > 0
    applies = F.array_compact(F.array(F.when(some, "desk_review"), F.when(some & F.col("on_water"), "on_water_verification"), F.when(some & F.col("air"), "air_support")))
    d = contacts.select("*", F.posexplode(applies).alias("ord", "tier")).join(tiers.select("tier", "low_usd", "high_usd"), "tier", "left")
    name = F.coalesce(F.col("track_id").cast("string"), F.lit(""))
    label = F.concat(looked_up(F.col("tier"), LABELS), F.when(name != "", F.concat(F.lit(" · "), name)).otherwise(""))
    return d.withColumns({"label": label, "conditional": F.col("tier") != "desk_review"})


def ranges(offered: DataFrame, group: str) -> DataFrame:
    """(group, n_contacts, n_options, low_usd, high_usd) over the options of each group; unpriced ones count but have no say in the range."""
    return offered.groupBy(group).agg(F.count_distinct("track_id").alias("n_contacts"), F.count(F.lit(1)).alias("n_options"), F.min("low_usd").alias("low_usd"), F.max("high_usd").alias("high_usd"))


def live_risk(dark: Column, sanctioned: Column, in_sanctuary: Column, in_port: Column, near_cables: Column, on_land: Column) -> dict[str, Column]:
    """signals, severity, on_water and air of a contact by where it is; nulls are no.

    Wording and order of signals are fixed, as clients show them. Without any signal severity is warning too.
    """
    dark, sanctioned, in_sanctuary, in_port, near_cables, on_land = (F.coalesce(c, F.lit(False)) for c in (dark, sanctioned, in_sanctuary, in_port, near_cables, on_land))
    inside = dark & in_sanctuary
    signals = F.array_compact(F.array(
        F.when(sanctioned, "Sanctions-list identity match"), F.when(inside, "AIS-silent contact in protected water").when(dark, "AIS-silent contact"), F.when(in_port, "Contact near a monitored port"),
        F.when(near_cables, "Contact near submarine infrastructure"), F.when(on_land, "Reported position plots on land"),
    ))
    return {"signals": signals, "severity": F.when(sanctioned | inside, "critical").otherwise("warning"), "on_water": dark | on_land, "air": inside}


def digests(alerts: DataFrame, tracks: DataFrame, clocks: DataFrame, group: str) -> DataFrame:
    """(group, text, n_alerts) of each group of clocks (group, clock): how many tracks are held and coast, then the details of its alerts by time.

    tracks: group, track_id, status; dead ones aren't held. alerts: group, t, ord, detail. Equal times go by ord. A group
    without alerts says so. The text holds all details, so a group's text is as long as they are.
    """
    live = tracks.where("status <> 'dead'").groupBy(group).agg(F.count(F.lit(1)).alias("_live"), F.count_if(F.col("status") == "coasting").alias("_coasting"))
    told = alerts.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("t", "ord", F.coalesce("detail", F.lit("")).alias("detail")))).alias("_told"))
    d = clocks.join(live, group, "left").join(told, group, "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    head = F.concat(F.lit("Situation at "), F.col("clock"), F.lit(": "), count("_live"), F.lit(" tracks held, "), count("_coasting"), F.lit(" coasting without AIS."))
    lines = F.when(F.coalesce(F.size("_told"), F.lit(0)) > 0, F.concat(F.lit(" Alerts: "), F.array_join(F.transform("_told", lambda s: s["detail"]), " | "))).otherwise(" No alerts raised.")
    return d.select(group, F.concat(head, lines).alias("text"), F.coalesce(F.size("_told"), F.lit(0)).cast("long").alias("n_alerts"))


