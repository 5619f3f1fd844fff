"""Zone watch, alerts, evaluation of narratives, vocabulary and the inputs of forecasts, as Column expressions and windows."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import movement

#: Severities of entering a zone and of being silent inside one, by kind of zone.
ENTERED = {"mpa": "warning", "danger": "warning", "cable": "warning", "port": "info"}
SILENT_INSIDE = {"mpa": "emergency", "danger": "critical", "cable": "critical", "port": "critical"}
#: The kind that each name of a kind of zone stands for.
KINDS = {
    "cable": "cable",
    "cable_corridor": "cable",
    "corridor": "cable",
    "pipeline": "cable",
    "submarine_cable": "cable",
    "subsea_cable": "cable",
    "danger": "danger",
    "danger_zone": "danger",
    "exclusion": "danger",
    "exclusion_zone": "danger",
    "hazard": "danger",
    "military": "danger",
    "military_area": "danger",
    "restricted": "danger",
    "restricted_area": "danger",
    "coast": "land",
    "coastline": "land",
    "land": "land",
    "landmask": "land",
    "shore": "land",
    "shoreline": "land",
    "terrain": "land",
    "marine_protected_area": "mpa",
    "marine_sanctuary": "mpa",
    "mpa": "mpa",
    "national_marine_sanctuary": "mpa",
    "nms": "mpa",
    "preserve": "mpa",
    "protected": "mpa",
    "protected_area": "mpa",
    "reserve": "mpa",
    "sanctuary": "mpa",
    "anchorage": "port",
    "berth": "port",
    "harbor": "port",
    "harbour": "port",
    "port": "port",
    "terminal": "port",
}
#: Priors of behaviours of a contact that is moored, anchored, aground or nearly at rest.
AT_REST = {"drift": 0.43, "stopped": 0.20, "slow_maneuver": 0.20, "maintain_course": 0.12, "course_reversal": 0.05, "maneuver": 0.0}


def lookup(value: Column, table: dict[str, str], default: str | None = None) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), value), F.lit(default))


def watch(points: DataFrame, zones=movement.ZONES) -> DataFrame:
    """mmsi, frame_idx, type, zone_id, severity of what each report (mmsi, frame_idx, x, y, dark) changed.

    A contact that is silent inside a zone raises one alert for each stay in it and each silence, that is, if it
    wasn't silent in that zone at its report before; so the state is the row before, and a window has it.
    """
    w = W.partitionBy("mmsi").orderBy("frame_idx")
    none = F.array().cast("array<string>")
    d = movement.inside(points, zones).withColumn("was", F.coalesce(F.lag("zones_in").over(w), none)).withColumn("was_dark", F.coalesce(F.lag("dark").over(w), F.lit(False)))
    kind = {z: k for z, k, _ in zones}

    def event(name: str, severity):
        return lambda z: F.struct(F.lit(name).alias("type"), z.alias("zone_id"), severity(z).alias("severity"))

    fixed = lambda s: lambda z: F.lit(s)
    by_kind = lambda table, default: lambda z: lookup(z, {i: table.get(k, default) for i, k in kind.items()}, default)
    when = lambda c, name, s: F.when(c, F.array(event(name, fixed(s))(F.lit("")))).otherwise(F.array())
    silent = F.when(F.col("dark"), F.when(F.col("was_dark"), F.array_except("zones_in", "was")).otherwise(F.col("zones_in"))).otherwise(none)
    all_ = F.concat(
        F.transform(F.array_except("was", "zones_in"), event("geofence_exit", fixed("info"))),
        F.transform(F.array_except("zones_in", "was"), event("geofence_enter", by_kind(ENTERED, "warning"))),
        when(F.col("dark") & ~F.col("was_dark") & (F.size("zones_in") == 0), "ais_dark", "warning"),
        when(~F.col("dark") & F.col("was_dark"), "ais_resume", "info"),
        F.transform(silent, event("dark_inside_protected_area", by_kind(SILENT_INSIDE, "critical"))),
    )
    return d.select("mmsi", "frame_idx", F.explode(all_).alias("e")).select("mmsi", "frame_idx", "e.*")


def severity(kind: Column, protected: Column, dark: Column) -> Column:
    """Severity of an alert; protected: the zone is a sanctuary or restricted."""
    return (
        F.when(kind == "intrusion", F.when(dark, "critical").when(protected, "warning").otherwise("info"))
        .when(kind.isin("went_dark", "identity_change"), "warning")
        .when((kind == "reacquired") & dark, "warning")
        .otherwise("info")
    )


def zone_kind(raw: Column) -> Column:
    """The kind that a free spelling means; null if it is unknown."""
    token = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"[ ./-]", "_"), "_+", "_"), F.lit("_"))
    return lookup(token, KINDS)


#: Prior weight of each behaviour of a moving contact, and what full doubt and a full turn add to it.
MOVING = {
    "maneuver": (0.18, 0.12, 0.12),
    "course_reversal": (0.035, 0.045, 0.0),
    "drift": (0.035, 0.04, 0.0),
    "stopped": (0.025, 0.035, 0.0),
    "slow_maneuver": (0.04, 0.0, 0.04),
}
#: Statuses of rest, the speed below which a contact rests, the age (s), gaps and turn rate at which doubt and turn are full, and the least weight of keeping course.
RESTING, SLOW, FULL_AGE, FULL_GAPS, FULL_TURN, LEAST_COURSE = (1, 5, 6), 0.8, 3600, 8, 1.5, 0.2


def behaviour_priors(speed: Column, status: Column, turn: Column, age_s: Column, missing: Column) -> dict[str, Column]:
    """Prior of each behaviour by a contact's last state; they add up to 1. Weights come from MOVING, keeping course takes what they leave."""
    full = lambda c: F.least(F.lit(1.0), c)
    doubt, turned = full(age_s / FULL_AGE + missing / FULL_GAPS), full(F.abs(turn) / FULL_TURN)
    weights = {name: base + by_doubt * doubt + by_turn * turned for name, (base, by_doubt, by_turn) in MOVING.items()}
    taken = reduce(add, weights.values())
    weights["maintain_course"] = F.greatest(F.lit(LEAST_COURSE), 1 - taken)
    at_rest = status.isin(*RESTING) | (speed < SLOW)
    return {name: F.when(at_rest, F.lit(AT_REST[name])).otherwise(w / (taken + weights["maintain_course"])) for name, w in weights.items()}


def detail(kind: Column, severity: Column, label: Column, dark: Column, zone: Column, t: Column) -> Column:
    """The line of an alert. The wording is fixed, as clients show it; t in whole seconds is h:mm:ss."""
    s = F.floor(t).cast("long")
    stamp = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    head = F.concat(F.lit("["), stamp, F.lit("] "), F.upper(severity), F.lit(": "))
    said = (
        F.when(kind == "intrusion", F.concat(label, F.when(dark, " (DARK, position predicted) entered ").otherwise(" (tracked) entered "), zone))
        .when(kind == "went_dark", F.concat(label, F.lit(" stopped transmitting; coasting on prediction, uncertainty growing")))
        .when(kind == "reacquired", F.concat(F.lit("unlabelled detection fused into "), label, F.lit(" after dark period")))
        .when(kind == "identity_change", F.concat(F.lit("displayed identity of "), label, F.lit(" changed")))
        .otherwise(F.concat(kind, F.lit(" on "), label))
    )
    return F.concat(head, said)


def raised(rows: DataFrame, mission: str, order: list[str]) -> DataFrame:
    """rows with alert_id: A-001 and so on within each mission, in the given order."""
    n = F.row_number().over(W.partitionBy(mission).orderBy(*order))
    return rows.withColumn("alert_id", F.concat(F.lit("A-"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))))


def windage(ship_type: Column, draught: Column) -> tuple[Column, Column]:
    """Least and most share of the wind's speed that an unpowered contact takes."""
    deep = ship_type.between(70, 89) | (draught >= 7)
    light = ship_type.between(30, 39) | ship_type.between(60, 69)
    return F.when(deep, 0.012).when(light, 0.02).otherwise(0.015), F.when(deep, 0.025).otherwise(0.04)


def time_steps(silent_min: Column, ahead_min: float = 30.0, most: float = 1440.0) -> Column:
    """Array of minutes: steps of 2 in the first hour of silence, of 5 in the next five, of 15 after, and of 2 in the forecast."""
    silent = F.greatest(F.lit(0.0), F.least(F.lit(most), silent_min))

    def phase(lo: Column, hi: Column, step: float) -> Column:
        last = F.greatest(F.ceil((hi - lo - 1e-9) / step).cast("int") - 1, F.lit(0))
        steps = F.transform(F.sequence(F.lit(0), last), lambda k: F.least(F.lit(step), hi - lo - k * step))
        return F.when(hi - lo > 1e-9, steps).otherwise(F.array().cast("array<double>"))

    hour, six = F.lit(60.0), F.lit(360.0)
    return F.concat(phase(F.lit(0.0), F.least(silent, hour), 2.0), phase(hour, F.least(silent, six), 5.0), phase(six, silent, 15.0), phase(silent, silent + ahead_min, 2.0))


def forecast_radius_km(age_s: Column, speed_kn: Column) -> Column:
    """How far around its last position a silent contact's forecast looks for conditions."""
    hours = F.least(F.lit(24.0), F.greatest(F.lit(0.0), age_s / 3600))
    speed = F.when(F.isnan(speed_kn) | (speed_kn >= 50), 5.0).otherwise(F.greatest(F.lit(0.0), speed_kn))
    return F.least(F.lit(700.0), F.greatest(F.lit(35.0), (speed * (hours + 0.5) + 20.0) * 1.852))


def timing(value: Column, duration: Column, earlier: Column | None = None, events: Column | None = None) -> Column:
    """PASS, FAIL or SKIP of a moment of a narrative: inside the window, after the moment before it if there is one, at one of the events."""
    good = value.between(0, duration)
    if earlier is not None:
        good = good & F.coalesce(value > earlier, F.lit(True))
    if events is not None:
        good = good & F.coalesce(F.exists(events, lambda t: F.abs(t - value) <= 1e-6), F.lit(False))
    return F.when(value.isNull(), "SKIP").when(good, "PASS").otherwise("FAIL")


def separation(actual: Column, wanted: float) -> Column:
    """PASS, MARGIN (by less than a hundredth, which the earth model decides) or FAIL of a distance."""
    return F.when(actual < wanted, "FAIL").when(actual - wanted < 0.01 * wanted, "MARGIN").otherwise("PASS")


def unique_ids(rows: DataFrame, name: str, order: str) -> DataFrame:
    """rows with uid: the first of a name keeps it, each later one gets the lowest #number that is free.

    A number is taken if any row is given it as its name, before or after, so no name that was given is ever minted. The
    k-th free number of a name is k and as many more as taken ones lie below it; a taken a, the i-th of its name, lies
    below if a - i < k. So rows and taken numbers are counted in one window. A null name stays null.
    """
    base, number = F.regexp_extract(name, r"(?s)^(.*)#([1-9][0-9]*)$", 1), F.expr(f"try_cast(regexp_extract(`{name}`, '(?s)^(.*)#([1-9][0-9]*)$', 2) AS bigint)")
    given = rows.select(name).distinct().select(base.alias("_name"), number.alias("_number")).where("_number IS NOT NULL")
    taken = given.select("_name", (F.col("_number") - F.row_number().over(W.partitionBy("_name").orderBy("_number"))).alias("_k"), F.lit(1).alias("_taken"))
    k = F.row_number().over(W.partitionBy(name).orderBy(order)) - 1
    held = rows.withColumns({"_name": F.col(name), "_k": k.cast("long"), "_taken": F.lit(0)})
    more = F.sum("_taken").over(W.partitionBy("_name").orderBy("_k", "_taken").rowsBetween(W.unboundedPreceding, 0))
    d = held.unionByName(taken, allowMissingColumns=True).withColumn("_more", more).where("_taken = 0")
    uid = F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), (F.col("_k") + F.col("_more")).cast("string")))
    return d.withColumn("uid", uid).drop("_name", "_k", "_taken", "_more")


def merged(state: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """The state after a delta (the same columns and ``gone``): rows of the delta replace or add, those marked gone remove."""
    untouched = state.join(delta.select(key), key, "left_anti")
    return untouched.unionByName(delta.where("NOT gone").drop("gone"))


def scan_collapsed(leaves: DataFrame, depth: int = 3) -> DataFrame:
    """leaves (group, root, hyp_id, weight, depth) that stay: a branch with two leaves or more, one of them that deep, keeps its heaviest only."""
    w = W.partitionBy("group", "root")
    rank = F.row_number().over(w.orderBy(F.desc("weight"), "hyp_id"))
    d = leaves.withColumns({"_rank": rank, "_deep": F.max("depth").over(w) >= depth})
    return d.where(~F.col("_deep") | (F.col("_rank") == 1)).drop("_rank", "_deep")
