"""Costs of responses: rates from files, signals of contacts, options and digests."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import responses
from tidemark.sources import files

#: Hourly rates in dollars that the published tiers come from.
RATES = {"personnel_hourly_usd": {"E-5": 96, "E-6": 110, "O-3": 149}, "boats_hourly_usd": {"Response Boat - Small (II)": 4690, "Response Boat - Medium": 9321}, "aircraft_hourly_usd": {"MH-65 Dolphin": 19346, "MH-60 Jayhawk": 30026}}


def priced(spark, tmp_path, rates=None):
    path = tmp_path / "rates.json"
    path.write_text(json.dumps({"source": {"rate_schedule": "FY26", "effective_date": "2025-10-01"}, "note": "x", **(rates or RATES)}))
    return responses.priced_tiers(responses.uses(spark), files.rates(spark, str(path)))


def test_tiers_come_from_the_rate_file(spark, tmp_path):
    got = {r.tier: (r.low_usd, r.high_usd, r.missing) for r in priced(spark, tmp_path).collect()}
    assert got == {"desk_review": (192, 589, []), "on_water_verification": (4690, 27963, []), "air_support": (19346, 90078, [])}
    read = files.rates(spark, str(tmp_path / "rates.json")).collect()
    assert {(r.unit, r.schedule, r.effective) for r in read} == {(u, "FY26", "2025-10-01") for u in ("personnel", "boats", "aircraft")}


def test_a_missing_rate_is_named_and_a_clash_is_an_error(spark, tmp_path):
    got = {r.tier: (r.low_usd, r.missing) for r in priced(spark, tmp_path, {"personnel_hourly_usd": {"E-5": 96, "O-3": 149, "E-6": "none"}, "boats_hourly_usd": RATES["boats_hourly_usd"]}).collect()}
    assert got == {"desk_review": (None, ["E-6"]), "on_water_verification": (4690, []), "air_support": (None, ["MH-60 Jayhawk", "MH-65 Dolphin"])}
    with pytest.raises(Exception, match="several rates of E-5"):
        priced(spark, tmp_path, {"personnel_hourly_usd": {"E-5": 96}, "boats_hourly_usd": {"E-5": 97}}).collect()


def plainly(alerts, silent):
    out = {}
    for g, _, track, kind, severity in sorted((a for a in alerts if a[0] is not None and a[3] in responses.SIGNALS), key=lambda a: (a[1], a[3])):
        c = out.setdefault((g, track or ""), {"signals": [], "rank": 0, "water": False, "air": False})
        c["signals"].append(responses.SIGNALS[kind])
        c["rank"] = max(c["rank"], responses.RANKS.get(severity, 0))
        c["water"] |= kind in ("intrusion", "went_dark")
        c["air"] |= kind == "intrusion" and severity == "critical"
    for g, track in silent:
        if g is not None:
            c = out.setdefault((g, track or ""), {"signals": [], "rank": 1, "water": True, "air": False})
            c["signals"].append(responses.SIGNALS["dark_monitoring"])
            c["water"] = True
    names = {n: s for s, n in responses.RANKS.items()}
    return {k: (tuple(dict.fromkeys(c["signals"])), names[c["rank"]], c["water"], c["air"]) for k, c in out.items()}


def test_signals_equal_a_plain_loop(spark):
    kinds = [*responses.SIGNALS, "unknown", None]
    severities = ["info", "warning", "critical", "odd", None]
    alerts = [(n % 4 if n % 11 else None, n // 2, None if n % 13 == 0 else f"t{n % 9}", kinds[n * 5 % 7], severities[n * 3 % 5]) for n in range(400)]
    silent = [(n % 5, f"t{n % 11}") for n in range(25)] + [(None, "t1"), (9, None), (9, None)]
    # Of alerts of equal ord and kind the severities differ, which only the gravest tells.
    a = spark.createDataFrame(alerts, "g long, ord long, track_id string, kind string, severity string")
    got = {(r.g, r.track_id): (tuple(r.signals), r.severity, r.on_water, r.air) for r in responses.contact_signals(a, spark.createDataFrame(silent, "g long, track_id string"), "g").collect()}
    # dark_monitoring as an alert keeps its place and isn't told twice
    assert got == plainly(alerts, silent)
    assert responses.contact_signals(a.limit(0), spark.createDataFrame([], "g long, track_id string"), "g").count() == 0


def test_options_are_alternatives(spark, tmp_path):
    c = spark.createDataFrame([(1, "a", ["s"], "info", False, False), (1, "b", ["s"], "critical", True, True), (2, "", ["s"], "warning", False, True), (3, "c", [], "info", True, True)], "g int, track_id string, signals array<string>, severity string, on_water boolean, air boolean")
    o = responses.options(c, priced(spark, tmp_path))
    assert sorted((r.g, r.track_id, r.ord, r.tier, r.conditional) for r in o.collect()) == [
        (1, "a", 0, "desk_review", False), (1, "b", 0, "desk_review", False), (1, "b", 1, "on_water_verification", True), (1, "b", 2, "air_support", True), (2, "", 0, "desk_review", False), (2, "", 1, "air_support", True),
    ]
    assert {r.label for r in o.where("g = 2").collect()} == {"Desk review", "Aircraft support, if authorized"}
    assert sorted(tuple(r) for r in responses.ranges(o, "g").collect()) == [(1, 2, 4, 192.0, 90078.0), (2, 1, 2, 192.0, 90078.0)]


def test_risk_of_nulls_is_no_risk(spark):
    d = spark.createDataFrame([(1, None, None, None, None, None, None), (2, True, None, True, True, None, True), (3, None, True, True, None, True, None)], "id int, a boolean, b boolean, c boolean, d boolean, e boolean, f boolean")
    risk = responses.live_risk(*[F.col(c) for c in "abcdef"])
    got = {r.id: (r.signals, r.severity, r.on_water, r.air) for r in d.select("id", *[c.alias(n) for n, c in risk.items()]).collect()}
    assert got[1] == ([], "warning", False, False)
    assert got[2] == (["AIS-silent contact in protected water", "Contact near a monitored port", "Reported position plots on land"], "critical", True, True)
    assert got[3] == (["Sanctions-list identity match", "Contact near submarine infrastructure"], "critical", False, False)


def test_digests_by_time(spark):
    alerts = spark.createDataFrame([(1, 9.0, 1, "late"), (1, 2.0, 5, "b"), (1, 2.0, 4, "a"), (1, None, 4, None)], "g int, t double, ord int, detail string")
    tracks = spark.createDataFrame([(1, "x", "coasting"), (1, "y", "confirmed"), (1, "z", "dead"), (7, "z", "coasting")], "g int, track_id string, status string")
    clocks = spark.createDataFrame([(1, "00:10"), (2, "00:20")], "g int, clock string")
    got = {r.g: (r.text, r.n_alerts) for r in responses.digests(alerts, tracks, clocks, "g").collect()}
    assert got[1] == ("Situation at 00:10: 2 tracks held, 1 coasting without AIS. Alerts:  | a | b | late", 4)
    assert got[2] == ("Situation at 00:20: 0 tracks held, 0 coasting without AIS. No alerts raised.", 0)
