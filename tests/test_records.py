"""Answers of other services, checks of inputs, labels and forecast branches on small tables."""

import math
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tidemark.functions import labels
from tidemark.operators import decisions, forecast
from tidemark.sources import records


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_origins_are_never_turned_round(spark):
    given = texts(spark, '{"lat": 36.75, "lon": -121.95}', "[-121.95, 36.75]", "[36.75, -121.95]", "[10, 20]", "[200, 100]", "[1, 2, 3]", '{"lat": 1}', '{"lat": "NaN", "lon": 2}', "[null, 2]", "nonsense", None)
    rows = [tuple(x) for x in records.origins(given, "value").select("lon", "lat", "problem").collect()]
    assert rows[:4] == [(-121.95, 36.75, None), (-121.95, 36.75, None), (None, None, "swapped"), (10.0, 20.0, None)]
    assert [x[2] for x in rows[4:]] == ["out of range", "length", "missing", "not a number", "missing", "unreadable", "unreadable"]
    with pytest.raises(Exception, match="origin of the pack: "):
        records.required(records.origins(given, "value"), "origin of the pack").collect()


def test_boxes_keep_their_corners(spark):
    given = texts(spark, "[1, 2, 3, 4]", "[3, 2, 1, 4]", "[1, 2, 3, 2]", '{"lon_min": 1, "lat_min": 2, "lon_max": 3, "lat_max": 95}', "[1, 2, 3]", "{}")
    assert [x.problem for x in records.boxes(given, "value").collect()] == [None, "degenerate", "degenerate", "out of range", "length", "missing"]


def test_empty_and_broken_answers(spark):
    raw = texts(spark, "{}", "not json", None, '{"features": [], "entries": []}')
    assert records.ports(raw).count() == 0 and records.activity(raw).count() == 0
    found = records.registry(raw.withColumn("mmsi", F.lit(1))).collect()
    assert [x.matched for x in found] == [False] * 4


def test_own_record_counts_before_a_newer_foreign_one(spark):
    answer = '{"entries": [{"selfReportedInfo": [{"id": "a", "ssvid": "7", "shipname": "", "transmissionDateTo": "2023"}, {"id": "b", "ssvid": "8", "transmissionDateTo": "2024"}], "registryInfo": [{"shipname": "R"}]}]}'
    x = records.registry(texts(spark, answer).withColumn("mmsi", F.lit(7))).first()
    assert (x.vessel_id, x.name, x.ship_types) == ("a", "R", None)


def test_unreadable_times_give_no_duration(spark):
    x = records.activity(texts(spark, '{"entries": [{"id": "1", "type": "gap", "start": "then", "end": "2024-01-01T00:00:00Z", "position": {"lat": 1, "lon": 2}}, {"id": "2", "position": {"lat": null, "lon": 2}}]}')).collect()
    assert [(e.id, e.type, e.duration_hours, e.classification) for e in x] == [("1", "GAP", None, "observed")]


def test_leaks_and_foreign_columns(spark):
    rows = spark.createDataFrame([("m1", "ais"), ("mmsi:5", "ais"), ("5", "radar"), (None, "ais")], "meas_id string, source string")
    actors = spark.createDataFrame([("5",), ("5",)], "actor_id string")
    assert sorted(x.value for x in records.leaks(rows, actors, ("meas_id", "source")).collect()) == ["5", "mmsi:5"]
    with pytest.raises(ValueError, match="mmsi"):
        records.leaks(rows.withColumn("mmsi", F.lit(1)), actors, ("meas_id", "source"))


def test_a_key_in_two_tables_is_an_error(spark):
    a, b = spark.range(3).withColumn("x", F.lit("a")), spark.range(3, 5).withColumn("x", F.lit("b"))
    assert records.united([a, b], ["id"]).count() == 5
    with pytest.raises(Exception, match="key is there twice: 2"):
        records.united([a, spark.range(2, 4).withColumn("x", F.lit("b"))], ["id"]).collect()


def test_unpriced_resources_are_named(spark):
    rates = spark.createDataFrame([("boat", 100.0), ("crew", 10.0)], "resource string, usd double")
    options = spark.createDataFrame([(1, "boat", 1.0, 3.0), (1, "crew", 2.0, 4.0), (2, "plane", 1.0, 1.0)], "option long, resource string, low_hours double, high_hours double")
    got = {x.option: (x.low_usd, x.high_usd, x.missing) for x in decisions.priced(options, rates, "option").collect()}
    assert got == {1: (120.0, 340.0, []), 2: (0.0, 0.0, ["plane"])}


def test_fixed_decimals_are_those_of_the_exact_value(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    at = [k / 20 for k in range(1, 4001)] + [292.5, 293.5, 0.15, 6.25, 0.0, 1e-7, 2.0**52 + 0.5] + list(rng.uniform(0, 400, 2000)) + list(rng.integers(0, 400_000, 2000) / 1000)
    at += [np.nextafter(v, d) for v in at[:4000:7] for d in (0.0, 1e9)]
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(at)], "i long, v double")
    for digits in (0, 1, 2, 4):
        got = {r["i"]: r["t"] for r in d.select("i", labels.fixed(F.col("v"), digits).alias("t")).collect()}
        assert not [(v, got[i]) for i, v in enumerate(at) if got[i] != f"{v:.{digits}f}"]
    assert [r[0] for r in spark.createDataFrame([(6.25 * 1852,), (292.5 * 1852,)], "m double").select(labels.distance(F.col("m"))).collect()] == ["6.2 NM", "292 NM"]


def test_labels(spark):
    d = spark.createDataFrame([(0, 0.0), (72, 119.6), (59, 3599.0), (30, 7260.0), (None, None)], "code int, s double")
    got = [tuple(x) for x in d.select(labels.ship_type(F.col("code")), labels.silence(F.col("s")), labels.distance(F.col("s") * 100)).collect()]
    assert got == [(None, "0 seconds", "0 m"), ("Cargo", "120 seconds", "6.5 NM"), ("AIS type 59", "59 minutes", "194 NM"), ("Fishing", "2h 1m", "392 NM"), (None, "0 seconds", "0 m")]


def branches_by_hand(rows, wanted=6, rounds=8):
    groups = {}
    for s, x, y, b in rows:
        groups.setdefault(b, []).append((s, x, y))
    share = dict.fromkeys(groups, 1)
    while sum(share.values()) < wanted:
        best = max(sorted(groups), key=lambda b: len(groups[b]) / share[b])
        share[best] += 1
    out = {}
    for b, members in groups.items():
        k, xy = min(share[b], len(members)), np.array([m[1:] for m in members])
        order = sorted(range(len(members)), key=lambda i: (math.atan2(members[i][1], members[i][2]), members[i][0]))
        at = np.array([xy[order[min(len(order) - 1, int((c + 0.5) * len(order) / k))]] for c in range(k)])
        for _ in range(rounds):
            mine = ((xy[:, None] - at[None]) ** 2).sum(2).argmin(1)
            last, at = at, np.array([xy[mine == c].mean(0) if (mine == c).any() else at[c] for c in range(k)])
        out |= {m[0]: int(c) for m, c in zip(members, ((xy[:, None] - last[None]) ** 2).sum(2).argmin(1), strict=True)}
    return out


def test_branches_as_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal(c * 900, 200)), float(rng.normal(-c * 400, 300)), "abc"[b]) for i, (c, b) in enumerate(zip(rng.integers(0, 4, 200), rng.choice(3, 200, p=(0.7, 0.25, 0.05)), strict=True))]
    points = spark.createDataFrame([(1, *r) for r in rows], "key long, sample long, x double, y double, behaviour string")
    got = forecast.branches(points).collect()
    assert {x["sample"]: x["cluster"] for x in got} == branches_by_hand(rows)
    summary = forecast.branch_summaries(forecast.branches(points)).collect()
    assert abs(sum(s.probability for s in summary) - 1) < 1e-3 and sum(s.n for s in summary) == 200 and all(s.radius >= 100 for s in summary)


def test_branches_of_few_points(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0, "a"), (1, 2, 5.0, 5.0, "b")], "key long, sample long, x double, y double, behaviour string")
    assert sorted((x["sample"], x["cluster"]) for x in forecast.branches(points).collect()) == [(1, 0), (2, 0)]
    assert forecast.branches(points.limit(0)).count() == 0


def test_ports_in_one_place_are_met_once(spark):
    import re

    from tidemark.plans import registry

    plan = registry.QUERIES["ports_within_reach"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[plat#\d+, plon#\d+\]", plan[plan.index("Join") :])


def test_samples_leave_python_a_few_contacts_at_a_time():
    import pandas as pd

    b = pd.DataFrame([(k, 0.0, 0.0, 10.0 * k, 5.0, 600.0) for k in range(300)], columns=["mmsi", "x", "y", "course_deg", "speed_mps", "age_s"])
    parts = list(forecast.drawn(iter([b]), 600))
    assert max(len(p) for p in parts) < forecast.PART + 600 and pd.concat(parts).groupby("mmsi")["sample"].nunique().tolist() == [600] * 300
