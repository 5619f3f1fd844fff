"""Messages of frames against a plain loop, as rows and as lines of JSON."""

import json
import math
import pathlib
import random

import numpy as np
import pytest
from tidemark.operators import payloads

STATE = "mission long, frame_idx long, track_id long, x double, y double, vx double, vy double, p00 double, p01 double, p11 double, status string, zones array<string>, last_source string"
PLOT = "mission long, frame_idx long, meas_id string, x double, y double, source string, suppressed boolean, matched boolean"
ALERT = "mission long, frame_idx long, alert_id string, headline string"
ZONE = "mission long, zone_id string, name string"


@pytest.fixture(scope="module")
def told(spark):
    rng = random.Random(5)
    states = [(m, f, t, 10.0 * t, f * 1.0, 3.0, 4.0, 9.0, 1.0, 4.0, rng.choice(["confirmed", "tentative", "coasting", "deleted"]), None if t % 2 else ["b", "a"], "ais") for m in (1, 2) for f in (0, 1, 2, 4) for t in range(40) if rng.random() < 0.8]
    plots = [(m, f, f"m{f}-{n}", 1.26, 2.0, "ais", rng.choice([True, False, None]), rng.choice([True, False, None])) for m in (1, 2, 3) for f in range(3) for n in range(rng.choice([1, 55]))]
    alerts = [(1, 0, "A-1", "one"), (2, 4, "A-2", None), (9, 7, "A-3", "alone")]
    zones = [(1, "z2", "two"), (1, "z1", "one"), (2, "z1", "one"), (1, None, "none"), (None, "z9", "nowhere")]
    lost = [(1, 0, None, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, "confirmed", None, "ais"), (None, 0, 5, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, "confirmed", None, "ais")]
    frames = [spark.createDataFrame(r, s) for r, s in ((states + lost, STATE), (plots, PLOT), (alerts, ALERT), (zones, ZONE))]
    return states, plots, alerts, zones, frames


def test_messages_equal_a_loop(told):
    states, plots, alerts, zones, (s, p, a, z) = told
    got = payloads.messages(payloads.tracks(s, 36.0, -121.0), p, a, z, 30.0, most=8).collect()
    shown = {(m, f, t): status for m, f, t, *_, status, _, _ in states if status != "deleted"}
    gone = {(m, f + 1, t) for m, f, t in shown if (m, f + 1, t) not in shown}
    want = {}
    at = lambda m, f: want.setdefault((m, f), {k: [] for k in payloads.KINDS} | {"hidden": 0, "matched": 0, "dark": 0})
    for (m, f, t), status in shown.items():
        at(m, f)["tracks"].append(t)
        at(m, f)["dark"] += status == "coasting"
    for m, f, t in gone:
        at(m, f)["removed"].append(t)
    for m, f, i, *_, hidden, matched in plots:
        at(m, f)["matched"] += bool(matched)
        if hidden:
            at(m, f)["hidden"] += 1
        else:
            at(m, f)["measurements"].append(i)
    for m, f, i, _ in alerts:
        at(m, f)["alerts"].append(i)
    for m, i, _ in zones[:3]:
        at(m, 0)["zones"].append(i)
    have = {}
    for r in got:
        have.setdefault((r.mission, r.frame_idx), []).append(r)
    assert have.keys() == want.keys()
    names = {"tracks": "track_id", "measurements": "meas_id", "alerts": "alert_id", "removed": "track_id", "zones": "zone_id"}
    for k, rows in have.items():
        w = want[k]
        for kind, name in names.items():
            assert sorted(str(i[name]) for r in rows for i in r[kind]) == sorted(map(str, w[kind]))
            assert all([str(i[name]) for i in r[kind]] == sorted(str(i[name]) for i in r[kind]) for r in rows)
        n = sum(len(w[kind]) for kind in names)
        assert {r.n_parts for r in rows} == {max(1, math.ceil(n / 8))} and all(r.part < r.n_parts for r in rows)
        assert {tuple(r.stats) for r in rows} == {(len(w["tracks"]), w["dark"], len(w["measurements"]), w["hidden"], w["matched"])}
        assert {r.t for r in rows} == {k[1] * 30.0}
    assert next(i.headline for r in got for i in r.alerts if i.alert_id == "A-3") == "alone"


def test_reruns_make_the_same_lines(told, tmp_path):
    s, p, a, z = told[4]
    texts = []
    for n in range(2):
        m = payloads.messages(payloads.tracks(s.repartition(n + 3), 36.0, -121.0), p.repartition(5 - n), a, z, 30.0, most=8)
        m.coalesce(1).write.json(str(tmp_path / str(n)))
        texts.append(sorted(x for f in pathlib.Path(tmp_path / str(n)).glob("*.json") for x in f.read_text().splitlines()))
    assert texts[0] == texts[1] and len(texts[0]) > 20
    line = next(v for v in map(json.loads, texts[0]) if v["tracks"])
    assert len(line["tracks"][0]["ellipse"]) == 25 and line["tracks"][0]["ellipse"][0] == line["tracks"][0]["ellipse"][-1]
    assert any(v["clock"] == "0:02:00" for v in map(json.loads, texts[0]))


def test_track_fields(told):
    r = payloads.tracks(told[4][0], 36.0, -121.0).where("track_id = 3").first()
    assert (r.heading_deg, r.speed_mps, r.speed_kn, r.label) == (36.9, 5.0, 9.7, "3 · 9.7 kn") and r.zones == []
    inverse = np.linalg.inv([[9.0, 1.0], [1.0, 4.0]])
    for x, y in r.ellipse:
        d = np.array([x - r.x, y - r.y])
        assert abs(d @ inverse @ d - 4) < 0.25  # two deviations, corners to a decimal
    assert abs(r.lat - (36 + math.degrees(r.y / 6371000))) < 1e-6


def test_nothing_told(spark):
    s, p, a, z = (spark.createDataFrame([], t) for t in (STATE, PLOT, ALERT, ZONE))
    assert payloads.messages(payloads.tracks(s, 0.0, 0.0), p, a, z, 30.0).count() == 0
