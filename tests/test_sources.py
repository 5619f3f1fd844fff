"""Readers of files and feeds on small files."""

import json
import random
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark.operators import alerts, history
from tidemark.sources import files, messages, tables


def put(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(path)


def square(x, size=1.0):
    return [[x, 0.0], [x + size, 0.0], [x + size, size], [x, size], [x, 0.0]]


def test_shapes_of_all_kinds(spark, tmp_path):
    f = lambda of, xy, **p: {"type": "Feature", "properties": p, "geometry": {"type": of, "coordinates": xy}}
    path = put(tmp_path / "z.json", {"type": "FeatureCollection", "features": [
        f("Polygon", [square(0), square(0.2, 0.1)], id="a", name="A"), f("Polygon", [square(5)], id="a"), f("MultiPolygon", [[square(1)], [square(3)]], kind="port"), f("LineString", [[0, 0], [1, 1]], buffer_m="250"), f("Point", [0, 0]),
    ]})
    z = {r["zone_id"]: r for r in files.shapes(spark, path, "mpa").collect()}
    assert set(z) == {"a", "a#1", "mpa_2", "mpa_3"}
    assert len(z["a"]["parts"][0]) == 2 and z["a"]["label"] == "A" and len(z["mpa_2"]["parts"]) == 2 and z["mpa_2"]["kind"] == "port" and z["mpa_3"]["buffer_m"] == 250
    bare = put(tmp_path / "b.json", {"type": "Polygon", "coordinates": [square(0)]})
    assert [r["zone_id"] for r in files.shapes(spark, bare, "mpa", layer="Bay Area").collect()] == ["bay_area:mpa_0"]
    line = put(tmp_path / "l.json", f("LineString", [[0, 0], [1, 1]]))
    assert files.shapes(spark, line, "cable").first()["buffer_m"] == 500
    with pytest.raises(Exception, match="buffer"):
        files.shapes(spark, line, "mpa").collect()


def test_sanctions_keys(spark, tmp_path):
    head = "ent_num,SDN_Name,SDN_Type,Program,Title,Call_Sign,Vess_type,Tonnage,GRT,Vess_flag,Vess_owner,Remarks\n"
    a = put(tmp_path / "a.csv", head + '1,ART AVIL,vessel,x,-0-,5IM316,-0-,-0-,-0-,-0-,-0-,"Vessel IMO 9187629; MMSI 572469210"\n')
    b = put(tmp_path / "b.csv", head + "1,OTHER,vessel,x,-0-,-0-,-0-,-0-,-0-,-0-,-0-,-0-\n2,B,vessel,x,-0-,-0-,-0-,-0-,-0-,-0-,-0-,-0-\n")
    assert {tuple(r) for r in files.sanctions(spark, a, b).collect()} == {("mmsi", "572469210", 1), ("imo", "9187629", 1), ("call_sign", "5IM316", 1), ("name", "ARTAVIL", 1), ("name", "B", 2)}


def test_registers_forecasts_places_and_packs(spark, tmp_path):
    areas = put(tmp_path / "w.csv", "﻿SITE_ID,NAME_ENG,NAME,DESIG_ENG,DESIG\n7,,Bahía,Park,\n,x,y,z,w\n")
    assert [tuple(r) for r in files.protected_areas(spark, areas).collect()] == [("7", "Bahía", "Park")]
    w = put(tmp_path / "wind.csv", "time,latitude,longitude,ugrd10m,vgrd10m\nUTC,degrees_north,degrees_east,m s-1,m s-1\n2026-07-18T12:00:00Z,36.5,-122.0,3.5,-1\n")
    assert [(r["lat"], r["east_mps"], r["north_mps"]) for r in files.wind(spark, w).collect()] == [(36.5, 3.5, -1.0)]
    p = put(tmp_path / "p.json", [{"display_name": "M", "lat": "36.6", "lon": "-121.9", "boundingbox": ["36.5", "36.7", "-122.0", "-121.8"], "type": "city"}, {"display_name": "bad", "lat": "x", "lon": "1", "boundingbox": []}])
    assert [(r["name"], r["bounds"]) for r in files.places(spark, p).collect()] == [("M", [-122.0, 36.5, -121.8, 36.7])]
    pack = put(tmp_path / "pack.json", {"id": "s", "origin": {"lat": 36.7, "lon": -122}, "events": [{"t": 180, "kind": "ais_off", "actor": "g", "params": {"a": 1}}], "expected": {"dark_at_s": 180}})
    row = files.packs(spark, pack).first()
    assert row["events"][0]["kind"] == "ais_off" and row["expected"]["dark_at_s"] == "180" and row["file"].endswith("pack.json")


def test_state_comes_back(spark, tmp_path):
    d = spark.createDataFrame([(1, 100_000.0, "p"), (2, 99_990.0, "p"), (3, 1.0, "p"), (4, 99_000.0, "p")], "mmsi long, last_seen double, _private string")
    files.save_state(d, str(tmp_path / "s"), 100_000.0, most=2)
    back = files.restore_state(spark, str(tmp_path / "s"), "mmsi long, last_seen double", 100_030.0).orderBy("mmsi").collect()
    assert [(r["mmsi"], r["dark"]) for r in back] == [(1, False), (2, False)]


def test_zipped_reports(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("a.csv", "MMSI,LAT,LON,X\n1,2.5,3,z\n2,bad,,y\n")
    assert sorted(map(tuple, history.zipped_rows(spark, str(tmp_path / "a.zip"), "MMSI,LAT,LON").collect())) == [("1", "2.5", "3"), ("2", "bad", "")]
    csv = put(tmp_path / "r.csv", "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading\n1,2024-01-01T00:00:30,36.5,-122,1,2,3\n1,2024-01-01T00:00:30,x,-122,1,2,3\n")
    assert [(r["mmsi"], r["lat"]) for r in tables.reports(spark, csv).collect()] == [("1", 36.5)]


def test_pushed_and_polled_messages(spark):
    raw = [
        {"MessageType": "PositionReport", "MetaData": {"MMSI": 5, "ShipName": " A ", "latitude": 1.23456, "longitude": 2}, "Message": {"PositionReport": {"Sog": 3.5, "Cog": 9}}},
        {"MessageType": "StandardClassBPositionReport", "MetaData": {"MMSI": 6, "ShipName": ""}, "Message": {"StandardClassBPositionReport": {"Latitude": 4, "Longitude": 5}}},
        {"MessageType": "PositionReport", "MetaData": {"MMSI": 7}, "Message": {}},
        {"MessageType": "ShipStaticData", "MetaData": {"MMSI": 8, "ShipName": "meta"}, "Message": {"ShipStaticData": {"ImoNumber": 12, "CallSign": " X1 ", "Type": 70}}},
    ]
    d = spark.createDataFrame([(json.dumps(r),) for r in raw] + [("not json",)], "value string")
    assert sorted((r["mmsi"], r["name"], r["lat"], r["speed_kn"]) for r in messages.positions(d).fillna(-1.0).collect()) == [(5, "A", 1.2346, 3.5), (6, "MMSI 6", 4.0, -1.0)]
    assert [(r["mmsi"], r["name"], r["imo"], r["call_sign"], r["draught_m"]) for r in messages.statics(d).collect()] == [(8, "meta", 12, "X1", 0.0)]
    feature = lambda m, t, **p: {"mmsi": m, "geometry": {"coordinates": [20.0, 60.0]}, "properties": {"timestampExternal": t, **p}}
    snap = {"features": [feature(230000001, 1_000, sog=5.0, heading=511), feature(230000001, 1_000), feature(12, 1), feature(230000002, 9_000_000)]}
    got = messages.polled_locations(spark.createDataFrame([(json.dumps(snap),)], "value string"), F.lit(10.0)).orderBy("mmsi").collect()
    assert [(r["mmsi"], r["source_time"], r["heading"]) for r in got] == [(230000001, 1.0, None), (230000002, 15.0, None)]
    meta = spark.createDataFrame([('[{"mmsi": 1, "name": " N ", "draught": 55}]',)], "value string")
    assert [(r["name"], r["draught_m"]) for r in messages.polled_metadata(meta).collect()] == [("N", 5.5)]


def test_time_steps_add_up(spark):
    for minutes in (0.0, 1.0, 59.0, 61.5, 360.0, 1397.0, 5000.0):
        steps = spark.range(1).select(alerts.time_steps(F.lit(minutes))).first()[0]
        assert abs(sum(steps) - min(minutes, 1440) - 30) < 1e-6 and min(steps) > 0 and max(steps) <= 15


def test_hull_corners():
    grid = [(float(x), float(y)) for x in range(5) for y in range(5)]
    assert sorted(history.corners(grid)) == [(0, 0), (0, 4), (4, 0), (4, 4)] and history.corners([(1.0, 1.0)]) == [(1.0, 1.0)] and len(history.corners([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)])) == 2


def test_partial_hulls_make_the_hull(spark):
    rng = random.Random(4)
    rows = [(k % 9 if k % 3 else 4, float(rng.randint(0, 30)), float(rng.randint(0, 30))) for k in range(3000)]
    parts = [pd.DataFrame(rows[i : i + 70], columns=["mmsi", "x", "y"]) for i in range(0, len(rows), 70)]
    first = list(history.partial(iter(parts)))
    assert sum(map(len, first)) < len(rows)
    sides = {k: set(history.corners([(x, y) for m, x, y in rows if m == k])) for k in range(9)}
    got = history.hulls(spark.createDataFrame(rows, "mmsi long, x double, y double").repartition(5)).collect()
    assert len(got) == len(set(got)) and {k: {(r["x"], r["y"]) for r in got if r["mmsi"] == k} for k in range(9)} == sides
