"""Paths against plain loops: contacts of many slices, ties, single fixes, nulls and none."""

import math
import random

import pytest
from pyspark.sql import functions as F
from tidemark.operators import paths

FIX = "k string, i long, t double, lat double, lon double, extra int"


def some_fixes(rng, contacts=14):
    out = []
    for c in range(contacts):
        t, lat, lon = 0.0, rng.uniform(-60, 60), rng.uniform(-170, 170)
        for i in range(rng.choice([1, 2, 3, 30, 80])):
            out.append((f"c{c}", i, t, lat, lon, c))
            if rng.random() < 0.7:
                lat, lon = lat + rng.uniform(-0.05, 0.05), lon + rng.uniform(-0.05, 0.05)
            t += rng.choice([0.0, 60.0, 600.0, 4000.0])
    return out


def of(fixes):
    by = {}
    for f in fixes:
        by.setdefault(f[0], []).append(f)
    return {k: sorted(v, key=lambda f: f[1]) for k, v in by.items()}


def great_m(a, b):
    p, q = math.radians(a[3]), math.radians(b[3])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(h))


def flat_um(a, b):
    return round(1852e6 * math.hypot((b[3] - a[3]) * 60, (b[4] - a[4]) * 60 * math.cos(math.radians(a[3]))))


NULLS = [(None, 1, 1.0, 1.0, 1.0, 0), ("c0", None, 1.0, 1.0, 1.0, 0), ("c0", 999, None, 1.0, 1.0, 0), ("c0", 999, 9e9, None, 1.0, 0), ("gone", 1, 1.0, 1.0, None, 0)]


def test_stretches_equal_a_loop(spark):
    fixes = some_fixes(random.Random(1))
    land = [(f[0], f[1]) for f in fixes if random.Random(str(f)).random() < 0.1]
    rows = paths.stretched(spark.createDataFrame(fixes + NULLS, FIX), "k", ["i"], spark.createDataFrame(land + land[:3], "k string, i long"), 50.0, seconds=1000.0).cache()
    got = {(r.k, r.part): (r.n, r.duration_min, r.length_m) for r in paths.stretches(rows, "k").collect()}
    told = {r.k: (r.n_fixes, r.n_shown, r.n_stretches, r.omitted) for r in paths.told(rows, "k").collect()}
    want, sums = {}, {}
    for k, path in of(fixes).items():
        parts, omitted = [[path[0]]], 0
        for a, b in zip(path, path[1:]):
            took = b[2] - a[2]
            if (k, b[1]) in land or (took > 0 and great_m(a, b) / took / 0.514444 >= 50):
                parts.append([b])
                omitted += 1
            else:
                parts[-1].append(b)
        shown = [(n, p) for n, p in enumerate(parts) if len(p) > 1]
        want |= {(k, n): (len(p), (p[-1][2] - p[0][2]) / 60, sum(map(great_m, p, p[1:]))) for n, p in shown}
        sums[k] = (len(path), sum(len(p) for _, p in shown), len(shown), omitted)
    bad = [(x, got.get(x), want[x]) for x in want if x not in got or got[x][:2] != want[x][:2] or not math.isclose(got[x][2], want[x][2], abs_tol=1e-3)]
    assert told == sums and sum(s[3] for s in sums.values()) > 20
    assert got.keys() == want.keys() and not bad


def test_connectors_pair_neighbours(spark):
    fixes = some_fixes(random.Random(2))
    got = sorted((r.k, r.i, r.lat1, r.t1, r.lon2, r.t2) for r in paths.connectors(spark.createDataFrame(fixes, FIX), "k", ["i"], seconds=500.0).collect())
    assert got == sorted((k, b[1], a[3], a[2], b[4], b[2]) for k, p in of(fixes).items() for a, b in zip(p, p[1:]))


def test_places_equal_a_loop(spark):
    fixes = some_fixes(random.Random(3)) + [("still", i, 60.0 * i, 5.0, 6.0, 0) for i in range(5)] + [("late", i, 60.0 * i, 5.0, 6.0 + (i > 3), 0) for i in range(6)]
    shares = [-1.0, 0.0, 0.1, 0.25, 0.5, 0.999, 1.0, 7.0, None]
    asked = [(k, n, s) for k in [*of(fixes), "nobody", None] for n, s in enumerate(shares)]
    got = paths.places(spark.createDataFrame(fixes + NULLS, FIX), spark.createDataFrame(asked, "k string, ask int, share double"), "k", ["i"], seconds=1000.0).collect()
    assert len(got) == len(asked)
    for r in got:
        path = of(fixes).get(r.k)
        if not path or r.share is None:
            assert r.segment is None and r.lat is None
            continue
        if len(path) == 1:
            assert (r.segment, r.lat, r.lon, r.bearing) == (0, *path[0][3:5], None)
            continue
        way = [0]
        for a, b in zip(path, path[1:]):
            way.append(way[-1] + flat_um(a, b))
        goal = min(1.0, max(0.0, r.share)) * way[-1]
        s = next(n for n in range(len(path) - 1) if goal <= way[n + 1])
        part = (goal - way[s]) / max(1, way[s + 1] - way[s])
        assert r.segment == s
        assert math.isclose(r.lat, path[s][3] + (path[s + 1][3] - path[s][3]) * part, abs_tol=1e-9)
        assert math.isclose(r.lon, path[s][4] + (path[s + 1][4] - path[s][4]) * part, abs_tol=1e-9)
        assert (r.bearing is None) == (way[s + 1] == way[s])


@pytest.mark.parametrize("most", [2, 7, 24])
def test_thinned_equals_the_definition(spark, most):
    fixes = some_fixes(random.Random(4))
    d = paths.thinned(spark.createDataFrame(fixes + NULLS, FIX), "k", ["i"], most, (F.col("i") % 11 == 5) | F.col("extra").isNull(), seconds=1000.0)
    want = set()
    for k, p in of(fixes).items():
        n = len(p)
        taken = range(n) if n <= most else {round(j * (n - 1) / (most - 1)) for j in range(most)}
        want |= {(k, p[x][1]) for x in taken} | {(k, f[1]) for f in p if f[1] % 11 == 5}
    assert sorted((r.k, r.i) for r in d.collect()) == sorted(want) and d.columns == FIX.replace(" ", ",").split(",")[0:1] + ["i", "t", "lat", "lon", "extra"]


def test_no_rows(spark):
    none = spark.createDataFrame([], FIX)
    rows = paths.stretched(none, "k", ["i"])
    assert paths.stretches(rows, "k").count() == paths.told(rows, "k").count() == paths.thinned(none, "k", ["i"], 5).count() == 0
    assert paths.places(none, spark.createDataFrame([("a", 1, 0.5)], "k string, ask int, share double"), "k", ["i"]).collect()[0].lat is None


def test_no_distance_from_nowhere(spark):
    d = spark.createDataFrame([(None, 1.0, 1.0, 2.0), (1.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double")
    got = [r[0] for r in d.select(paths.great_circle_m(*map(F.col, "abcd"))).collect()]
    assert got[:2] == [None, 0.0] and math.isclose(got[2], math.pi * 6371008.8)
