"""Nearest lines, buffered fences and belief graphs against brute-force versions."""

import collections
import math
import random

import pytest
from tidemark.operators import beliefs, lines

LINES = "line_id string, corners array<array<double>>"


def to_stretch(x, y, p, q):
    dx, dy = q[0] - p[0], q[1] - p[1]
    u = max(0.0, min(1.0, ((x - p[0]) * dx + (y - p[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(x - p[0] - u * dx, y - p[1] - u * dy)


def to_line(x, y, corners):
    return min(to_stretch(x, y, p, q) for p, q in zip(corners, corners[1:] or corners))


def drawn(seed, n):
    """Routes of metres and of a hundred kilometres, some equal, some of one corner."""
    rng, out = random.Random(seed), []
    for k in range(n):
        step = rng.choice([30.0, 900.0, 60_000.0])
        corners = [[rng.uniform(-40_000, 40_000), rng.uniform(-40_000, 40_000)]]
        for _ in range(rng.randrange(0, 5)):
            corners.append([corners[-1][0] + rng.uniform(-step, step), corners[-1][1] + rng.uniform(-step, step)])
        out.append((f"line{k:03}", corners))
    return out + [("twin_b", out[0][1]), ("twin_a", out[0][1]), ("none", []), ("null", None)]


@pytest.mark.parametrize(("k", "first"), [(1, None), (3, 50.0), (3, 25_000.0), (500, 100.0)])
def test_nearest_lines_against_all(spark, k, first):
    rng, routes = random.Random(4), drawn(1, 60)
    points = [(i, rng.uniform(-60_000, 60_000), rng.uniform(-60_000, 60_000)) for i in range(80)] + [(100 + i, *routes[i][1][0]) for i in range(20)] + [(7, 1.0, 2.0), (None, 0.0, 0.0), (200, None, 1.0)]
    points = [p for p in points if p[:1] != (7,) or p[1] == 1.0]
    got = lines.nearest(spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(routes, LINES), k, 25_000.0, first=first, digits=3).collect()
    want = []
    for i, x, y in points:
        if i is not None and x is not None:
            near = sorted((round(to_line(x, y, c), 3), name) for name, c in routes if c and to_line(x, y, c) <= 25_000)[:k]
            want += [(i, name, d, n + 1) for n, (d, name) in enumerate(near)]
    assert sorted((r["point_id"], r["line_id"], r["rank"]) for r in got) == sorted((i, name, n) for i, name, _, n in want)
    assert all(abs(r["distance"] - {(i, m): d for i, m, d, _ in want}[r["point_id"], r["line_id"]]) < 0.002 for r in got)


def test_no_lines_and_no_points(spark):
    points, routes = spark.createDataFrame([(1, 0.0, 0.0)], "point_id long, x double, y double"), spark.createDataFrame(drawn(2, 3), LINES)
    assert lines.nearest(points, routes.limit(0), 3, 1000.0).count() == lines.nearest(points.limit(0), routes, 3, 1000.0).count() == 0


def test_pieces_keep_the_line(spark):
    routes = spark.createDataFrame(drawn(3, 30), LINES)
    whole = {r["line_id"]: r["n"] for r in routes.select("line_id", lines.length(routes["corners"]).alias("n")).collect()}
    parts = collections.defaultdict(float)
    for r in lines.pieces(routes, piece=500.0).collect():
        d = math.hypot(r["x2"] - r["x1"], r["y2"] - r["y1"])
        assert d <= 500.000001
        parts[r["line_id"]] += d
    assert all(parts[name] == pytest.approx(n) for name, n in whole.items() if n)


FENCES = "fence_id string, kind string, label string, shape string, buffer_m double, coordinates array<array<array<double>>>"


def square(a, x=0.0, y=0.0):
    return [[x - a, y - a], [x + a, y - a], [x + a, y + a], [x - a, y + a]]


def test_fences_and_their_buffers(spark):
    rows = [
        ("plain", "mpa", "A reserve", "ring", None, [square(100.0)]), ("cable", "cable", None, "ring", None, [square(100.0)]), ("wide", "mpa", None, "ring", 50.0, [square(100.0)]), ("zero", "cable", None, "ring", 0.0, [square(100.0)]),
        ("holed", "mpa", None, "rings", None, [square(100.0), square(40.0)]), ("holed_wide", "mpa", None, "rings", 10.0, [square(100.0), square(40.0)]), ("route", "cable", None, "line", 25.0, [[[-100.0, 0.0], [100.0, 0.0], [100.0, 300.0]]]),
        (None, "mpa", None, "ring", None, [square(1.0)]), ("bare", "cable", None, "line", None, [[[0.0, 0.0], [1.0, 1.0]]]), ("flat", "mpa", None, "line", 0.0, [[[0.0, 0.0], [1.0, 1.0]]]), ("two", "mpa", None, "ring", 9.0, [[[0.0, 0.0], [1.0, 1.0]]]),
        ("empty", "mpa", None, "ring", 9.0, []), ("null", "mpa", None, "ring", 9.0, None), ("kindless", None, None, "ring", 9.0, [square(1.0)]), ("odd", "mpa", None, "star", 9.0, [square(1.0)]),
    ]
    made = {r["fence_id"]: r for r in lines.fences(spark.createDataFrame(rows, FENCES)).collect()}
    assert made["cable"]["buffer_m"] == 500.0 and made["zero"]["buffer_m"] == 0.0 and made["plain"]["buffer_m"] == 0.0 and made["plain"]["label"] == "A reserve" and made["wide"]["label"] == "wide"
    wrong = {None: "no id", "bare": "a line without a buffer", "flat": "a line without a buffer", "two": "a ring of fewer than three corners", "empty": "no geometry", "null": "no geometry", "kindless": "no kind", "odd": "unknown shape"}
    assert {k: r["problem"] for k, r in made.items() if r["problem"]} == wrong
    rng = random.Random(5)
    points = [(k, rng.uniform(-180, 180), rng.uniform(-180, 340)) for k in range(400)] + [(1000, 100.0, 0.0), (1001, 0.0, 0.0), (1002, 0.0, 35.0), (1003, 100.0, 325.0), (1004, 120.0, 300.0)]
    got = {(r["point_id"], r["fence_id"]) for r in lines.in_fences(spark.createDataFrame(points, "point_id long, x double, y double"), lines.fences(spark.createDataFrame(rows, FENCES))).collect()}

    def holds(name, x, y):
        outer, inner = max(abs(x), abs(y)), max(abs(x), abs(y)) > 40
        far = to_line(x, y, [*square(100.0), square(100.0)[0]])
        hole = to_line(x, y, [*square(40.0), square(40.0)[0]])
        within = lambda b: outer < 100 or b > 0 and far <= b
        return {
            "plain": within(0), "zero": within(0), "cable": within(500), "wide": within(50), "holed": outer < 100 and inner, "holed_wide": outer < 100 and inner or min(far, hole) <= 10,
            "route": to_line(x, y, [[-100.0, 0.0], [100.0, 0.0], [100.0, 300.0]]) <= 25,
        }[name]

    assert got == {(k, n) for k, x, y in points for n in ("plain", "zero", "cable", "wide", "holed", "holed_wide", "route") if holds(n, x, y)}


GRAPH = ("graph int, node string, believed boolean", "graph int, justification string, conclusion string", "graph int, justification string, node string, refutes boolean")


def by_passes(facts, justifications, antecedents, start):
    status = {**start, **facts}
    for _ in range(64):
        new = dict(status)
        for c in {c for _, c in justifications}:
            new[c] = any(all(status[n] != refutes for k, n, refutes in antecedents if k == j) for j, d in justifications if d == c)
        if new == status:
            return status
        status = new
    raise RuntimeError


def test_belief_graphs_against_passes(spark):
    rng, facts, justifications, antecedents, changes = random.Random(3), [], [], [], []
    for g in range(40):
        names = [f"f{k}" for k in range(rng.randrange(1, 6))]
        facts += [(g, n, rng.choice([True, False, None])) for n in names]
        depth = rng.randrange(0, 9)
        for k in range(depth):
            known = names + [f"c{i}" for i in range(k)]
            for j in range(rng.randrange(1, 4)):
                justifications.append((g, f"j{k}_{j}", f"c{k}"))
                antecedents += [(g, f"j{k}_{j}", n, rng.random() < 0.3) for n in rng.sample(known, rng.randrange(0, min(4, len(known) + 1)))]
        if g % 3:
            changes += [(g, n, rng.random() < 0.5) for n in names if rng.random() < 0.6]
    tables = [spark.createDataFrame(rows, kind) for rows, kind in zip((facts, justifications, antecedents), GRAPH)]
    first = beliefs.solved(*tables)
    after = beliefs.changed(first, spark.createDataFrame(changes, GRAPH[0]), *tables[1:])
    flipped = {(r["graph"], r["node"], r["believed"]) for r in beliefs.flips(after).collect()}
    got = {(r["graph"], r["node"]): (r["before"], r["believed"]) for r in after.collect()}
    assert len(got) == after.count()
    for g in range(40):
        own = lambda rows: [r[1:] for r in rows if r[0] == g]
        said, js, ants = {n: bool(b) for n, b in own(facts)}, own(justifications), own(antecedents)
        one = by_passes(said, js, ants, {c: False for _, c in js})
        two = by_passes({**said, **dict(own(changes))}, js, ants, {n: b for n, b in one.items() if n not in said})
        assert {n: got[g, n] for n in one} == {n: (one[n], two[n]) for n in one}
        assert {(n, b) for h, n, b in flipped if h == g} == {(n, two[n]) for n in one if n not in said and one[n] != two[n]}


def test_belief_graphs_that_are_wrong(spark):
    t = lambda *rows: [spark.createDataFrame(r, kind) for r, kind in zip(rows, GRAPH)]
    fine = [(1, "f", True)], [(1, "j", "c")], [(1, "j", "f", False)]
    for rows, message in (
        (([(1, "f", True), (1, "f", False)], fine[1], fine[2]), "twice"), (([*fine[0], (1, "c", True)], fine[1], fine[2]), "twice"), ((fine[0], [(1, "j", "c"), (1, "j", "d")], fine[2]), "twice"),
        ((fine[0], fine[1], [(1, "j", "g", False)]), "unknown node"), ((fine[0], fine[1], [(1, "k", "f", False)]), "unknown justification"), (([(2, "f", True)], fine[1], fine[2]), "unknown node"),
    ):
        with pytest.raises(ValueError, match=message):
            beliefs.solved(*t(*rows))
    state = beliefs.solved(*t(*fine))
    with pytest.raises(ValueError, match="no fact"):
        beliefs.changed(state, spark.createDataFrame([(1, "c", True)], GRAPH[0]), *t(*fine)[1:])
    with pytest.raises(RuntimeError, match="settle"):
        beliefs.solved(*t([(1, "f", True)], [(1, "j", "c")], [(1, "j", "f", False), (1, "j", "c", True)]))


def test_briefs_tell_what_changed_and_why(spark):
    facts = spark.createDataFrame([(1, "f_a", True), (1, "f_b", False), (2, "f_a", None)], "graph int, node string, believed boolean")
    justified = spark.createDataFrame([(1, "j1", "c", 2), (1, "j2", "c", 1), (1, "j3", "free", 1), (2, "j1", "c", 1)], "graph int, justification string, conclusion string, ord int")
    needs = spark.createDataFrame([(1, "j1", "f_a", False), (1, "j1", "f_b", True), (1, "j2", "f_b", False), (2, "j1", "f_a", True)], "graph int, justification string, node string, refutes boolean")
    before = beliefs.solved(facts, justified, needs)
    said = lambda state: {(r.graph, r.node): (r.status, r.text, r.source_ids) for r in beliefs.briefs(state, justified, needs, by="ord").collect()}
    assert said(before) == {
        (1, "c"): ("IN", "c: OUT -> IN (justification j1 satisfied: f_a is believed and f_b is not believed)", ["f_b", "f_a"]),
        (1, "free"): ("IN", "free: OUT -> IN (justification j3 satisfied: trivially (no antecedents or inhibitors))", []),
        (2, "c"): ("IN", "c: OUT -> IN (justification j1 satisfied: f_a is not believed)", ["f_a"]),
    }
    gone = spark.createDataFrame([(1, "f_a", False)], "graph int, node string, believed boolean")
    after = said(beliefs.changed(before, gone, justified, needs))
    assert after[1, "c"] == ("OUT", "c: IN -> OUT (justification j2 not satisfied: f_b is no longer believed; no alternate justification holds (1 other(s) also unsatisfied))", ["f_b", "f_a"])
    assert after[1, "free"][1] == "free: IN (justification j3 satisfied: trivially (no antecedents or inhibitors))"
    assert after[2, "c"][1] == "c: IN (justification j1 satisfied: f_a is not believed)"
    assert said(before.limit(0)) == {}
