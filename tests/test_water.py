"""Vector tiles by round trip, clipping and coverage against other methods."""

import math
import random

import pytest
from tidemark.operators import water
from tidemark.sources import vector_tiles

TILES = "z int, x long, y long, parts array<array<array<array<double>>>>"


def varint(v):
    out = b""
    while v > 127:
        out, v = out + bytes([v & 127 | 128]), v >> 7
    return out + bytes([v])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def encoded(polygons, layer="water", extent=4096, kind=3):
    """A tile with one feature for each polygon, a shell and its holes, wound as the format says."""
    zigzag = lambda v: varint((v << 1) ^ (v >> 63))
    features = b""
    for polygon in polygons:
        commands, at = b"", (0, 0)
        for k, ring in enumerate(polygon):
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))
            ring = ring if (area > 0) == (k == 0) else ring[::-1]
            for n, p in enumerate(ring):
                if n < 2:
                    commands += varint(1 << 3 | 1) if n == 0 else varint(len(ring) - 1 << 3 | 2)
                commands += zigzag(p[0] - at[0]) + zigzag(p[1] - at[1])
                at = p
            commands += varint(1 << 3 | 7)
        features += field(2, field(1, 300) + field(2, b"\x00\x01") + field(3, kind) + field(4, commands))
    return field(3, field(15, 2) + field(1, layer.encode()) + features + field(3, b"class") + (field(5, extent) if extent != 4096 else b""))


def test_tiles_come_back(spark):
    rng, rows, want = random.Random(1), [], {}
    for k in range(30):
        extent, polygons = rng.choice([4096, 512]), []
        for _ in range(rng.randrange(0, 4)):
            x, y, a = rng.randrange(-64, extent), rng.randrange(-64, extent), rng.randrange(20, 200)
            box = lambda d: [(x - d, y - d), (x + d, y - d), (x + d, y + d), (x - d, y + d)]  # noqa: B023, E731
            polygons.append([box(a), *([box(a // 2)] if a % 2 else [])])
        rows.append((11, 300 + k, 700 + k, encoded([[[(7, 7), (9, 7), (9, 9)]]], "roads") + encoded(polygons, extent=extent) + encoded([[[(0, 0), (1, 0), (1, 1)]]], "lake", kind=2)))
        want[300 + k] = (extent, polygons)
    bad = [(11, 1, 1, None), (11, 2, 2, b"\x1a\xff"), (11, 3, 3, b""), (11, 4, 4, encoded([], "other")), (11, 5, 5, field(3, field(1, b"water") + field(2, field(3, 3) + field(4, b"\x0b"))))]
    got = {r["x"]: r for r in vector_tiles.decoded(spark.createDataFrame(rows + bad, "z int, x long, y long, payload binary")).collect()}
    assert got[1]["problem"] == "no payload" and "cut off" in got[2]["problem"] and got[2]["parts"] is None and got[3]["parts"] == got[4]["parts"] == [] and "unknown command" in got[5]["problem"]
    for x, (extent, polygons) in want.items():
        y = x + 400
        at = lambda p: ((x + p[0] / extent) / 2048 * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (y + p[1] / extent) / 2048)))))  # noqa: B023, E731
        parts = got[x]["parts"]
        assert [len(p) for p in parts] == [len(p) for p in polygons] and got[x]["problem"] is None
        for mine, polygon in zip(parts, polygons):
            assert [sorted(map(tuple, ring)) for ring in mine] == [sorted(map(at, ring)) for ring in polygon]


def convex_area(a, b):
    """Area that two convex polygons share, by the corners of each inside the other and their edges' crossings."""
    left = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    edges = lambda ring: list(zip(ring, ring[1:] + ring[:1]))
    inside = lambda r, ring: all(left(p, q, r) >= -1e-12 for p, q in edges(ring))
    points = [p for p in a if inside(p, b)] + [p for p in b if inside(p, a)]
    for p, q in edges(a):
        for r, s in edges(b):
            d = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
            if d:
                t, u = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / d, ((r[0] - p[0]) * (q[1] - p[1]) - (r[1] - p[1]) * (q[0] - p[0])) / d
                if 0 <= t <= 1 and 0 <= u <= 1:
                    points.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    if len(points) < 3:
        return 0.0
    cx, cy = sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points)
    points.sort(key=lambda p: math.atan2(p[1] - cy, p[0] - cx))
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in edges(points))) / 2


def corners(z, x, y):
    lat = lambda row: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * row / 2**z))))
    return x / 2**z * 360 - 180, (x + 1) / 2**z * 360 - 180, lat(y + 1), lat(y)


def grid(missing=()):
    """Water tiles with an island each around 122 W, 37 N at all zooms."""
    out, holes = [], {}
    for z in (11, 10, 8):
        cx, cy = int((-122 + 180) / 360 * 2**z), int((1 - math.asinh(math.tan(math.radians(37))) / math.pi) / 2 * 2**z)
        for x in range(cx - 8, cx + 9):
            for y in range(cy - 8, cy + 9):
                w, e, s, n = corners(z, x, y)
                box = lambda a: [(w + (e - w) * i, s + (n - s) * j) for i, j in ((a, a), (1 - a, a), (1 - a, 1 - a), (a, 1 - a))]  # noqa: B023, E731
                there = (z, x - cx, y - cy) not in missing
                holes[z, x, y] = box(0.3)
                out.append((z, x, y, [[[*map(list, box(0.0)), list(box(0.0)[0])], [*map(list, box(0.3))]]] if there else None))
    return out, holes


def test_hulls_are_clipped_exactly(spark):
    tiles, holes = grid()
    rng, hulls = random.Random(2), []
    for k in range(40):
        a, turn = rng.choice([0.02, 0.6, 1.3]), rng.random()
        x, y = -122 + rng.uniform(-0.2, 0.2), 37 + rng.uniform(-0.2, 0.2)
        ring = [[x + a * math.cos(2 * math.pi * (turn + i / 7)), y + a * math.sin(2 * math.pi * (turn + i / 7))] for i in range(7)]
        hulls.append((k, ring[::-1] if k % 3 == 0 else [*ring, ring[0]]))
    hulls += [(100, [[0.0, 0.0], [1.0, 1.0]]), (101, [[10.0, 10.0], [10.1, 10.0], [10.0, 10.1]]), (102, [[-160.0, 0.0], [-100.0, 0.0], [-130.0, 60.0]]), (103, None), (104, [])]
    table = spark.createDataFrame(tiles, TILES)
    got = {r["hull_id"]: r for r in water.clipped(spark.createDataFrame(hulls, "hull_id long, hull array<array<double>>"), table).collect()}
    assert len(got) == len(hulls) and [got[k]["state"] for k in (100, 101, 102, 103, 104)] == ["unknown", "unknown", "large", "unknown", "unknown"]
    assert {got[k]["z"] for k in range(40)} == {11, 10, 8} and got[102]["area"] == 0 and got[102]["rings"] == []
    for k, ring in hulls[:40]:
        ring = [tuple(p) for p in (ring[::-1] if k % 3 == 0 else ring[:-1])]
        whole = convex_area(ring, ring)
        land = sum(convex_area(ring, hole) for (z, _, _), hole in holes.items() if z == got[k]["z"])
        assert got[k]["area"] == pytest.approx(whole - land, rel=1e-9) and got[k]["state"] == "clipped"
        signed = sum((1 if r["shell"] else -1) * abs(sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(r["points"], r["points"][1:] + r["points"][:1]))) / 2 for r in got[k]["rings"])
        assert signed == pytest.approx(got[k]["area"])


def test_missing_tiles_lead_to_coarser_zooms(spark):
    one = [(1, [[-122.02, 36.98], [-121.98, 36.98], [-121.98, 37.02], [-122.02, 37.02]])]
    hulls = spark.createDataFrame(one, "hull_id long, hull array<array<double>>")
    zoom = lambda *gone: water.clipped(hulls, spark.createDataFrame(grid(gone)[0], TILES)).first()["z"]
    assert (zoom(), zoom((11, 0, 0)), zoom((11, 0, 0), (10, 0, 0)), zoom((11, 0, 0), (10, 0, 0), (8, 0, 0))) == (11, 10, 8, None)


def test_coverage_against_islands_on_the_way(spark):
    tiles, holes = grid([(11, 2, 1), (10, -3, 0)])
    rng = random.Random(3)
    ways = [(k, *[c + rng.uniform(-a, a) for c in (-122, 37, -122, 37)]) for k in range(300) for a in [rng.choice([0.02, 0.1, 0.4])]]
    ways += [(1000, -122.0, 37.0, -122.0, 37.0), (1001, 0.0, 0.0, 0.1, 0.1)]
    got = {r["segment_id"]: r for r in water.covered(spark.createDataFrame(ways, "segment_id long, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(tiles, TILES)).collect()}
    assert len(got) == len(ways) and got[1001]["z"] is None and got[1001]["covered"] is None
    def share(p, q, low, high):
        """From where to where a coordinate is between two others, as shares of the way."""
        if p == q:
            return (0.0, 1.0) if low < p < high else (2.0, 1.0)
        return tuple(sorted(((low - p) / (q - p), (high - p) / (q - p))))

    seen = set()
    for k, x1, y1, x2, y2 in ways[:-1]:
        land = False
        for (z, *_), hole in holes.items():
            if z == got[k]["z"]:
                (a, b), (c, d) = share(x1, x2, hole[0][0], hole[2][0]), share(y1, y2, hole[0][1], hole[2][1])
                land |= min(b, d, 1.0) - max(a, c, 0.0) > 1e-9
        assert got[k]["covered"] == (not land), k
        seen.add((got[k]["z"], land))
    assert len(seen) >= 4 and {z for z, _ in seen} >= {11, 10}
