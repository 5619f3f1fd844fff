import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import decisions, replay, tracking, zones


def brute(n, m, cost):
    best = math.inf
    for k in range(min(n, m) + 1):
        for ts in itertools.combinations(range(n), k):
            for ms in itertools.permutations(range(m), k):
                if all((t, j) in cost for t, j in zip(ts, ms)):
                    best = min(best, sum(cost[t, j] for t, j in zip(ts, ms)) + tracking.MISS * (n - k) + tracking.BIRTH * (m - k))
    return best


@pytest.mark.parametrize("seed", range(40))
def test_solver_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 5, 2)
    cost = {(i, j): float(rng.normal(8, 6)) for i in range(n) for j in range(m) if rng.random() < 0.7}
    ti, mi = np.array([p[0] for p in cost], int), np.array([p[1] for p in cost], int)
    chosen = tracking.solve(n, m, ti, mi, np.array(list(cost.values())))
    assert len({t for t, _ in chosen}) == len({j for _, j in chosen}) == len(chosen)
    total = sum(cost[p] for p in chosen) + tracking.MISS * (n - len(chosen)) + tracking.BIRTH * (m - len(chosen))
    assert total == pytest.approx(brute(n, m, cost))


def test_fold_smooths(spark):
    """Over many straight tracks the filter's last position errs by less than 0.6 of what a report does."""
    rng, t, parts = np.random.default_rng(1), np.arange(60) * 30.0, []
    for k in range(40):
        noise = rng.normal(0, 50, (60, 2))
        parts.append(pd.DataFrame({"mmsi": k, "t": t, "x": 5 * t + noise[:, 0], "y": 2 * t + noise[:, 1], "sigma": 50.0}))
    out = tracking.filtered(spark.createDataFrame(pd.concat(parts)), q=1e-5).toPandas()
    error = np.sqrt(((out["x"] - 5 * t[-1]) ** 2 + (out["y"] - 2 * t[-1]) ** 2).mean())
    assert len(out) == 40 and (out["n"] == 60).all() and error < 0.6 * 50 * math.sqrt(2)


def test_replay_coasts_and_reacquires(spark):
    frames = [k for k in range(40) if not 20 <= k < 30]
    m = pd.DataFrame({"mission": 7, "frame_idx": frames, "t": [30.0 * k for k in frames], "meas_id": frames, "x": [150.0 * k for k in frames], "y": 0.0, "sigma": 5.0})
    gaps = pd.DataFrame({"mission": 7, "frame_idx": range(40), "t": [30.0 * k for k in range(40)], "meas_id": range(1000, 1040), "x": 900000.0, "y": [2e5 * (k % 2) for k in range(40)], "sigma": 5.0})
    out = replay.replay(spark.createDataFrame(pd.concat([m, gaps]))).toPandas()
    own = out[out["track_id"] == out[out["meas_id"] == 1]["track_id"].iloc[0]]
    assert "went_dark" in set(own["event"]) and "reacquired" in set(own["event"])
    assert own[own["frame_idx"] == 35]["status"].iloc[0] == "confirmed"


def test_beliefs_follow_retraction(spark):
    rows = [(k, *[bool(k >> n & 1) for n in range(3)]) for k in range(8)]
    out = {r["k"]: r for r in decisions.believed(spark.createDataFrame(rows, f"k int, {', '.join(f'{n} boolean' for n in decisions.FACTS)}")).collect()}
    for k, jump, two, match in rows:
        spoofed = jump and two
        assert (out[k]["c_spoofed"], out[k]["c_genuine"], out[k]["c_alert"]) == (spoofed, match and not spoofed, spoofed or two and not match)


def test_belief_graphs_are_checked(spark):
    one = spark.createDataFrame([(True,)], "f boolean")
    for facts, justifications in ((("f", "f"), ()), (("f",), (("j", "c", ("g",), ()),)), (("f",), (("j", "c", ("f",), ()), ("j", "d", ("f",), ()))), (("f",), (("j", "f", (), ()),))):
        with pytest.raises(ValueError):
            decisions.believed(one, facts, justifications)
    with pytest.raises(Exception, match="settle"):
        decisions.believed(one, ("f",), (("j", "c", ("f",), ("c",)),)).collect()


def test_gates_of_any_covariance(spark):
    """Against all pairs, with deviations of metres and of kilometres in one frame."""
    rng = np.random.default_rng(4)
    tracks = [(k % 3, k, *(float(v) for v in rng.uniform(-9e4, 9e4, 2)), *p) for k in range(90) for p in [[(25.0, 0.0, 25.0), (7.4e6, 2e6, 1e6), (1.6e9, 0.0, 4e4)][k % 3 if k % 2 else 0]]]
    plots = [(k % 3, k, *(float(v) for v in rng.uniform(-9e4, 9e4, 2)), float(rng.choice([5, 50, 900]))) for k in range(300)]
    plots += [(f, 1000 + k, px + 4500, py, 50.0) for f, k, px, py, *_ in tracks]
    want = set()
    for f, k, px, py, a, b, c in tracks:
        for g, m, x, y, s in plots:
            p, q = a + s * s, c + s * s
            if f == g and (q * (x - px) ** 2 - 2 * b * (x - px) * (y - py) + p * (y - py) ** 2) / (p * q - b * b) <= tracking.GATE:
                want.add((f, k, m))
    got = tracking.candidates(spark.createDataFrame(tracks, "frame_idx long, track_id long, px double, py double, p00 double, p01 double, p11 double"), spark.createDataFrame(plots, "frame_idx long, meas_id long, x double, y double, sigma double"))
    rows = [tuple(r) for r in got.select("frame_idx", "track_id", "meas_id").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 40


def test_zone_tables(spark):
    """Holes, parts and edges; a point on a hole's edge belongs to the zone only if edges count."""
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    areas = spark.createDataFrame([("z", [[square(0.0, 10000.0), square(2.0, 4.0)], [square(20000.0, 20001.0)]]), ("none", [])], "zone_id string, parts array<array<array<array<double>>>>")
    points = spark.createDataFrame([(k, *p) for k, p in enumerate([(1.0, 1.0), (0.0, 5.0), (3.0, 3.0), (2.0, 3.0), (10000.0, 10000.0), (20000.5, 20000.5), (15000.0, 15000.0), (-1.0, 0.0), (5.0, 0.0)])], "id int, x double, y double")
    ids = lambda covers: {r["id"] for r in zones.contained(points, areas, covers=covers).collect()}
    assert ids(False) == {0, 5} and ids(True) == {0, 1, 3, 4, 5, 8}
    with pytest.raises(Exception, match="repeated"):
        zones.without_repeats(points.select("x").unionAll(points.select("x")), "x").collect()


def test_streams_merge_and_split(spark, tmp_path):
    from tidemark.streaming import live

    rows = [(1, 10.0, "ARTA", 5.0), (1, 9.0, "OLD", 1.0), (1, 12.0, None, None), (1, 13.0, "arta ", 6.0), (1, 14.0, "OTHER", 7.0), (2, 1.0, None, None)]
    spark.createDataFrame(rows, "mmsi long, t_abs double, name string, speed_kn double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("mmsi long, t_abs double, name string, speed_kn double").parquet(str(tmp_path / "in"))
    got = {r["mmsi"]: r for r in live.run_once(live.changelog(stream), str(tmp_path / "out"), str(tmp_path / "cp")).collect()}
    assert got[1]["identity_changes"] >= 1 and got[1]["t_abs"] == 14.0 and got[1]["speed_kn"] == 7.0 and got[2]["name"] is None


def test_contacts_turn_dark_by_timer(spark, tmp_path):
    import time

    from tidemark.streaming import live

    schema = "mmsi long, t_abs double, x double, y double, name string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        return {(r["mmsi"], r["revision"]): r for r in live.run_once(live.contacts(stream, 1500), str(tmp_path / "out"), str(tmp_path / "cp")).collect()}

    # Timers keep a query awake with batches without data; runs over what is there must end.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    put([(1, 1.0, None, None, "EARLY"), (2, 5.0, 1.0, 1.0, "B"), (3, 1.0, None, None, "NEVER")])
    assert set(run()) == {(2, 1)}
    time.sleep(2)
    put([(1, 6.0, 2.0, 2.0, None), (3, 2.0, None, None, "STILL")])
    out = run()
    assert out[1, 1]["name"] == "EARLY" and not out[1, 1]["dark"] and out[2, 2]["kind"] == "dark" and out[2, 2]["dark"] and not any(m == 3 for m, _ in out)
    put([(2, 4.0, 9.0, 9.0, None), (2, 7.0, 3.0, 3.0, None)])
    out = run()
    assert out[2, 3]["kind"] == "resume" and out[2, 3]["x"] == 3.0 and not out[2, 3]["dark"]
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


FRAMES = "frame_idx long, track_id long, meas_id long, cost double"


def small_frames(seed):
    """Pairs of frames of up to five tracks and plots in up to three groups, with repeated costs, and each frame's numbers of tracks and plots."""
    rng = np.random.default_rng(seed)
    pairs, sizes = [], []
    for f in range(25):
        n, m = (int(v) for v in rng.integers(0, 5, 2))
        sizes.append((f, n, m))
        for i in range(n):
            for j in range(m):
                if rng.random() < 0.5 and (i < 2) == (j < 2):
                    pairs.append((f, 10 + i, 100 + j, float(rng.choice([4.0, 9.5, round(float(rng.normal(12, 5)), 3)]))))
    return pairs, sizes


def frame_tables(spark, pairs, sizes):
    side = lambda k, at, name: spark.createDataFrame([(f, at + i) for f, *n in sizes for i in range(n[k])], f"frame_idx long, {name} long")
    return spark.createDataFrame(pairs, FRAMES), side(0, 10, "track_id"), side(1, 100, "meas_id")


def optima(n, m, cost):
    """(cost, pairs) of every partial matching, the cheapest first."""
    out = []
    for k in range(min(n, m) + 1):
        for ts in itertools.combinations(range(n), k):
            for ms in itertools.permutations(range(m), k):
                if all((10 + t, 100 + j) in cost for t, j in zip(ts, ms)):
                    chosen = [(10 + t, 100 + j) for t, j in zip(ts, ms)]
                    out.append((sum(cost[p] for p in chosen) + tracking.MISS * (n - k) + tracking.BIRTH * (m - k), chosen))
    return sorted(out, key=lambda x: (x[0], len(x[1])))


def test_assignments_by_group_against_all_matchings(spark):
    pairs, sizes = small_frames(3)
    table, tracks, plots = frame_tables(spark, pairs, sizes)
    costs = {f: {(t, m): c for g, t, m, c in pairs if g == f} for f, *_ in sizes}
    best, greedy = tracking.assign(table), tracking.assign_greedily(table)
    total = {r["frame_idx"]: r for r in tracking.total_costs(best, tracks, plots).collect()}
    chosen, first_come = ([(r["frame_idx"], r["track_id"], r["meas_id"]) for r in d.collect()] for d in (best, greedy))
    margin = {r["frame_idx"]: r for r in tracking.margins(table, tracks, plots).collect()}
    for f, n, m in sizes:
        if not n + m:
            assert f not in total and f not in margin
            continue
        own = [(t, j) for g, t, j in chosen if g == f]
        assert len({t for t, _ in own}) == len({j for _, j in own}) == len(own)
        least, *_ = optima(n, m, costs[f])
        assert total[f]["cost"] == pytest.approx(least[0]) and (total[f]["n_tracks"], total[f]["n_plots"], total[f]["n_assigned"]) == (n, m, len(own))
        used, want = set(), set()
        for c, t, j in sorted((c, t, j) for (t, j), c in costs[f].items()):
            if t not in used and j not in used:
                used |= {t, j}
                want.add((t, j))
        assert {(t, j) for g, t, j in first_come if g == f} == want
        if not own:
            assert (margin[f]["margin"], margin[f]["ambiguous"], margin[f]["w_best"], margin[f]["w_second"]) == (math.inf, False, 1.0, 0.0)
            continue
        pivot = min((costs[f][p], *p) for p in own)[1:]
        second = optima(n, m, {p: c for p, c in costs[f].items() if p != pivot})[0][0]
        assert (margin[f]["cost_best"], margin[f]["cost_second"]) == (pytest.approx(least[0]), pytest.approx(second))
        assert margin[f]["ambiguous"] == (second - least[0] < 2.0) and margin[f]["w_second"] == pytest.approx(math.exp(least[0] - second) / (1 + math.exp(least[0] - second)))
    empty = table.limit(0)
    assert tracking.assign(empty).count() == tracking.assign_greedily(empty).count() == 0


def test_greedy_is_dearer_where_paths_cross(spark):
    table = spark.createDataFrame([(0, 1, 1, 1.0), (0, 1, 2, 2.0), (0, 2, 1, 2.0), (0, 2, 2, 12.0)], FRAMES)
    assert sum(r["cost"] for r in tracking.assign(table).collect()) == 4.0 and sum(r["cost"] for r in tracking.assign_greedily(table).collect()) == 13.0


def test_groups_are_those_of_links(spark):
    from tidemark.operators.groups import connected

    rng = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(80)]
    root = {x: x for p in links for x in p}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    table = spark.createDataFrame([((0, a), (0, b)) for a, b in links], "a struct<f:int,id:int>, b struct<f:int,id:int>")
    got = [(r["node"]["id"], r["root"]["id"]) for r in connected(table).collect()]
    assert sorted(got) == sorted((x, y) for x, y in root.items() if any(x in p and p[0] != p[1] for p in links))


def test_lifecycle_against_a_loop(spark):
    rng = np.random.default_rng(6)
    rows = [(k, f, bool(rng.random() < (0.2, 0.5, 0.8, 0.97)[k % 4]), float(rng.uniform(0, 9)), 8.0) for k in range(60) for f in range(int(rng.integers(1, 45)))]
    got = {(r["track_id"], r["frame_idx"]): r for r in tracking.lifecycles(spark.createDataFrame(rows, "track_id long, frame_idx long, hit boolean, d2 double, logdet double")).collect()}
    seen = set()
    for k, mine in itertools.groupby(rows, key=lambda r: r[0]):
        status, last, misses, score = "tentative", [], 0, 0.0
        for _, f, hit, d2, logdet in mine:
            if status != "dead":
                last, misses = [*last[-4:], hit], 0 if hit else misses + 1
                score += math.log(tracking.PD / tracking.BETA) - 0.5 * d2 - tracking.LOG_2PI - 0.5 * logdet if hit else math.log(1 - tracking.PD)
                if misses >= 10 or score < -20:
                    status = "dead"
                elif hit and (status == "coasting" or status == "tentative" and sum(last) >= 3):
                    status = "confirmed"
                elif status == "confirmed" and misses >= 2:
                    status = "coasting"
            seen.add(status)
            r = got[k, f]
            assert (r["status"], r["misses"], r["llr"]) == (status, misses, pytest.approx(score))
    assert seen == {"tentative", "confirmed", "coasting", "dead"}


def test_turns_that_cannot_be_are_missing(spark):
    from pyspark.sql import functions as F
    from tidemark.operators import forecast

    rows = [(0, 127.0, None), (1, -20.0, None), (2, 20.5, 1.0), (3, float("nan"), None), (4, 20.0, 0.5), (5, None, 90.0)]
    d = spark.createDataFrame(rows, "k int, turn double, past double")
    no = F.lit(None).cast("double")
    nav = forecast.navigation(no, no, no, F.col("turn"), F.lit(0), no, no, F.col("past"), F.lit(5), F.lit(0.0))
    out = {r["k"]: r for r in d.select("k", nav["turn"].alias("turn"), F.array_contains(nav["missing"], "rate_of_turn").alias("missing")).collect()}
    assert [(out[k]["turn"], out[k]["missing"]) for k in range(6)] == [(0.0, True), (-1.5, False), (1.0, False), (0.0, True), (1.5, False), (1.5, False)]


def test_candidates_are_told_in_order(spark):
    shape = "det_id long, track_id long, d2 double, gated_out boolean, p double, x double, y double, t double, last_x double, last_y double, last_t double"
    rows = [(1, 5, 12.345678, True, 0.0, 30.0, 40.0, 10.0, 0.0, 0.0, 0.0), (1, 4, 2.25, False, 0.2, 3.0, 4.0, 5.0, 0.0, 0.0, 5.0), (1, 3, 1.0, False, 0.7, 3.0, 4.0, 2.0, 0.0, 0.0, 5.0), (1, 2, 9.5, True, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), (2, 9, -1e-12, False, 0.1, 0.0, 0.0, 1.0, None, 0.0, 0.0)]
    got = {(r.det_id, r.track_id): r for r in tracking.told(spark.createDataFrame(rows, shape)).collect()}
    assert [got[1, t]["rank"] for t in (3, 4, 2, 5)] == [1, 2, 3, 4]
    assert got[1, 5].reason == "gated out: d2=12.35 > 9.21 (3.5 sigma)" and got[1, 4].reason == ""
    assert (got[1, 5].range_m, got[1, 5].implied_speed_mps) == (50.0, 5.0) and abs(got[1, 5].implied_speed_kn - 9.719222) < 1e-5
    assert got[1, 4].implied_speed_mps == got[1, 3].implied_speed_mps == 0.0 and got[1, 3].time_dark_s == -3.0
    assert got[2, 9].sigma_distance == 0.0 and got[2, 9].range_m is None
    assert tracking.told(spark.createDataFrame([], shape)).count() == 0


def test_reachable_in_no_time_is_staying(spark):
    d = spark.createDataFrame([(0.0, 0.0), (0.0, -5.0), (3.0, 0.0), (3.0, 1.0), (3.0, 0.99)], "far double, elapsed double")
    zero = F.lit(0.0)
    assert [r.c for r in d.select(geo.reachable(zero, zero, F.col("far"), zero, F.col("elapsed"), F.lit(3.0)).alias("c")).collect()] == [True, True, False, True, False]


def test_the_heaviest_hypothesis_stays_whatever_the_shares_round_to(spark):
    light, heavy = 50.93, math.nextafter(50.93, 99)
    rows = [(g, 0, name, w, 0) for g in range(60) for name, w in [("a", light), ("b", heavy), *[(f"c{i}", 40 + g / 7) for i in range(200)]]]
    totals = {g: math.fsum(r[3] for r in rows if r[0] == g) for g in range(60)}
    assert any(light / t == heavy / t for t in totals.values())
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "group long, root long, hyp_id string, weight double, depth int").repartition(7)
        for kept in (decisions.pruned(d), decisions.maintained(d)):
            assert {r["group"]: (r["hyp_id"], r["weight"]) for r in kept.collect()} == {g: ("b", 1.0) for g in range(60)}


def test_zones_of_one_shape_are_tested_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ring = lambda x, y, n: [[x + 4 * math.cos(2 * math.pi * k / n), y + 4 * math.sin(2 * math.pi * k / n)] for k in range(n)]
    square = lambda x, y: [[x, y], [x + 5.0, y], [x + 5.0, y + 5.0], [x, y + 5.0]]
    kinds = [[[square(0.0, 0.0), square(1.0, 1.0)]], [[ring(8.0, 8.0, 9)], [square(2.0, 9.0)]], [[ring(6.0, 6.0, 100)]]]
    areas = spark.createDataFrame([(f"z{k}", k % 5, kinds[k % 3]) for k in range(90)], "zone_id string, kind long, parts array<array<array<array<double>>>>")
    monkeypatch.setattr(zones, "SAME", 7)
    assert zones.shapes(areas).count() == 3 * math.ceil(30 / 7)
    at = [(float(x), float(y)) for x, y in rng.integers(-2, 15, (150, 2))] + [tuple(map(float, p)) for p in rng.uniform(-2, 15, (150, 2))]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "id long, x double, y double")
    for covers in (False, True):
        one = points.crossJoin(areas.withColumn("lines", zones.edges(F.col("parts"))))
        edge, inner = zones.on_edge(F.col("x"), F.col("y"), F.col("lines")), zones.enclosed(F.col("x"), F.col("y"), F.col("lines"))
        expected = sorted(map(tuple, one.where(edge | inner if covers else ~edge & inner).select("id", "zone_id", "kind").collect()))
        for few in (0, 100_000):
            monkeypatch.setattr(zones, "FEW", few)
            assert sorted(map(tuple, zones.contained(points, areas, covers=covers).select("id", "zone_id", "kind").collect())) == expected


def test_cheapest_pairs_are_enough_for_mutual_best(spark):
    rng = np.random.default_rng(8)
    tracks = spark.createDataFrame([(f, t, float(x), float(y), 40000.0, 5000.0, 90000.0) for f in range(3) for t, (x, y) in enumerate(rng.integers(0, 6, (60, 2)) * 150)], "frame_idx long, track_id long, px double, py double, p00 double, p01 double, p11 double")
    plots = spark.createDataFrame([(f, m, float(x), float(y), float(5 + m % 3 * 40)) for f in range(3) for m, (x, y) in enumerate(rng.integers(0, 6, (60, 2)) * 150)], "frame_idx long, meas_id long, x double, y double, sigma double")
    pairs, few = tracking.pair_costs(tracks, plots), tracking.cheapest_pairs(tracks, plots)
    assert few.count() < pairs.count() / 4
    best = lambda d: sorted(tuple(r) for r in tracking.mutual_best(d).select("frame_idx", "track_id", "meas_id").collect())
    assert best(few) == best(pairs)
