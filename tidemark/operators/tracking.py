"""Filters, gating, assignment, lifecycle and re-attribution of tracks.

What is a formula over pairs or rows is a Column expression or a window. The optimal assignment is solved over Arrow
for each connected group of a frame's gated pairs, so no task holds a frame; the frame-by-frame replay of a mission
is sequential and runs per mission.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.labels import fixed
from tidemark.operators.cells import in_cells
from tidemark.operators.groups import connected
from tidemark.operators.staging import staged

GATE, PD, BETA = 9.21034, 0.9, 1e-6
MISS, BIRTH = -math.log(1 - PD), -math.log(BETA)
LOG_2PI = math.log(2 * math.pi)


def distance2(dx: Column, dy: Column, a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Squared Mahalanobis distance and log determinant for the covariance (a b; b c)."""
    det = a * c - b * b
    return (c * dx * dx - 2 * b * dx * dy + a * dy * dy) / det, F.log(det)


def candidates(tracks: DataFrame, plots: DataFrame, gate: float = GATE) -> DataFrame:
    """Per frame, every track (frame_idx, track_id, px, py, p00, p01, p11) with every plot (frame_idx, meas_id, x, y, sigma) inside the gate; adds dx, dy, the sum's covariance a, b, c and d2.

    A track is dealt to the cells that its own gate's box touches, whatever its covariance, so no gated pair is lost.
    Plots are told apart by powers of two of their sigma, so one wide plot widens no track's box for the others.
    """
    plots = plots.withColumn("_wide", F.ceil(F.log2(F.greatest("sigma", F.lit(1e-3)))).cast("int"))
    most = plots.groupBy("frame_idx", "_wide").agg(F.max(F.col("sigma") * F.col("sigma")).alias("most"))
    wide = lambda p: F.sqrt(gate * (F.col(p) + F.col("most")))
    t = tracks.join(most, "frame_idx").withColumn("rx", wide("p00")).withColumn("ry", wide("p11")).drop("most")
    low, high = [tuple(F.col(c) + sign * F.col(r) for c, r in (("px", "rx"), ("py", "ry"))) for sign in (-1, 1)]
    pairs = in_cells(t, plots, ["frame_idx", "_wide"], low, high, (F.col("x"), F.col("y"))).drop("rx", "ry", "_wide")
    r = F.col("sigma") * F.col("sigma")
    pairs = pairs.withColumns({"dx": F.col("x") - F.col("px"), "dy": F.col("y") - F.col("py"), "a": F.col("p00") + r, "b": F.col("p01"), "c": F.col("p11") + r})
    d2, _ = distance2(*[F.col(k) for k in ("dx", "dy", "a", "b", "c")])
    return pairs.withColumn("d2", d2).where(F.col("d2") <= gate)


def pair_costs(tracks: DataFrame, plots: DataFrame) -> DataFrame:
    """The candidates inside the gate with their cost."""
    pairs = candidates(tracks, plots)
    _, logdet = distance2(*[F.col(k) for k in ("dx", "dy", "a", "b", "c")])
    return pairs.withColumn("cost", 0.5 * F.col("d2") + LOG_2PI + 0.5 * logdet - math.log(PD)).drop("dx", "dy", "a", "b", "c")


def left_over(tracks: DataFrame, plots: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tracks and the plots of each frame that an assignment leaves without a partner."""
    return tracks.join(chosen, ["frame_idx", "track_id"], "left_anti"), plots.join(chosen, ["frame_idx", "meas_id"], "left_anti")


def mutual_best(pairs: DataFrame) -> DataFrame:
    """The pairs that are the cheapest of both their track and their plot: the first round of any greedy assignment. Ties go to the smaller ids."""
    pick = F.struct("cost", "track_id", "meas_id")
    best = lambda side: pairs.groupBy("frame_idx", side).agg(F.min(pick).alias("p")).select("frame_idx", "p.track_id", "p.meas_id", "p.cost")
    return best("track_id").join(best("meas_id"), ["frame_idx", "track_id", "meas_id", "cost"])


#: More than two runs over the same pairs can make a cost differ.
SAME_COST = 1e-9


def cheapest_pairs(tracks: DataFrame, plots: DataFrame) -> DataFrame:
    """The pairs of pair_costs that are as cheap as the cheapest of their track or their plot, and at most a few more: all that mutual_best needs.

    The least cost of each side is a number, so it is told in passing, without pairs that are sorted, shuffled or written;
    the pairs are gone through once more to keep those that have it.
    """
    pairs = pair_costs(tracks.select("frame_idx", "track_id", "px", "py", "p00", "p01", "p11"), plots.select("frame_idx", "meas_id", "x", "y", "sigma"))
    least = lambda side: staged(pairs.groupBy("frame_idx", side).agg(F.min("cost").alias(f"least_{side}")))
    t, p = tracks.join(least("track_id"), ["frame_idx", "track_id"]), plots.join(least("meas_id"), ["frame_idx", "meas_id"])
    near = pair_costs(t, p).where((F.col("cost") <= F.col("least_track_id") + SAME_COST) | (F.col("cost") <= F.col("least_meas_id") + SAME_COST))
    return staged(near.select("frame_idx", "track_id", "meas_id", "cost"))


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row of the cheapest matching of all rows (shortest augmenting paths); there are at least as many columns."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j, least, via, seen = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while row_of[j]:
            seen[j] = True
            r = row_of[j]
            slack = cost[r - 1] - u[r] - v[1:]
            better = ~seen[1:] & (slack < least[1:])
            least[1:][better], via[1:][better] = slack[better], j
            open_ = np.where(seen[1:], np.inf, least[1:])
            k = int(open_.argmin()) + 1
            delta = open_[k - 1]
            u[row_of[seen]] += delta
            v[seen] -= delta
            least[~seen] -= delta
            j = k
        while j:
            row_of[j] = row_of[via[j]]
            j = via[j]
    out = np.full(n, -1)
    used = np.flatnonzero(row_of[1:])
    out[row_of[1:][used] - 1] = used
    return out


def solve(n: int, m: int, ti: np.ndarray, mi: np.ndarray, cost: np.ndarray, miss: float = MISS, birth: float = BIRTH) -> list[tuple[int, int]]:
    """The cheapest set of gated pairs, misses and births.

    A pair saves miss + birth - cost; pairs that save nothing are never needed. Groups of tracks and
    plots that no pair connects are solved one by one, each track with a free column for its miss.
    """
    gain = cost - miss - birth
    worth = gain < 0
    ti, mi, gain = ti[worth], mi[worth], gain[worth]
    root = np.arange(n + m)
    while True:
        least = np.minimum(root[ti], root[n + mi])
        before = root.copy()
        np.minimum.at(root, ti, least)
        np.minimum.at(root, n + mi, least)
        root = root[root]
        if np.array_equal(root, before):
            break
    out: list[tuple[int, int]] = []
    order = np.argsort(root[ti], kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(root[ti][order])) + 1) if len(order) else []:
        t, ri = np.unique(ti[part], return_inverse=True)
        c, ci = np.unique(mi[part], return_inverse=True)
        table = np.full((len(t), len(c) + len(t)), 1e12)
        table[ri, ci] = gain[part]
        table[:, len(c) :] = 0
        out += [(int(t[i]), int(c[j])) for i, j in enumerate(hungarian(table).tolist()) if j < len(c)]
    return sorted(out)


def in_groups(pairs: DataFrame) -> DataFrame:
    """The pairs (frame_idx, track_id, meas_id, cost) that are cheaper than a miss and a birth, with the group they belong to: its least track. Others are in no optimum."""
    worth = staged(pairs.select("frame_idx", "track_id", "meas_id", "cost").where(F.col("cost") < MISS + BIRTH))
    node = lambda side, c: F.struct(F.col("frame_idx"), F.lit(side).alias("side"), F.col(c).alias("id"))
    roots = connected(worth.select(node(1, "meas_id").alias("a"), node(0, "track_id").alias("b"))).where("node.side = 0")
    return worth.join(roots.select("node.frame_idx", F.col("node.id").alias("track_id"), F.col("root.id").alias("group")), ["frame_idx", "track_id"])


def solved(pairs: pd.DataFrame) -> tuple[pd.DataFrame, float]:
    """The optimum's pairs and what they save."""
    (t, ti), (m, mi) = (np.unique(pairs[c], return_inverse=True) for c in ("track_id", "meas_id"))
    chosen = solve(len(t), len(m), ti, mi, pairs["cost"].to_numpy())
    rows = pd.DataFrame([(t[i], m[j]) for i, j in chosen], columns=["track_id", "meas_id"]).merge(pairs, on=["track_id", "meas_id"])
    return rows, float((rows["cost"] - MISS - BIRTH).sum())


ASSIGNED = "frame_idx long, track_id long, meas_id long, cost double"


def assign(pairs: DataFrame) -> DataFrame:
    """Optimal assignment of each frame, as the optima of its connected groups. A pair comes once in pairs."""
    best = lambda rows: solved(rows)[0][["frame_idx", "track_id", "meas_id", "cost"]]
    return in_groups(pairs).groupBy("frame_idx", "group").applyInPandas(best, ASSIGNED)


def assign_greedily(pairs: DataFrame) -> DataFrame:
    """Best-first assignment by (cost, track_id, meas_id): rounds of pairs that are the best of both their sides, until none is left.

    A pair that is the best of both is committed before anything that could take its sides, so the rounds come to what
    one sorted pass over a frame comes to. Each round takes at least the best pair of every frame that is left.
    """
    left, taken = staged(pairs.select("frame_idx", "track_id", "meas_id", "cost")), []
    while not left.isEmpty():
        taken.append(staged(mutual_best(left)))
        left = staged(left_of(left, taken[-1]))
    out = left
    for rows in taken:
        out = out.unionByName(rows)
    return out


def left_of(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The pairs neither of whose sides is taken."""
    for side in ("track_id", "meas_id"):
        pairs = pairs.join(chosen.select("frame_idx", side), ["frame_idx", side], "left_anti")
    return pairs


def total_costs(chosen: DataFrame, tracks: DataFrame, plots: DataFrame) -> DataFrame:
    """frame_idx, cost, n_assigned, n_tracks, n_plots: costs of the chosen pairs, of a miss for each other track and a birth for each other plot."""
    count = lambda rows, name: rows.groupBy("frame_idx").agg(F.count(F.lit(1)).alias(name))
    made = chosen.groupBy("frame_idx").agg(F.sum("cost").alias("made"), F.count(F.lit(1)).alias("n_assigned"))
    d = count(tracks, "n_tracks").join(count(plots, "n_plots"), "frame_idx", "full").join(made, "frame_idx", "left").na.fill(0)
    cost = F.col("made") + MISS * (F.col("n_tracks") - F.col("n_assigned")) + BIRTH * (F.col("n_plots") - F.col("n_assigned"))
    return d.select("frame_idx", cost.alias("cost"), "n_assigned", "n_tracks", "n_plots")


#: Fixed value: a frame whose second best assignment is nearer than this is ambiguous.
AMBIGUOUS = 2.0


def margins(pairs: DataFrame, tracks: DataFrame, plots: DataFrame) -> DataFrame:
    """frame_idx, cost_best, cost_second, margin, ambiguous, w_best, w_second: how much the optimum costs more without its cheapest pair.

    Only the group of that pair changes, so each group is solved with and without its own cheapest pair and the frame takes
    the difference of the one that has the cheapest of all (ties by track and plot). Weights are the softmax of the negative
    costs. A frame without any assignment has an infinite margin and the weights 1 and 0.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        best, saved = solved(rows)
        if best.empty:
            return pd.DataFrame([], columns=["frame_idx", "cost", "track_id", "meas_id", "n", "made", "more"])
        pivot = best.sort_values(["cost", "track_id", "meas_id"]).iloc[0]
        again = rows[(rows["track_id"] != pivot["track_id"]) | (rows["meas_id"] != pivot["meas_id"])]
        more = (solved(again)[1] if len(again) else 0.0) - saved
        return pd.DataFrame([(key[0], pivot["cost"], int(pivot["track_id"]), int(pivot["meas_id"]), len(best), best["cost"].sum(), more)], columns=["frame_idx", "cost", "track_id", "meas_id", "n", "made", "more"])

    found = in_groups(pairs).groupBy("frame_idx", "group").applyInPandas(run, "frame_idx long, cost double, track_id long, meas_id long, n long, made double, more double")
    by_frame = found.groupBy("frame_idx").agg(F.sum("made").alias("cost"), F.sum("n").alias("n"), F.min(F.struct("cost", "track_id", "meas_id", "more")).alias("pivot"))
    count = lambda rows, name: rows.groupBy("frame_idx").agg(F.count(F.lit(1)).alias(name))
    d = count(tracks, "n_tracks").join(count(plots, "n_plots"), "frame_idx", "full").join(by_frame, "frame_idx", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    d = d.withColumn("cost_best", none("cost") + MISS * (none("n_tracks") - none("n")) + BIRTH * (none("n_plots") - none("n")))
    more = F.when(F.col("pivot").isNull(), float("inf")).otherwise(F.greatest(F.col("pivot.more"), F.lit(0.0)))
    d = d.withColumns({"margin": more, "cost_second": F.col("cost_best") + more, "ambiguous": more < AMBIGUOUS, "w_best": 1 / (1 + F.exp(-more))})
    return d.select("frame_idx", "cost_best", "cost_second", "margin", "ambiguous", "w_best", (1 - F.col("w_best")).alias("w_second"))


def filtered(points: DataFrame, q: float = 0.5) -> DataFrame:
    """mmsi, n, x, vx, y, vy, p00, p01, p11: constant-velocity filter over each contact's reports (t, x, y, sigma).

    With equal noise in both axes the axes part into two filters with one covariance (p00, p01, p11), so the
    whole run is a fold over the contact's sorted reports, without Python. Started from the first two.
    """
    rows = points.groupBy("mmsi").agg(F.sort_array(F.collect_list(F.struct("t", "x", "y", "sigma"))).alias("z")).where(F.size("z") >= 2)
    a, b = F.get("z", F.lit(0)), F.get("z", F.lit(1))
    dt, r = b["t"] - a["t"], b["sigma"] * b["sigma"]
    named = lambda *v: F.struct(*[c.alias(n) for n, c in zip(("t", "x", "vx", "y", "vy", "p00", "p01", "p11"), v, strict=True)])
    start = named(b["t"], b["x"], (b["x"] - a["x"]) / dt, b["y"], (b["y"] - a["y"]) / dt, r, r / dt, 2 * r / (dt * dt))

    def step(s: Column, z: Column) -> Column:
        d, rr = z["t"] - s["t"], z["sigma"] * z["sigma"]
        p00 = s["p00"] + 2 * d * s["p01"] + d * d * s["p11"] + q * d * d * d * d / 4
        p01 = s["p01"] + d * s["p11"] + q * d * d * d / 2
        p11 = s["p11"] + q * d * d
        k0, k1 = p00 / (p00 + rr), p01 / (p00 + rr)
        ex, ey = z["x"] - (s["x"] + d * s["vx"]), z["y"] - (s["y"] + d * s["vy"])
        return named(
            z["t"], s["x"] + d * s["vx"] + k0 * ex, s["vx"] + k1 * ex, s["y"] + d * s["vy"] + k0 * ey, s["vy"] + k1 * ey,
            (1 - k0) * (1 - k0) * p00 + k0 * k0 * rr, (1 - k0) * (p01 - k1 * p00) + k0 * k1 * rr, p11 - 2 * k1 * p01 + k1 * k1 * (p00 + rr),
        )

    return rows.select("mmsi", F.size("z").cast("long").alias("n"), F.aggregate(F.slice("z", 3, F.size("z")), start, step).alias("s")).select("mmsi", "n", "s.*")


def switches(matches: DataFrame) -> DataFrame:
    """truth_id, n_matches, n_switches, n_tracks from (frame, ord, track_id, truth_id); gaps don't clear a truth's last track."""
    before = F.lag("track_id").over(W.partitionBy("truth_id").orderBy("frame", "ord"))
    d = matches.withColumn("switch", F.when(before.isNotNull() & (before != F.col("track_id")), 1).otherwise(0))
    return d.groupBy("truth_id").agg(F.count(F.lit(1)).alias("n_matches"), F.sum("switch").cast("long").alias("n_switches"), F.count_distinct("track_id").alias("n_tracks"))


def clear_mot_totals(matches: DataFrame, frames: DataFrame) -> DataFrame:
    """One row: id_switches, merges, frames, total_matches, truths_seen, tracks_seen. matches as in switches; frames: every frame, empty ones too.

    A merge is each further truth that one track has in the same frame. Truths and tracks are counted from one row each.
    """
    by_truth = switches(matches).agg(F.coalesce(F.sum("n_switches"), F.lit(0)).alias("id_switches"), F.coalesce(F.sum("n_matches"), F.lit(0)).alias("total_matches"), F.count(F.lit(1)).alias("truths_seen"))
    one = matches.select("frame", "track_id", "truth_id").distinct().groupBy("frame", "track_id").agg((F.count(F.lit(1)) - 1).alias("more"))
    merged = one.groupBy("track_id").agg(F.sum("more").alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("merges"), F.count(F.lit(1)).alias("tracks_seen"))
    counted = frames.select("frame").distinct().agg(F.count(F.lit(1)).alias("frames"))
    key = F.lit(1).alias("_one")  # three tables of one row each
    return by_truth.select("*", key).join(merged.select("*", key), "_one").join(counted.select("*", key), "_one").drop("_one")


def reattributed(candidates: DataFrame, beta: float = 1e-9) -> DataFrame:
    """candidates (det_id, track_id, dx, dy, a, b, c, ...) with d2, gated_out and p: likelihoods over their sum and the clutter density, in logarithms."""
    d2, logdet = distance2(F.col("dx"), F.col("dy"), F.col("a"), F.col("b"), F.col("c"))
    d = candidates.withColumn("d2", d2).withColumn("gated_out", F.col("d2") > GATE).withColumn("ll", F.when(~F.col("gated_out"), -0.5 * F.col("d2") - LOG_2PI - 0.5 * logdet))
    w = W.partitionBy("det_id")
    d = d.withColumn("top", F.greatest(F.max("ll").over(w), F.lit(math.log(beta))))
    mass = F.exp(F.col("ll") - F.col("top"))
    return d.withColumn("p", F.coalesce(mass / (F.sum(mass).over(w) + F.exp(math.log(beta) - F.col("top"))), F.lit(0.0))).drop("ll", "top")


#: Fixed value: knots of a metre a second.
KNOTS = 1.943844492440605


def told(found: DataFrame, gate: float = GATE) -> DataFrame:
    """found (of reattributed, with x, y, t of the plot and last_x, last_y, last_t of the track's last fix) with what is said of each candidate.

    Adds sigma_distance, time_dark_s, range_m, implied_speed_mps and implied_speed_kn (0 if no time has passed), reason
    (empty inside the gate; fixed wording, as clients show it) and rank: the likeliest track of a plot first, then the
    nearest by d2, then by id.
    """
    dark, far = F.col("t") - F.col("last_t"), F.hypot(F.col("x") - F.col("last_x"), F.col("y") - F.col("last_y"))
    speed, sigmas = F.when(dark > 0, far / dark).otherwise(0.0), F.sqrt(F.greatest("d2", F.lit(0.0)))
    reason = F.when(F.col("gated_out"), F.concat(F.lit("gated out: d2="), fixed(F.col("d2"), 2), F.lit(f" > {gate:.2f} ("), fixed(sigmas, 1), F.lit(" sigma)"))).otherwise("")
    d = found.withColumns({"sigma_distance": sigmas, "time_dark_s": dark, "range_m": far, "implied_speed_mps": speed, "implied_speed_kn": speed * KNOTS, "reason": reason})
    return d.withColumn("rank", F.row_number().over(W.partitionBy("det_id").orderBy(F.desc("p"), "d2", "track_id")))


#: A track is confirmed by so many hits in so many frames, coasts after so many misses and dies after so many or below this score.
CONFIRM_HITS, CONFIRM_FRAMES = 3, 5
COAST_MISSES, DEAD_MISSES, DEAD_SCORE = 2, 10, -20.0


def lifecycles(hits: DataFrame) -> DataFrame:
    """track_id, frame_idx, status, misses, llr of each row of hits (track_id, frame_idx, hit, d2, logdet).

    A track is tentative until its first hit with enough hits in its last frames, then coasting while it has enough misses
    in a row, else confirmed, and dead for good once it has too many or its score is too low; then nothing of it changes.
    All of it are counts and sums over the rows before, so windows of one sort by track have it.
    """
    w = W.partitionBy("track_id").orderBy("frame_idx")
    till, recent = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(1 - CONFIRM_FRAMES, 0)
    hit = F.coalesce(F.col("hit"), F.lit(False))
    gain = F.when(hit, math.log(PD / BETA) - LOG_2PI - 0.5 * F.col("d2") - 0.5 * F.col("logdet")).otherwise(math.log(1 - PD))
    d = hits.select("track_id", "frame_idx", hit.alias("hit"), F.row_number().over(w).alias("n"), F.sum(gain).over(till).alias("llr"), F.sum(hit.cast("int")).over(recent).alias("recent"))
    d = d.withColumn("misses", F.col("n") - F.coalesce(F.max(F.when(F.col("hit"), F.col("n"))).over(till), F.lit(0)))
    dying = (F.col("misses") >= DEAD_MISSES) | (F.col("llr") < DEAD_SCORE)
    at_death = F.first(F.when(dying, F.struct("n", "misses", "llr")), ignorenulls=True).over(till)
    confirmed = F.max(F.when(F.col("hit") & ~dying & (F.col("recent") >= CONFIRM_HITS), True)).over(till)
    d = d.withColumns({"end": at_death, "confirmed": F.coalesce(confirmed, F.lit(False))})
    status = F.when(F.col("end").isNotNull(), "dead").when(~F.col("confirmed"), "tentative").when(F.col("misses") >= COAST_MISSES, "coasting").otherwise("confirmed")
    return d.select("track_id", "frame_idx", status.alias("status"), F.coalesce("end.misses", "misses").cast("int").alias("misses"), F.coalesce("end.llr", "llr").alias("llr"))
