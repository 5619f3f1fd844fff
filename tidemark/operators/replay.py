"""Replay of missions frame by frame: predict, associate, coast, reacquire, give birth.

Frame k + 1 depends on frame k, so a mission runs in one task; missions run in parallel.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.tracking import BETA, GATE, LOG_2PI, PD, solve

Q, DELETE_AFTER, FRESH_S, REACH_MPS = 0.5, 60, 600.0, 20.0
#: Detection probability and clutter density when live tracks are matched, and when silent ones are.
LIVE, COASTING = (PD, BETA), (0.5, 1e-11)
TRACKS = "mission long, frame_idx long, track_id long, x double, y double, vx double, vy double, p00 double, status string, event string, meas_id long"


@dataclass
class Track:
    id: int
    x: np.ndarray
    p: np.ndarray
    fix: tuple[float, float, float]
    status: str = "tentative"
    hits: int = 2
    misses: int = 0
    history: list[bool] = field(default_factory=lambda: [True, True])
    llr: float = 0.0

    def predict(self, dt: float) -> None:
        f = np.eye(4)
        f[0, 2] = f[1, 3] = dt
        a, b, c = dt**4 / 4, dt**3 / 2, dt**2
        noise = Q * np.array([[a, 0, b, 0], [0, a, 0, b], [b, 0, c, 0], [0, b, 0, c]])
        self.x, self.p = f @ self.x, f @ self.p @ f.T + noise

    def update(self, z: np.ndarray, r: float, t: float, d2: float, logdet: float) -> str:
        pd_, beta = COASTING if self.status == "coasting" else LIVE
        s = self.p[:2, :2] + r * np.eye(2)
        k = self.p[:, :2] @ np.linalg.inv(s)
        a = np.eye(4)
        a[:, :2] -= k
        self.x = self.x + k @ (z - self.x[:2])
        self.p = a @ self.p @ a.T + r * k @ k.T
        was, long_gone = self.status, self.misses >= 4
        self.fix, self.misses, self.hits = (t, *z.tolist()), 0, self.hits + 1
        self.history = [*self.history[-4:], True]
        self.llr += math.log(pd_ / beta) - 0.5 * d2 - LOG_2PI - 0.5 * logdet
        if was == "coasting" or was == "tentative" and sum(self.history) >= 3:
            self.status = "confirmed"
        return "reacquired" if was == "coasting" and long_gone else ""

    def miss(self) -> str:
        self.llr += math.log(1 - (0.05 if self.status == "coasting" else PD))
        self.misses, self.history = self.misses + 1, [*self.history[-4:], False]
        if self.misses >= DELETE_AFTER or self.llr < -20:
            self.status = "dead"
        elif self.status == "confirmed" and self.misses >= 2:
            self.status = "coasting"
            return "went_dark" if self.hits >= 6 else ""
        return ""


def associate(tracks: list[Track], z: np.ndarray, r: np.ndarray, stage: tuple[float, float]) -> dict[int, tuple[int, float, float]]:
    """Track number to (plot number, d2, log determinant) of the cheapest assignment."""
    if not tracks or not len(z):
        return {}
    pd_, beta = stage
    s = np.array([t.p[:2, :2] for t in tracks])[:, None] + r[None, :, None, None] * np.eye(2)
    d = z[None] - np.array([t.x[:2] for t in tracks])[:, None]
    det = s[..., 0, 0] * s[..., 1, 1] - s[..., 0, 1] ** 2
    d2 = (s[..., 1, 1] * d[..., 0] ** 2 - 2 * s[..., 0, 1] * d[..., 0] * d[..., 1] + s[..., 0, 0] * d[..., 1] ** 2) / det
    ti, mi = np.nonzero(d2 <= GATE)
    logdet = np.log(det)
    cost = 0.5 * d2 + LOG_2PI + 0.5 * logdet - math.log(pd_)
    return {i: (j, d2[i, j], logdet[i, j]) for i, j in solve(len(tracks), len(z), ti, mi, cost[ti, mi], -math.log(1 - pd_), -math.log(beta))}


def run_mission(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    tracks: list[Track] = []
    pending: list[tuple[float, np.ndarray, float]] = []
    out, last_t, next_id = [], None, 0
    for frame, plots in rows.sort_values(["frame_idx", "meas_id"]).groupby("frame_idx", sort=True):
        t = float(plots["t"].iloc[0])
        dt = t - last_t if last_t is not None else 0.0
        last_t = t
        z, r, ids = plots[["x", "y"]].to_numpy(float), plots["sigma"].to_numpy(float) ** 2, plots["meas_id"].tolist()
        for track in tracks:
            track.predict(dt)
        live, coasting = [k for k in tracks if k.status != "coasting"], [k for k in tracks if k.status == "coasting"]
        found: dict[int, tuple[int, float, float]] = {}
        for i, hit in associate(live, z, r, LIVE).items():
            found[live[i].id] = hit
        left = [j for j in range(len(z)) if j not in {h[0] for h in found.values()}]
        fresh = [k for k in coasting if t - k.fix[0] <= FRESH_S]
        left = np.array([j for j in left if any(math.hypot(z[j, 0] - k.fix[1], z[j, 1] - k.fix[2]) <= REACH_MPS * (t - k.fix[0]) for k in fresh)] or [], int)
        for i, (j, d2, logdet) in associate(fresh, z[left], r[left], COASTING).items():
            found[fresh[i].id] = (int(left[j]), d2, logdet)
        used = {h[0] for h in found.values()}
        for track in tracks:
            hit = found.get(track.id)
            event = track.update(z[hit[0]], r[hit[0]], t, hit[1], hit[2]) if hit else track.miss()
            out.append((key[0], frame, track.id, *track.x, track.p[0, 0], track.status, event, ids[hit[0]] if hit else None))
        tracks = [k for k in tracks if k.status != "dead"]
        free = [j for j in range(len(z)) if j not in used]
        for t0, z0, r0 in pending:
            step = t - t0
            near = [(math.hypot(*(z[j] - z0)), j) for j in free]
            if step > 0 and near and min(near)[0] < 15 * step + 100:
                j = min(near)[1]
                free.remove(j)
                cov = np.zeros((4, 4))
                for axis in (0, 1):
                    cov[axis, axis], cov[axis, axis + 2] = r[j], r[j] / step
                    cov[axis + 2, axis], cov[axis + 2, axis + 2] = r[j] / step, (r[j] + r0) / step**2
                born = Track(next_id, np.array([*z[j], *((z[j] - z0) / step)]), cov, (t, *z[j].tolist()))
                next_id += 1
                tracks.append(born)
                out.append((key[0], frame, born.id, *born.x, born.p[0, 0], born.status, "born", ids[j]))
        pending = [(t, z[j], r[j]) for j in free]
    return pd.DataFrame(out, columns=[c.split()[0] for c in TRACKS.split(", ")]).astype({"meas_id": "Int64"})


def replay(measurements: DataFrame) -> DataFrame:
    """measurements: mission, frame_idx, t, meas_id, x, y, sigma; no identity. A row for each live track and frame."""
    cols = ["mission", "frame_idx", "t", "meas_id", "x", "y", "sigma"]
    return measurements.select(*cols).groupBy("mission").applyInPandas(run_mission, TRACKS)
