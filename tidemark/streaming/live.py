"""Live contacts as a stream: one state per contact, a changelog of its merged rows, and silences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "mmsi long, revision long, t_abs double, name string, speed_kn double, n_reports long, identity_changes long"
STATE = "t_abs double, name string, speed_kn double, n_reports long, identity_changes long"


def merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fields that a report lacks keep their last value; reports that aren't newer than the last are dropped; a new name counts as a change of identity."""
    t_abs, name, speed, n, changes = state.get if state.exists else (float("-inf"), None, None, 0, 0)
    rows = pd.concat(list(batches)).sort_values("t_abs")
    touched = False
    for r in rows.itertuples():
        if r.t_abs <= t_abs:
            continue
        new = r.name if isinstance(r.name, str) and r.name.strip() else None
        if new and name and new.strip().upper() != name.strip().upper():
            changes += 1
        t_abs, name, speed, n, touched = r.t_abs, new or name, r.speed_kn if pd.notna(r.speed_kn) else speed, n + 1, True
    state.update((t_abs, name, speed, n, changes))
    if touched:
        yield pd.DataFrame([(key[0], n, t_abs, name, speed, n, changes)], columns=[c.split()[0] for c in CHANGE.split(", ")])


def changelog(reports: DataFrame) -> DataFrame:
    """reports (streaming): mmsi, t_abs, name, speed_kn. A row for each contact that a batch changed."""
    return reports.groupBy("mmsi").applyInPandasWithState(merge, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)


CONTACT = "mmsi long, kind string, t_abs double, x double, y double, name string, dark boolean, revision long"
CONTACT_STATE = "t_abs double, x double, y double, name string, dark boolean, revision long, seen_ms long"


def contacts(messages: DataFrame, silent_ms: int = 45_000) -> DataFrame:
    """messages (streaming): mmsi, t_abs, x, y, name; without x it is static data. A row for each change: update, resume or dark.

    Static data that come before a contact's first position wait for it in the state and aren't seen outside; they never
    count as a sign of life. A contact of which no position came for silent_ms of processing time turns dark by its own
    timer, and a position ends that. Positions that aren't newer than the last are dropped.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t_abs, x, y, name, dark, revision, seen = state.get if state.exists else (None, None, None, None, False, 0, 0)
        kind = None
        if state.hasTimedOut:
            dark, kind = True, "dark"
        else:
            for r in pd.concat(list(batches)).sort_values("t_abs", kind="stable").itertuples():
                moved = pd.notna(r.x)
                if moved and t_abs is not None and r.t_abs <= t_abs:
                    continue
                if isinstance(r.name, str) and r.name.strip():
                    name = r.name.strip()
                if moved:
                    kind, dark = "resume" if dark or kind == "resume" else "update", False
                    t_abs, x, y, seen = r.t_abs, r.x, r.y, state.getCurrentProcessingTimeMs()
                elif t_abs is not None:
                    kind = kind or "update"
        revision += kind is not None
        state.update((t_abs, x, y, name, dark, revision, seen))
        if t_abs is not None and not dark:
            state.setTimeoutDuration(max(1, seen + silent_ms - state.getCurrentProcessingTimeMs()))
        if kind:
            yield pd.DataFrame([(key[0], kind, t_abs, x, y, name, dark, revision)], columns=[c.split()[0] for c in CONTACT.split(", ")])

    return messages.groupBy("mmsi").applyInPandasWithState(keep, CONTACT, CONTACT_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def evicted(latest: DataFrame, capacity: int, pinned: tuple[int, ...] = ()) -> DataFrame:
    """The contacts (mmsi, t_abs, dark) beyond capacity, those least recently seen; silent and pinned ones are never among them, but pinned ones take up room."""
    active = latest.where(~F.col("dark"))
    held = active.where(F.col("mmsi").isin(*pinned)).count() if pinned else 0
    free = active.where(~F.col("mmsi").isin(*pinned)) if pinned else active
    kept = free.orderBy(F.desc("t_abs"), "mmsi").limit(max(0, capacity - held))
    return free.join(kept.select("mmsi"), "mmsi", "left_anti")


def spells(reports: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """reports (streaming or not): mmsi, ts. Unbroken spells of reporting: a silence longer than gap ends one."""
    rows = reports.withWatermark("ts", late) if reports.isStreaming else reports
    w = F.session_window("ts", gap)
    return rows.groupBy("mmsi", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("mmsi", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote to path."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
