"""Live contacts in state of bounded size: capacity, waiting names, revisions with tombstones and their floor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Contacts, removals that are remembered, and how many names may wait for a position for each contact.
CAPACITY, TOMBSTONES, WAITING = 100_000, 50_000, 2
CHANGES = "bucket long, revision long, mmsi long, gone boolean, t_abs double, x double, y double, name string, switches long, floor long"
CONTACT = "t_abs double, x double, y double, name string, switches long, seen long, revision long"


def clean(name) -> str | None:
    """A name that says something: not null, blank or a placeholder of @ signs."""
    name = name.strip(" @\t") if isinstance(name, str) else ""
    return name or None


class ContactTable(StatefulProcessor):
    """The contacts of a bucket. State: contacts, names that wait for a first position, tombstones, and counters."""

    def __init__(self, capacity: int, tombstones: int, pinned: tuple[int, ...], waiting_ms: int):
        self.capacity, self.most, self.pinned, self.waiting_ms = capacity, tombstones, frozenset(pinned), waiting_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.contacts = handle.getMapState("contacts", "mmsi long", CONTACT)
        self.names = handle.getMapState("names", "mmsi long", "name string, seen long", ttlDurationMs=self.waiting_ms)
        self.gone = handle.getMapState("gone", "revision long", "mmsi long")
        self.counters = handle.getValueState("counters", "revision long, floor long, clock long, contacts long, names long, gone long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        revision, floor, clock, n, waiting, n_gone = self.counters.get() if self.counters.exists() else (0, 0, 0, 0, 0, 0)
        out: dict[int, tuple] = {}
        for r in pd.concat(list(rows)).sort_values(["t_abs", "mmsi"], kind="stable").itertuples():
            clock += 1
            mmsi, name, moved = (r.mmsi,), clean(r.name), pd.notna(r.x) and pd.notna(r.y)
            known = self.contacts.getValue(mmsi) if self.contacts.containsKey(mmsi) else None
            if known is None and not moved:
                if name:
                    waiting += not self.names.containsKey(mmsi)
                    self.names.updateValue(mmsi, (name, clock))
                continue
            if known is None:
                n += 1
                early = self.names.getValue(mmsi)[0] if self.names.containsKey(mmsi) else None
                if early:
                    self.names.removeKey(mmsi)
                    waiting -= 1
                known = (float("-inf"), None, None, early, 0, clock, 0)
            t, x, y, before, switches, seen, _ = known
            if moved and r.t_abs <= t:
                continue
            switches += bool(name and before and name.upper() != before.upper())
            if moved:  # what isn't a position is no sign of life
                t, x, y, seen = float(r.t_abs), float(r.x), float(r.y), clock
            revision += 1
            row = (t, x, y, name or before, switches, seen, revision)
            self.contacts.updateValue(mmsi, row)
            out[r.mmsi] = (key[0], revision, r.mmsi, False, t, x, y, name or before, switches, 0)
        if n > self.capacity:
            order = sorted((v[5], k[0]) for k, v in self.contacts.iterator() if k[0] not in self.pinned)
            for _, mmsi in order[: n - self.capacity]:
                t, x, y, name, switches, *_ = self.contacts.getValue((mmsi,))
                self.contacts.removeKey((mmsi,))
                revision += 1
                self.gone.updateValue((revision,), (mmsi,))
                out[mmsi] = (key[0], revision, mmsi, True, t, x, y, name, switches, 0)
                n, n_gone = n - 1, n_gone + 1
        if waiting > WAITING * self.capacity:
            order = sorted((v[1], k[0]) for k, v in self.names.iterator())  # some may have run out of time
            for _, mmsi in order[: max(0, len(order) - WAITING * self.capacity)]:
                self.names.removeKey((mmsi,))
            waiting = min(len(order), WAITING * self.capacity)
        if n_gone > self.most:
            for at in sorted(k[0] for k in self.gone.keys())[: n_gone - self.most]:
                self.gone.removeKey((at,))
                floor, n_gone = at, n_gone - 1
        self.counters.update((revision, floor, clock, n, waiting, n_gone))
        if out:
            yield pd.DataFrame([(*v[:-1], floor) for v in out.values()], columns=[c.split()[0] for c in CHANGES.split(", ")])


def contact_table(messages: DataFrame, *, capacity: int = CAPACITY, tombstones: int = TOMBSTONES, buckets: int = 64, pinned: tuple[int, ...] = (), waiting_ms: int = 86_400_000) -> DataFrame:
    """messages (streaming): mmsi, t_abs, x, y, name; without x and y it is static data. A row for the last change of each contact in a batch (CHANGES).

    Contacts are dealt to buckets by mmsi; each holds its share of the capacity, so the state never holds more contacts than
    capacity, twice as many waiting names, and tombstones, however long the stream runs. After a batch, the contacts that
    were least recently heard leave a full bucket, but for pinned ones, and make a row with ``gone``; a bucket counts its own
    revisions. Only the last ``tombstones`` removals are remembered; floor is the revision up to which they were forgotten.
    Names wait for waiting_ms at most for their contact's first position. Needs the RocksDB state store,
    and ``spark.sql.streaming.noDataMicroBatches.enabled=false`` for runs over what is there only.
    """
    share = lambda n: max(1, n // buckets)
    processor = ContactTable(share(capacity), share(tombstones), pinned, waiting_ms)
    keyed = messages.withColumn("bucket", F.pmod(F.xxhash64("mmsi"), F.lit(buckets)))
    return keyed.groupBy("bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=CHANGES, outputMode="Append", timeMode="ProcessingTime")


def snapshot_since(changes: DataFrame, since: DataFrame) -> DataFrame:
    """What a client that holds revision ``since`` of each bucket (bucket, since) has to learn: bucket, mmsi, revision, gone, full and what is known.

    changes: all rows of a contact_table so far. A bucket is answered in full, with what it holds and no removals, if the
    client has nothing (0 or no row), is behind the floor, or is ahead of the bucket; else with what changed after since.
    """
    now = changes.groupBy("bucket").agg(F.max("revision").alias("revision"), F.max("floor").alias("floor"))
    asked = now.join(since, "bucket", "left").withColumn("since", F.coalesce("since", F.lit(0)))
    full = (F.col("since") <= 0) | (F.col("since") < F.col("floor")) | (F.col("since") > F.col("revision"))
    asked = asked.select("bucket", F.when(full, 0).otherwise(F.col("since")).alias("since"), full.alias("full"))
    last = changes.withColumn("_n", F.row_number().over(W.partitionBy("bucket", "mmsi").orderBy(F.desc("revision")))).where("_n = 1").drop("_n", "floor")
    return last.join(F.broadcast(asked), "bucket").where((F.col("revision") > F.col("since")) & ~(F.col("full") & F.col("gone"))).drop("since")  # a row for each bucket
