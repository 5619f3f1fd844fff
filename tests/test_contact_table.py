"""The bounded contact table against a plain simulation of its rules."""

import random

import pytest
from tidemark.streaming import live, tables

SCHEMA = "mmsi long, t_abs double, x double, y double, name string"


@pytest.fixture()
def rocks(spark):
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():  # runs over what is there must end, though names time out
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def simulated(batches, capacity, tombstones, pinned):
    """Changes by revision, contacts, waiting names and the floor after each batch."""
    contacts, names, gone, revision, floor, clock, log = {}, {}, [], 0, 0, 0, []
    for batch in batches:
        last = {}
        for mmsi, t, x, y, name in sorted(batch, key=lambda r: (r[1], r[0])):
            clock += 1
            name = (name or "").strip(" @\t") or None
            if mmsi not in contacts:
                if x is None:
                    if name:
                        names[mmsi] = (name, clock)
                    continue
                contacts[mmsi] = [float("-inf"), None, names.pop(mmsi, (None, 0))[0], 0, clock]
            c = contacts[mmsi]
            if x is not None and t <= c[0]:
                continue
            c[3] += bool(name and c[2] and name.upper() != c[2].upper())
            if x is not None:
                c[0], c[1], c[4] = t, x, clock
            c[2] = name or c[2]
            revision += 1
            last[mmsi] = (revision, False, c[0], c[1], c[2], c[3])
        for mmsi in sorted((m for m in contacts if m not in pinned), key=lambda m: contacts[m][4])[: max(0, len(contacts) - capacity)]:
            c = contacts.pop(mmsi)
            revision += 1
            gone.append(revision)
            last[mmsi] = (revision, True, c[0], c[1], c[2], c[3])
        for mmsi in sorted(names, key=lambda m: names[m][1])[: max(0, len(names) - 2 * capacity)]:
            names.pop(mmsi)
        while len(gone) > tombstones:
            floor = gone.pop(0)
        log += [(m, *v, floor) for m, v in last.items()]
    return log, contacts, floor, revision


def test_table_of_bounded_state(rocks, tmp_path):
    spark, rng = rocks, random.Random(2)
    batches = []
    for b in range(4):
        rows = []
        for k in range(70):
            mmsi, static = rng.randrange(40), rng.random() < 0.3
            rows.append((mmsi, float(b * 100 + rng.randrange(100)), None if static else rng.random(), None if static else rng.random(), rng.choice([None, "@@@@", " ", "ARTA", "arta ", "BORA"])))
        rows = list({(r[0], r[1]): r for r in rows}.values())
        batches.append(rows)
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = tables.contact_table(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), capacity=12, tombstones=9, buckets=1, pinned=(3,))
        got = live.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        log, contacts, floor, revision = simulated(batches[: b + 1], 12, 9, {3})
        assert sorted((r["mmsi"], r["revision"], r["gone"], r["t_abs"], r["x"], r["name"], r["switches"], r["floor"]) for r in got.collect()) == sorted(log)
    assert floor > 0 and len(contacts) == 12
    since = lambda n: {(r["mmsi"], r["gone"], r["full"]) for r in tables.snapshot_since(got, spark.createDataFrame([(0, n)] if n is not None else [], "bucket long, since long")).collect()}
    everything = {(m, False, True) for m in contacts}
    assert since(None) == since(0) == since(floor - 1) == since(revision + 1) == everything and since(revision) == set()
    newest = {m: (v, dead) for m, v, dead, *_ in sorted(log, key=lambda x: x[1])}
    assert since(floor) == {(m, dead, False) for m, (v, dead) in newest.items() if v > floor}
