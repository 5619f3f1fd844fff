"""Leaves of unknown JSON against a recursive walk."""

import json
import random

from tidemark.sources import documents


def leaves(value, path="", name=""):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in leaves(v, f"{path}.{k}" if path else k, k)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in leaves(v, f"{path}[{i}]", name)]
    return [(path, name, value)]


def grown(rng, depth):
    kind = rng.randrange(6) if depth else rng.randrange(4)
    if kind < 4:
        return [None, True, rng.randrange(-9, 9), rng.choice(["x.csv", "a/b.json", "", "Ünï", "see a/b.csv."])][kind]
    return [grown(rng, depth - 1) for _ in range(rng.randrange(4))] if kind == 4 else {rng.choice(["a", "b c", "notes", "file", "ä"]): grown(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_every_leaf_at_any_depth(spark):
    rng = random.Random(7)
    values = [grown(rng, 6) for _ in range(120)] + [{"a": {"b": [[{"c": [1]}]]}}]
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(1000, None), (1001, "{bad"), (1002, "")]
    got = sorted((r["id"], r["path"], r["name"], r["value"]) for r in documents.walk(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect() if r["value"] is not None)
    text = lambda v: "true" if v is True else str(v)
    assert got == sorted((k, p, n, text(v)) for k, value in enumerate(values) for p, n, v in leaves(value) if v is not None)


def test_references_and_what_is_missing(spark):
    pack = {"a": ["x.csv", {"file": "d/y.json"}], "url": "https://h/z.csv", "title": "no file.csv", "notes": "read d/y.json, (e/old.geojson) or https://h/q.csv; plain.csv isn't meant", "n": 1.5}
    found = documents.references(documents.walk(spark.createDataFrame([(1, json.dumps(pack))], "id int, j string"), "id", "j"))
    assert sorted((r["path"], r["file"], r["promised"]) for r in found.collect()) == [("a[0]", "x.csv", True), ("a[1].file", "d/y.json", True), ("notes", "d/y.json", False), ("notes", "e/old.geojson", False)]
    lost = documents.missing(found, spark.createDataFrame([(1, "d/y.json"), (2, "x.csv")], "id int, file string"), "id").collect()
    assert sorted((r["file"], r["outcome"]) for r in lost) == [("e/old.geojson", "SKIP"), ("x.csv", "FAIL")]
