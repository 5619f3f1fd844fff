"""Moments, windows and boxes against the standard library's reader."""

import json
import math
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import times


def variants(spark, values, column):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
    return [r.c for r in rows.select("n", column(F.try_parse_json("v")).alias("c")).orderBy("n").collect()]


def plainly(text):
    try:
        d = datetime.fromisoformat(text.strip())
    except ValueError:
        return None
    return (d if d.tzinfo else d.replace(tzinfo=UTC)).timestamp()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_texts_are_read_as_the_standard_library_does(spark, zone):
    rng = random.Random(5)
    texts = ["2024-06-15", "20240615", "2024-02-30", "2023-02-29", "0001-01-01", "0000-01-01", "2024-06-15T", "2024-06-15T24:00", "2024-06-15T06:00:60", "2024-03-10T02:30:00", "2024-06-15T06:00+23:59", "2024-06-15T06:00-24:00", "2024-06-15T06:00z", "x2024-06-15", "2024-6-15", "2024-06-15T06:00:00.1234567", "2024-06-15T06:00:00.", " 2024-06-15T06 "]
    for _ in range(500):
        y, mo, d, h, mi, s = rng.randrange(1900, 2100), rng.randrange(0, 14), rng.randrange(0, 33), rng.randrange(0, 26), rng.randrange(0, 62), rng.randrange(0, 62)
        date = rng.choice([f"{y}-{mo:02}-{d:02}", f"{y}{mo:02}{d:02}"])
        time = rng.choice(["", f"{h:02}", f"{h:02}:{mi:02}", f"{h:02}:{mi:02}:{s:02}", f"{h:02}:{mi:02}:{s:02}.{rng.randrange(1000):03}", f"{h:02}{mi:02}", f"{h:02}{mi:02}{s:02}"])
        texts.append(date + (rng.choice("T _") + time + rng.choice(["", "", "Z", "+02:00", "-0530", "+14", "+00:00:30"]) if time else ""))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = variants(spark, [json.dumps(t) for t in texts], lambda v: times.epoch(v, numeric_text=False))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    wrong = [(t, g.seconds, plainly(t)) for t, g in zip(texts, got, strict=True) if (g.seconds is None) != (plainly(t) is None) or g.seconds is not None and not math.isclose(g.seconds, plainly(t), abs_tol=2e-6)]
    # The end of a day as 24:00 is read by newer versions of the library only.
    assert [w for w in wrong if "24" not in w[0][9:14]] == []
    assert all((g.seconds is None) != (g.problem is None) for g in got)


def test_other_kinds_of_values(spark):
    values = ["1718431200", "1718431200.5", '"1718431200"', '"1e3"', '"20240615"', "20240615", "true", "null", None, "{}", "[1]", '""', '"  "', '"12d"', '"nan"', '"inf"', '"soon"', "not json"]
    got = [(r.seconds, r.problem) for r in variants(spark, values, times.epoch)]
    assert [g[0] for g in got[:6]] == [1718431200.0, 1718431200.5, 1718431200.0, 1000.0, 1718409600.0, 20240615.0]
    assert [g[1] for g in got[6:13]] == ["boolean is no time", "no time", "no time", "object is no time", "array is no time", "an empty text", "an empty text"]
    assert all(s is None and p.startswith("not an ISO 8601 time or a number: ") for s, p in got[13:17]) and got[17] == (None, "no time")
    assert variants(spark, ['"1718431200"'], lambda v: times.epoch(v, numeric_text=False))[0].seconds is None


def test_windows(spark):
    values = ['{"start": "1970-01-02", "end": 90000}', '{"t0": 1, "start": null, "finish": "2"}', "[0, 5]", "[5, 5]", "[5]", '{"start": 1}', '{"start": true, "end": 2}', '{"start": 1, "end": "x"}', "7", None, "[true, 3]"]
    got = [tuple(r) for r in variants(spark, values, times.window)]
    assert got[:3] == [(86400.0, 90000.0, None), (1.0, 2.0, None), (0.0, 5.0, None)]
    assert [g[2] for g in got[3:]] == ["the start isn't before the end", "a list of 1 bounds", "a bound is missing", "start: boolean is no time", "end: not an ISO 8601 time or a number: x", "number is no window", "no window", "start: boolean is no time"]
    assert all(g[:2] == (None, None) for g in got[3:])


def test_boxes(spark):
    values = ["[1, 2, 3, 4]", '{"lon_min": -1, "lat_min": "2.5", "lon_max": 3, "lat_max": 4, "more": []}', None, "[1, 2, 3]", '{"lon_min": 1}', '[1, 2, "x", 4]', "[1, 2, true, 4]", '"here"']
    got = [tuple(r) for r in variants(spark, values, times.box)]
    none = (None, None, None, None)
    assert got == [(1.0, 2.0, 3.0, 4.0, None), (-1.0, 2.5, 3.0, 4.0, None), (*none, None), (*none, "a list of 3 corners"), (*none, "a corner is missing or no number"), (*none, "a corner is missing or no number"), (*none, "a corner is missing or no number"), (*none, "string is no box")]
