"""Queries over moments, windows and boxes as people write them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.plans.registry import query
from tidemark.sources.tables import table


@query("""SELECT event_id, CASE WHEN event_id % 10 < 7 THEN round(epoch_us(CASE WHEN event_id % 10 IN (2, 4) THEN date_trunc('second', ts) ELSE ts END) / 1e6, 6) END AS seconds, CASE event_id % 10 WHEN 7 THEN 'boolean is no time' WHEN 8 THEN 'not an ISO 8601 time or a number: ' || event_type WHEN 9 THEN 'no time' END AS problem FROM events""")
def written_times(spark, sf_dir):
    """Every event's time written in ten ways, three of which are none."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    micros, k = F.unix_micros("ts"), F.col("event_id") % 10
    # Written by arithmetic, so that the session's zone has no say.
    day, rest = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / 86400000000).cast("int")).cast("string"), F.pmod(micros, F.lit(86400000000))
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    h, m, s, us = two(F.floor(rest / 3600000000)), two(F.floor(rest / 60000000) % 60), two(F.floor(rest / 1000000) % 60), F.lpad((rest % 1000000).cast("string"), 6, "0")
    quoted = lambda *parts: F.concat(F.lit('"'), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit('"'))
    text = (
        F.when(k == 0, quoted(day, "T", h, ":", m, ":", s, ".", us, "Z")).when(k == 1, quoted(day, " ", h, ":", m, ":", s, ".", us)).when(k == 2, quoted(F.regexp_replace(day, "-", ""), "T", h, m, s, "+0000"))
        .when(k == 3, quoted(day, "T", h, ":", m, ":", s, ",", us, "999+00:00")).when(k == 4, F.floor(micros / 1000000).cast("string")).when(k == 5, quoted((micros / 1e6).cast("decimal(20,6)").cast("string"))).when(k == 6, (micros / 1e6).cast("decimal(20,6)").cast("string"))
        .when(k == 7, "true").when(k == 8, quoted(F.col("event_type"))).otherwise("null")
    )
    d = e.select("event_id", times.epoch(F.try_parse_json(text)).alias("t"))
    return d.select("event_id", F.round("t.seconds", 6).alias("seconds"), "t.problem")


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, epoch(l_shipdate)::DOUBLE AS a, epoch(l_shipdate)::DOUBLE + 86400 * (l_quantity::BIGINT % 13 - 3) AS b, (l_orderkey + l_linenumber) % 5 AS k FROM lineitem),
p AS (SELECT *, CASE WHEN k = 4 THEN 'a bound is missing' WHEN k = 3 THEN 'a list of 3 bounds' WHEN a >= b THEN 'the start isn''t before the end' END AS problem FROM k) SELECT l_orderkey, l_linenumber, CASE WHEN problem IS NULL THEN a END AS t0, CASE WHEN problem IS NULL THEN b END AS t1, problem FROM p""")
def written_windows(spark, sf_dir):
    """From shipping to a day that hangs on the quantity as a window, written in five ways."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").cast("string").alias("a"), F.date_add(F.col("l_shipdate").cast("date"), (F.col("l_quantity").cast("int") % 13 - 3)).cast("string").alias("b"))
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    fill = lambda pattern, *c: F.format_string(pattern, *c)
    text = (
        F.when(k == 0, fill('{"start": "%sT00:00:00Z", "end": "%s"}', "a", "b")).when(k == 1, fill('["%s", "%s 00:00+00:00"]', "a", "b")).when(k == 2, fill('{"end": null, "t0": "%s", "finish": "%s"}', "a", "b"))
        .when(k == 3, fill('["%s", "%s", 1]', "a", "b")).otherwise(fill('{"start": "%s", "until": "%s"}', "a", "b"))
    )
    return li.select("l_orderkey", "l_linenumber", times.window(F.try_parse_json(text)).alias("w")).select("l_orderkey", "l_linenumber", "w.*")
