"""Moments and windows of time from values of any kind, by arithmetic alone: no session zone has a say.

Values are VARIANT columns (``F.try_parse_json``), as a number, a text and a truth value say different things. What says
no time gives null seconds and a problem in words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names under which the two bounds of a window are looked for, in this order.
STARTS, ENDS = ("start", "start_t", "t0", "begin"), ("end", "end_t", "t1", "finish")
#: Dates with or without dashes, then any one character, then a time with or without colons, a part of a second and a zone.
ISO = r"^(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2}))(?:.(\d{2})(?:(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)|(?:(\d{2})(?:(\d{2})(?:[.,](\d+))?)?))?(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?)?$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def bound(value: Column, body) -> Column:
    """body of the value, which is worked out once: expressions would otherwise grow with every use of it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def seconds(text: Column) -> Column:
    """UTC seconds of an ISO 8601 text: a date, or a date and time with or without a zone, which is UTC if none is given; null for anything else, week dates too.

    Parts of a second count to the microsecond; hours end at 23, seconds at 59.
    """
    groups = F.split(F.regexp_replace(text, ISO, "|".join(f"${g}" for g in range(1, 14))), r"\|")

    def found(g: Column) -> Column:
        part = lambda k, *more: F.concat(*[g[n - 1] for n in (k, *more)])
        whole = lambda c: F.coalesce(F.nullif(c, F.lit("")).try_cast("long"), F.lit(0).cast("long"))
        day = F.unix_date(F.concat_ws("-", part(1), part(2, 4), part(3, 5)).try_cast("date"))
        zone = F.regexp_replace(part(13), "[Z:]", "")
        numbers = {"hour": whole(part(6)), "minute": whole(part(7, 10)), "second": whole(part(8, 11)), "micros": whole(F.rpad(F.substring(part(9, 12), 1, 6), 6, "0"))}
        numbers |= {name: whole(F.substring(zone, at, 2)) for name, at in (("zh", 2), ("zm", 4), ("zs", 6))}
        n = F.struct(day.alias("day"), F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1).alias("sign"), *[c.alias(name) for name, c in numbers.items()])
        return F.when((F.size(g) == 13) & (g[0] >= "0001"), bound(n, total))

    def total(n: Column) -> Column:
        good = n["day"].isNotNull() & (n["hour"] < 24) & (n["zh"] < 24)
        for name in ("minute", "second", "zm", "zs"):
            good = good & (n[name] < 60)
        ahead = n["sign"] * (n["zh"] * 3600 + n["zm"] * 60 + n["zs"])
        at = (n["day"] * F.lit(86400).cast("long") + n["hour"] * 3600 + n["minute"] * 60 + n["second"] - ahead) * 1000000 + n["micros"]
        return F.when(good, at / 1e6)

    return F.when(F.rlike(text, F.lit(ISO)), bound(groups, found))


def finite(number: Column) -> Column:
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def kind_of(value: Column) -> Column:
    """number, string, boolean, object, array or void of a VARIANT; null is void."""
    kind = F.regexp_extract(F.coalesce(F.schema_of_variant(value), F.lit("VOID")), r"^\w+", 0)
    return bound(kind, lambda k: F.when(k.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "number").otherwise(F.lower(k)))


def epoch(value: Column, numeric_text: bool = True) -> Column:
    """(seconds, problem) of a VARIANT: a finite number of seconds, an ISO 8601 text, or, with numeric_text, a number as text.

    A text of eight digits is a date. Truth values, lists and objects are no times, nor are null and an empty text.
    """

    def read(v: Column) -> Column:
        kind, text = v["kind"], v["text"]
        written = F.when(F.rlike(text, F.lit(NUMBER)), finite(text.try_cast("double"))) if numeric_text else F.lit(None).cast("double")
        found = F.when(kind == "number", finite(v["number"])).when(kind == "string", F.coalesce(seconds(text), written))
        return bound(found, lambda f: F.struct(f.alias("seconds"), problem(f, kind, text).alias("problem")))

    def problem(found: Column, kind: Column, text: Column) -> Column:
        said = F.when(text == "", "an empty text").otherwise(F.concat(F.lit("not an ISO 8601 time" + (" or a number: " if numeric_text else ": ")), text))
        return F.when(found.isNotNull(), None).when(kind == "void", "no time").when(kind == "number", "not a finite time").when(kind == "string", said).otherwise(F.concat(kind, F.lit(" is no time")))

    return bound(F.struct(kind_of(value).alias("kind"), stripped(F.try_variant_get(value, "$", "string")).alias("text"), F.try_variant_get(value, "$", "double").alias("number")), read)


def member(value: Column, names: tuple[str, ...]) -> Column:
    """The first of the members that is there and isn't null."""
    got = [F.try_variant_get(value, f"$.{n}", "variant") for n in names]
    return F.coalesce(*[F.when(kind_of(g) != "void", g) for g in got])


def window(value: Column, numeric_text: bool = True) -> Column:
    """(t0, t1, problem) of a VARIANT: an object with both bounds by any of their names, each in any form of a time, or a list of two.

    The start must be before the end. With a problem both bounds are null.
    """

    def read(v: Column) -> Column:
        kind, items, start, end = v["kind"], v["items"], v["start"], v["end"]
        problem = (
            F.when(~kind.isin("object", "array"), F.when(kind == "void", "no window").otherwise(F.concat(kind, F.lit(" is no window"))))
            .when((kind == "array") & (items != 2), F.concat(F.lit("a list of "), items.cast("string"), F.lit(" bounds"))).when((kind == "object") & v["lacking"], "a bound is missing")
            .when(start["problem"].isNotNull(), F.concat(F.lit("start: "), start["problem"])).when(end["problem"].isNotNull(), F.concat(F.lit("end: "), end["problem"]))
            .when(start["seconds"] >= end["seconds"], "the start isn't before the end")
        )
        return bound(problem, lambda p: F.struct(F.when(p.isNull(), start["seconds"]).alias("t0"), F.when(p.isNull(), end["seconds"]).alias("t1"), p.alias("problem")))

    kind, items = kind_of(value), F.try_variant_get(value, "$", "array<variant>")
    one = lambda names, k: F.when(kind == "object", member(value, names)).when(kind == "array", F.get(items, F.lit(k)))
    bounds = F.struct(kind.alias("kind"), F.size(items).alias("items"), one(STARTS, 0).alias("a"), one(ENDS, 1).alias("b"))
    times = lambda v: F.struct(v["kind"].alias("kind"), v["items"].alias("items"), (v["a"].isNull() | v["b"].isNull()).alias("lacking"), epoch(v["a"], numeric_text).alias("start"), epoch(v["b"], numeric_text).alias("end"))
    return bound(bounds, lambda v: bound(times(v), read))


def box(value: Column) -> Column:
    """(west, south, east, north, problem) of a VARIANT: a list of the four in this order or an object with lon_min, lat_min, lon_max and lat_max; null without any box or problem if there is none.

    Numbers as text count, as do corners the wrong way round; truth values, which aren't places, don't.
    """
    kind = kind_of(value)
    items = F.try_variant_get(value, "$", "array<variant>")
    number = lambda v: F.when(kind_of(v).isin("number", "string"), finite(F.try_variant_get(v, "$", "string").try_cast("double")))
    names = ("lon_min", "lat_min", "lon_max", "lat_max")
    corners = [F.when(kind == "object", number(F.try_variant_get(value, f"$.{n}", "variant"))).when(kind == "array", number(F.get(items, F.lit(k)))) for k, n in enumerate(names)]
    lacking = reduce(lambda a, b: a | b, [c.isNull() for c in corners])
    problem = (
        F.when(kind == "void", None).when(~kind.isin("object", "array"), F.concat(kind, F.lit(" is no box")))
        .when((kind == "array") & (F.size(items) != 4), F.concat(F.lit("a list of "), F.size(items).cast("string"), F.lit(" corners"))).when(lacking, "a corner is missing or no number")
    )
    return bound(problem, lambda p: F.struct(*[F.when(p.isNull(), c).alias(n) for n, c in zip(("west", "south", "east", "north"), corners, strict=True)], p.alias("problem")))
