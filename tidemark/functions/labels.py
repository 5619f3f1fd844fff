"""Texts that clients show, as Column expressions. Wording is fixed, as clients compare it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What types of ships mean, singly and by tens.
SHIP_TYPES = {
    30: "Fishing", 31: "Towing", 32: "Towing", 33: "Dredging", 34: "Diving operations", 35: "Military operations", 36: "Sailing", 37: "Pleasure craft",
    50: "Pilot vessel", 51: "Search and rescue", 52: "Tug", 53: "Port tender", 55: "Law enforcement", 58: "Medical transport",
}
SHIP_TENS = {4: "High-speed craft", 6: "Passenger", 7: "Cargo", 8: "Tanker", 9: "Other"}


def ship_type(code: Column) -> Column:
    """The type's label; null without a positive code, ``AIS type n`` if the code means nothing."""
    table = lambda t: F.create_map(*[F.lit(x) for p in t.items() for x in p])
    known = F.coalesce(F.try_element_at(table(SHIP_TYPES), code.cast("int")), F.try_element_at(table(SHIP_TENS), F.floor(code / 10).cast("int")))
    return F.when(code > 0, F.coalesce(known, F.concat(F.lit("AIS type "), code.cast("string"))))


def silence(seconds: Column) -> Column:
    """``n seconds`` below two minutes, ``n minutes`` below an hour, then ``nh`` or ``nh nm``."""
    s = F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0))
    minutes = F.floor(s / 60)
    hours = F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), F.when(minutes % 60 > 0, F.concat(F.lit(" "), (minutes % 60).cast("string"), F.lit("m"))).otherwise(""))
    return F.when(s < 120, F.concat(F.floor(s + 0.5).cast("string"), F.lit(" seconds"))).when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" minutes"))).otherwise(hours)


def fixed(value: Column, digits: int) -> Column:
    """The text of a number that isn't negative with that many decimals, as C and Python write it: by the double's exact value, halves to the even digit.

    format_string rounds a double's shortest decimal text, halves up. Here the double is split in two parts whose products
    with the scale are exact, so it is known on which side of a half it lies. From 2^53 on, scaled, the text is format_string's.
    """
    scale = float(10**digits)
    spread = value * 134217729.0  # 2^27 + 1
    high = spread - (spread - value)
    a, b = high * scale, (value - high) * scale
    n = F.floor(value * scale)
    over = ((a - n.cast("double")) - 0.5) + b
    whole = n + F.when((over > 0) | ((over == 0) & (n % 2 == 1)), 1).otherwise(0)
    return F.format_string(f"%.{digits}f", F.when(value * scale < 2.0**53, whole / scale).otherwise(value))


def degrees(value: Column, positive: str, negative: str) -> Column:
    return F.concat(fixed(F.abs(value), 4), F.lit("° "), F.when(value >= 0, positive).otherwise(negative))


def distance(metres: Column) -> Column:
    """Whole metres below a nautical mile, else nautical miles with one decimal, from 100 on with none."""
    m = F.greatest(F.coalesce(metres, F.lit(0.0)), F.lit(0.0))
    miles = m / 1852
    return F.when(miles < 1, F.concat(F.format_number(F.floor(m + 0.5), 0), F.lit(" m"))).otherwise(F.concat(F.when(miles >= 100, fixed(miles, 0)).otherwise(fixed(miles, 1)), F.lit(" NM")))


def region(protected: Column, no_take: Column, mpa: Column, eez: Column, rfmo: Column) -> Column:
    """What an event's regions (arrays of names) are called: the first protected area by name, else the kind of reserve, then zone and fishery bodies."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    area = F.coalesce(F.get(F.filter(protected, lambda x: x != ""), F.lit(0)), F.when(some(no_take), "no-take MPA reference").when(some(mpa), "marine protected area"))
    return F.concat_ws(" · ", area, F.when(some(eez), "EEZ"), F.when(some(rfmo), F.concat(F.lit("RFMO "), F.array_join(F.slice(rfmo, 1, 2), ", "))))


def elided(text: Column, limit: int = 132) -> Column:
    """White space as one space each, and at most limit characters, the last three of which are dots if something is cut."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def chosen(weights: dict[str, Column], draw: Column) -> Column:
    """The name in whose share of the summed weights, in the given order, the draw (0 to 1) falls."""
    sums, total = {}, F.lit(0.0)
    for name, w in weights.items():
        sums[name] = total = total + w
    names = list(weights)
    pick = lambda later, name: F.when(draw * total <= sums[name], F.lit(name)).otherwise(later)
    return reduce(pick, reversed(names[:-1]), F.lit(names[-1]))
