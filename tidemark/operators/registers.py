"""Lookups in a list of listed vessels by several keys, of which the first that the list knows decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.decisions import first_match

#: How remarks give numbers, and a call sign that says nothing.
NUMBERS = {"mmsi": r"(?i)\bMMSI\s+(\d{9})\b", "imo": r"(?i)\bIMO\s+(\d{7})\b"}
NO_CALL_SIGN = "0"


def normal_key(value: Column) -> Column:
    """Letters and digits in upper case; null if there is none."""
    return F.nullif(F.regexp_replace(F.upper(value.cast("string")), r"[^\p{L}\p{N}]", ""), F.lit(""))


def listed_keys(entries: DataFrame) -> DataFrame:
    """(basis, key, match_id) of a list (match_id, ord, name, call_sign, remarks): numbers stand in remarks, any number of them.

    Of entries with one id the first by ord counts, the others are repeats; of entries with one key the last.
    """
    e = entries.where(F.col("match_id").isNotNull()).groupBy("match_id").agg(F.min_by(F.struct("name", "call_sign", "remarks"), "ord").alias("e"), F.min("ord").alias("ord")).select("match_id", "ord", "e.*")
    none = F.array().cast("array<string>")
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(none)
    sign = normal_key(F.col("call_sign"))
    keys = {b: F.coalesce(F.regexp_extract_all("remarks", F.lit(p), 1), none) for b, p in NUMBERS.items()}
    keys |= {"call_sign": one(F.when(sign != NO_CALL_SIGN, sign)), "name": one(normal_key(F.col("name")))}
    of = lambda basis: lambda x: F.struct(F.lit(basis).alias("basis"), x.alias("key"))
    named = F.flatten(F.array(*[F.transform(k, of(basis)) for basis, k in keys.items()]))
    return e.select("match_id", "ord", F.inline(named)).groupBy("basis", "key").agg(F.max_by("match_id", "ord").alias("match_id"))


def listed(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows (row_id, mmsi, imo, call_sign, name and others) with match_id and basis: by MMSI, then IMO, call sign and name; null if the list knows none."""
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    keys = (("mmsi", text("mmsi")), ("imo", text("imo")), ("call_sign", normal_key(F.col("call_sign"))), ("name", normal_key(F.col("name"))))
    return first_match(rows, listed_keys(entries), keys)
