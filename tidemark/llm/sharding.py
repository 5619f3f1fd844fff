"""Sharding by a permutation-filled lookup table.

Each shard has an order of preference over the slots of a table of prime size: it starts at its
offset and goes on by its step, both from its name. The shards take turns; each claims the first
slot in its order that is still free, until none is. The table depends on nothing but names and
size, so it is small and fixed; documents find their shard by the slot of their key's hash, a
broadcast join on one long. If shards come or go, few slots change hands.

Nulls and ties: a null key hashes as the empty string; rows with equal keys share a shard, unless
``salts`` spreads each key over that many slots by the row's text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import body, id_hash

SLOTS = 65_537
#: Most slots that a table may have: about 1 MB broadcast.
MOST_SLOTS = 131_101
SHARDS = tuple(f"shard-{k:04d}" for k in range(64))


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot."""
    if not shards or slots <= len(shards) or slots > MOST_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table needs a prime number of slots, more than there are shards and at most MOST_SLOTS")
    number = lambda what, name: int(hashlib.md5(f"{what}:{name}".encode()).hexdigest()[:15], 16)
    at = [number("offset", s) % slots for s in shards]
    step = [number("step", s) % (slots - 1) + 1 for s in shards]
    table, free, turn = [-1] * slots, slots, 0
    while free:
        while table[at[turn]] >= 0:
            at[turn] = (at[turn] + step[turn]) % slots
        table[at[turn]] = turn
        free, turn = free - 1, (turn + 1) % len(shards)
    return table


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard): a fixed number of rows."""
    codes = F.lit("".join(f"{s:04x}" for s in fill(shards, slots)))
    names = F.array(*map(F.lit, shards))
    packed = spark.range(1).select(F.posexplode(F.split(F.regexp_replace(codes, "(.{4})(?!$)", "$1,"), ",")).alias("slot", "code"))
    return packed.select(F.col("slot").cast("long"), F.element_at(names, F.conv("code", 16, 10).cast("int") + 1).alias("shard"))


def assign_shards(docs: DataFrame, *, shards: Sequence[str] = SHARDS, slots: int = SLOTS, key: str = "doc_id", salts: int = 1, text_col: str = "text") -> DataFrame:
    """docs with _tm_slot and _tm_shard."""
    hashed = id_hash(key)
    if salts > 1:
        hashed = hashed + F.pmod(F.xxhash64(body(text_col)), F.lit(salts))
    table = lookup_table(docs.sparkSession, shards, slots).select(F.col("slot").alias("_tm_slot"), F.col("shard").alias("_tm_shard"))
    return docs.withColumn("_tm_slot", hashed % slots).join(F.broadcast(table), "_tm_slot")  # at most MOST_SLOTS rows


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Writes docs as Parquet with a folder for each shard; rows are first brought together by shard, each shard over several tasks."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = assign_shards(docs, **how).withColumnRenamed("_tm_shard", "shard")
    placed.repartition(n, "shard", F.col("_tm_slot") % 16).drop("_tm_slot").write.partitionBy("shard").parquet(path)
