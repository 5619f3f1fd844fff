"""Beliefs, hypotheses, risk, response cost and lookups."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Response tiers as (tier, low, high) in USD for the first hour.
TIERS = (("review", 192, 589), ("boat", 4690, 27963), ("air", 19346, 90078))
#: Ranks of severities.
RANK = {"info": 0, "warning": 1, "critical": 2, "emergency": 3}


#: The demonstration graph of a spoofed identity: facts, and (id, conclusion, supports, refutes) of each justification.
FACTS = ("f_position_jump", "f_two_emitters", "f_registry_match")
SPOOFED = (
    ("j1", "c_spoofed", ("f_position_jump", "f_two_emitters"), ()), ("j2", "c_genuine", ("f_registry_match",), ("c_spoofed",)),
    ("j3", "c_alert", ("c_spoofed",), ()), ("j4", "c_alert", ("f_two_emitters",), ("f_registry_match",)),
)
#: Fixed value: after so many passes a graph that hasn't settled is an error.
MOST_PASSES = 64


def conclusions(facts: tuple[str, ...], justifications: tuple) -> list[str]:
    """The graph's conclusions in order; an error for repeated ids and for nodes that nothing defines."""
    names = list(dict.fromkeys(j[1] for j in justifications))
    ids = [j[0] for j in justifications]
    if len(set(facts)) < len(facts) or len(set(ids)) < len(ids) or set(facts) & set(names):
        raise ValueError("an id is in the graph twice")
    if unknown := {n for j in justifications for n in (*j[2], *j[3])} - {*facts, *names}:
        raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
    return names


def holds(justification: tuple, status: dict[str, Column]) -> Column:
    return reduce(and_, [*[status[n] for n in justification[2]], *[~status[n] for n in justification[3]]], F.lit(True))


def believed(rows: DataFrame, facts: tuple[str, ...] = FACTS, justifications: tuple = SPOOFED) -> DataFrame:
    """rows, one belief graph each with a boolean column for each fact, with a boolean column for each conclusion.

    A conclusion holds if any of its justifications has all supports and no refutation. Each pass works out all
    conclusions from those of the pass before; a graph that doesn't settle raises. Graphs are small and the same for
    all rows, so a row's passes are a fold over its few booleans.
    """
    names = conclusions(facts, justifications)
    start = F.struct(F.array(*[F.lit(False)] * len(names)).alias("now"), F.lit(False).alias("settled"))

    def one_pass(state: Column, _: Column) -> Column:
        status = {n: F.coalesce(F.col(n), F.lit(False)) for n in facts} | {n: F.get(state["now"], F.lit(k)) for k, n in enumerate(names)}
        new = F.array(*[reduce(or_, [holds(j, status) for j in justifications if j[1] == n]) for n in names])
        return F.when(state["settled"], state).otherwise(F.struct(new.alias("now"), (new == state["now"]).alias("settled")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_PASSES)), start, one_pass)
    d = rows.withColumn("_found", F.explode(F.array(found)))
    now = F.when(F.col("_found.settled"), F.col("_found.now")).otherwise(F.raise_error(F.lit("beliefs don't settle")).cast("array<boolean>"))
    return d.withColumn("_found", now).select(*rows.columns, *[F.get("_found", F.lit(k)).alias(n) for k, n in enumerate(names)])


def reason(name: str, justifications: tuple = SPOOFED) -> Column:
    """Why a conclusion holds (its first justification that does) or doesn't (what its first lacks), over columns of all nodes.

    The wording is fixed, as clients show it.
    """
    own = [j for j in justifications if j[1] == name]
    status = {n: F.coalesce(F.col(n), F.lit(False)) for j in justifications for n in (j[1], *j[2], *j[3])}
    both = lambda j, yes, no: [(n, yes, status[n]) for n in j[2]] + [(n, no, ~status[n]) for n in j[3]]
    whole = lambda j: " and ".join(f"{n} {text}" for n, text, _ in both(j, "is believed", "is not believed")) or "trivially (no antecedents or inhibitors)"
    lacks = F.concat_ws(" and ", *[F.when(~met, F.lit(f"{n} {text}")) for n, text, met in both(own[0], "is no longer believed", "is now believed")])
    more = f"; no alternate justification holds ({len(own) - 1} other(s) also unsatisfied)" if len(own) > 1 else ""
    out = F.concat(F.lit(f"justification {own[0][0]} not satisfied: "), lacks, F.lit(more))
    for j in own[::-1]:
        out = F.when(holds(j, status), F.lit(f"justification {j[0]} satisfied: {whole(j)}")).otherwise(out)
    return out


def stepped(leaves: DataFrame, ambiguous: Column, w1: float = 0.5, w2: float = 0.5, fork_all: bool = False) -> DataFrame:
    """The leaves (group, root, hyp_id, weight, depth) after a frame: where it is ambiguous the heaviest leaf (or all) gives way to two children, else all leaves are one deeper."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("group").orderBy(F.desc("weight"), "hyp_id"))
    d = leaves.withColumn("_fork", ambiguous & (F.lit(fork_all) | (rank == 1))).withColumn("_deeper", F.col("_fork") | ~ambiguous)
    child = lambda mark, w: F.struct(F.concat("hyp_id", F.lit(mark)).alias("hyp_id"), (F.col("weight") * w).alias("weight"))
    after = F.when(F.col("_fork"), F.array(child("a", w1), child("b", w2))).otherwise(F.array(child("", 1.0)))
    return d.select("group", "root", (F.col("depth") + F.col("_deeper").cast("int")).alias("depth"), F.inline(after))


def collapsed(leaves: DataFrame, depth: int = 3) -> DataFrame:
    """Of a root with two leaves or more, one of them depth deep or deeper, only the heaviest leaf."""
    from pyspark.sql import Window as W

    g = W.partitionBy("group", "root")
    d = leaves.withColumn("_many", (F.count(F.lit(1)).over(g) > 1) & (F.max("depth").over(g) >= depth)).withColumn("_rank", F.row_number().over(g.orderBy(F.desc("weight"), "hyp_id")))
    return d.where(~F.col("_many") | (F.col("_rank") == 1)).drop("_many", "_rank")


def in_shares(leaves: DataFrame) -> DataFrame:
    """leaves with _share, their part of their group's weight. Weights are added up heaviest first, so a task that is done again comes to the same sum; without any weight all shares are equal, and so are the weights."""
    from pyspark.sql import Window as W

    g = W.partitionBy("group").orderBy(F.desc("weight"), "hyp_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = leaves.withColumns({"_total": F.sum("weight").over(g), "_n": F.count(F.lit(1)).over(g)})
    some = F.col("_total") > 0
    share = F.when(some, F.col("weight") / F.col("_total")).otherwise(1 / F.col("_n"))
    return d.withColumn("_share", share).withColumn("weight", F.when(some, F.col("weight")).otherwise(0.0)).drop("_total", "_n")


def maintained(leaves: DataFrame) -> DataFrame:
    """Weights are normalised before roots are collapsed; light leaves are those below the floor of these weights."""
    return kept(collapsed(in_shares(leaves)))


def pruned(leaves: DataFrame, floor: float = 0.01, cap: int = 8, normalise: bool = True) -> DataFrame:
    """group, hyp_id, weight of the hypotheses that stay: weights are normalised, light ones and those beyond the cap go (never the heaviest), the rest is normalised again."""
    return kept(in_shares(leaves) if normalise else leaves.withColumn("_share", F.col("weight")), floor, cap)


def kept(leaves: DataFrame, floor: float = 0.01, cap: int = 8) -> DataFrame:
    """leaves (with _share) whose share reaches the floor, at most cap of a group, and the heaviest in any case; weight becomes their part of what stays.

    The order is that of the weights, as given: shares of different weights may be equal, according to the sum's last bits.
    """
    from pyspark.sql import Window as W

    g = W.partitionBy("group").orderBy(F.desc("weight"), "hyp_id")
    d = leaves.withColumn("rank", F.row_number().over(g)).where(((F.col("_share") >= floor) | (F.col("rank") == 1)) & (F.col("rank") <= cap))
    total = F.sum("_share").over(g.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return d.withColumn("weight", F.col("_share") / total).drop("rank", "_share")


def risk(dark: Column, zone_kinds: Column, sanctioned: Column) -> tuple[Column, Column]:
    """signals (array) and severity of a contact."""
    protected = F.array_contains(zone_kinds, "mpa")
    signals = F.array_compact(F.array(F.when(sanctioned, "sanctions_match"), F.when(dark, "ais_silent"), F.when(protected, "protected_area"), F.when(F.array_contains(zone_kinds, "danger"), "danger_area")))
    severity = F.when(sanctioned | dark & protected, "critical").otherwise("warning")
    return signals, severity


def response(signals: Column, on_water: Column, air: Column) -> tuple[Column, Column]:
    """Lowest and highest cost over the options that apply: a range of alternatives, not a sum."""
    some = F.size(signals) > 0
    applies = (some, some & on_water, some & air)
    low = F.coalesce(F.least(*[F.when(a, t[1]) for a, t in zip(applies, TIERS, strict=True)]), F.lit(0))
    high = F.coalesce(F.greatest(*[F.when(a, t[2]) for a, t in zip(applies, TIERS, strict=True)]), F.lit(0))
    return low.cast("long"), high.cast("long")


def first_match(rows: DataFrame, registry: DataFrame, keys: tuple[tuple[str, Column], ...]) -> DataFrame:
    """rows with match_id and basis: the first of several keys that the registry knows wins. registry: basis, key, match_id.

    One join over the rows' keys in order of preference, then the best for each row (column row_id).
    """
    named = F.array(*[F.struct(F.lit(n).alias("rank"), F.lit(basis).alias("basis"), value.alias("key")) for n, (basis, value) in enumerate(keys)])
    hits = rows.select("row_id", F.explode(named).alias("k")).select("row_id", "k.*").join(registry, ["basis", "key"])
    best = hits.groupBy("row_id").agg(F.min(F.struct("rank", "match_id", "basis")).alias("m"))
    return rows.join(best, "row_id", "left").select(*rows.columns, F.col("m.match_id").alias("match_id"), F.col("m.basis").alias("basis"))


def priced(options: DataFrame, rates: DataFrame, key: str) -> DataFrame:
    """key, low_usd, high_usd, n_inputs, missing of options (key, resource, low_hours, high_hours) by the rates (resource, usd) an hour; resources without a rate are named, not priced."""
    d = options.join(rates.select("resource", "usd"), "resource", "left")
    cost = lambda hours: F.coalesce(F.sum(F.col(hours) * F.col("usd")), F.lit(0.0))
    missing = F.sort_array(F.collect_set(F.when(F.col("usd").isNull(), F.col("resource"))))
    return d.groupBy(key).agg(cost("low_hours").alias("low_usd"), cost("high_hours").alias("high_usd"), F.count(F.lit(1)).alias("n_inputs"), missing.alias("missing"))
