"""Graphs of beliefs as tables, any number of different graphs at once.

facts: graph, node, believed. justifications: graph, justification, conclusion. antecedents: graph, justification, node,
refutes. A conclusion holds if any of its justifications has all its supports believed and none of its refutations; one
without antecedents always holds. Each pass works out all conclusions from the pass before, with two joins and two
aggregations over all graphs; graphs that a pass didn't change are settled and leave the next one.

A state is a row for each node: graph, node, fact, before, believed. Retracting or reinstating facts is a table of
changes; ``before`` then tells what was believed until then, so flips are rows where they differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.decisions import MOST_PASSES
from tidemark.operators.staging import staged


def problems(facts: DataFrame, justifications: DataFrame, antecedents: DataFrame) -> DataFrame:
    """graph, id, problem of ids that a graph has twice, antecedents that nothing defines and those of unknown justifications."""
    concluded = justifications.select("graph", F.col("conclusion").alias("node")).distinct()
    nodes = facts.select("graph", "node").unionByName(concluded)
    twice = nodes.groupBy("graph", F.col("node").alias("id")).count().unionByName(justifications.groupBy("graph", F.col("justification").alias("id")).count())
    lost = antecedents.select("graph", "node").join(nodes, ["graph", "node"], "left_anti").select("graph", F.col("node").alias("id"), F.lit("unknown node").alias("problem"))
    loose = antecedents.select("graph", "justification").join(justifications, ["graph", "justification"], "left_anti").select("graph", F.col("justification").alias("id"), F.lit("unknown justification").alias("problem"))
    return twice.where("count > 1").select("graph", "id", F.lit("defined twice").alias("problem")).unionByName(lost).unionByName(loose).distinct()


def settled(state: DataFrame, justifications: DataFrame, antecedents: DataFrame) -> DataFrame:
    """The state when no pass changes it any more; an error if a graph goes on changing."""
    live, done = staged(state), []
    for _ in range(MOST_PASSES):
        met = antecedents.join(live.select("graph", "node", "believed"), ["graph", "node"]).groupBy("graph", "justification").agg(F.bool_and(F.col("believed") != F.col("refutes")).alias("met"))
        open_ = justifications.join(live.select("graph").distinct(), "graph", "left_semi")
        held = open_.join(met, ["graph", "justification"], "left").groupBy("graph", F.col("conclusion").alias("node")).agg(F.bool_or(F.coalesce("met", F.lit(True))).alias("now"))
        now = staged(live.join(held, ["graph", "node"], "left").withColumn("now", F.when(F.col("fact"), F.col("believed")).otherwise(F.coalesce("now", F.lit(False)))))
        moving = staged(now.where("now <> believed").select("graph").distinct())
        now = now.withColumn("believed", F.col("now")).drop("now")
        done.append(now.join(moving, "graph", "left_anti"))
        if moving.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out
        live = now.join(moving, "graph", "left_semi")
    raise RuntimeError(f"beliefs don't settle in {MOST_PASSES} passes")


def solved(facts: DataFrame, justifications: DataFrame, antecedents: DataFrame) -> DataFrame:
    """The settled state, from no conclusion believed; a null fact isn't believed. Graphs with problems are an error."""
    wrong = problems(facts, justifications, antecedents).orderBy("graph", "id").limit(3).collect()
    if wrong:
        raise ValueError("; ".join(f"graph {w['graph']}: {w['id']}: {w['problem']}" for w in wrong))
    f = facts.select("graph", "node", F.lit(True).alias("fact"), F.lit(False).alias("before"), F.coalesce("believed", F.lit(False)).alias("believed"))
    c = justifications.select("graph", F.col("conclusion").alias("node"), F.lit(False).alias("fact"), F.lit(False).alias("before"), F.lit(False).alias("believed")).distinct()
    return settled(f.unionByName(c), justifications, antecedents)


def changed(state: DataFrame, changes: DataFrame, justifications: DataFrame, antecedents: DataFrame) -> DataFrame:
    """The state after facts (graph, node, believed) were retracted or reinstated, with ``before`` as it was. Only graphs with changes are worked out again; an unknown fact is an error."""
    state = staged(state)
    changes = changes.select("graph", "node", F.col("believed").alias("_to"))
    unknown = changes.join(state.where("fact"), ["graph", "node"], "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"graph {unknown[0]['graph']}: no fact {unknown[0]['node']}")
    touched = changes.select("graph").distinct()
    same = state.join(touched, "graph", "left_anti").withColumn("before", F.col("believed"))
    moved = state.join(touched, "graph", "left_semi").join(changes, ["graph", "node"], "left")
    moved = moved.withColumns({"before": F.col("believed"), "believed": F.coalesce("_to", "believed")}).drop("_to")
    return same.unionByName(settled(moved, justifications, antecedents))


def flips(state: DataFrame) -> DataFrame:
    """graph, node, believed of the conclusions that changed."""
    return state.where("NOT fact AND before <> believed").select("graph", "node", "believed")


def explained(state: DataFrame, justifications: DataFrame, antecedents: DataFrame, *, among: str = "node") -> DataFrame:
    """graph, justification, conclusion, satisfied, whole, lacks, sources of each justification in a state.

    whole says what it stands on, lacks what of that isn't so, both in the fixed wording that clients show: supports first, then refutations,
    each in the order of the column among. sources are the nodes in that order. One without antecedents stands on nothing.
    """
    d = antecedents.join(state.select("graph", "node", "believed"), ["graph", "node"])
    met = F.col("believed") != F.col("refutes")
    says = lambda yes, no: F.concat(F.col("node"), F.when(F.col("refutes"), no).otherwise(yes))
    item = F.struct("refutes", F.col(among).alias("ord"), "node", says(" is believed", " is not believed").alias("is"), F.when(~met, says(" is no longer believed", " is now believed")).alias("isnt"))
    per = d.groupBy("graph", "justification").agg(F.bool_and(met).alias("_met"), F.sort_array(F.collect_list(item)).alias("_items"))
    of = lambda name: F.transform("_items", lambda i: i[name])
    j = justifications.join(per, ["graph", "justification"], "left")
    some = F.coalesce(F.size("_items"), F.lit(0)) > 0
    whole = F.when(some, F.array_join(of("is"), " and ")).otherwise("trivially (no antecedents or inhibitors)")
    return j.select(*justifications.columns, F.coalesce("_met", F.lit(True)).alias("satisfied"), whole.alias("whole"), F.array_join(F.array_compact(of("isnt")), " and ").alias("lacks"), F.coalesce(of("node"), F.array().cast("array<string>")).alias("sources"))


def briefs(state: DataFrame, justifications: DataFrame, antecedents: DataFrame, *, by: str = "justification", among: str = "node") -> DataFrame:
    """graph, node, status (IN or OUT), text, source_ids, model_used, cost_usd of each conclusion of a state.

    The text tells the status, and the one before if it was another, and why: the first justification by ``by`` that is
    satisfied, or what the first one lacks. source_ids are the nodes of all its justifications, each once, in order. It
    comes from a template, so it costs nothing; wording is fixed, as clients show it.
    """
    e = explained(state, justifications, antecedents, among=among)
    first = F.struct(F.col(by).alias("_by"), "justification", "whole", "lacks")
    per = e.groupBy("graph", F.col("conclusion").alias("node")).agg(
        F.min(F.when(F.col("satisfied"), first)).alias("_holds"), F.min(first).alias("_first"), F.count(F.lit(1)).alias("_n"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(by).alias("_by"), "justification", "sources"))), lambda s: s["sources"])).alias("_sources"),
    )
    d = state.where("NOT fact").join(per, ["graph", "node"])
    word = lambda c: F.when(F.col(c), "IN").otherwise("OUT")
    change = F.when(F.col("before") != F.col("believed"), F.concat(word("before"), F.lit(" -> "), word("believed"))).otherwise(word("believed"))
    others = F.when(F.col("_n") > 1, F.concat(F.lit("; no alternate justification holds ("), (F.col("_n") - 1).cast("string"), F.lit(" other(s) also unsatisfied)"))).otherwise("")
    why = F.when(F.col("believed"), F.concat(F.lit("justification "), F.col("_holds.justification"), F.lit(" satisfied: "), F.col("_holds.whole"))).otherwise(
        F.concat(F.lit("justification "), F.col("_first.justification"), F.lit(" not satisfied: "), F.col("_first.lacks"), others)
    )
    text = F.concat(F.col("node"), F.lit(": "), change, F.lit(" ("), why, F.lit(")"))
    return d.select("graph", "node", word("believed").alias("status"), text.alias("text"), F.array_distinct("_sources").alias("source_ids"), F.lit("template").alias("model_used"), F.lit(0.0).alias("cost_usd"))
