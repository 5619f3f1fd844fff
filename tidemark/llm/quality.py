"""Quality rules: a learned decision list over text statistics.

Sequential covering learns an ordered list of rules that reject a document. A rule is a
conjunction of thresholds; it grows by the threshold that gains most on the labelled documents
not yet covered, is pruned on held-out ones to the prefix that is purest there, and ends the list
if even that isn't pure enough. Labelled rows are binned once at quantiles and added up by cell;
each step is one histogram of the cells by feature and bin, of at most features x bins rows, from
which the driver picks a threshold. The list becomes one Spark CASE expression.

All documents are scored over their whole text; only the labelled rows that the list is learned
from are a bounded sample, the ``max_labelled`` of smallest id hash.

Nulls and ties: a null text is empty; a document without a label isn't learned from, nor one with
contradicting labels; without labelled rows the list is empty and only the base rule rejects.
Of equal gains the first feature, direction and smallest threshold wins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, body, id_hash, staged, word_array

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("bangs", "upper", "lines")
#: Ratios that rules may test.
FEATURES = ("words", "symbols", "repeats", "dup_lines", "word_length", "bangs", "upper")
MAX_LABELLED, BINS, MAX_RULES, MAX_TESTS, PURITY = 20_000, 16, 8, 3, 0.9


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns of STATS and EXTRA, each with _tm_ before its name.

    Repeated 3-word windows are found by sorting, per text, the window hashes packed with their
    position into one long; windows whose packed part has a twin are then compared by the whole hash.
    """
    text = body(text_col)
    count = lambda c, chars: (F.length(c) - F.length(F.regexp_replace(c, chars, ""))).cast("long")
    d = docs.withColumn("_tm_w", word_array(text)).withColumn("_tm_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}")))
    grams = F.transform(
        F.sequence(F.lit(1), F.size("_tm_w") - 2), lambda i: F.xxhash64(F.element_at("_tm_w", i), F.element_at("_tm_w", i + 1), F.element_at("_tm_w", i + 2))
    )
    none = F.array().cast("array<bigint>")
    d = d.withColumn("_tm_g", F.when(F.size("_tm_w") >= 4, grams).otherwise(none))
    d = d.withColumn("_tm_p", F.sort_array(F.transform("_tm_g", lambda x, i: F.shiftleft(x, 31).bitwiseOR(i.cast("long")))))

    def twins(column: str, same) -> Column:
        """Elements of a sorted array that are the same as a neighbour."""
        at = lambda i: F.get(F.col(column), i)
        return F.filter(column, lambda x, i: F.coalesce(same(x, at(i - 1)), F.lit(False)) | F.coalesce(same(x, at(i + 1)), F.lit(False)))

    d = d.withColumn("_tm_p", twins("_tm_p", lambda x, y: F.shiftrightunsigned(x, 31) == F.shiftrightunsigned(y, 31)))
    at = lambda p: p.bitwiseAND(F.lit(2**31 - 1)).cast("int")
    d = d.withColumn("_tm_p", F.sort_array(F.transform("_tm_p", lambda p: F.struct(F.get("_tm_g", at(p)).alias("g"), at(p).alias("i")))))
    d = d.withColumn("_tm_p", twins("_tm_p", lambda x, y: x["g"] == y["g"]))
    d = d.withColumn("_tm_p", F.sort_array(F.transform("_tm_p", lambda x: x["i"])))
    covered = F.aggregate(
        "_tm_p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"]
    )
    joined = F.array_join("_tm_w", "")
    values = (
        F.size("_tm_w"), F.length(joined), count(text, r"[#*$%&|<>]"), F.size("_tm_l") - F.size(F.array_distinct("_tm_l")), covered,
        count(text, "!"), count(text, r"\p{Lu}"), F.size("_tm_l"),
    )
    # A generator of one row: filters on the statistics stay above it, and don't repeat what makes them.
    row = F.struct(*[v.cast("long").alias(n) for n, v in zip(STATS + EXTRA, values, strict=True)])
    return d.select(*docs.columns, F.inline(F.array(row)).alias(*[f"_tm_{n}" for n in STATS + EXTRA]))


def features() -> list[Column]:
    """The values of FEATURES from the columns of STATS and EXTRA."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(f"_tm_{a}").cast("double"), F.col(f"_tm_{b}")), F.lit(0.0))
    return [
        F.col("_tm_n_words").cast("double"), per("n_symbols", "word_chars"), per("n_repeat_words", "n_words"), per("n_dup_lines", "lines"),
        per("word_chars", "n_words"), per("bangs", "n_words"), per("upper", "word_chars"),
    ]


def base_failed() -> Column:
    return (F.col("_tm_n_words") < 50) | (100 * F.col("_tm_n_repeat_words") > 50 * F.col("_tm_n_words"))


@dataclass(frozen=True)
class Test:
    """A threshold: the feature's value is above it, or not."""

    feature: int
    above: bool
    cut: int
    threshold: float

    def on_bins(self) -> Column:
        b = F.col(f"b{self.feature}")
        return b > self.cut if self.above else b <= self.cut

    def on_values(self, values: list[Column]) -> Column:
        v = values[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold:.6g}"


def every(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def grow(cells: DataFrame, open_: Column, cuts: list[list[float]]) -> list[Test]:
    """Adds thresholds while they gain, up to MAX_TESTS."""
    rule: list[Test] = []
    while len(rule) < MAX_TESTS:
        here = cells.where(open_ & every([t.on_bins() for t in rule]) & ~F.col("held_out"))
        by = here.select("bad", "n", F.posexplode(F.array(*[F.col(f"b{k}") for k in range(len(cuts))])).alias("f", "bin"))
        counts = by.groupBy("f", "bin").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("q")).collect()
        total_p, total_q = (sum(r[k] for r in counts if r["f"] == 0) for k in ("p", "q"))
        if not total_p or not total_q and rule:
            break
        before, best = math.log2(total_p / (total_p + total_q)), (1e-9, None)
        for f, of in enumerate(cuts):
            for cut, threshold in enumerate(of):
                low = [sum(r[k] for r in counts if r["f"] == f and r["bin"] <= cut) for k in ("p", "q")]
                for above, (p, q) in ((True, (total_p - low[0], total_q - low[1])), (False, low)):
                    gain = p * (math.log2(p / (p + q)) - before) if p else 0.0
                    if gain > best[0]:
                        best = (gain, Test(f, above, cut, threshold))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def prune(cells: DataFrame, open_: Column, rule: list[Test], purity: float) -> list[Test]:
    """The prefix that is purest on held-out rows, or none if it's less pure than asked. Rows are counted with one of each kind added."""
    held, sums = cells.where(open_ & F.col("held_out")), []
    for k in range(1, len(rule) + 1):
        inside = every([t.on_bins() for t in rule[:k]])
        sums += [F.sum(F.when(inside & (F.col("bad") == kind), F.col("n")).otherwise(0)).alias(f"{k}{kind}") for kind in (True, False)]
    row = held.agg(*sums).first() if rule else None
    if row is None:
        return []
    count = lambda k, kind: row[f"{k}{kind}"] or 0
    score, k = max(((count(k, True) + 1) / (count(k, True) + count(k, False) + 2), -k) for k in range(1, len(rule) + 1))
    p, q = count(-k, True), count(-k, False)
    return rule[:-k] if p and p >= purity * (p + q) else []


def learn_decision_list(labelled: DataFrame, *, bins: int = BINS, max_rules: int = MAX_RULES, purity: float = PURITY) -> list[list[Test]]:
    """labelled: bad (boolean), held_out (boolean) and the values of FEATURES as array ``values``. Returns rules that reject, in order."""
    at = [k / bins for k in range(1, bins)]
    row = labelled.agg(*[F.percentile_approx(F.get("values", F.lit(k)), at, 10_000).alias(f"c{k}") for k in range(len(FEATURES))]).first()
    if row is None or row[0] is None:
        return []
    cuts = [sorted(set(c)) for c in row]
    # The bin is the number of cuts below the value.
    binned = [reduce(add, [F.when(F.get("values", F.lit(k)) > t, 1).otherwise(0) for t in c]).alias(f"b{k}") for k, c in enumerate(cuts)]
    cells = labelled.select("bad", "held_out", *binned)
    cells = staged(cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    rules: list[list[Test]] = []
    while len(rules) < max_rules:
        open_ = every([~every([t.on_bins() for t in rule]) for rule in rules])
        rule = prune(cells, open_, grow(cells, open_, cuts), purity)
        if not rule or rule in rules:
            break
        rules.append(rule)
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """Number of the first rule that rejects, from 1; 0 if none does."""
    values, out = features(), None
    for k, rule in enumerate(rules, 1):
        condition = every([t.on_values(values) for t in rule])
        out = F.when(condition, F.lit(k)) if out is None else out.when(condition, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def labelled_rows(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What learn_decision_list takes, of at most max_labelled documents that pass the base rule."""
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_tm_id")).agg(F.min("quality").alias("a"), F.max("quality").alias("b"))
    known = known.where("a = b").select("_tm_id", (F.col("a") == 0).alias("bad"), id_hash("_tm_id").alias("h")).orderBy("h", "_tm_id").limit(max_labelled)
    picked = docs.select(F.col(id_col).alias("_tm_id"), F.col(text_col).alias("_tm_text")).join(F.broadcast(known), "_tm_id")  # at most max_labelled short rows
    return statistics(picked, "_tm_text").where(~base_failed()).select("bad", (F.col("h") % 3 == 0).alias("held_out"), F.array(*features()).alias("values"))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs with STATS, base_failed, rule (0: none rejects) and kept, each with _tm_ before its name."""
    rules = learn_decision_list(staged(labelled_rows(docs, labels, max_labelled=max_labelled, id_col=id_col, text_col=text_col)))
    scored = statistics(docs, text_col).withColumn("_tm_base_failed", base_failed()).withColumn("_tm_rule", verdict(rules))
    return scored.withColumn("_tm_kept", ~F.col("_tm_base_failed") & (F.col("_tm_rule") == 0)).drop(*[f"_tm_{n}" for n in EXTRA])


def kept_rows(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that the base rule and the learned decision list let through, as they are."""
    return judge(docs, labels, **how).where("_tm_kept").select(*docs.columns)
