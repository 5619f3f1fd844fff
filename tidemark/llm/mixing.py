"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training progress 0..1, piecewise linear. Its integral
is the source's weight; targets share all words by weight, but none exceeds ``max_epochs`` times
what its source holds, and the excess is shared again among the others. A source's documents
stand in a fixed pseudo-random order that is repeated epoch by epoch; a document that starts
after c words of that stream is due when the integrated schedule, scaled to the target, reaches c.
Inverting the integral gives its training position, and the result is sorted by range of position.

Running sums never put a whole source into one task: the id hash cuts each source into buckets,
the buckets' sums are added up first, and the rows are summed within their bucket only.

Nulls and ties: a null source is a source of its own, ordered last; a null text has no words, is
never taken and has a null position; a row of a null id is placed by its text. Rows with the same id
stand next to each other, ordered by text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import body, id_hash, staged, word_count

#: Weights of the sources in order, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: Schedules in order, repeated: (progress, factor of the weight); the mean factor is 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)))


def segments(schedule: tuple[tuple[float, float], ...]) -> list[tuple[float, ...]]:
    """(start, factor, slope, integral before, integral after) of each piece, integrals scaled to end at 1."""
    area = lambda p, q: (q[0] - p[0]) * (p[1] + q[1]) / 2
    pieces = list(zip(schedule, schedule[1:], strict=False))
    total, before, out = sum(area(p, q) for p, q in pieces), 0.0, []
    for p, q in pieces:
        after = before + area(p, q) / total
        out.append((p[0], p[1] / total, (q[1] - p[1]) / (q[0] - p[0]) / total, before, after))
        before = after
    return out


def inverse_integral(share: Column, schedule: Column) -> Column:
    """Progress at which the integral over the segments (t, w, slope, before, after) reaches share."""
    piece = F.coalesce(F.get(F.filter(schedule, lambda s: share <= s["after"]), F.lit(0)), F.element_at(schedule, -1))
    rest = F.greatest(share - piece["before"], F.lit(0.0))
    root = F.sqrt(F.greatest(piece["w"] * piece["w"] + 2 * piece["slope"] * rest, F.lit(0.0)))
    return F.least(piece["t"] + F.coalesce(F.try_divide(2 * rest, piece["w"] + root), F.lit(0.0)), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """sizes: (_tm_src, source, source_size), a row for each source. Adds rank, weight and target.

    With sources ordered by size over weight, the level that the open sources share falls from
    the first source that it doesn't exceed; that level is everyone's words per weight.
    """
    cap = max_epochs * F.col("source_size")
    ranked = sizes.withColumn("_tm_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_tm_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_tm_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_tm_ratio", cap / F.col("_tm_weight"))
    before = W.orderBy("_tm_ratio", "_tm_rank").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (
        F.sum("_tm_weight").over(every) - F.coalesce(F.sum("_tm_weight").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("_tm_level", level)
    ranked = ranked.withColumn("_tm_level", F.max(F.when(F.col("_tm_level") <= F.col("_tm_ratio"), F.col("_tm_level"))).over(every))
    target = F.least(cap.cast("double"), F.coalesce(F.col("_tm_level") * F.col("_tm_weight"), cap.cast("double")))
    return ranked.select("_tm_src", "_tm_rank", "_tm_weight", "source_size", target.alias("target"))


def curriculum_mix(
    docs: DataFrame,
    *,
    keep: tuple[str, ...] = (),
    weights: tuple[float, ...] = WEIGHTS,
    schedules: tuple = SCHEDULES,
    max_epochs: int = 3,
    whole: bool = False,
    rows_per_bucket: int = 16_384,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """A row for each document: id, size, source_size, target, taken, position (of its first use),
    uses (array of epoch, words, position), and the columns in keep as struct ``row``.

    The stream of a source ends at its target: a document that lies across the end is taken for
    its leading words only, or with whole=True entirely or not at all, whichever is nearer.
    """
    rows = max(1, docs.count())
    bits = max(4, (-(-rows // rows_per_bucket) - 1).bit_length())
    d = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(body(text_col)).alias("size"),
        F.when(F.col(id_col).isNull(), id_hash(body(text_col))).otherwise(id_hash(id_col)).alias("_tm_hash"),
        F.xxhash64(body(text_col)).alias("_tm_text"),
        *([F.struct(*[F.col(c) for c in keep]).alias("row")] if keep else []),
    )
    if not keep:
        d = staged(d)  # the texts are read once
    d = d.withColumn("_tm_src", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source"))))
    d = d.withColumn("_tm_bucket", F.shiftrightunsigned("_tm_hash", 60 - bits))

    buckets = d.groupBy("_tm_src", "source", "_tm_bucket").agg(F.sum("size").alias("_tm_size"))
    targets = source_targets(buckets.groupBy("_tm_src", "source").agg(F.sum("_tm_size").alias("source_size")), weights, max_epochs)
    upto = W.partitionBy("_tm_src").orderBy("_tm_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.select("_tm_src", "_tm_bucket", F.coalesce(F.sum("_tm_size").over(upto), F.lit(0)).alias("_tm_before"))
    buckets = buckets.join(targets, "_tm_src")

    inside = W.partitionBy("_tm_src", "_tm_bucket").orderBy("_tm_hash", "id", "_tm_text").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_tm_upto", F.sum("size").over(inside)).join(buckets, ["_tm_src", "_tm_bucket"])
    d = d.withColumn("_tm_start", F.col("_tm_before") + F.col("_tm_upto") - F.col("size"))

    kind = "array<struct<t:double,w:double,slope:double,before:double,after:double>>"
    literal = lambda s: F.array(*[F.struct(*[F.lit(x) for x in p]) for p in segments(s)]).cast(kind)
    schedule = F.element_at(F.array(*map(literal, schedules)), (F.col("_tm_rank") % len(schedules) + 1).cast("int"))
    d = d.withColumn("_tm_schedule", schedule).withColumn("_tm_end", F.round("target").cast("long"))

    def use(epoch: int) -> Column:
        start = F.col("_tm_start") + epoch * F.col("source_size")
        if whole:
            words = F.when(2 * start + F.col("size") <= 2 * F.col("_tm_end"), F.col("size")).otherwise(0)
        else:
            words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_tm_end") - start))
        share = F.coalesce(F.try_divide(start.cast("double"), F.col("target")), F.lit(0.0))
        return F.struct(F.lit(epoch).alias("epoch"), words.cast("long").alias("words"), inverse_integral(share, F.col("_tm_schedule")).alias("position"))

    d = d.withColumn("uses", F.filter(F.array(*[use(e) for e in range(max_epochs)]), lambda u: u["words"] > 0))
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda n, u: n + u["words"])
    return d.select("id", "size", "source_size", "target", taken.alias("taken"), F.get("uses", F.lit(0))["position"].alias("position"), "uses", *(["_tm_text", "row"] if keep else []))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The documents as the mix takes them: a row for each use, sorted by training position; columns as given."""
    mixed = curriculum_mix(docs, keep=tuple(docs.columns), whole=True, **how)
    used = mixed.select("row", "id", "_tm_text", F.explode("uses").alias("_tm_use")).select("row", F.col("_tm_use.position").alias("_tm_position"), F.col("id").alias("_tm_id"), "_tm_text")
    return used.orderBy("_tm_position", "_tm_id", "_tm_text").select("row.*")
