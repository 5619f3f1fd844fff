"""Line dedup by distinct-site spread.

A line is boilerplate if it stands on at least ``min_sites`` sites, in whatever texts and however often: every distinct
(line, site) counts. Lines are counted first over distinct (text, site) pairs, and only those in ``min_sites`` of them or
more go further; they are few. The sites of each are added up in one HyperLogLog sketch for each line hash, which partial
aggregation merges before anything is shuffled; where an estimate lies within six deviations of the threshold the line's
distinct sites are counted exactly, so with five sites a line is missed with a probability of 4e-9.

Boilerplate lines go from every document; other lines and their order stay. A text all of whose lines with a word would
go keeps them, so a document that has copies on many sites isn't emptied. Of near copies on many sites, which share most
of their lines, the text that has only shared lines stays so, and others keep what is their own. Lines are compared
trimmed and in lower case, by 128 bits of hash. Lines of fewer than ``min_words`` words, 1 by default, always stay.

Lines and texts with more than a thousandth of all rows are joined by broadcast, as there are at most 1000 of each;
so no copy group and no common line meets in one task.

Nulls and ties: a null text has no lines and stays null; a null site is one site of its own; rows
with equal texts, whatever their ids, get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import FREQUENT, SPACE, join_counted, staged

MIN_SITES, MIN_WORDS, ERROR, DEVIATIONS = 5, 1, 0.1, 6
TEXT, LINE = ["_tm_t1", "_tm_t2"], ["_tm_a", "_tm_b"]


def normal(line: Column) -> Column:
    return F.lower(F.trim(line, F.lit(" \t\n\x0b\f\r")))


def text_key(text_col: str) -> list[Column]:
    """Two hashes; the second is never zero."""
    return [F.xxhash64(F.lit(1), text_col).alias(TEXT[0]), F.xxhash64(F.lit(2), text_col).bitwiseOR(F.lit(1).cast("long")).alias(TEXT[1])]


def distinct_texts(docs: DataFrame, text_col: str, site_col: str, min_words: int) -> DataFrame:
    """TEXT, _tm_site, _tm_copies and _tm_lines (position and line hashes of each line of min_words or more) of each text but null on each of its sites."""
    long_enough = rf"^(?:[^\x20\x09-\x0D]+{SPACE}+){{{min_words - 1}}}[^\x20\x09-\x0D]" if min_words > 1 else "."
    split = F.transform(F.split(text_col, "\n"), normal)
    lines = F.transform(split, lambda x, i: F.when(x.rlike(long_enough), F.struct(i.alias("_tm_pos"), F.xxhash64(F.lit(1), x).alias(LINE[0]), F.xxhash64(F.lit(2), x).alias(LINE[1]))))
    d = docs.where(F.col(text_col).isNotNull()).select(*text_key(text_col), F.coalesce(F.concat(F.lit("+"), F.col(site_col).cast("string")), F.lit("-")).alias("_tm_site"), F.array_compact(lines).alias("_tm_lines"))
    return d.groupBy(*TEXT, "_tm_site").agg(F.count(F.lit(1)).alias("_tm_copies"), F.first("_tm_lines").alias("_tm_lines"))


def boilerplate(met: DataFrame, min_sites: int = MIN_SITES, error: float = ERROR) -> DataFrame:
    """LINE and n of the lines that are on min_sites sites or more. met: a row (_tm_site, LINE, n) for each frequent line of each text and site."""
    spread = met.groupBy(*LINE).agg(F.max("n").alias("n"), F.approx_count_distinct("_tm_site", error).alias("sites"))
    sure, never = (F.col("sites") > min_sites * (1 + DEVIATIONS * error)), (F.col("sites") < min_sites * (1 - DEVIATIONS * error))
    spread = staged(spread.where(~never).select(*LINE, "n", sure.alias("sure")))
    near = join_counted(met.select("_tm_site", *LINE), spread.where("NOT sure"), LINE, met.count())
    exact = near.groupBy(*LINE, "_tm_site").agg(F.max("n").alias("n")).groupBy(*LINE).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return spread.where("sure").select(*LINE, "n").unionByName(exact.select(*LINE, "n"))


def lines_to_remove(texts: DataFrame, min_sites: int) -> DataFrame:
    """TEXT and _tm_gone (line numbers) of each text with boilerplate and other lines."""
    rows = texts.select(*TEXT, "_tm_site", F.size("_tm_lines").alias("_tm_size"), F.inline("_tm_lines"))
    every = F.array_distinct(F.transform("_tm_lines", lambda x: F.struct(*[x[c] for c in LINE])))
    counted = texts.select(F.inline(every)).groupBy(*LINE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    total = texts.agg(F.coalesce(F.sum(F.size("_tm_lines")), F.lit(0))).first()[0]
    met = staged(join_counted(rows, staged(counted), LINE, total))
    gone = join_counted(met.select(*TEXT, "_tm_size", "_tm_pos", *LINE), staged(boilerplate(met, min_sites)), LINE, met.count())
    by_text = gone.groupBy(*TEXT).agg(F.collect_set("_tm_pos").alias("_tm_gone"), F.max("_tm_size").alias("_tm_size"))
    return by_text.where(F.size("_tm_gone") < F.col("_tm_size")).drop("_tm_size")


def dedup_lines(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with boilerplate lines cut from the text, and _tm_n_lines, _tm_n_removed."""
    texts = staged(distinct_texts(docs, text_col, site_col, min_words))
    gone = staged(lines_to_remove(texts, min_sites))
    rows = texts.agg(F.coalesce(F.sum("_tm_copies"), F.lit(0))).first()[0]
    hot = texts.groupBy(*TEXT).agg(F.sum("_tm_copies").alias("n")).where(F.col("n") > FREQUENT * rows).select(*TEXT)
    of_hot = hot.join(gone, TEXT, "left").select(*TEXT, F.coalesce("_tm_gone", F.array().cast("array<int>")).alias("_tm_hot"))
    keyed = docs.select("*", *text_key(text_col)).join(F.broadcast(of_hot), TEXT, "left")  # at most 1 / FREQUENT rows
    # What is settled or null gets a key of its own, so that it meets no other row; no text has zero as its second hash.
    settled = F.col("_tm_hot").isNotNull() | F.col(text_col).isNull()
    keyed = keyed.withColumn(TEXT[0], F.when(settled, F.monotonically_increasing_id()).otherwise(F.col(TEXT[0]))).withColumn(TEXT[1], F.when(settled, F.lit(0).cast("long")).otherwise(F.col(TEXT[1])))
    out = keyed.join(gone, TEXT, "left").withColumn("_tm_gone", F.coalesce(F.when(F.size("_tm_hot") > 0, F.col("_tm_hot")), F.col("_tm_gone")))
    out = out.withColumn("_tm_split", F.split(text_col, "\n"))
    #: The numbers of the lines that stay; array_except is linear, membership tests in long lists are not.
    out = out.withColumn("_tm_stay", F.sort_array(F.array_except(F.sequence(F.lit(0), F.size("_tm_split") - 1), F.col("_tm_gone"))))
    cut = F.array_join(F.transform("_tm_stay", lambda i: F.get(F.col("_tm_split"), i)), "\n")
    out = out.withColumn("_tm_cut", F.when(F.col("_tm_gone").isNull(), F.col(text_col)).otherwise(cut))
    out = out.withColumn("_tm_n_lines", F.coalesce(F.size("_tm_split"), F.lit(0)).cast("long")).withColumn("_tm_n_removed", F.coalesce(F.size("_tm_gone"), F.lit(0)).cast("long"))
    return out.select(*[F.col("_tm_cut").alias(c) if c == text_col else F.col(c) for c in docs.columns], "_tm_n_lines", "_tm_n_removed")
