"""Language identification by language-bitmask n-gram filters.

What is learned of a language is the set of its grams: N characters of lower-cased letters, with a blank for what is
between words, that are at least MIN_SHARE of all its grams and at least TYPICAL times as frequent as in the language
that has them most. Text counts in the learned grams by character, so long documents count for more. MIN_SHARE bounds the
number of a language's grams by 1 / MIN_SHARE, whatever the corpus, and with it the size of the filter.

The sets are kept in one bit-sliced Bloom filter: SLOTS rows of bits, one bit for each language. A gram sets its
languages' bits in HASHES slots; the AND of these slots' rows gives at once all languages that (may) contain it. A text's
grams are looked up so, and each language's bits are counted (popcount). Of n grams a language without any would get
n * f, f being its slots' share of set bits to the power of HASHES, so the count is corrected to (count - n * f) / (1 - f).
The highest corrected count decides, then the language with more learned grams' text, then its name.

The score is the corrected share of the text's grams that its language contains, 0 to 1. ``und`` with score 0 is what a
null text, a text without letters, and every text gets if nothing was learned. Repeated rows count as often as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import body, short_batches, staged

#: Characters of a gram; a code point takes 21 bits of a long.
N = 3
MIN_SHARE, TYPICAL = 1 / 50_000, 0.4
SLOTS, HASHES = 1 << 20, 3
#: Odd 64-bit numbers of mixing functions.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """The code of each gram of a text; none if it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letters()[code], code, 32).astype(np.int64)
    code = np.concatenate([[32], code, [32]])
    code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]  # runs of blanks are one
    if len(code) < N:
        return code[:0]
    return code[:-2] << 42 | code[1:-1] << 21 | code[2:]


def slots_of(codes: np.ndarray) -> list[np.ndarray]:
    """HASHES slots of each gram."""
    h = codes.astype(np.uint64)
    h = (h ^ h >> np.uint64(30)) * np.uint64(MIX[1])
    h = (h ^ h >> np.uint64(27)) * np.uint64(MIX[2])
    h = h ^ h >> np.uint64(31)
    step = (h * np.uint64(MIX[0])) >> np.uint64(32) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(SLOTS)).astype(np.int64) for k in range(HASHES)]


def gram_counts(texts: DataFrame) -> DataFrame:
    """lang, gram, n: how often each gram stands in the texts (lang, text) of each language."""
    short_batches(texts.sparkSession)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, part in b.groupby("lang"):
                code, n = np.unique(np.concatenate([grams(t) for t in part["text"]]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": code, "n": n})

    return texts.mapInPandas(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learned_grams(counts: DataFrame, min_share: float = MIN_SHARE, typical: float = TYPICAL) -> DataFrame:
    """lang, gram of the sets; at most 1 / min_share for each language."""
    total = F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("total")))  # a row for each language
    share = counts.join(total, "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= min_share)
    return share.withColumn("most", F.max("share").over(W.partitionBy("gram"))).where(F.col("share") >= typical * F.col("most")).select("lang", "gram")


def bloom(chosen: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The filter as a table of SLOTS rows with 64 languages a column, and each language's rate of false positives."""
    number = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))])

    @F.pandas_udf("array<int>")
    def slots(codes: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(slots_of(codes.to_numpy()), 1).astype(np.int32)))

    at = chosen.withColumn("k", number[F.col("lang")]).select("k", F.explode(slots("gram")).alias("slot"))
    rows = at.groupBy("slot", F.floor(F.col("k") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, k % 64)")).alias("bits"))
    table = np.zeros((SLOTS, -(-len(names) // 64)), np.uint64)
    for part in rows.toLocalIterator():  # at most a row for each slot and 64 languages
        table[part["slot"], int(part["word"])] = np.uint64(part["bits"] & (1 << 64) - 1)
    full = np.array([np.count_nonzero(table[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(names))])
    return table, (full / SLOTS) ** HASHES


def languages_of(codes: np.ndarray, table: np.ndarray, n_languages: int) -> np.ndarray:
    """How many of the grams each language (may) contain."""
    first, *more = slots_of(codes)
    mask = table[first]
    for s in more:
        mask = mask & table[s]
    return np.array([np.count_nonzero(mask[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(n_languages)])


def best(text: str, table: np.ndarray, false: np.ndarray) -> tuple[int, float] | None:
    """The number of a text's language and the score; None without a gram. Languages are numbered so that of equals the first wins."""
    codes = grams(text)
    if not len(codes):
        return None
    rest = (languages_of(codes, table, len(false)) - len(codes) * false) / np.maximum(1 - false, 1e-9)
    k = int(rest.argmax())
    return k, float(min(max(rest[k] / len(codes), 0), 1))


def identify(docs: DataFrame, train: Column, *, text_col: str = "text", lang_col: str = "lang", min_share: float = MIN_SHARE, typical: float = TYPICAL) -> DataFrame:
    """docs with _tm_lang_pred and _tm_score. train: which rows may be learned from; lang_col isn't read of any other row."""
    spark = docs.sparkSession
    short_batches(spark)
    known = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = staged(gram_counts(known))
    names = [r["lang"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()]  # a row for each language
    kind = "lang_pred string, score double"
    if names:
        table, false = bloom(learned_grams(counts, min_share, typical), names)
        held = spark.sparkContext.broadcast((table, false))

        @F.pandas_udf(kind)
        def predict(texts: pd.Series) -> pd.DataFrame:
            found = [best(t, *held.value) for t in texts]
            return pd.DataFrame([("und", 0.0) if f is None else (names[f[0]], f[1]) for f in found], columns=["lang_pred", "score"])

        made = predict(body(text_col))
    else:
        made = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    out = docs.withColumn("_tm_found", made)
    return out.select(*docs.columns, F.col("_tm_found.lang_pred").alias("_tm_lang_pred"), F.col("_tm_found.score").alias("_tm_score"))
