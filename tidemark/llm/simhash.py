"""SimHash near-dedup by a binary trie self-join.

A text's fingerprint has a bit for each of 64 that is set in over half of its shingles' hashes.
Fingerprints that differ in at most two bits are linked, and linked ones form components.

Two such fingerprints agree in one of three blocks of bits. Each distinct fingerprint is dealt
out three times, turned so that another block leads, by the value of that block. A task sorts
what it got, which makes every range of equal leading bits a node of a binary trie, and walks
pairs of nodes down together from the nodes of equal leading block: it adds up the bits in which
the pair differs and drops it beyond the budget. Pairs that reach the leaves are links; the task
keeps only a spanning star of each of its groups. Components over all tasks follow from the stars.

Equal fingerprints are one node however many documents have them, so copies never make pairs.
The pairs walked per fingerprint are bounded by the number of bit patterns within the budget.

Nulls and ties: a null text is empty; texts without words have fingerprint zero and are linked like
any other. component_id is the smallest id of the component; ids that are null don't count, and a
component of null ids only has a null component_id. Rows with the same id are documents of their own;
where rows have one id and one text, drop_near_copies may keep any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.common import body, join_counted, short_batches, spread, staged
from tidemark.llm.components import connected_components, local_roots

SEED, BUDGET, BLOCKS = 42, 2, ((0, 22), (22, 21), (43, 21))
CHUNK = 1 << 18


def shingle_hashes(text: str, k: int = 3) -> np.ndarray:
    """XXH64 of each window of k words, or of the whole sequence if it is shorter; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII space count
    if not words:
        return np.empty(0, np.uint64)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[i:j], SEED) for i, j in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str, k: int = 3) -> int:
    h = shingle_hashes(text, k)
    votes = np.zeros(64, np.int64)
    for part in range(0, len(h), 4096):
        votes += np.unpackbits(h[part : part + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def turn(keys: np.ndarray, bits: int) -> np.ndarray:
    """Rotates 64-bit keys left."""
    return keys if not bits else (keys << np.uint64(bits)) | (keys >> np.uint64(64 - bits))


def trie_pairs(keys: np.ndarray, lead: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of sorted distinct keys that agree in the first lead bits and differ in at most budget others.

    A trie node is a range of keys; its bit column's running sum tells where its second child begins.
    Large frontiers are cut up and walked part by part, so memory is bounded.
    """
    ones: dict[int, np.ndarray] = {}

    def second_child(depth: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        return end - (ones[depth][end] - ones[depth][start])

    head = keys >> np.uint64(64 - lead)
    start = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(keys) else np.empty(0, np.int64)
    end = np.append(start[1:], len(keys))
    few = end - start > 1
    stack = [(lead, np.array([start[few], end[few], start[few], end[few], np.zeros(few.sum(), np.int64)]))]
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > CHUNK:
            half = pairs.shape[1] // 2
            stack += [(depth, pairs[:, :half]), (depth, pairs[:, half:])]
            continue
        if not pairs.shape[1]:
            continue
        if depth == 64:
            yield pairs[0], pairs[2]
            continue
        a, a_end, b, b_end, differ = pairs
        a_mid, b_mid = second_child(depth, a, a_end), second_child(depth, b, b_end)
        same = a == b
        one_more = differ + 1
        following = np.concatenate(
            [
                np.array([a, a_mid, b, b_mid, differ]),
                np.array([a_mid, a_end, b_mid, b_end, differ]),
                np.array([a, a_mid, b_mid, b_end, one_more]),
                np.array([a_mid, a_end, b, b_mid, one_more])[:, ~same],
            ],
            axis=1,
        )
        a, a_end, b, b_end, differ = following
        alive = (a < a_end) & (b < b_end) & (differ <= budget) & ~((a == b) & (a_end - a == 1))
        stack.append((depth + 1, following[:, alive]))


def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning stars (a, b) of the linked fingerprints among the partition's (turn, key)."""
    rows = [p for p in parts if len(p)]
    if not rows:
        return
    rows = pd.concat(rows)
    for block, (offset, width) in enumerate(BLOCKS):
        keys = np.unique(rows.loc[rows["block"] == block, "key"].to_numpy(np.int64).view(np.uint64))
        root = np.arange(len(keys))
        for i, j in trie_pairs(keys, width, BUDGET):
            root = local_roots(len(keys), np.concatenate([np.arange(len(keys)), i]), np.concatenate([root, j]))
        linked = np.flatnonzero(root != np.arange(len(keys)))
        own = turn(keys, (64 - offset) % 64).view(np.int64)
        yield pd.DataFrame({"a": own[linked], "b": own[root[linked]]})


def near_links(distinct: DataFrame) -> DataFrame:
    """distinct: fingerprints fp (long), each once. Returns stars (a, b) that connect all that differ in at most two bits."""
    n = spread(distinct.sparkSession, 3 * distinct.count(), 50_000)
    key = lambda bits: F.col("fp") if not bits else F.shiftleft("fp", bits).bitwiseOR(F.shiftrightunsigned("fp", 64 - bits))
    turned = distinct.select(F.explode(F.array(*[F.struct(F.lit(k).alias("block"), key(offset).alias("key"), F.shiftrightunsigned(key(offset), 64 - width).alias("lead")) for k, (offset, width) in enumerate(BLOCKS)])).alias("x")).select("x.*")
    return turned.repartition(n, "block", "lead").select("block", "key").mapInPandas(walk, "a long, b long")


def rooted(prints: DataFrame, **least) -> DataFrame:
    """fp, root, n (rows of fp) and the given aggregates of each fingerprint."""
    distinct = staged(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in least.items()]))
    roots = connected_components(near_links(distinct.select("fp"))).select(F.col("node").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (long) and component_id of every row."""
    short_batches(docs.sparkSession)
    prints = staged(docs.select(F.col(id_col).alias("id"), fingerprints(body(text_col)).alias("fp")))
    roots = staged(rooted(prints, first=F.min("id")))
    components = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(components, "root").select("fp", "n", "component_id")
    return join_counted(prints, named, ["fp"], prints.count()).select("id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of its smallest id (null last), and of rows with that id that of the least text hash."""
    short_batches(docs.sparkSession)
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(body(text_col)).alias("hash"))
    prints = staged(docs.select(key.alias("key"), fingerprints(body(text_col)).alias("fp")))
    stay = rooted(prints, first=F.min("key")).groupBy("root").agg(F.min("first").alias("first"))
    stay = stay.select(F.col("first.id").alias("_tm_id"), F.col("first.hash").alias("_tm_hash"))
    met = docs.withColumn("_tm_own", F.xxhash64(body(text_col))).join(stay, (F.col("_tm_own") == F.col("_tm_hash")) & F.col(id_col).eqNullSafe(F.col("_tm_id")), "left_semi")
    return met.dropDuplicates([id_col, "_tm_own"]).select(*docs.columns)
