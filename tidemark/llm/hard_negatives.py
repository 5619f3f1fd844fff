"""Hard-negative mining by L2AP-style threshold joins.

A window is what an anchor looks for: the K highest inner products within bounds, among rows of its own label
(its positives) or of others (for each positive the negatives that score a given share of it). Windows are filled by
rounds of threshold joins: all pairs of an open window's anchor with a row that reach its threshold are found, and
windows that K of them fill are done; for the others the threshold is lowered, at last to the window's lower bound.
What reaches the threshold is the top of the window, so a filled one is exact.

A threshold join deals rows into blocks by a hash of their id and anchors into groups, both of bounded size, and joins
each block with each group. Blocks and groups are read from where they are staged, some of each to a task, so what is
written and the number of tasks don't grow with their pairs. In a pair an inverted index lists a row in those dimensions only (most energy first) after
which what is left of its norm, times the largest rest of an anchor's, could still reach the lowest threshold; partial
scores add up dimension by dimension over the lists, and after each step rows go whose partial score and remaining
norms reach no anchor's threshold. Pairs that are left get the omitted dimensions added. Each task's own top K of a
window goes on, which loses none of the overall ones, so what is shuffled doesn't grow with ties or copies.

Components are whole numbers after ``quantised``, so scores are exact. Nulls and ties: a row with a null id, label or
vector or a null or non-finite component takes no part; of rows with one id the one of least label and vector does;
vectors are as long as the longest, with zeros behind; an empty vector scores zero; equal scores stand by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import spread, staged

#: Rows of a block, anchors of a group, and dimensions of a step.
BLOCK, GROUP, STEP = 4096, 4096, 8
#: Blocks and groups of a task (there are fewer blocks where that leaves cores idle), and pairs of them that Python gets at once.
TASK_BLOCKS, TASK_GROUPS, BATCH = 16, 16, 2
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Found rows that are kept besides the best ones, until these are told anew.
HEAP = 500_000
#: Of a positive's window: first its norms' product times these, then all rows; of a negative's: so far from the upper to the lower bound.
POSITIVE_STEPS, NEGATIVE_STEPS = (0.3, 0.15), (0.15, 0.5)
#: Bounds of a square root's error.
SLACK = 1e-6


def quantised(vec: str | Column, scale: float = 256.0) -> Column:
    """The vector with each component as floor(scale * x); null if a component is null or not finite."""
    v = F.col(vec) if isinstance(vec, str) else vec
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))  # NaN is above all
    return F.when(finite, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def pack(rows: DataFrame, key: str, width: int, columns: dict[str, str], n: int) -> DataFrame:
    """A row for each key with the numpy bytes of each column; those of arrays are padded to width."""

    def packed(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = {key: [k[0]]}
        for c, kind in columns.items():
            if kind == "array":
                table = np.zeros((len(part), width))
                for row, v in zip(table, part[c], strict=True):
                    row[: len(v)] = v
                out[c] = [table.tobytes()]
            else:
                out[c] = [part[c].to_numpy(kind).tobytes()]
        return pd.DataFrame(out)

    return rows.repartition(n, key).groupBy(key).applyInPandas(packed, f"{key} long, {', '.join(f'{c} binary' for c in columns)}")


def reaching(x: np.ndarray, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, their inner product) of all pairs whose product is least[row of q] or more."""
    order = np.argsort(-(x * x).sum(0) * (q * q).sum(0), kind="stable")
    x, q = x[:, order], q[:, order]
    edges = [*range(0, x.shape[1], STEP), x.shape[1]]
    rest = lambda v: np.sqrt(np.stack([(v[:, e:] * v[:, e:]).sum(1) for e in edges], 1))
    rx, rq = rest(x), rest(q)
    #: The inverted index: in how many steps a row is listed. What is left after them can't reach a threshold by itself.
    listed = np.minimum((rx * rq.max(0) + SLACK >= least.min()).sum(1), len(edges) - 1)
    rows = np.argsort(-listed, kind="stable")
    rows = rows[: np.count_nonzero(listed)] if least.min() > 0 else rows
    score = np.zeros((len(q), len(rows)))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        n = np.count_nonzero(listed[rows] > k)
        if not n:
            break
        score[:, :n] += q[:, a:b] @ x[rows[:n], a:b].T
        done = np.minimum(listed[rows], k + 1)
        alive = (score + rq[:, done] * rx[rows, done] + SLACK >= least[:, None]).any(0)
        if not alive.all():
            rows, score = rows[alive], score[:, alive]
    done = listed[rows]
    qi, at = np.nonzero(score + rq[:, done] * rx[rows, done] + SLACK >= least[:, None])
    xi, found, done = rows[at], score[qi, at], done[at]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        open_ = np.flatnonzero(done <= k)
        for part in np.array_split(open_, len(open_) // 65536 + 1):
            found[part] += (q[qi[part], a:b] * x[xi[part], a:b]).sum(1)
    keep = found >= least[qi]
    return qi[keep], xi[keep], found[keep]


def joined(batches: Iterator[pd.DataFrame], width: int, k: int, same: bool) -> Iterator[pd.DataFrame]:
    """The top k of each window in the blocks of a task."""
    best, more, size = pd.DataFrame(), [], 0
    for batch in batches:
        for r in batch.itertuples():
            ids, labels, x = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64), np.frombuffer(r.vectors).reshape(-1, width)
            anchor, key, of = (np.frombuffer(c, np.int64) for c in (r.anchor, r.key, r.label))
            low, high, q = np.frombuffer(r.low), np.frombuffer(r.high), np.frombuffer(r.vector).reshape(-1, width)
            own, first = np.unique(anchor, return_index=True)
            least = pd.Series(low).groupby(anchor).min().to_numpy()
            windows = pd.Series(range(len(anchor))).groupby(anchor).indices
            out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            by_least = np.argsort(-least, kind="stable")
            for part in np.array_split(by_least, len(own) // 256 + 1):
                if not len(part):
                    continue
                qi, xi, score = reaching(x, q[first[part]], least[part])
                bounds = np.searchsorted(qi, np.arange(len(part) + 1))
                for j, p in enumerate(part):
                    mine = slice(bounds[j], bounds[j + 1])
                    name, s_all, x_all = own[p], score[mine], xi[mine]
                    mate = (labels[x_all] == of[first[p]]) == same
                    mate &= ids[x_all] != name
                    s_all, i_all = s_all[mate], ids[x_all[mate]]
                    for w in windows[name]:
                        fits = (s_all >= low[w]) & (s_all <= high[w])
                        s, i = s_all[fits], i_all[fits]
                        if len(s) > k:
                            top = s >= np.partition(s, len(s) - k)[len(s) - k]
                            s, i = s[top], i[top]
                        top = np.lexsort((i, -s))[:k]
                        if len(top):
                            out.append((name, key[w], i[top], s[top]))
            if out:
                n = [len(i) for *_, i, _ in out]
                more.append(pd.DataFrame({"anchor": np.repeat([o[0] for o in out], n), "key": np.repeat([o[1] for o in out], n), "id": np.concatenate([o[2] for o in out]), "score": np.concatenate([o[3] for o in out]).astype(np.int64)}))
                size += len(more[-1])
            if size > len(best) + HEAP:
                best, more, size = topmost([best, *more], k), [], 0
    if more:
        best = topmost([best, *more], k)
    for at in range(0, len(best), HEAP):
        yield best[at : at + HEAP]


def topmost(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The k highest of each window."""
    d = pd.concat([f for f in found if len(f)])
    d = d.iloc[np.lexsort((d["id"], -d["score"], d["key"], d["anchor"]))]
    return d[d.groupby(["anchor", "key"]).cumcount() < k]


def filled(blocks: DataFrame, n_blocks: int, width: int, windows: DataFrame, steps: list[Column], k: int, same: bool) -> DataFrame:
    """anchor, key, id, score, rank: the k highest of each window (anchor, key, label, vector, low, high). steps: the thresholds to try before a window's lower bound."""
    spark = blocks.sparkSession
    done, open_ = [], windows
    for step in [*steps, F.col("low")]:
        n = open_.count()
        if not n:
            break
        groups = -(-n // GROUP)
        tried = open_.withColumns({"bound": F.col("low"), "low": F.greatest(step, "low"), "g": F.pmod(F.xxhash64("anchor"), F.lit(groups))})
        kinds = {"anchor": "int64", "key": "int64", "label": "int64", "low": "float64", "high": "float64", "vector": "array"}
        asked = staged(pack(tried, "g", width, kinds, groups)).drop("g").coalesce(-(-groups // TASK_GROUPS))
        pairs = blocks.drop("b").coalesce(spread(spark, n_blocks, TASK_BLOCKS)).crossJoin(asked)
        tops = pairs.mapInPandas(lambda batches: joined(batches, width, k, same), "anchor long, key long, id long, score long")
        ranked = tops.withColumn("rank", F.row_number().over(W.partitionBy("anchor", "key").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        batch = spark.conf.get(ARROW_ROWS)
        try:
            spark.conf.set(ARROW_ROWS, str(BATCH))  # a pair is megabytes
            ranked = staged(ranked)
        finally:
            spark.conf.set(ARROW_ROWS, batch)
        full = tried.join(ranked.groupBy("anchor", "key").count(), ["anchor", "key"], "left").withColumn("full", (F.col("low") <= F.col("bound")) | F.coalesce(F.col("count") >= k, F.lit(False)))
        full = staged(full.drop("count", "g", "low").withColumnRenamed("bound", "low"))
        done.append(ranked.join(full.where("full").select("anchor", "key"), ["anchor", "key"], "left_semi"))
        open_ = full.where("NOT full").drop("full")
    out = spark.createDataFrame([], "anchor long, key long, id long, score long, rank int")
    for d in done:
        out = out.unionByName(d)
    return out


def mine(rows: DataFrame, anchors: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", n_positives: int = 5, k: int = 10, low: float = 30, high: float = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchors: which rows are, by id_col and others.

    Components are whole numbers (see quantised), labels too. low and high: the share of the positive's score, in percent, that a negative has.
    """
    spark = rows.sparkSession
    vector = F.col(vec_col)
    whole = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    known = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & whole)
    known = known.select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(label_col).cast("long").alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("vector"), anchors.alias("anchor")).alias("r"))
    known = staged(known.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*"))
    n, width, largest, norm = known.agg(
        F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("vector", F.abs))), F.lit(0.0)),
        F.coalesce(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))), F.lit(0.0)),
    ).first()
    if largest * largest * width >= 2.0**53:
        raise ValueError("components are too large for exact inner products")
    width, n_blocks = max(width, 1), max(1, -(-n // BLOCK))
    dealt = known.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("b"), F.col("id").alias("ids"), F.col("label").alias("labels"), F.col("vector").alias("vectors"))
    blocks = staged(pack(dealt, "b", width, {"ids": "int64", "labels": "int64", "vectors": "array"}, spread(spark, n_blocks, 1)))
    asking = known.where("anchor").select(F.col("id").alias("anchor"), "label", "vector")
    own_norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    first = asking.select("*", F.lit(0).cast("long").alias("key"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    positives = filled(blocks, n_blocks, width, first, [own_norm * (norm * s) for s in POSITIVE_STEPS], n_positives, same=True)
    positives = staged(positives.select("anchor", F.col("id").alias("key"), F.col("score").alias("positive_score")))
    ends = {"low": F.ceil(F.col("positive_score") * low / 100).cast("double"), "high": F.floor(F.col("positive_score") * high / 100).cast("double")}
    windows = asking.join(positives, "anchor").withColumns(ends).where("low <= high")
    steps = [F.col("high") - (F.col("high") - F.col("low")) * s for s in NEGATIVE_STEPS]
    found = filled(blocks, n_blocks, width, windows.drop("positive_score"), steps, k, same=False)
    return found.join(positives, ["anchor", "key"]).select(
        F.col("anchor").alias("anchor_id"), F.col("key").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
