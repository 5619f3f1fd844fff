"""Substring dedup by paragraph MinHash banding.

Two kinds of repeats are found over all documents. Paragraphs are lines of MIN_WORDS words or more, and
runs of shorter lines between them that have as many words together; a text without any is one paragraph
as a whole. Equal paragraphs are one node, and different ones that collide in a MinHash band are joined and
kept as linked if the exact Jaccard similarity of their five-word shingles is THRESHOLD or more; linked ones
form clusters. Bands and rows are tuned so that a pair at the threshold collides nearly always. Before texts
are fetched, a pair must agree in LEAST of its HASHES minima, which a pair at the threshold fails with a
probability below 1e-5. Passages are windows of PASSAGE words that start where a five-word hash is the least
of ANCHOR in a row: any RUN equal words in two documents hold an equal passage, wherever lines break. A passage
that only repeats within one document doesn't count.

The first occurrence of a cluster or passage stays, by document id and place; later ones are removals.
Documents that share any are linked and form components. Band codes and passages are sorted by range, so that
what recurs stands side by side and a key of any size lies across many tasks; what occurs once goes no further.
A bucket of up to WINDOW + 1 paragraphs is joined whole. In a larger one (and in those that a range's edge may
cut) each paragraph is joined to the WINDOW rows after it in the order of the next bands' codes, that is, to
those that have most bands in common with it; that bounds pairs by the number of paragraphs. Most of a bucket
is then one cluster. Members that are outside its largest cluster are then compared with all its members, in
blocks of BLOCK rows on each side, and only links between clusters come out; so no link of a bucket is lost,
whatever its size.

Nulls and ties: a null text has no words; rows of a null id have no repeats of their own and get a
null component; rows with the same id are one document, whatever their texts; words are compared in lower case.
Ids may be of any type that sorts; those that aren't whole numbers are numbered in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegralType, StringType

from tidemark.llm.common import body, join_counted, short_batches, spread, staged
from tidemark.llm.components import connected_components, local_roots

SHINGLE, MIN_WORDS, THRESHOLD, RECALL = 5, 20, 0.8, 0.999
RUN, ANCHOR = 50, 16
WINDOW, TAIL, BLOCK = 16, 3, 512
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = RUN - ANCHOR
SEED = 42
#: Bytes of text that are worked on at once, and the longest word that is hashed with others.
CHUNK, LONG_WORD = 1 << 20, 256


def tuned_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = 64) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands together find a pair at the threshold with the given probability."""
    for rows in range(8, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most_hashes:
            return bands, rows
    return most_hashes, 1


def least_matches(hashes: int, threshold: float = THRESHOLD, miss: float = 1e-5) -> int:
    """The number of equal minima that a pair at the threshold falls short of with a probability of at most miss."""
    below, k = 0.0, 0
    while (below := below + comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k)) <= miss:
        k += 1
    return k


BANDS, ROWS = tuned_bands(most_hashes=36)
HASHES = BANDS * ROWS
LEAST = least_matches(HASHES)
_random = np.random.default_rng(SEED)
_odd = lambda n: _random.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS, TERMS = _odd(HASHES), _odd(HASHES)
LETTERS, PLACES, WORDS, BASE = _odd(256), _odd(LONG_WORD), _odd(SHINGLE), int(_odd(1)[0])
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all of them."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words of the bytes start and end, and their hashes; first: where texts start."""
    word = ~IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[first] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    stops = word.copy()
    stops[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    at = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))])
    letters = LETTERS[raw] * PLACES[np.minimum(at, LONG_WORD - 1)]
    letters[~word] = 0
    hashes = mixed(np.add.reduceat(letters, starts))
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[k] = xxhash.xxh64_intdigest(raw[starts[k] : ends[k]].tobytes(), SEED)
    return starts, ends, hashes


def slid(values: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each window of the given size."""
    out, width = values, 1
    while width < size:
        step = min(width, size - width)
        out = pick(out[:-step], out[step:])
        width += step
    return out


def minima(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each of HASHES (row) the least value over the grams of each paragraph (column). bounds: first gram, end, in turn, of each."""
    out = np.empty((HASHES, len(bounds) // 2), np.uint64)
    if len(bounds):
        bounds = bounds[:-1] if bounds[-1] >= len(grams) else bounds
        for k in range(HASHES):
            x = grams * FACTORS[k] + TERMS[k]
            x ^= x >> np.uint64(32)
            out[k] = np.minimum.reduceat(x, bounds)[::2]
    return out


def units(raw: np.ndarray, first: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Of the bytes of texts in lower case, joined: paragraphs and passages as columns; first: where texts start. ``text`` is the text's number."""
    with np.errstate(over="ignore"):
        starts, ends, hashes = word_hashes(raw, first)
        n = len(starts)
        text = np.searchsorted(first, starts, "right") - 1
        newlines = np.flatnonzero(raw == 10)
        line = np.searchsorted(newlines, starts) - np.searchsorted(newlines, first)[text]
        own = np.searchsorted(starts, first)  # the first word of each text
        none = np.empty(0, np.int64)
        if not n:
            empty = {k: none for k in ("text", "line", "lines", "first", "start", "length", "content")}
            return empty | {"bands": np.empty((0, BANDS), np.int64), "marks": np.empty((0, HASHES), np.uint8)}, {"text": none, "place": none, "cluster": none}
        grams = np.zeros(n, np.uint64)
        if n >= SHINGLE:
            size = n - SHINGLE + 1
            grams[:size] = mixed(sum(hashes[k : k + size] * WORDS[k] for k in range(SHINGLE)))

        # Paragraphs: from the lines that have words.
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(line) != 0)]))
        long = np.diff(np.append(heads, n)) >= MIN_WORDS
        opens = long.copy()
        opens[0] = True
        opens[1:] |= long[:-1] | (text[heads[1:]] != text[heads[:-1]])
        begin = heads[opens]
        end = np.append(begin[1:], n)
        of = text[begin]
        alone = np.bincount(of, minlength=len(first))[of] == 1
        kept = (end - begin >= MIN_WORDS) | alone
        begin, end, of = begin[kept], end[kept], of[kept]
        data = raw.tobytes()
        content = np.array([xxhash.xxh64_intdigest(b" ".join(data[i:j].split()), SEED) for i, j in zip(starts[begin].tolist(), ends[end - 1].tolist(), strict=True)], np.uint64)
        short = end - begin < SHINGLE
        least = np.empty((HASHES, len(begin)), np.uint64)
        least[:, ~short] = minima(grams, np.column_stack([begin[~short], end[~short] - SHINGLE + 1]).ravel())
        least[:, short] = content[short] * FACTORS[:, None] + TERMS[:, None]
        code = np.empty((len(begin), BANDS), np.uint64)
        for b in range(BANDS):
            x = np.full(len(begin), b + 1, np.uint64)
            for row in least[b * ROWS : (b + 1) * ROWS]:
                x = mixed(x ^ row)
            code[:, b] = x
        paragraphs = {
            "text": of, "line": line[begin], "lines": line[end - 1] - line[begin] + 1, "first": begin - own[of], "start": starts[begin] - first[of], "length": ends[end - 1] - starts[begin],
            "content": content.view(np.int64), "bands": code.view(np.int64), "marks": (mixed(least) >> np.uint64(56)).astype(np.uint8).T,
        }

        # Passages: where a five-word hash is the least of a window that lies in one text.
        passages = {"text": none, "place": none, "cluster": none}
        reach = ANCHOR + SHINGLE - 1
        if n >= PASSAGE + ANCHOR - 1:
            low = slid(grams[: n - SHINGLE + 1], ANCHOR, np.minimum)
            low = np.where(text[: len(low)] == text[reach - 1 :], low, np.uint64(0))
            high = slid(np.concatenate([np.zeros(ANCHOR - 1, np.uint64), low, np.zeros(ANCHOR - 1, np.uint64)]), ANCHOR, np.maximum)
            at = np.flatnonzero(high == grams[: len(high)])
            at = at[at + PASSAGE <= n]
            at = at[text[at] == text[at + PASSAGE - 1]]
            powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(PASSAGE - 1, BASE, np.uint64)]), dtype=np.uint64)
            cluster = np.zeros(len(at), np.uint64)
            for k in range(PASSAGE):
                cluster += hashes[at + k] * powers[k]
            passages = {"text": text[at], "place": at - own[text[at]], "cluster": mixed(cluster).view(np.int64)}
        return paragraphs, passages


LONG_LIST, INT_LIST = pa.list_(pa.int64()), pa.list_(pa.int32())
FOUND = "id long, text_hash long, line array<int>, lines array<int>, first array<int>, start array<int>, length array<int>, content array<long>, bands array<array<long>>, marks array<binary>, place array<int>, cluster array<long>"


def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maps (id, text_hash, text) to FOUND."""
    for batch in batches:
        texts = batch.column("text")
        if pa.types.is_string(texts.type):
            texts = texts.cast(pa.large_string())
        sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        whole = np.concatenate([[0], np.cumsum(sizes)])
        i = 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(whole, whole[i] + CHUNK, "right")) - 1)
            raw = np.frombuffer("".join(texts[i:j].to_pylist()).encode("utf-8", "surrogatepass"), np.uint8)
            p, w = units(raw, whole[i:j] - whole[i])
            cut = lambda t: np.searchsorted(t, np.arange(j - i + 1)).astype(np.int32)  # noqa: B023, E731
            lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets), values)
            ps, ws, m = cut(p["text"]), cut(w["text"]), len(p["text"])
            codes = lists(np.arange(0, m * BANDS + 1, BANDS, dtype=np.int32), pa.array(p["bands"].ravel()))
            marks = np.ascontiguousarray(p["marks"])
            marks = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(0, m * HASHES + 1, HASHES, dtype=np.int32)), pa.py_buffer(marks.tobytes())])
            ints = [lists(ps, pa.array(p[c].astype(np.int32))) for c in ("line", "lines", "first", "start", "length")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id")[i:j], batch.column("text_hash")[i:j], *ints, lists(ps, pa.array(p["content"])), lists(ps, codes), lists(ps, marks), lists(ws, pa.array(w["place"].astype(np.int32))), lists(ws, pa.array(w["cluster"]))],
                names=["id", "text_hash", "line", "lines", "first", "start", "length", "content", "bands", "marks", "place", "cluster"],
            )
            i = j


def shingles_of(text: bytes) -> list[bytes]:
    w = text.split()
    return [b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))]


@F.pandas_udf(DoubleType())
def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of the sets of five-word shingles of two texts in bytes."""
    sets = ((set(shingles_of(bytes(x))), set(shingles_of(bytes(y)))) for x, y in zip(a, b, strict=True))
    return pd.Series([len(x & y) / len(x | y) for x, y in sets], dtype="float64")


@F.pandas_udf(BooleanType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether LEAST marks of two paragraphs are equal."""
    x, y = (np.frombuffer(b"".join(map(bytes, s)), np.uint8).reshape(-1, HASHES) for s in (a, b))
    return pd.Series((x == y).sum(axis=1) >= LEAST)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start and end."""
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return heads, np.append(heads[1:], len(keys))


def gathered(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> list[np.ndarray]:
    """A task's rows as columns, sorted by all of them, the first first."""
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in names] for b in batches if b.num_rows]
    if not parts:
        return []
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.lexsort(columns[::-1])
    return [c[order] for c in columns]


def bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of (code, content): pairs (a, b) of each whole bucket of up to WINDOW + 1; the rows of others as (code, a)."""
    columns = gathered(batches, ("code", "content"))
    if not columns:
        return
    code, content = columns
    heads, ends = runs(code)
    size = ends - heads
    whole = size <= WINDOW + 1
    whole[[0, -1]] = False  # their buckets may go on in the ranges beside
    names = ["code", "a", "b"]
    for d in range(1, WINDOW + 1):
        of = np.flatnonzero(whole & (size > d))
        if not len(of):
            break
        at = np.concatenate([np.arange(h, e - d) for h, e in zip(heads[of], ends[of], strict=True)])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(content[at]), pa.array(content[at + d])], names=names)
    others = np.repeat(~whole, size)
    yield pa.RecordBatch.from_arrays([pa.array(code[others]), pa.array(content[others]), pa.nulls(int(others.sum()), pa.int64())], names=names)


def recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of (cluster, id, place): the rows whose cluster is in two documents, or may be in the ranges beside."""
    columns = gathered(batches, ("cluster", "id", "place"))
    if not columns:
        return
    cluster, key, _ = columns
    heads, ends = runs(cluster)
    kept = key[heads] != key[ends - 1]
    kept[[0, -1]] = True
    rows = np.repeat(kept, ends - heads)
    yield pa.RecordBatch.from_arrays([pa.array(c[rows]) for c in columns], names=["cluster", "id", "place"])


def neighbours(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a partition sorted by code and those of the next bands, each row with the WINDOW rows after it that have its code."""
    rows = [p for p in parts if len(p)]
    if not rows:
        return
    rows = pd.concat(rows)
    code, content = (rows[c].to_numpy() for c in ("c0", "content"))
    for d in range(1, min(WINDOW, len(rows) - 1) + 1):
        same = code[d:] == code[:-d]
        x, y = content[:-d][same], content[d:][same]
        yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def colliding(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of paragraphs that collide in a band, a pair perhaps several times; rows (code, content) of buckets that aren't joined whole. distinct: content, bands.

    The rows of such buckets are sorted by their code, then by the codes of the next TAIL bands: the more bands two have in
    common, the nearer they stand. Ranges of that order are the tasks, so pairs grow with the paragraphs.
    """
    spark = distinct.sparkSession
    n = spread(spark, BANDS * distinct.count(), 400_000)
    rows = distinct.select("content", F.explode("bands").alias("code"))
    met = staged(rows.repartitionByRange(n, "code", "content").mapInArrow(bucket_pairs, "code long, a long, b long"))
    open_ = met.where("code IS NOT NULL").select("code", F.col("a").alias("content"))
    band = F.array_position("bands", F.col("code")) - 1
    after = lambda k: F.get("bands", ((band + k) % BANDS).cast("int")).alias(f"c{k}")
    order = ["c0", *[f"c{k}" for k in range(1, TAIL + 1)], "content"]
    ordered = open_.join(distinct, "content").select("content", F.col("code").alias("c0"), *[after(k) for k in range(1, TAIL + 1)])
    ordered = ordered.repartitionByRange(spread(spark, open_.count(), 100_000), *order).sortWithinPartitions(*order)
    pairs = ordered.select("c0", "content").mapInPandas(neighbours, "a long, b long")
    return met.where("code IS NULL").select("a", "b").unionByName(pairs), open_


def block_links(block: pd.DataFrame) -> pd.DataFrame:
    """Of a block of members and one of queries, links (a, b) between different roots by exact Jaccard similarity; a star for each group linked."""
    ids: dict[bytes, int] = {}
    shingles = [np.unique([ids.setdefault(s, len(ids)) for s in shingles_of(bytes(text))]) for text in block["words"]]
    names, root = np.unique(block["root"].to_numpy(), return_inverse=True)
    query = block["query"].to_numpy()
    members, queries = np.flatnonzero(~query), np.flatnonzero(query)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(members) and len(queries):
        sizes = np.array([len(shingles[m]) for m in members])
        flat, owner = np.concatenate([shingles[m] for m in members]), np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(flat, kind="stable")
        owner, bounds = owner[order], np.searchsorted(flat[order], np.arange(len(ids) + 1))
        for q in queries:
            held = np.concatenate([owner[bounds[t] : bounds[t + 1]] for t in shingles[q]])
            common = np.bincount(held, minlength=len(members))
            met = np.unique(root[members[common / (sizes + len(shingles[q]) - common) >= THRESHOLD]])
            met = met[met != root[q]]
            a.append(np.full(len(met), root[q]))
            b.append(met)
    least = local_roots(len(names), np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(least != np.arange(len(names)))
    return pd.DataFrame({"a": names[least[moved]], "b": names[moved]})


def links_between_clusters(rooted: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of roots whose clusters have similar members in a bucket. rooted: content, root; rows: code, content of the buckets; texts: content, words."""
    rows = staged(rows.join(rooted, "content"))
    held = rows.groupBy("code", "root").agg(F.count(F.lit(1)).alias("k"))
    buckets = held.groupBy("code").agg(F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    buckets = staged(buckets.select("code", "n", F.col("most.root").alias("largest"), blocks(F.col("n")).alias("m"), blocks(F.col("n") - F.col("most.k")).alias("q")))
    members = join_counted(rows, buckets, ["code"], rows.count()).join(texts, "content")
    block = lambda seed, n: F.pmod(F.xxhash64("content", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = members.select("code", "root", "words", F.lit(False).alias("query"), block(1, "m").alias("mb"), every("q").alias("qb"))
    asking = members.where(F.col("root") != F.col("largest")).select("code", "root", "words", F.lit(True).alias("query"), every("m").alias("mb"), block(2, "q").alias("qb"))
    return asked.unionByName(asking).groupBy("code", "mb", "qb").applyInPandas(block_links, "a long, b long")


def texts_of(wanted: DataFrame, distinct: DataFrame, lowered: DataFrame) -> DataFrame:
    """(content, words) of the wanted contents: their bytes, from the one place that distinct names. Texts are shuffled once."""
    at = distinct.join(wanted, "content", "left_semi").groupBy(F.col("at.id").alias("id"), F.col("at.text_hash").alias("text_hash")).agg(F.collect_list(F.struct("content", "at.start", "at.length")).alias("places"))
    bytes_ = F.col("text").cast("binary")
    met = lowered.join(at.hint("shuffle_hash"), ["id", "text_hash"]).select(bytes_.alias("text"), F.explode("places").alias("p"))
    return met.select("p.content", F.substring("text", F.col("p.start") + 1, F.col("p.length")).alias("words")).dropDuplicates(["content"])


def paragraph_clusters(lowered: DataFrame, distinct: DataFrame) -> DataFrame:
    """(content, root) of each content hash; similar paragraphs that collide in a band have one root. distinct: content, bands, marks, at (id, line, text_hash, start, length); lowered: id, text_hash, text."""
    met, open_ = colliding(distinct.select("content", "bands"))
    marks = lambda c, name: distinct.select(F.col("content").alias(c), F.col("marks").alias(name))
    pairs = met.distinct().join(marks("a", "x"), "a").join(marks("b", "y"), "b")
    pairs = staged(pairs.where(alike("x", "y")).select("a", "b"))
    texts = staged(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct(), distinct, lowered))
    both = pairs.join(texts.select(F.col("content").alias("a"), F.col("words").alias("x")), "a").join(texts.select(F.col("content").alias("b"), F.col("words").alias("y")), "b")
    near = connected_components(both.where(jaccard("x", "y") >= THRESHOLD)).select(F.col("node").alias("content"), "root")
    rooted = staged(distinct.select("content").join(near, "content", "left").withColumn("root", F.coalesce("root", "content")))
    mixed_up = staged(several_roots(open_, rooted))
    if not mixed_up.isEmpty():
        members = texts_of(mixed_up.select("content").distinct(), distinct, lowered)
        far = connected_components(links_between_clusters(rooted, mixed_up, staged(members)))
        higher = far.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        rooted = rooted.join(higher, "root", "left").select("content", F.coalesce("higher", "root").alias("root"))
    return rooted


def several_roots(rows: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows (code, content) of buckets whose members have more than one root."""
    with_root = staged(rows.join(rooted, "content"))
    codes = with_root.groupBy("code").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("code", "n")
    return join_counted(with_root, codes, ["code"], with_root.count()).select("code", "content")


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """docs with the id as a long ``_tm_id`` (null for null); for ids that aren't whole numbers, also the table (_tm_id, _tm_name) that numbers them in order."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return docs.withColumn("_tm_id", F.col(id_col).cast("long")), None
    names = docs.select(F.col(id_col).alias("_tm_name")).where("_tm_name IS NOT NULL").distinct().orderBy("_tm_name")
    names = staged(names.withColumn("_tm_id", F.monotonically_increasing_id()))
    return docs.join(names, docs[id_col] == F.col("_tm_name"), "left").drop("_tm_name"), names


def repeats(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(id, text_hash, kind, first_word, place, lines, cluster, keeper, keeper_place, removed): a row for each repeated paragraph or passage of each document. docs: _tm_id and text.

    place is the first line's number of a paragraph, of lines lines, and the first word of a passage; keeper is the document where the cluster is first.
    """
    short_batches(docs.sparkSession)
    lowered = docs.where("_tm_id IS NOT NULL").select(F.col("_tm_id").alias("id"), F.lower(body(text_col)).alias("text")).select("id", F.xxhash64("text").alias("text_hash"), "text")
    found = staged(lowered.select("id", "text_hash", "text").mapInArrow(unit_rows, FOUND))
    paragraphs = found.select("id", "text_hash", F.inline(F.arrays_zip("line", "lines", "first", "start", "length", "content", "bands", "marks")))
    passages = found.select("id", F.inline(F.arrays_zip("cluster", "place")))

    distinct = staged(paragraphs.groupBy("content").agg(F.first("bands").alias("bands"), F.first("marks").alias("marks"), F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "line", "text_hash", "start", "length")).alias("at")))
    counted = staged(distinct.select("content", "n", "at").join(paragraph_clusters(lowered, distinct).withColumnRenamed("root", "cluster"), "content"))
    clusters = counted.groupBy("cluster").agg(F.sum("n").alias("paragraphs"), F.min(F.struct("at.id", "at.line")).alias("at"), F.count(F.lit(1)).alias("n")).where("paragraphs > 1")
    first_at = [F.col("at.id").alias("keeper"), F.col("at.line").alias("keeper_place")]
    repeated = join_counted(counted.select("content", "cluster", F.col("n").alias("rows")), clusters, ["cluster"], counted.count()).select("content", "cluster", F.col("rows").alias("n"), *first_at)
    sums = found.agg(F.coalesce(F.sum(F.size("line")), F.lit(0)), F.coalesce(F.sum(F.size("place")), F.lit(0))).first()
    first = join_counted(paragraphs.select("id", "text_hash", "line", "lines", "first", "content"), staged(repeated), ["content"], sums[0])
    first = first.select("id", "text_hash", F.lit("paragraph").alias("kind"), F.col("first").alias("first_word"), F.col("line").alias("place"), "lines", "cluster", "keeper", "keeper_place")

    n = spread(docs.sparkSession, sums[1], 400_000)
    again = staged(passages.repartitionByRange(n, "cluster", "id").mapInArrow(recurring, "cluster long, id long, place int"))
    twice = staged(again.groupBy("cluster").agg(F.min(F.struct("id", "place")).alias("at"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("at.id < last"))
    second = join_counted(again, twice, ["cluster"], again.count()).select(
        "id", F.lit(None).cast("long").alias("text_hash"), F.lit("passage").alias("kind"), F.col("place").alias("first_word"), "place", F.lit(0).alias("lines"), "cluster", F.col("at.id").alias("keeper"), F.col("at.place").alias("keeper_place")
    )
    both = first.unionByName(second)
    return both.withColumn("removed", (F.col("id") != F.col("keeper")) | (F.col("place") != F.col("keeper_place")))


def repeat_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, component_id, n_paragraphs and n_passages that are removals, n_links (documents that keep what this one repeats) of every document."""
    docs, names = numbered(docs, id_col)
    kinds = [F.count_if(F.col("removed") & (F.col("kind") == kind)).alias(kind) for kind in ("paragraph", "passage")]
    rows = staged(repeats(docs, text_col=text_col).groupBy("id", "keeper").agg(*kinds))
    roots = connected_components(rows, "id", "keeper").select(F.col("node").alias("id"), "root")
    sums = rows.groupBy("id").agg(F.sum("paragraph").alias("n_paragraphs"), F.sum("passage").alias("n_passages"), F.count_if(F.col("keeper") != F.col("id")).alias("n_links"))
    every = docs.select(F.col("_tm_id").alias("id")).distinct()
    out = every.join(sums, "id", "left").join(roots, "id", "left").withColumn("component_id", F.coalesce("root", "id"))
    if names is not None:
        named = lambda c: names.select(F.col("_tm_id").alias(c), F.col("_tm_name").alias(f"_tm_{c}"))
        out = out.join(named("id"), "id", "left").join(named("component_id"), "component_id", "left").drop("id", "component_id").withColumnsRenamed({"_tm_id": "id", "_tm_component_id": "component_id"})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("id", "component_id", zero("n_paragraphs"), zero("n_passages"), zero("n_links"))


@F.pandas_udf(StringType())
def without(text: pd.Series, paragraphs: pd.Series, passages: pd.Series) -> pd.Series:
    """Texts without the given lines (struct of the first's number and how many) and passages (by first word)."""

    def one(t: str, cut_lines: list[dict], cut_words: list[int]) -> str:
        gone = {w for i in cut_words for w in range(i, i + PASSAGE)}
        numbers, cut, out = iter(range(len(t) + 1)), {k for p in cut_lines for k in range(p["place"], p["place"] + p["lines"])}, []
        for k, line in enumerate(t.split("\n")):
            words = [(m.group(), next(numbers)) for m in WORD.finditer(line)]
            if k in cut:
                continue
            out.append(line if not any(n in gone for _, n in words) else " ".join(w for w, n in words if n not in gone))
        return "\n".join(out)

    return pd.Series([None if t is None else one(t, x, y) for t, x, y in zip(text, paragraphs, passages, strict=True)], dtype="object")


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines and passages that are removals; what stays keeps its order and spacing."""
    columns = docs.columns
    docs, _ = numbered(docs, id_col)
    gone = staged(repeats(docs, text_col=text_col).where("removed").select("id", "text_hash", "kind", "place", "lines").distinct())
    kind = "array<struct<place:int,lines:int>>"
    by_text = gone.where("kind = 'paragraph'").groupBy(F.col("id").alias("_tm_id"), F.col("text_hash").alias("_tm_hash")).agg(F.collect_list(F.struct("place", "lines")).alias("_tm_lines"))
    by_id = gone.where("kind = 'passage'").groupBy(F.col("id").alias("_tm_id")).agg(F.collect_list("place").alias("_tm_words"))
    joined = docs.withColumn("_tm_hash", F.xxhash64(F.lower(body(text_col)))).join(by_text, ["_tm_id", "_tm_hash"], "left").join(by_id, ["_tm_id"], "left")
    cut = without(text_col, F.coalesce("_tm_lines", F.array().cast(kind)), F.coalesce("_tm_words", F.array().cast("array<int>")))
    return joined.select(*[F.when(F.col("_tm_lines").isNull() & F.col("_tm_words").isNull(), F.col(c)).otherwise(cut).alias(c) if c == text_col else F.col(c) for c in columns])
