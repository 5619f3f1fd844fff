"""Packing of documents into sequences by a grouping genetic algorithm.

A document's token ids, with an end id, are cut into pieces of at most ``capacity`` tokens; only
the first piece of a long document is shorter. Full pieces are sequences of their own. The others
are dealt out by hash to groups of about ``group_size`` pieces, so that no task grows with the input.
On each group several islands breed solutions: a solution is a grouping of pieces into sequences,
crossover injects well-filled sequences of one parent into the other, takes out the sequences that
then hold a piece twice, and fits the displaced pieces again. After each epoch the islands pass their
best solution on to the next island. A group is searched until it has as few sequences as a lower
bound allows, or all epochs are over; then the best of its islands stands.

A group's last sequence is as a rule half empty. So the emptiest sixteenth of the sequences of each
group goes to a next round, dealt out whole to fewer groups, whose search begins with that grouping
and can only lower its number; and so on until one group is left.

Nulls and ties: a null text is empty and has the end id only; a null id is carried along; rows with
the same id are packed one by one. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, short_batches, spread, staged

CAPACITY, END_ID, GROUP_SIZE = 2048, 0, 3000
#: A search ends before its generations when so many in a row (STALE) have brought nothing.
ISLANDS, EPOCHS, GENERATIONS, STALE, POPULATION = 4, 3, 200, 40, 6
#: Pieces from which a sequence is filled at a time.
SAMPLE = 48
#: Groups of more pieces than this a sequence are fitted by best fit alone, which is quick and has pieces for every gap there.
FEW = 16
#: A group has tokens for so many sequences at least, however short its pieces are.
SEQUENCES = 256
#: Of a group's sequences one in so many, the emptiest, goes to the next round.
OPENED = 16
#: Fixed value: the pattern by which byte-level BPE splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: tiktoken's pattern overflows its stack on a run of white space of a million characters, not on 600,000.
LONG_SPACE = 100_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def has_long_space(text: str) -> bool:
    """Whether a run of white space is longer than LONG_SPACE."""
    return len(text) > LONG_SPACE and any(m.end() - m.start() > LONG_SPACE for m in re.finditer(r"\s+", text))


@lru_cache(maxsize=4)
def encoder(path: str, special: bool = False):
    """A function from text to ids for a byte-level BPE file of the tokenizers library.

    The ids of its merged tokens ascend in order of their merges, so they serve as ranks for
    tiktoken, which gives the same ids several times as fast. The library itself takes the texts that
    tiktoken can't: those with white space so long that its pattern overflows and, if special, those
    with the string of an added token, which then gets that token's id. Otherwise it is ordinary text.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    added, letters = {t["content"] for t in file["added_tokens"]}, byte_letters()
    ranks = {bytes(letters[c] for c in word): i for word, i in file["model"]["vocab"].items() if word not in added}
    fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = not special

    def encode(text: str) -> list[int]:
        if special and any(t in text for t in added) or has_long_space(text):
            return whole.encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


def tokenized(path: str, capacity: int, end_id: int, special: bool = False):
    """Maps (id, text) to a row for each piece. Ids stay in Arrow, so that none changes beside a null."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, special)
        for batch in batches:
            row, out = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                tokens = np.array([*encode(text), end_id], "<u4")
                n = len(tokens)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                row += [k] * (len(cuts) - 1)
                out += [(piece, i, j - i, zlib.crc32(tokens[i:j].tobytes())) for piece, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["id", "piece", "start", "length", "ids_crc32"])

    return pieces


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], free: list[int], capacity: int) -> None:
    """Puts each item, largest first, where the least space stays free. shelf[s] holds the bins with s free; mask has a bit for each s in use."""
    shelf: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, space in enumerate(free):
        shelf[space].append(b)
        mask |= 1 << space
    for item in sorted(items, key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = shelf[space].pop()
            if not shelf[space]:
                mask ^= 1 << space
            bins[b].append(item)
        else:
            space, b = capacity, len(bins)
            bins.append([item])
            free.append(capacity)
        free[b] = space - size
        shelf[free[b]].append(b)
        mask |= 1 << free[b]


def subset(sizes: list[int], items: list[int], at: list[int], room: int) -> list[int]:
    """Which of the places at of items fill the room best, later places first. Bit s of a mask: some of the places before come to s."""
    within, mask, before = (1 << room + 1) - 1, 1, []
    for k in at:
        before.append(mask)
        mask |= mask << sizes[items[k]] & within
        if mask >> room:
            break
    total, picked = mask.bit_length() - 1, []
    for k, seen in zip(reversed(at[: len(before)]), reversed(before), strict=True):
        if not seen >> total & 1:
            picked.append(k)
            total -= sizes[items[k]]
    return picked


def fill(sizes: list[int], items: list[int], bins: list[list[int]], free: list[int], capacity: int, rng: random.Random) -> None:
    """Adds a bin for the largest item that is left, fills it with the best subset of a sample of those that fit, until none does, and goes on."""
    left = sorted(items, key=lambda i: (-sizes[i], i))
    while left:
        held = [left.pop(0)]
        room = capacity - sizes[held[0]]
        while (first := bisect_left(left, -room, key=lambda i: -sizes[i])) < len(left):
            n = len(left) - first
            # A third of the sample are the largest.
            at = range(first, len(left)) if n <= SAMPLE else {*range(first, first + SAMPLE // 3), *(first + int(rng.random() * n) for _ in range(SAMPLE - SAMPLE // 3))}
            for k in subset(sizes, left, sorted(at), room):
                room -= sizes[left[k]]
                held.append(left.pop(k))
        bins.append(held)
        free.append(room)


def fewest(sizes: list[int], capacity: int) -> int:
    """A number of sequences below which no grouping comes: by tokens, by how many pieces above capacity / (k + 1) fit together (k), and beside pieces of more than half a sequence."""
    count = np.bincount(sizes, minlength=capacity + 1)
    n, tokens = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    k = np.arange(1, capacity + 1)
    together = -(-(n[-1] - n[capacity // (k + 1)]) // k)
    # Pieces above capacity - a stand beside none of a or more; those above half a sequence stand alone, with space for the pieces from a to half.
    a, half = np.arange(1, capacity // 2 + 1), capacity // 2
    large = tokens[capacity - a] - tokens[half]
    beside = (n[capacity - a] - n[half]) * capacity - large
    alone = n[-1] - n[half] + np.maximum(0, -(-(tokens[half] - tokens[a - 1] - beside) // capacity))
    return int(max(-(-tokens[-1] // capacity), together.max(initial=0), alone.max(initial=0)))


Solution = tuple[tuple[int, int], list[list[int]], list[int]]


def solution(bins: list[list[int]], free: list[int]) -> Solution:
    """With how good it is: fewer sequences first, then those with the free space in fewest places."""
    return ((-len(free), sum(s * s for s in free)), bins, free)


def seeded(sizes: list[int], number: int, capacity: int, few: bool, rng: random.Random) -> Solution:
    """A first solution. By subsets if few and number isn't 1; else by best fit, after an eighth at random if number is above 1."""
    bins: list[list[int]] = []
    free: list[int] = []
    if few and number != 1:
        fill(sizes, [*range(len(sizes))], bins, free, capacity, rng)
    else:
        lead = set(rng.sample(range(len(sizes)), len(sizes) // 8)) if number > 1 else set()
        best_fit(sizes, [*lead], bins, free, capacity)
        best_fit(sizes, [i for i in range(len(sizes)) if i not in lead], bins, free, capacity)
    return solution(bins, free)


def cross(a: Solution, b: Solution, sizes: list[int], capacity: int, few: bool, rng: random.Random) -> Solution:
    """Injects well-filled bins of b into a; what a thereby loses is fitted again."""
    (_, kept, spaces), (_, others, other_free) = a, b
    filled = sorted(range(len(others)), key=lambda k: (other_free[k], rng.random()))[: max(1, int(len(others) * rng.uniform(0.3, 0.9)))]
    injected = rng.sample(filled, max(1, min(len(filled), int(len(others) * rng.uniform(0.02, 0.3)))))
    taken = {i for k in injected for i in others[k]}
    whole = sorted(((s, k) for k, s in enumerate(spaces) if taken.isdisjoint(kept[k])), reverse=True)
    displaced = [i for x in kept if not taken.isdisjoint(x) for i in x if i not in taken]
    # Some of the emptiest bins are opened as well, so that solutions keep changing.
    opened = rng.randrange(1, 2 + len(whole) // 20)
    displaced += [i for _, k in whole[:opened] for i in kept[k]]
    bins = [list(others[k]) for k in injected] + [list(kept[k]) for _, k in whole[opened:]]
    free = [other_free[k] for k in injected] + [s for s, _ in whole[opened:]]
    if few and rng.random() < 0.7:
        fill(sizes, displaced, bins, free, capacity, rng)
    else:
        best_fit(sizes, displaced, bins, free, capacity)
    return solution(bins, free)


def evolve(sizes: list[int], given: list[list[list[int]]], seed: int, capacity: int) -> list[list[int]]:
    """The best grouping after some generations; given: groupings that came from elsewhere. It ends early at a grouping that none can be better than."""
    rng, least = random.Random(seed), fewest(sizes, capacity)
    few = len(sizes) <= FEW * least
    people = [solution(x, [capacity - sum(sizes[i] for i in y) for y in x]) for x in given]
    while len(people) < POPULATION and all(len(p[1]) > least for p in people):
        people.append(seeded(sizes, len(people), capacity, few, rng))
    people.sort(key=lambda p: p[0], reverse=True)
    stale = 0
    for _ in range(GENERATIONS):
        if len(people[0][1]) <= least or stale == STALE:
            break
        child = cross(*rng.sample(people, 2), sizes, capacity, few, rng)
        stale += 1
        if child[0] > people[-1][0] and all(child[0] != p[0] for p in people):
            people = sorted([*people[:-1], child], key=lambda p: p[0], reverse=True)
            stale = 0
    return people[0][1]


def island(capacity: int, epoch: int):
    """A task's part: the pieces of one group, with the groupings that it had before and that islands sent as columns."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group, number = key
        rows = rows.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        sizes = rows["length"].tolist()
        given = []
        for column in ("own", "sent"):
            if rows[column].notna().all():
                bins: dict[int, list[int]] = {}
                for i, b in enumerate(rows[column].astype("int64")):
                    bins.setdefault(b, []).append(i)
                given.append(list(bins.values()))
        best = evolve(sizes, given, (int(group) * 1009 + int(number) * 31 + epoch) % 2**32, capacity)
        best.sort(key=lambda x: sum(sizes[i] for i in x))
        label, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for b, items in enumerate(best):
            label[items] = b
            place[items] = np.cumsum([0, *(sizes[i] for i in items[:-1])])
        return pd.DataFrame({"group": group, "island": number, "row": rows["row"], "length": rows["length"], "own": label, "place": place, "bins": len(best), "least": fewest(sizes, capacity)})

    return run


def searched(dealt: DataFrame, capacity: int, groups: int, islands: int, epochs: int) -> DataFrame:
    """group, row, length, own, place and bins of the best island; own numbers a group's bins from the emptiest on. dealt: group, row, length and as own the bin that it had before, or null."""
    n = spread(dealt.sparkSession, groups * islands, 4)
    made = "group long, island int, row long, length long, own long, place long, bins long, least long"
    state = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("sent", F.lit(None).cast("long"))
    found = []
    for epoch in range(epochs):
        state = staged(state.repartition(n, "group", "island").groupBy("group", "island").applyInPandas(island(capacity, epoch), made))
        best = state.groupBy("group").agg(F.min(F.col("bins") * islands + F.col("island")).alias("x"), F.first("least").alias("least"))
        best = best.select("group", (F.col("x") % islands).cast("int").alias("island"), (F.floor(F.col("x") / islands) <= F.col("least")).alias("done"))
        last = epoch + 1 == epochs or best.where(~F.col("done")).isEmpty()
        found.append(state.join(best if last else best.where("done"), ["group", "island"]).select("group", "row", "length", "own", "place", "bins"))
        if last:
            break
        state = state.join(best.where(~F.col("done")).select("group"), "group")
        elite = state.select("group", ((F.col("island") + 1) % islands).alias("island"), "row", F.col("own").alias("sent"))
        state = state.select("group", "island", "row", "length", "own").join(elite, ["group", "island", "row"])
    return reduce(DataFrame.unionByName, found)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, group_size: int = GROUP_SIZE, islands: int = ISLANDS, epochs: int = EPOCHS, special: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id and offset of each piece. tokenizer: a path that every executor has; special: strings of its added tokens are those tokens."""
    spark = docs.sparkSession
    short_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    cut = docs.select(F.col(id_col).alias("id"), body(text_col).alias("text")).mapInArrow(tokenized(tokenizer, capacity, end_id, special), f"id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = staged(cut.withColumn("row", F.monotonically_increasing_id()))
    small = pieces.where(F.col("length") < capacity).select("row", "length", F.lit(None).cast("long").alias("own"), F.xxhash64("row").alias("hash"))
    placed, first, most = [], 0, None
    while True:
        n, tokens = small.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        groups = max(1, min(round(n / group_size), tokens // (SEQUENCES * capacity), most or n))
        found = staged(searched(small.select("row", "length", "own", F.pmod("hash", F.lit(groups)).alias("group")), capacity, groups, islands, epochs))
        #: Sequences of a group count up from group * 2^32; groups of later rounds follow on.
        number = F.shiftleft(F.col("group") + first, 32) + F.col("own")
        opens = F.col("own") < F.floor(F.col("bins") / OPENED) if groups > 1 else F.lit(False)
        placed.append(found.where(~opens).select("row", number.alias("number"), "place"))
        if groups == 1:
            break
        small = found.where(opens).select("row", "length", number.alias("own"), F.xxhash64(number).alias("hash"))
        first, most = first + groups, groups // 2
    out = pieces.join(reduce(DataFrame.unionByName, placed), "row", "left")
    #: A full piece is the sequence of its row, below zero.
    number = F.coalesce("number", -F.col("row") - 1)
    return out.select("id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), F.coalesce("place", F.lit(0)).cast("long").alias("offset"))
