"""Each operator against a brute-force version, and on rows that are null, empty, long, repeated or none."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tidemark.llm import html_text, line_dedup, media, mixing, packing, pii, quality, sharding, simhash, substring_dedup
from tidemark.llm.components import connected_components

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string"
WORDS = [f"wort{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def hard_rows() -> list[tuple]:
    long = prose(1, 30_000)
    texts = [None, "", " \t\n", "a", "ein wort zwei", prose(2, 80), prose(2, 80), long, "\n\n", "Ünïcode 😀 <|endoftext|>  two  spaces\n", prose(3, 60) + "\n" + prose(3, 60)]
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", None, "r", "x") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id", None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (1, 1, 0), (5, 1, 0), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")


def test_hard_rows_keep_their_number(spark, hard, none, labels):
    n = len(hard_rows())
    for docs, expected in ((hard, n), (none, 0)):
        assert mixing.curriculum_mix(docs).count() == expected
        assert sharding.assign_shards(docs, shards=("a", "b"), slots=101).count() == expected
        assert line_dedup.dedup_lines(docs).count() == expected
        assert quality.judge(docs, labels).count() == expected
        assert simhash.simhash_components(docs).count() == expected
        assert pii.personal_data(docs).count() == expected
        assert substring_dedup.drop_repeats(docs).count() == expected
        assert substring_dedup.repeat_components(docs).count() == docs.select("doc_id").distinct().count()
        pieces = packing.pack(docs, BPE).toPandas()
        assert (pieces["piece"] == 0).sum() == expected
        mixing.mixed_rows(docs).count()
        simhash.drop_near_copies(docs).count()
    assert quality.judge(hard, labels.limit(0)).where("_tm_rule > 0").count() == 0


def test_mixing_caps_and_spends_everything(spark):
    rows = [(i, prose(i, 5 + i % 50), "en", s, None, None, None) for i, s in enumerate(["a"] * 300 + ["b"] * 5 + ["c"] * 80 + [None] * 3)]
    out = mixing.curriculum_mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    by = out.groupby("target").agg(taken=("taken", "sum"), size=("size", "sum"))
    assert abs(out["taken"].sum() - out["size"].sum()) <= 4 and (out["taken"] <= 3 * out["size"]).all()
    assert (abs(by["taken"] - by.index) <= 1).all() and (by.index <= 3 * by["size"] + 1e-6).all()
    for schedule in mixing.SCHEDULES:
        seg = mixing.segments(schedule)
        literal = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("t", "w", "slope", "before", "after"), p)]) for p in seg])
        got = [r[0] for r in spark.range(11).select(mixing.inverse_integral(F.col("id") / 10, literal)).collect()]
        back = [sum(min(max(t - s[0], 0), 1) * s[1] + s[2] * min(max(t - s[0], 0), 1) ** 2 / 2 for s in seg) for t in got]
        assert np.allclose(back, np.arange(11) / 10)


def test_shards_take_turns(spark):
    names = [f"n{i}" for i in range(7)]
    table = sharding.fill(names, 1009)
    sizes = collections.Counter(table)
    assert set(table) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 0.25 * 1009
    assert [r["shard"] for r in sharding.lookup_table(spark, names, 1009).orderBy("slot").collect()] == [names[i] for i in table]
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


def by_sites(rows, min_sites=5):
    """(id, text) without the lines that are on so many sites; a text that has no others keeps them."""
    sites, norm = collections.defaultdict(set), lambda line: line.strip(" \t\n\x0b\f\r").lower()
    for _, text, _, site, *_ in rows:
        for line in (text or "").split("\n"):
            sites[norm(line)].add(site)
    gone = {x for x, s in sites.items() if x and len(s) >= min_sites}
    out = []
    for k, text, *_ in rows:
        lines = (text or "").split("\n")
        every = all(not norm(x) or norm(x) in gone for x in lines)
        out.append((k, text if text is None or every else "\n".join(x for x in lines if norm(x) not in gone)))
    return out


def test_boilerplate_goes_and_copies_stay(spark):
    foot = "All rights of this page are reserved by us"
    copy = "\n".join(prose(900 + k, 12) for k in range(6))
    notice = "\n".join(prose(950 + k, 8) for k in range(3))
    rows = [(i, f"{prose(i, 12)}\n{foot}\n\n{prose(i + 500, 12)}", None, f"s{i % 9}", None, None, None) for i in range(40)] + [(100 + i, copy, None, f"s{i % 9}", None, None, None) for i in range(60)]
    rows += [(200 + i, f"{prose(i + 700, 40)}\n{notice}", None, f"s{i % 7}", None, None, None) for i in range(14)] + [(300 + i, f"{prose(700, 40)}\n{notice}", None, "s1", None, None, None) for i in range(90)]
    # Pages of six shared lines and a few words of their own; a line of five texts, each on a site; four texts on ten sites each; short lines.
    heavy = "\n".join(prose(970 + k, 10) for k in range(6))
    rows += [(400 + i, f"{heavy}\n{prose(2000 + i, 8)}", None, f"h{i}", None, None, None) for i in range(60)]
    rows += [(500 + i, f"{prose(3000 + i, 30)}\nSeen in five texts", None, f"f{i}", None, None, None) for i in range(5)] + [(510 + i, f"{prose(3100 + i, 30)}\nSeen in four texts only", None, f"f{i}", None, None, None) for i in range(4)]
    rows += [(600 + 10 * i + k, f"{prose(4000 + i, 30)}\nOn ten sites each", None, f"t{k}" if k else None, None, None, None) for i in range(4) for k in range(10)]
    rows += [(700 + i, f"{prose(5000 + i, 30)}\nSubscribe now\n!\n", None, f"u{i}", None, None, None) for i in range(50)] + [(800, None, None, "x", None, None, None), (801, "\n \n", None, None, None, None, None)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert sorted(zip(out["doc_id"], out["text"].where(out["text"].notna(), None)), key=str) == sorted(by_sites(rows), key=str)
    text = out.set_index("doc_id")["text"]
    assert not out["text"].str.contains(f"{foot}|Subscribe|Seen in five|^!$", regex=True, na=False).any()
    assert (text[[i for i in text.index if 100 <= i < 200]] == copy).all() and set(out[out["doc_id"] < 100]["_tm_n_removed"]) == {1}
    assert all(text[400 + i] == prose(2000 + i, 8) for i in range(60)) and text[510].endswith("only")
    assert all(text[600 + 10 * i + k] == f"{prose(4000 + i, 30)}\nOn ten sites each" for i in range(4) for k in range(10))  # copies on ten sites have no line of their own
    few = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), min_words=4).toPandas().set_index("doc_id")["text"]
    assert few[700].endswith("Subscribe now\n!\n") and foot not in few[1]


@pytest.mark.parametrize("sites", [1, 2, 4, 5, 6, 9, 40])
def test_sites_are_counted_whatever_the_sketch_says(spark, sites):
    rows = [(f"s{i}", line, -line, 9) for line in range(400) for i in range(sites)] * 2
    met = spark.createDataFrame(rows, "_tm_site string, _tm_a long, _tm_b long, n long")
    assert line_dedup.boilerplate(met).count() == (400 if sites >= 5 else 0)


def test_statistics_and_rules(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("a b c d# e* f| $g".split()) for _ in range(rng.randrange(0, 60))) + "\n" * rng.randrange(3) + "x y" for _ in range(200)]
    texts += ["x y z " * 4000]
    for r in quality.statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {g for g, n in collections.Counter(grams).items() if n > 1}
        covered = {j for i, g in enumerate(grams) if g in twice for j in (i, i + 1, i + 2)}
        lines = [x for x in r["text"].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r["text"])), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[f"_tm_{c}"] for c in quality.STATS) == want
    shout = lambda t: t.upper().replace(" ", "!! ")
    docs = [(i, shout(prose(i, 90)) if i % 5 == 0 else prose(i, 90).replace(" ", "*** ") if i % 5 == 1 else prose(i, 90)) for i in range(400)]
    known = [(i, int(i % 5 > 1), 0) for i in range(0, 400, 2)]
    judged = quality.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, quality int, toxic int")).toPandas()
    assert (judged["_tm_kept"] == (judged["doc_id"] % 5 > 1)).mean() > 0.98
    assert (judged["_tm_base_failed"] == ((judged["_tm_n_words"] < 50) | (2 * judged["_tm_n_repeat_words"] > judged["_tm_n_words"]))).all()


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_trie_finds_every_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = [b ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, k, replace=False))) for b in base for k in (1, 2, 3)]
    keys = np.unique(np.concatenate([base, np.array(flips, np.uint64), np.arange(64, dtype=np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in keys.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in connected_components(simhash.near_links(frame)).collect()}
    near = [(i, j) for i in range(len(keys)) for j in np.flatnonzero(np.bitwise_count(keys[i + 1 :] ^ keys[i]) <= 2) + i + 1]
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near:
        root[find(i)] = find(j)
    groups = collections.defaultdict(set)
    for i, k in enumerate(keys.view(np.int64).tolist()):
        groups[find(i)].add(k)
    for g in groups.values():
        assert {got.get(k, k) for k in g} == {min(g)}


def test_fingerprints_match_brute_force():
    for text in ["", "Ein Wort", "A b C d e", prose(5, 200), "Ä " * 50, " \n x"]:
        assert simhash.fingerprint(text) == brute_print(text)


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(None, 3), (7, 7)], "a long, b long")
    assert {r["root"] for r in connected_components(links).collect()} == {0}


def test_passages_and_paragraphs_are_found(spark):
    passage, paragraph = prose(70, 52), prose(71, 60)
    words = paragraph.split()
    words[30] = "anders"
    docs = [(1, f"{prose(1, 33)} {passage} {prose(2, 21)}"), (2, f"{prose(3, 8)} {passage}"), (3, f"{prose(4, 40)}\n{paragraph}"), (4, f"{' '.join(words)}\n{prose(5, 30)}"), (5, prose(6, 300)), (6, prose(7, 49))]
    out = {r["id"]: r for r in substring_dedup.repeat_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[2]["component_id"] == 1 and out[4]["component_id"] == 3
    assert all(out[i]["component_id"] == i and out[i]["n_links"] == 0 for i in (1, 3, 5, 6))
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept[1] == docs[0][1] and kept[4] == prose(5, 30) and len(kept[2].split()) < 30 and kept[5] == docs[4][1]


def test_bands_recall():
    bands, rows = substring_dedup.BANDS, substring_dedup.ROWS
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def clusters_of(spark, texts: list[str]) -> list[int]:
    """The root of each text, one paragraph each."""
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lowered = docs.select("id", F.xxhash64("text").alias("text_hash"), "text")
    found = lowered.mapInArrow(substring_dedup.unit_rows, substring_dedup.FOUND)
    rows = found.select("id", "text_hash", F.inline(F.arrays_zip("line", "start", "length", "content", "bands", "marks")))
    distinct = rows.groupBy("content").agg(F.first("bands").alias("bands"), F.first("marks").alias("marks"), F.min(F.struct("id", "line", "text_hash", "start", "length")).alias("at")).cache()
    root = {r["content"]: r["root"] for r in substring_dedup.paragraph_clusters(lowered, distinct).collect()}
    return [root[substring_dedup.xxhash.xxh64_intdigest(" ".join(t.split()).encode(), 42) - (1 << 64) * (substring_dedup.xxhash.xxh64_intdigest(" ".join(t.split()).encode(), 42) >> 63)] for t in texts]


def changed(base: list[str], rng: random.Random, least: int, most: int) -> str:
    words = list(base)
    for _ in range(rng.randrange(least, most)):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def near_pairs(texts: list[str]) -> list[tuple[int, int]]:
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    return [(i, j) for i in range(len(texts)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]


def test_large_group_of_near_copies_keeps_its_links(spark):
    rng, base = random.Random(11), prose(80, 120).split()
    texts = [changed(base, rng, 1, 4) for _ in range(400)] + [prose(1000 + k, 60) for k in range(50)]
    near, of = near_pairs(texts), clusters_of(spark, texts)
    assert len(near) > 3000 and sum(of[i] != of[j] for i, j in near) == 0
    assert all(of.count(x) == 1 for x in of[400:])


@pytest.mark.parametrize("window", [1, 16])
def test_clusters_are_components_of_similar_pairs(spark, monkeypatch, window):
    """Also with hardly any neighbours joined and small blocks."""
    monkeypatch.setattr(substring_dedup, "WINDOW", window)
    monkeypatch.setattr(substring_dedup, "BLOCK", 8)
    rng, base = random.Random(5), prose(81, 60).split()
    texts = [changed(base, rng, 1, 6) for _ in range(200)]
    want = list(range(200))
    for _ in range(200):
        for i, j in near_pairs(texts):
            want[i] = want[j] = min(want[i], want[j])
    of = clusters_of(spark, texts)
    assert len(set(want)) > 20 and len(set(zip(of, want))) == len(set(of)) == len(set(want))


def test_units_match_brute_force():
    rng = random.Random(17)
    line = lambda n: rng.choice([" ", "  ", "\t"]).join(rng.choice([*WORDS, "ü" * 300, "😀"]) for _ in range(n))
    texts = ["\n".join(line(rng.choice([0, 1, 3, 7, 19, 20, 45])) for _ in range(rng.randrange(12))) for _ in range(60)] + ["", " \n\t", "a", "a b c", "x y z " * 300]
    data = [t.encode() for t in texts]
    first = np.cumsum([0, *map(len, data)])[:-1]
    paragraphs, passages = substring_dedup.units(np.frombuffer(b"".join(data), np.uint8), first)
    got, keys, at = collections.defaultdict(list), {}, collections.defaultdict(set)
    for k, t in enumerate(paragraphs["text"].tolist()):
        a, n = paragraphs["start"][k], paragraphs["length"][k]
        got[t].append((paragraphs["line"][k], paragraphs["lines"][k], paragraphs["first"][k], data[t][a : a + n].split()))
    for t, place, cluster in zip(*(passages[c].tolist() for c in ("text", "place", "cluster"))):
        words = tuple(data[t].split()[place : place + substring_dedup.PASSAGE])
        assert len(words) == substring_dedup.PASSAGE and keys.setdefault(cluster, words) == words
        at[t].add(place)
    assert len(set(keys.values())) == len(keys)
    for t, raw in enumerate(data):
        lines, runs, word = [x.split() for x in raw.split(b"\n")], [], 0
        for k, w in enumerate(lines):
            if w:
                if len(w) < 20 and runs and not runs[-1][0]:
                    runs[-1][2].extend(w)
                    runs[-1][4] = k
                else:
                    runs.append([len(w) >= 20, k, list(w), word, k])
            word += len(w)
        assert got[t] == [(k, last - k + 1, w0, w) for long, k, w, w0, last in runs if len(w) >= 20 or len(runs) == 1]
        # Wherever 50 words stand, a passage of them is found in its first 16 places.
        assert all(at[t] & set(range(i, i + 16)) for i in range(word - 49))


def test_short_texts_string_ids_and_rows_with_one_id(spark):
    verse = "\n".join(prose(500 + k, 7) for k in range(8))
    rows = [("b", "Drei kurze Worte"), ("a", "drei  kurze worte"), ("c", "vier ganz andere Worte"), ("d", verse), ("e", f"{verse}\n{prose(9, 30)}"), (None, verse), ("f", prose(3, 30)), ("f", prose(4, 30)), ("g", prose(4, 30))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    out = {r["id"]: r for r in substring_dedup.repeat_components(docs).collect()}
    assert {k: r["component_id"] for k, r in out.items()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", "f": "f", "g": "f", None: None}
    kept = [(r["doc_id"], r["text"]) for r in substring_dedup.drop_repeats(docs).collect()]
    assert ("e", prose(9, 30)) in kept and ("f", prose(3, 30)) in kept and ("f", prose(4, 30)) in kept and ("g", "") in kept and ("b", "") in kept


PYTHON = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def test_base_spans_match_python(spark):
    rng = random.Random(8)
    pieces = ["a@b.c_d@e.f", "x.y+z@mail-1.example.com.", "@no", "1.2.3.4.5.6.7.8", "256.1.1.1", "010.000.1.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (310) 555-4510", "+49..12--3456789 ", "😀", "ü", " ", "-", "7" * 30, "+1 2", "..", "a_", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(600)] + ["5" * 20_000, "a" * 20_000 + "@", "1.2.3.4 " * 500]
    spans = {r["id"]: r["s"] for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("id", pii.text_of(F.col("base")).alias("s")).collect()}
    for i, t in enumerate(texts):
        found = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PYTHON.items()) for m in re.finditer(p, t) if passes(kind, m[0]))
        assert spans[i] == ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found), t[:200]


def test_secrets_are_learned(spark):
    rng = random.Random(2)
    texts = [prose(i, 20) + (f' token = "{rng.randbytes(20).hex()}" ' if i % 3 == 0 else f" {'donaudampfschifffahrt' + str(i)} ") + prose(i, 5) for i in range(150)]
    out = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("id", pii.text_of(F.col("spans")).alias("s")).collect()
    assert all(("secret" in r["s"]) == (r["id"] % 3 == 0) for r in out)


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(BPE)
    bpe.encode_special_tokens = True
    texts = [prose(i, random.Random(i).randrange(1, 900)) for i in range(150)] + [prose(1, 9000), "", "a  b \n c d", "it's 12 ok<|endoftext|>", None, "😀\n\n\tx"]
    out = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BPE).toPandas()
    for key, rows in out.groupby("id"):
        ids, at = np.array([*bpe.encode(texts[key] or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in rows.sort_values("piece").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and (r.piece == 0 or r.length == 2048)
            at += r.length
        assert at == len(ids)
    for _, rows in out.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]] and rows["length"].sum() <= 2048
    assert out["sequence_id"].nunique() <= math.ceil(out["length"].sum() / 2048) + 1


def fewest_bins(sizes: list[int], capacity: int) -> int:
    """By trying all groupings."""
    least = len(sizes)

    def go(k: int, free: list[int]) -> None:
        nonlocal least
        if k == len(sizes) or len(free) >= least:
            least = min(least, len(free))
            return
        for b, space in enumerate(free):
            if space >= sizes[k]:
                go(k + 1, [*free[:b], space - sizes[k], *free[b + 1 :]])
        go(k + 1, [*free, capacity - sizes[k]])

    go(0, [])
    return least


def test_packing_bound_is_one():
    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.randrange(2, 30)
        sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(8))), reverse=True)
        best, found = fewest_bins(sizes, capacity), packing.evolve(sizes, [], 1, capacity)
        assert packing.fewest(sizes, capacity) <= best <= len(found) <= best + 1 and sorted(i for x in found for i in x) == [*range(len(sizes))]
    assert [packing.fewest([s] * 3000, 2048) for s in (330, 700, 1100, 2047)] == [500, 1500, 3000, 3000]


def test_packing_search_goes_beyond_best_fit():
    rng = random.Random(3)
    pairs = [(a, rng.randrange(520, (2048 - a) // 2 + 1)) for a in (rng.randrange(780, 1000) for _ in range(300))]
    threes = sorted((x for a, b in pairs for x in (a, b, 2048 - a - b)), reverse=True)
    alike = sorted([330] * 200 + [rng.randrange(180, 500) for _ in range(1800)] + [rng.randrange(2, 1500) for _ in range(600)], reverse=True)
    for sizes, few in ((threes, 302), (alike, packing.fewest(alike, 2048))):
        bins, free = [], []
        packing.best_fit(sizes, [*range(len(sizes))], bins, free, 2048)
        found = packing.evolve(sizes, [], 1, 2048)
        assert len(found) <= few < len(bins) and sorted(i for x in found for i in x) == [*range(len(sizes))]
        assert all(sum(sizes[i] for i in x) <= 2048 for x in found)


def test_packing_islands_keep_what_they_are_given(spark):
    rng = random.Random(4)
    sizes = [rng.randrange(400, 800) for _ in range(400)]
    rows = [(i % 2, i, s, None) for i, s in enumerate(sizes)]
    dealt = spark.createDataFrame(rows, "group long, row long, length long, own long")
    for epochs in (1, 2):
        found = packing.searched(dealt, 2048, 2, 3, epochs).toPandas()
        assert sorted(found["row"]) == [*range(400)]
        for _, x in found.sort_values("place").groupby(["group", "own"]):
            assert x["length"].sum() <= 2048 and x["place"].tolist() == [0, *x["length"].cumsum().tolist()[:-1]]
        free = found.groupby(["group", "own"])["length"].sum()
        assert all(x.is_monotonic_increasing and len(x) == found[found["group"] == g]["bins"].iloc[0] for g, x in free.groupby("group"))
        before, dealt = found.groupby("group")["bins"].first(), spark.createDataFrame(found[["group", "row", "length", "own"]])
    again = packing.searched(dealt, 2048, 2, 1, 1).toPandas().groupby("group")["bins"].first()
    assert (again <= before).all()


def test_packing_groups_share_their_rests(spark):
    texts = [prose(i, random.Random(i).randrange(1, 12)) for i in range(6000)]
    out = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BPE, capacity=128, group_size=300).toPandas()
    assert out["sequence_id"].nunique() == math.ceil(out["length"].sum() / 128)
    for _, rows in out.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]] and rows["length"].sum() <= 128
    many = packing.pack(spark.createDataFrame([(i, "") for i in range(9000)], "doc_id long, text string"), BPE, capacity=8, group_size=30)
    assert many.select("sequence_id").distinct().count() == 1125 and many.count() == 9000


def test_packing_query_has_as_few_sequences_as_there_can_be(spark):
    from tidemark.llm import queries

    n, tokens = queries.op8_packing(spark, "/root/testdata/sf0.1").agg(F.countDistinct("sequence_id"), F.sum("length")).first()
    assert n == math.ceil(tokens / 2048)


def test_media_round_trip_and_alignment(spark):
    for payload in (b"", b"x", b"y" * 576, bytes(range(256)) * 9):
        assert media.from_png(media.to_png(media.padded(payload))) == media.padded(payload) and len(media.padded(payload)) % 576 == 0 and media.padded(payload)
    with pytest.raises(ValueError):
        media.from_png(b"no png")
    digest = hashlib.sha256(b"one").hexdigest()
    page = f'<head><title>t</title></head><p>Before &amp; now<figure><img src="sha256:{digest}" alt="alt"><figcaption>Cap  one</figcaption></figure><p>after<img src="x.png" alt="other"><script>no</script>'
    seqs = media.sequences(spark.createDataFrame([(1, page), (2, None), (3, "")], "k long, html string"), id_col="k", html_col="html")
    known = media.describe(media.store(spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"one"),)], "payload binary")))
    rows = {(r["id"], r["position"]): r for r in media.resolve(seqs, known).collect()}
    shown = spark.createDataFrame([(1, "one & <b>\n\nthree"), (2, "")], "k long, t string").select("k", media.illustrated("t", F.lit(digest)).alias("html"))
    parts = {(r["id"], r["position"]): (r["text"], r["digest"], r["caption"]) for r in media.resolve(media.sequences(shown, id_col="k", html_col="html"), known).collect()}
    assert parts == {(1, 0): ("one & <b>", None, None), (1, 1): (None, digest, "one & <b>"), (1, 2): ("three", None, None), (2, 0): (None, digest, None)}
    assert [rows[1, k]["kind"] for k in range(4)] == ["text", "media", "text", "media"]
    assert rows[1, 0]["text"] == "Before & now" and rows[1, 1]["caption"] == "Cap one" and rows[1, 1]["n_bytes"] == 3 and rows[1, 3]["n_bytes"] is None and rows[1, 3]["caption"] == "other"
    assert known.count() == 1


def test_pages(spark, monkeypatch):
    article = "<nav><p>Menu</p></nav><div class='ad'>Buy<div>x</div></div><article><h1>T &amp; t</h1><p><b>one\n two<br><p>three<aside>no</aside><div class='comments'><p>hi</p></div></article><footer>f</footer>"
    plain = lambda k: f"<div>Site title</div><p>Own text {k}</p><form><p>Login</p></form><p>About us</p><script>var a='</p>'</script>"
    rows = [(1, "http://a.x/en/1", article), (2, "http://b.x/1", plain(1)), (3, "http://b.x/12", plain(2)), (4, None, None), (5, "http://c.x/", "<p>alone"), (6, "http://c.x/", "<p>alone"), (7, "bad", "a &lt; b <!-- c --> d")]
    out = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == "T & t\n\none two\n\nthree" and out[2] == "Own text 1" and out[3] == "Own text 2" and out[4] == "" and out[5] == out[6] == "alone" and out[7] == "a < b d"
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        for small in (1 << 22, 2):
            monkeypatch.setattr(html_text, "SMALL", small)
            found = sorted(html_text.common_lines(a, b))
            assert len(found) == table[-1][-1]
            rest = iter(b)
            assert all(any(a[i] == y for y in rest) for i in found)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>a<img class="social-icon">b<input class="search"><hr class="widget"><p>c</article>', ["ab", "c"]),
        ("<head><meta charset='x'><title>t</title><article><p>a</article>", ["a"]),
        ("<head><title>t<body><article><p>a</article>", ["a"]),
        ("<body><nav><ul><li>Menu</ul><article><p>a<p>b</article>", ["a", "b"]),
        ("<div><form>Login<input></div><article><p>a</article></form>", ["a"]),
        ("<article><select><option>o<p>a</p></article>", ["a"]),
        ('<article><h2 id="related-work">a</h2><p id="search-methods">b</p><section class="social-history"><p>c</section><div class="share">no</div></article>', ["a", "b", "c"]),
        ('<article><div class="ad">no<div><p>no</div>no</div><ul><li class="ad">no<li>a</ul><p class=ad>no<p>b<p data-id="ad">c</article>', ["a", "b", "c"]),
        ('<body><div class="menu">no</div><div role="main"><p>a</p><div>b</div></div><div>no</div>', ["a", "b"]),
        ('<article><p>a <span class="share">b</span> c</p><span class="share">no</span></article>', ["a b c"]),
        ("<article><p title=it's>a</p><p title='x>y' class=\"it's\">b</article>", ["a", "b"]),
        ("<article><nav/><p>a<nav class=x/>no</nav>b</article>", ["a", "b"]),
    ],
)
def test_frame_ends_with_its_element(page, text):
    assert html_text.main_text(html_text.lines_of(page))[0].split("\n\n") == text


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    default = Tokenizer.from_file(BPE)
    for text in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>\n", "a" + " " * 1_000_000 + "b", "\t\n" * 500_000, "a  b " * 30_000):
        want = default.encode(text, add_special_tokens=False).ids
        assert packing.encoder(BPE, special=True)(text) == want
        if "<|" not in text:
            assert packing.encoder(BPE)(text) == want
    assert packing.encoder(BPE, special=True)("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_packing_query_uses_added_tokens(spark, tmp_path):
    from tidemark.llm import queries

    spark.createDataFrame([(1, "a <|endoftext|> b"), (2, " " * 1_000_000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lengths = queries.op8_packing(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in lengths} == {1: 5, 2: 1_000_001}


@pytest.mark.parametrize("shared", [0, 6, 20, 33, 50, 60])
def test_passages_are_what_repeats(spark, shared):
    """Pairs of texts that share so many words in a row: below 34 nothing is linked and nothing lost, from 50 on the pair is linked and only shared words go."""
    docs, common = [], {}
    for k in range(30):
        middle = [f"c{k}x{j}" for j in range(shared)]
        for half in (0, 1):
            own = [f"d{k}y{half}z{j}" for j in range(140)]
            at = 10 + 3 * k
            docs.append((2 * k + half, " ".join([*own[:at], *middle, *own[at:]])))
        common[k] = set(middle)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["id"]: r for r in substring_dedup.repeat_components(table).collect()}
    kept = {r["doc_id"]: r["text"].split() for r in substring_dedup.drop_repeats(table).collect()}
    for i, text in docs:
        words = text.split()
        assert out[i]["component_id"] == (i if shared < 34 else i - i % 2) and (out[i]["n_passages"] > 0) == (shared >= 50 and i % 2 == 1)
        assert [w for w in words if w not in common[i // 2]] == [w for w in kept[i] if w not in common[i // 2]]
        assert i % 2 == 1 or kept[i] == words
        if i % 2 and shared >= 50:
            assert len(kept[i]) <= len(words) - 34


def test_many_documents_of_one_short_line_are_no_repeat(spark):
    line = " ".join(f"w{j}" for j in range(15))
    docs = [(k, "\n".join([" ".join(f"a{k}b{j}" for j in range(60)), line, " ".join(f"e{k}f{j}" for j in range(60))])) for k in range(20)]
    out = substring_dedup.repeat_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["id"] and r["n_passages"] == 0 for r in out)


def test_shared_lines_inside_articles_go(spark):
    notice, story = "We have moved to a new house", prose(60, 40)
    page = lambda k, text: f"<article><div>Start<ul><li>Archive</ul></div><p>{text}</p><p>Line of {k}</p><p>{notice}</p></article><article class='comment'><p>Me too</p></article>"
    own = {k: prose(k, 40) for k in (1, 2, 3)}
    # Page 4 is page 2 under another address; 5 and 6 are versions of one story on a host of their own; 7 and 8 have one neighbour.
    rows = [(k, f"http://a.x/{k}", page(k, t)) for k, t in own.items()] + [(4, "http://a.x/22", page(2, own[2]))]
    rows += [(5, "http://b.x/1", page(5, story)), (6, "http://b.x/2", page(6, story)), (7, "http://c.x/1", page(7, own[1])), (8, "http://c.x/2", page(8, own[2]))]
    out = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # What isn't marked as text goes, paragraphs stay however short and whoever has them.
    assert out[4] == out[2]
    assert [out[k] for k in (1, 2, 3, 7, 8)] == [f"{own[t]}\n\nLine of {k}\n\n{notice}" for k, t in ((1, 1), (2, 2), (3, 3), (7, 1), (8, 2))]
    yes = [(k, f"http://e.x/{k}", f"<article><p>{prose(k, 25)}</p><p>Yes.</p><ul><li>Older</ul></article>") for k in range(3)]
    for r in html_text.extract_text(spark.createDataFrame(yes, "page_id long, url string, html string")).collect():
        assert r["text"] == f"{prose(r['page_id'], 25)}\n\nYes."
    assert [out[k] for k in (5, 6)] == [f"Start\n\nArchive\n\n{story}\n\nLine of {k}\n\n{notice}" for k in (5, 6)]
    short = lambda k: f"<article><h1>One title</h1><p>One short text</p><p>Line of {k}</p></article>"
    rows = [(k, f"http://d.x/{k}", short(k)) for k in range(3)]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"One title\n\nOne short text\n\nLine of {r['page_id']}" for r in out)


def brute_pages(rows):
    """Every page against the nearest ones before and after it, on its host, whose lines differ."""
    parts = []
    for key, url, page in rows:
        m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", url or "")
        parts.append(((m[1].lower(), m[2]) if m else ("", ""), "-" if key is None else f"+{key}", html_text.lines_of(page or ""), page or "", (key, url)))
    parts.sort(key=lambda p: (p[0], p[1]))
    out = collections.Counter()
    for k, ((host, path), _, own, _, row) in enumerate(parts):
        before = next((p for p in parts[:k][::-1] if p[2] != own or p[0][0] != host), None)
        after = next((p for p in parts[k + 1 :] if p[2] != own or p[0][0] != host), None)
        near = [p for p in (before, after) if p and host and p[0][0] == host]
        near.sort(key=lambda p: -len(os.path.commonprefix([p[0][1], path])))
        out[(*row, *html_text.main_text(own, *[p[2] for p in near]))] += 1
    return out


def test_extraction_matches_brute_force_however_rows_are_dealt(spark):
    rng = random.Random(23)
    lines = [prose(2000 + k, 3 + k % 9) for k in range(12)]
    rows = []
    for k in range(160):
        page = "".join(f"<{t}>{rng.choice(lines)}</{t.split()[0]}>" for t in rng.choices(["p", "div", "nav", "li", "h2", 'div class="ad"'], k=rng.randrange(7)))
        page = page if k % 3 else f"<header>{lines[0]}</header><article>{page}</article>"
        rows.append((2**53 + 1 + k, f"http://{rng.choice('ab')}.x/{rng.choice('pq')}/{k // 4}", page))
    same = "<p>same</p>" + rows[0][2]
    rows += [(1000 + k, f"http://a.x/p/{k}/{k}", same) for k in range(30)] + [(None, "http://a.x/p/7", None), (7, None, "<p>x"), (8, "bad", "")]
    want = brute_pages(rows)
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    for per_task in (5, 40, 20_000):
        got = html_text.extract_text(docs.repartition(per_task % 7 + 1), per_task=per_task).collect()
        assert collections.Counter(map(tuple, got)) == want


def test_pages_without_rows_and_with_long_ones(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string, host string")
    assert html_text.extract_text(empty).count() == 0
    shared = "".join(f"<div>{k % 1000} line</div>" for k in range(50_000))
    rows = [(k, f"http://l.x/{k}", f"<div>own {k}</div>{shared}<p>tail {k}</p>", "x", "y") for k in range(2)]
    out = html_text.extract_text(spark.createDataFrame(rows, empty.schema)).collect()
    assert {r["text"] for r in out} == {f"own {k}\n\ntail {k}" for k in range(2)}


def test_clashing_names_and_rows_with_one_id(spark, labels):
    rows = [(1, prose(1, 60), "n", "k", "r", 5), (1, prose(2, 60), "n", "k", "r", 6), (2, prose(1, 60), None, None, None, None), (None, prose(3, 60), None, None, None, None), (None, prose(3, 60), None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept string, rule string, words long")
    assert quality.kept_rows(docs, labels).count() == 5 and quality.kept_rows(docs, labels).columns == docs.columns
    for _ in range(2):
        assert {(r["doc_id"], r["text"]) for r in simhash.drop_near_copies(docs).collect()} == {(1, prose(1, 60)), (1, prose(2, 60)), (None, prose(3, 60))}
    assert simhash.drop_near_copies(docs).count() == 3


def test_ids_beside_nulls_stay_exact(spark):
    docs = spark.createDataFrame([(2**53 + 1, "<p>a", "u"), (None, "<p>b", "u")], "doc_id long, text string, url string")
    assert {r["id"] for r in packing.pack(docs, BPE).collect()} == {2**53 + 1, None}
    assert {r["id"] for r in media.sequences(docs, id_col="doc_id", html_col="text").collect()} == {2**53 + 1, None}


def test_announced_secrets_and_many_spans(spark):
    rng = random.Random(6)
    kinds = [lambda: f' password: "{rng.choice("abcdefgh")}x{rng.randrange(1000, 9999)}!q" ', lambda: f" api_key={rng.randbytes(9).hex()}/+{rng.randrange(99)}== ", lambda: f' note: "{prose(rng.randrange(999), 2)}" ', lambda: f" {prose(rng.randrange(999), 3)} "]
    texts = [prose(i, 20) + kinds[i % 4]() + prose(i, 5) for i in range(200)] + [" ".join(f"a{k}@b{k}.example.com" for k in range(20_000)), 'token = "a.b@c.example.com"']
    out = {r["id"]: r["s"] for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("id", pii.text_of(F.col("spans")).alias("s")).collect()}
    assert all(("secret" in out[i]) == (i % 4 < 2) for i in range(200))
    assert out[200].count("email") == 20_000 and out[201] == "email:9:26"
