"""The stages on the smallest tables: each keeps the columns, and its decisions take effect."""

import collections
import hashlib
import math
import os
import random
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline
from tidemark.llm import quality, simhash
from tidemark.llm.common import read, staged

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, SF))
        assert docs.columns == columns and docs.count() > 0
        if name == "quality rules":
            kept = {r["doc_id"] for r in quality.judge(before, read(spark, SF, "labels")).where("_tm_kept").collect()}
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == kept
        if name == "near-dedup":
            assert docs.count() == simhash.simhash_components(before).select("component_id").distinct().count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()


WORD = r"[^\x20\x09-\x0D]+"


def brute_lines(docs):
    """Lines on five sites go, but from texts that have no others."""
    norm = lambda line: line.strip(" \t\n\x0b\f\r").lower()
    sites = collections.defaultdict(set)
    for _, text, source in docs:
        for line in (text or "").split("\n"):
            sites[norm(line)].add(source)
    out = []
    for i, text, source in docs:
        stay = [x for x in (text or "").split("\n") if not norm(x) or len(sites[norm(x)]) < 5]
        out.append((i, "\n".join(stay) if text is not None and any(map(norm, stay)) else text, source))
    return out


def brute_near(docs, fingerprint):
    """One document of each group whose fingerprints differ in at most two bits: that of the smallest id."""
    prints, out = [fingerprint(t or "") for _, t, _ in docs], []
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    for r in set(root):
        out.append(min((d for k, d in enumerate(docs) if root[k] == r), key=lambda d: d[0]))
    return out


def brute_mix(docs):
    """How often each document is used."""
    size = {i: len(re.findall(WORD, t or "")) for i, t, _ in docs}
    by = collections.defaultdict(list)
    for i, _, s in docs:
        by[s].append(i)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    own = [sum(size[i] for i in by[s]) for s in names]
    weight, target, open_ = [(5, 2, 1)[k % 3] for k in range(len(names))], {}, set(range(len(names)))
    while open_:
        level = (sum(own) - sum(target.values())) / sum(weight[k] for k in open_)
        full = {k for k in open_ if level * weight[k] > 3 * own[k]}
        target |= {k: 3 * own[k] if full else level * weight[k] for k in full or open_}
        open_ -= full or open_
    uses = collections.Counter()
    for k, s in enumerate(names):
        at = 0
        for i in sorted(by[s], key=lambda i: (hashlib.md5(str(i).encode()).hexdigest()[:15], i)):
            uses[i] += sum(size[i] > 0 and 2 * (at + e * own[k]) + size[i] <= 2 * math.floor(target[k] + 0.5) for e in range(3))
            at += size[i]
    return +uses


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng, words = random.Random(12), [f"wort{k}" for k in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    notice = ["all rights of this page are reserved", "read our terms before use of it"]
    rows = []
    for i in range(150):
        body = [prose(40), prose(30)]
        text = "\n".join(body + notice if i % 4 == 0 else body)
        rows.append((i, text, None if i % 10 == 9 else f"s{i % 7 if i % 3 else 0}"))
    rows += [(200 + i, rows[i % 3][1], f"s{i % 7}") for i in range(40)] + [(300 + i, rows[5][1] + f" ende{i}", "s1") for i in range(5)]
    rows += [(400, None, "s1"), (401, "", "s2"), (402, prose(20), "s3"), (403, "dies und das " * 60, "s4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def passes(text):
        w = re.findall(WORD, text or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(grams)
        return len(w) >= 50 and 2 * len({j for k, g in enumerate(grams) if n[g] > 1 for j in range(k, k + 3)}) <= len(w)

    kept = [r for r in rows if passes(r[1])]
    lined = brute_lines(kept)
    assert sum(a != b for a, b in zip(kept, lined, strict=True)) == 37  # one text with the notice has copies on all sites, so nothing of its own
    near = brute_near(lined, simhash.fingerprint)
    assert len(near) < len(lined) - 30
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert collections.Counter(out[out["piece"] == 0]["doc_id"].tolist()) == brute_mix(near)
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048


def test_stages_on_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
