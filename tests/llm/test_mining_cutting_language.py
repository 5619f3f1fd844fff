"""Hard negatives, fill-in-middle and language identification against brute-force versions and on hard rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark.llm import fill_in_middle, hard_negatives, language_id
from tidemark.llm.queries import op13_language_id

VECTORS = "vec_id long, label int, embedding array<float>, score string, anchor string, b long"
TEXTS = "doc_id long, text string, lang string, n long, _tm_made_by string"


def wanted(rows, n_positives=5, k=10):
    """(anchor, positive, rank, negative, positive score, negative score) by all pairs."""
    least = {}
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        least[i] = min(least.get(i, row), row)
    out = []
    for a, (mine, va) in least.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(va, v)) for i, (_, v) in least.items() if i != a}
        best = lambda ids: sorted(ids, key=lambda i: (-score[i], i))
        for p in best(i for i in score if least[i][0] == mine)[:n_positives]:
            fits = [i for i in score if least[i][0] != mine and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(best(fits)[:k])]
    return sorted(out)


def mined(spark, rows):
    table = spark.createDataFrame(rows, VECTORS).withColumn("embedding", hard_negatives.quantised("embedding"))
    return sorted(tuple(r) for r in hard_negatives.mine(table, F.col("vec_id") % 100 == 0).collect())


def vector(rng, width=12):
    return [rng.gauss(0, 0.3) for _ in range(width)]


@pytest.mark.parametrize("block, group", [(4096, 4096), (50, 2)])
def test_hard_negatives_as_by_all_pairs(spark, monkeypatch, block, group):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    rng = random.Random(11)
    rows = [(i, rng.randrange(3), vector(rng), "s", "a", 1) for i in range(0, 460)]
    hot = vector(rng)
    rows += [(1000 + i, 1 + i % 2, hot, None, None, None) for i in range(150)]  # ties: a quarter of all rows are one vector
    assert mined(spark, rows) == wanted(rows)


def test_a_task_returns_the_best_of_all_its_blocks(monkeypatch):
    monkeypatch.setattr(hard_negatives, "HEAP", 3)
    bytes_of = lambda kind, *v: np.array(v, kind).tobytes()
    window = {"anchor": bytes_of(int, 0), "key": bytes_of(int, 0), "label": bytes_of(int, 1), "low": bytes_of(float, -np.inf), "high": bytes_of(float, np.inf), "vector": bytes_of(float, 1)}
    blocks = [{"ids": bytes_of(int, b, b + 100), "labels": bytes_of(int, 2, 2), "vectors": bytes_of(float, b % 7, b % 5)} | window for b in range(1, 30)]
    found = pd.concat(hard_negatives.joined(iter(pd.DataFrame([b]) for b in blocks), 1, 2, False))
    assert found[["anchor", "key", "id", "score"]].to_numpy().tolist() == [[0, 0, 6, 6], [0, 0, 13, 6]]


def test_hard_negatives_of_hard_rows(spark):
    rng = random.Random(12)
    nan, inf = float("nan"), float("inf")
    rows = [(i * 25, i % 2, vector(rng), "x", "y", 0) for i in range(40)]
    rows += [(1, None, vector(rng), None, None, None), (2, 0, None, None, None, None), (3, 0, [0.5, None], None, None, None), (4, 0, [nan] * 12, None, None, None), (5, 1, [0.1, inf], None, None, None), (6, 1, [-inf], None, None, None)]
    rows += [(None, 1, vector(rng), None, None, None), (7, 1, [], None, None, None), (8, 1, [0.9, -0.9], None, None, None), (9, 0, [1.0] * 15, None, None, None), rows[3], rows[4], (rows[4][0], 0, vector(rng), None, None, None)]
    rows += [(5000 + i, i % 2, [0.0] * 12, None, None, None) for i in range(4)]
    assert mined(spark, rows) == wanted(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0], None, None, None)]) == []
    with pytest.raises(ValueError):
        mined(spark, [(0, 1, [1e9], None, None, None), (1, 1, [1e9], None, None, None)])


@pytest.mark.parametrize("least", [-1e9, 0.0, 40.0, 400.0, 4000.0])
def test_reaching_finds_all_pairs_at_any_threshold(least):
    rng = np.random.default_rng(5)
    x, q = rng.integers(-40, 40, (300, 21)).astype(float), rng.integers(-40, 40, (17, 21)).astype(float)
    bound = least + rng.integers(0, 3, 17) * 100
    qi, xi, score = hard_negatives.reaching(x, q, bound)
    exact = q @ x.T
    assert sorted(zip(qi.tolist(), xi.tolist(), score.tolist())) == [(i, j, exact[i, j]) for i in range(17) for j in range(300) if exact[i, j] >= bound[i]]


def hard_texts():
    rng = random.Random(3)
    long = "\n".join("wort " * rng.randrange(30) for _ in range(20_000))
    texts = [None, "", "\n", "\n\n\n", "eine Zeile", "eine Zeile\n", "zwei\nZeilen", "mit <P> darin\nx", "x\n<S>\n", "<M>", "Ünï 😀\ncödé\n x\r\ny", long]
    return [(i, t, "en", 1, "r") for i, t in enumerate(texts)] + [(5, texts[5], None, None, None), (None, "ohne\nNummer\n", None, None, None), (None, None, None, None, None)] + [(100 + i, "a\nbb\nccc\ndddd", "de", 2, "r") for i in range(60)]


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_by_hand_and_back(spark):
    rows = hard_texts()
    docs = spark.createDataFrame(rows, TEXTS)
    made = fill_in_middle.restore(fill_in_middle.fill_in_middle(docs))
    assert made.columns[: len(docs.columns)] == docs.columns
    got = made.collect()
    assert len(got) == len(rows) and {r["_tm_form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        want = by_hand(r["doc_id"], r["text"])
        assert tuple(r[f"_tm_{c}"] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) == want
        assert r["_tm_output_sha256"] == hashlib.sha256(want[-1].encode()).hexdigest()
        assert r["_tm_restored"] == (r["text"] or "") and r["_tm_restored_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0
    assert {r["_tm_form"] for r in fill_in_middle.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    half = [r["_tm_form"] for r in fill_in_middle.fill_in_middle(docs.where("doc_id >= 100"), rate=50, spm_rate=0).collect()]
    assert set(half) == {"plain", "psm"}


def test_cutting_splits_pieces():
    p = fill_in_middle.Piece
    table = [p("abcdef", 0, 6), p("XY", 0, 2), p("abcdef", 2, 5)]
    text = "abcdefXYcde"
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            parts = fill_in_middle.cut(table, a, b)
            assert ["".join(fill_in_middle.slices(x)) for x in parts] == [text[:a], text[a:b], text[b:]]


def languages(seed, n):
    """Texts of three invented languages with letters of their own and shared ones."""
    rng, out = random.Random(seed), []
    words = {k: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 7))) for _ in range(200)] for k, a in (("aa", "abcdeßü"), ("bb", "bcdefgé"), ("日", "日本語かな"))}
    for i in range(n):
        lang = sorted(words)[i % 3]
        out.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 40))), lang, None, None))
    return out


def test_language_is_found_and_never_read(spark):
    rows = languages(1, 600)
    hidden = [(i, t, lang if i % 4 else "zz", n, m) for i, t, lang, n, m in rows]  # what is held out has a wrong language
    hidden += [(1000, None, "aa", None, None), (1001, "", "aa", None, None), (1002, "12 3.4 !?", None, None, None), (1003, "q", None, None, None), (None, rows[1][1] * 400, None, None, None), (1, rows[1][1], "aa", None, None)]
    docs = spark.createDataFrame(hidden, TEXTS)
    train = F.coalesce(F.col("doc_id") % 4 != 0, F.lit(False))
    got = language_id.identify(docs, train)
    assert got.columns == [*docs.columns, "_tm_lang_pred", "_tm_score"]
    got = got.collect()
    assert len(got) == len(hidden) and all(0 <= r["_tm_score"] <= 1 for r in got)
    by = {r["doc_id"]: r["_tm_lang_pred"] for r in got}
    right = sum(by[i] == lang for i, _, lang, *_ in rows if i % 4 == 0)
    assert right >= 0.97 * 150 and "zz" not in by.values()
    assert by[1000] == by[1001] == by[1002] == "und" and by[1003] in ("aa", "bb", "日") and by[None] == rows[1][2]
    again = language_id.identify(docs.withColumn("lang", F.when(train, F.col("lang"))), train)
    assert collections.Counter(map(tuple, again.drop("lang").collect())) == collections.Counter(tuple(r[c] for c in r.asDict() if c != "lang") for r in got)


def test_nothing_learned_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "ein Text", None, None, None), (2, None, "de", None, None)], TEXTS)
    assert {(r["_tm_lang_pred"], r["_tm_score"]) for r in language_id.identify(docs, F.lit(True)).collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0), F.lit(True)).count() == 0


def test_filter_holds_all_grams_and_few_others(spark):
    rng, names = random.Random(9), [f"l{k}" for k in range(70)]
    sets = {n: {rng.randrange(1 << 60) for _ in range(rng.randrange(0, 3000))} for n in names}
    table, false = language_id.bloom(spark.createDataFrame([(n, g) for n, s in sets.items() for g in s], "lang string, gram long"), names)
    for k, n in enumerate(names):
        codes = np.array(sorted(sets[n]), np.int64)
        assert not len(codes) or language_id.languages_of(codes, table, len(names))[k] == len(codes)
    other = np.array([rng.randrange(1 << 60, 1 << 62) for _ in range(50_000)], np.int64)
    assert (language_id.languages_of(other, table, len(names)) <= 50_000 * false + 10).all()


def test_grams_are_those_of_lower_cased_letters():
    text = "Äb  c1d\n!"
    clean = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    want = [tuple(map(ord, clean[i : i + 3])) for i in range(len(clean) - 2)]
    assert [(int(c) >> 42, int(c) >> 21 & 0x1FFFFF, int(c) & 0x1FFFFF) for c in language_id.grams(text)] == want
    assert len(language_id.grams("")) == len(language_id.grams(" 1 ")) == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = op13_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert out[0] >= 0.98 and out[1] > 200
