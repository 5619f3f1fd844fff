"""Personal data by weak supervision.

Base spans are matches of fixed patterns that pass their check (ranges, Luhn, digit counts). For
other secrets, long tokens and what an announcing word with = or : names are candidates on which labelers vote: regular expressions, a gazetteer
of words that announce secrets, and the context around the token. Expectation-maximisation over the
counts of vote patterns (at most 3^6 rows, whatever the corpus) estimates how reliable each labeler
is and how likely each pattern means a secret. With these soft labels a span classifier, naive Bayes
over the token's shape, is trained on all candidates; it decides which are spans.

Everything over the corpus is DataFrame functions. Texts are scanned once; what is found is written
to the shared folder without the texts.

Positions count code points, ends are exclusive. Nulls and ties: a null text is empty; spans of
different kinds may overlap, but an added one never overlaps a base span; equal texts get equal
spans; without candidates, or with all votes abstaining, nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, staged

#: The kinds in order. Possessive forms match what the greedy ones do, without backtracking;
#: a start inside a run of its first class is only tried where the match before ended (\G).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to match at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
ADDED = "secret"
#: Gazetteer: words that announce a secret, in the corpus's languages.
ANNOUNCING = "token secret password passwd pwd apikey api_key key auth bearer credential clave contraseña jeton passe schlüssel kennwort passwort".split()
#: Long tokens, and whatever stands after an announcing word with = or :, from that sign on.
CANDIDATE = rf"""(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{{16,}}+|[=:](?<=(?i:{'|'.join(ANNOUNCING)})["']?\x20?[=:])\x20{{0,2}}["']?[^\s"'<>]{{6,}}+"""
SIGN = """^[=:]\\x20{0,2}["']?"""
CONTEXT, PART = 24, 256
SPAN = "array<struct<s:int,k:int,e:int>>"
CANDIDATES = "struct<s:int,e:int,token:string,before:string,after:string>"


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    one = lambda i: F.substring(turned, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda n, i: n + F.when(i % 2 == 1, one(i)).otherwise(2 * one(i) - F.when(one(i) > 4, 9).otherwise(0)))
    return total % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, hint: str | None = None) -> tuple[Column, Column]:
    """The matches, and the pieces of text around them (one more)."""
    there = text.rlike(hint) if hint else F.lit(True)
    none = F.array().cast("array<string>")
    return F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(there, F.split(text, pattern, -1)).otherwise(none)


def running(values: Column, step, zero: int) -> Column:
    """For each element of an array of ints, step (a function of two) over all before it, from zero on. Works in parts of PART, as appending copies an array."""
    none = F.array().cast("array<int>")

    def fold(part: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), none.alias("out"))
        return F.aggregate(part, first, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / PART).cast("int")), lambda k: F.slice(values, k * PART + 1, F.lit(PART)))
    first = F.struct(F.lit(zero).alias("at"), F.array().cast("array<array<int>>").alias("out"))

    def one(a: Column, part: Column) -> Column:
        # An array of one, so that the fold is worked out once.
        done = F.transform(F.array(fold(part, a["at"])), lambda f: F.struct(f["at"].alias("at"), F.array_append(a["out"], f["out"]).alias("out")))
        return F.element_at(done, 1)

    return F.when(F.size(values) > 0, F.flatten(F.aggregate(parts, first, one)["out"])).otherwise(none)


def starts(hits: str, gaps: str) -> Column:
    """Where each match starts: the lengths of what stands before it, added up."""
    ahead = running(F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.length(h) + F.length(g)), lambda a, x: a + x, 0)
    return F.zip_with(ahead, F.slice(gaps, F.lit(1), F.size(hits)), lambda a, g: a + F.length(g))


def checked(k: int, kind: str):
    """From a match and its number to its span, null if it fails its check."""

    def span(hit: Column, i: Column) -> Column:
        start = F.get(f"s_{kind}", i)
        return F.when(passes(kind, hit), F.struct(start.alias("s"), F.lit(k).alias("k"), (start + F.length(hit)).alias("e")))

    return span


def found(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """id, base (SPAN, sorted) and candidates (position, token, text before and after), in one scan."""
    d = docs.select(F.col(id_col).alias("id"), body(text_col).alias("t"))
    for kind, pattern in PATTERNS.items():
        hits, gaps = matches(F.col("t"), pattern, HINTS[kind])
        d = d.withColumns({f"h_{kind}": hits, f"g_{kind}": gaps})
    hits, gaps = matches(F.col("t"), CANDIDATE)
    d = d.withColumns({"h_c": hits, "g_c": gaps}).drop("t")
    d = d.withColumns({f"s_{kind}": starts(f"h_{kind}", f"g_{kind}") for kind in [*PATTERNS, "c"]})
    base = []
    for k, kind in enumerate(PATTERNS):
        base.append(F.array_compact(F.transform(f"h_{kind}", checked(k, kind))).cast(SPAN))
    def candidate(h: Column, i: Column) -> Column:
        sign = F.regexp_extract(h, SIGN, 0)
        token = F.regexp_replace(F.substr(h, F.length(sign) + 1), "[.,;:!?)]+$", "")
        start = F.get("s_c", i) + F.length(sign)
        before = F.right(F.concat(F.get("g_c", i), sign), F.lit(CONTEXT))
        return F.struct(start.alias("s"), (start + F.length(token)).alias("e"), token.alias("token"), before.alias("before"), F.left(F.get("g_c", i + 1), F.lit(2)).alias("after"))

    candidates = F.filter(F.transform("h_c", candidate), lambda c: F.length(c["token"]) >= 6)
    # A generator of one row, so that nothing above repeats what makes these.
    row = F.struct(F.sort_array(F.concat(*base)).alias("base"), candidates.alias("candidates"))
    return d.select("id", F.inline(F.array(row)).alias("base", "candidates"))


def letters(token: Column, wanted: str) -> Column:
    return F.length(F.regexp_replace(token, f"[^{wanted}]", ""))


def votes(c: Column) -> Column:
    """One of -1, 0 and 1 from each labeler, as an array."""
    token, before, n = c["token"], c["before"], F.length(c["token"])
    share = letters(token, "0-9") / n
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    return F.array(
        vote(token.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[A-Z0-9]{20})$"), token.rlike("^(?:[0-9-]+|[A-Za-z_-]+)$")),
        vote(F.lower(before).rlike(rf"(?:{'|'.join(ANNOUNCING)})[^\p{{L}}0-9]{{0,6}}$"), F.lit(False)),
        vote(before.rlike("""[=:]\\s*["']?$"""), before.rlike("[\\p{L}.,]\\s$")),
        vote(share.between(0.15, 0.85), (share < 0.05) | (share > 0.95)),
        vote(F.size(F.array_distinct(F.split(token, ""))) >= 12, F.size(F.array_distinct(F.split(token, ""))) < 7),
        vote(before.rlike("""["']$""") & c["after"].rlike("""^["']"""), before.rlike("[/.@#]$")),
    )


LABELERS = 6


def shape(c: Column) -> Column:
    """The classifier's features, each a small number, as an array."""
    token, n = c["token"], F.length(c["token"])
    return F.array(
        F.least(F.floor(n / 8), F.lit(12)).cast("int"),
        F.floor(8 * letters(token, "0-9") / n).cast("int"),
        token.rlike("^[0-9a-fA-F]+$").cast("int"),
        token.rlike("[A-Z]").cast("int") * 2 + token.rlike("[a-z]").cast("int"),
        token.rlike("[_-]").cast("int"),
        F.when(c["before"].rlike("""["']$"""), 2).when(c["before"].rlike("\\s$"), 1).otherwise(0),
    )


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 30) -> dict[tuple[int, ...], float]:
    """Probability that each vote pattern means a secret, by expectation-maximisation from the majority of votes.

    Each labeler has a distribution over its three votes for secrets and one for others, smoothed by one count.
    """
    chance = {p: 0.5 + 0.4 * (sum(p) > 0) - 0.4 * (sum(p) < 0) for p, _ in patterns}
    for _ in range(rounds):
        weight = [1.0, 1.0]
        given = [[[1.0, 1.0, 1.0] for _ in range(LABELERS)] for _ in range(2)]
        for p, n in patterns:
            for side, w in enumerate((n * (1 - chance[p]), n * chance[p])):
                weight[side] += w
                for k, v in enumerate(p):
                    given[side][k][v + 1] += w
        for p, _ in patterns:
            log = [math.log(weight[side]) + sum(math.log(given[side][k][v + 1] / sum(given[side][k])) for k, v in enumerate(p)) for side in range(2)]
            chance[p] = 1 / (1 + math.exp(max(-700.0, min(700.0, log[0] - log[1]))))
    return chance


def classifier(candidates: DataFrame) -> dict[tuple[int, int], float] | None:
    """Log odds of each feature value (feature, value), and of a secret as such (-1, 0). candidates: column c."""
    counted = candidates.select(votes(F.col("c")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    patterns = [(tuple(r["v"]), r["n"]) for r in counted.collect()]  # at most 3 ** LABELERS
    patterns = [(p, n) for p, n in sorted(patterns) if any(p)]
    if not patterns:
        return None
    chance = reliabilities(patterns)
    table = F.create_map(*[x for p, q in chance.items() for x in (F.lit(",".join(map(str, p))), F.lit(q))])
    soft = candidates.select(shape(F.col("c")).alias("f"), F.coalesce(F.try_element_at(table, F.array_join(votes(F.col("c")).cast("array<string>"), ",")), F.lit(0.5)).alias("q"))
    by = soft.select("q", F.posexplode("f").alias("feature", "value")).groupBy("feature", "value").agg(F.sum("q").alias("p"), F.sum(1 - F.col("q")).alias("n")).collect()  # a few values for each feature
    sums = {f: [sum(r[k] for r in by if r["feature"] == f) for k in ("p", "n")] for f in {r["feature"] for r in by}}
    total = sums[0]
    odds = {(r["feature"], r["value"]): math.log((r["p"] + 0.5) / (sums[r["feature"]][0] + 1)) - math.log((r["n"] + 0.5) / (sums[r["feature"]][1] + 1)) for r in by}
    return odds | {(-1, 0): math.log((total[0] + 0.5) / (total[1] + 0.5))}


def is_secret(c: Column, odds: dict[tuple[int, int], float]) -> Column:
    values, score = shape(c), F.lit(odds[(-1, 0)])
    for f in sorted({f for f, _ in odds if f >= 0}):
        of = F.create_map(*[x for (g, v), w in sorted(odds.items()) if g == f for x in (F.lit(v), F.lit(w))])
        score = score + F.coalesce(F.try_element_at(of, F.get(values, F.lit(f))), F.lit(0.0))
    return score > 0


def text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, [*PATTERNS, ADDED]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def apart(base: Column, candidates: Column) -> Column:
    """The candidates that overlap no base span, by one sorted merge: of the base spans that start before a candidate ends, none ends after it starts."""
    ends = F.transform(base, lambda b: F.struct(b["s"].alias("at"), F.lit(1).alias("kind"), b["e"].alias("e"), F.lit(None).cast(CANDIDATES).alias("c")))
    asking = F.transform(candidates, lambda c: F.struct(c["e"].alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("e"), c.alias("c")))
    line = F.sort_array(F.concat(ends, asking))
    furthest = running(F.transform(line, lambda x: x["e"]), F.greatest, -1)
    free = F.filter(F.arrays_zip(line.alias("x"), furthest.alias("most")), lambda z: (z["x"]["kind"] == 0) & (z["most"] <= z["x"]["c"]["s"]))
    return F.when((F.size(base) == 0) | (F.size(candidates) == 0), candidates).otherwise(F.transform(free, lambda z: z["x"]["c"]))


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans (SPAN: start, number of the kind, end; sorted) of every row. Kind 4 are the added secrets."""
    spans = staged(found(docs, id_col=id_col, text_col=text_col))
    odds = classifier(spans.select(F.explode("candidates").alias("c")))
    if odds is None:
        return spans.select("id", "base", F.col("base").alias("spans"))
    secrets = F.filter(apart(F.col("base"), F.col("candidates")), lambda c: is_secret(c, odds))
    added = F.transform(secrets, lambda c: F.struct(c["s"].alias("s"), F.lit(len(PATTERNS)).alias("k"), c["e"].alias("e"))).cast(SPAN)
    return spans.select("id", "base", F.sort_array(F.concat("base", added)).alias("spans"))
