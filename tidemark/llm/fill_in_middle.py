"""Fill-in-middle transformation by a piece table.

A text is never edited: it is an immutable buffer beside that of the sentinels, and a document is a table of pieces, each
(buffer, start, stop). Cutting splits the piece a cut falls in, an arrangement permutes the pieces of prefix, middle and
suffix and puts sentinels before them, and the inverse permutation restores the text from an output. Hashes read the
pieces one slice after another, so no output need be put together for them.

Cuts fall between lines, at two places that a hash of the document's id gives, so reruns agree and equal texts of
different ids differ. Form is ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix,
middle). A text that is empty or holds a sentinel is plain.

Nulls and ties: a null text is empty; a null id hashes as an empty one; rows of one id and text get equal results.
Texts may be of any length. The result's columns start with ``_tm_``, so a caller's own stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, short_batches

#: The sentinels' buffer, and where each stands in it.
SENTINELS = "<P><S><M>"
MARK = {"prefix": (0, 3), "suffix": (3, 6), "middle": (6, 9)}
#: The order of the parts in each form; each has its sentinel before it.
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
SLICE = 1 << 20

LINE = re.compile(r"[^\n]*\n|[^\n]+")


@dataclass(frozen=True)
class Piece:
    buffer: str
    start: int
    stop: int


def cut(pieces: list[Piece], *at: int) -> list[list[Piece]]:
    """The pieces before, between and after the places, of which each is not below the one before it."""
    out: list[list[Piece]] = [[]]
    places, done = [*at], 0
    for p in pieces:
        while places and places[0] < done + p.stop - p.start:
            split = p.start + places.pop(0) - done
            if split > p.start:
                out[-1].append(Piece(p.buffer, p.start, split))
            done, p = done + split - p.start, Piece(p.buffer, split, p.stop)
            out.append([])
        out[-1].append(p)
        done += p.stop - p.start
    return out + [[] for _ in places]


def arranged(parts: dict[str, list[Piece]], form: str) -> list[Piece]:
    return [x for name in ORDER[form] for x in (Piece(SENTINELS, *MARK[name]), *parts[name])]


def restored(output: str, form: str) -> list[Piece]:
    """The text's pieces, found in an output by its sentinels and put back in their order."""
    if form == "plain":
        return [Piece(output, 0, len(output))]
    names = ORDER[form]
    marks = [output.index(SENTINELS[slice(*MARK[n])]) for n in names]
    ends = [*marks[1:], len(output)]
    part = {n: Piece(output, m + 3, e) for n, m, e in zip(names, marks, ends)}
    return [part[n] for n in ("prefix", "middle", "suffix")]


def slices(pieces: list[Piece]) -> Iterator[str]:
    for p in pieces:
        for at in range(p.start, p.stop, SLICE):
            yield p.buffer[at : min(at + SLICE, p.stop)]


def digest(pieces: list[Piece]) -> str:
    total = hashlib.sha256()
    for s in slices(pieces):
        total.update(s.encode())
    return total.hexdigest()


def transformed(text: str, numbers: tuple[int, int, int, int], rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, list[Piece]]:
    """Lines, form, code points of prefix and middle, and the output's pieces."""
    ends = [0, *accumulate(len(x) for x in LINE.findall(text))]
    n, whole = len(ends) - 1, [Piece(text, 0, len(text))]
    h1, h2, h3, h4 = numbers
    if not text or h3 % 100 >= rate or any(SENTINELS[slice(*m)] in text for m in MARK.values()):
        return n, "plain", None, None, whole
    first, last = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    form = "spm" if h4 % 100 < spm_rate else "psm"
    prefix, middle, suffix = cut(whole, first, last)
    return n, form, first, last - first, arranged({"prefix": prefix, "middle": middle, "suffix": suffix}, form)


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: int = 100, spm_rate: int = 50, seed: int = 7) -> DataFrame:
    """docs with _tm_n, _tm_form, _tm_prefix_chars, _tm_middle_chars, _tm_output and _tm_output_sha256. rate: percent of texts that are cut; spm_rate: percent of these in spm."""
    short_batches(docs.sparkSession)
    kind = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"

    @F.pandas_udf(kind)
    def arrange(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        out = []
        for text, hexes in zip(texts, numbers, strict=True):
            *counts, pieces = transformed(text, tuple(int(hexes[k : k + 8], 16) for k in range(0, 32, 8)), rate, spm_rate)
            out.append((*counts, "".join(slices(pieces)), digest(pieces)))
        frame = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
        return frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    numbers = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    made = docs.withColumn("_tm_made", arrange(body(text_col), numbers))
    return made.select(*docs.columns, *[F.col(f"_tm_made.{c.split()[0]}").alias(f"_tm_{c.split()[0]}") for c in kind.split(", ")])


def restore(rows: DataFrame, *, output_col: str = "_tm_output", form_col: str = "_tm_form") -> DataFrame:
    """rows with _tm_restored, the text rebuilt from output and form alone, and _tm_restored_sha256. A null output stays null."""
    short_batches(rows.sparkSession)

    @F.pandas_udf("text string, sha256 string")
    def rebuild(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        found = [restored(o, f) if o is not None else None for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame([("".join(slices(p)), digest(p)) if p is not None else (None, None) for p in found], columns=["text", "sha256"])

    made = rows.withColumn("_tm_back", rebuild(F.col(output_col), F.col(form_col)))
    return made.select(*rows.columns, F.col("_tm_back.text").alias("_tm_restored"), F.col("_tm_back.sha256").alias("_tm_restored_sha256"))
