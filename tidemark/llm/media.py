"""Media columns: interleaved document sequences.

A page becomes an ordered sequence of parts, each either text or a reference to a medium by the
SHA-256 of its payload, with position and caption. The media are a table of their own: digest, stored bytes, type
and size, each medium once. A join on digests resolves references; parts without a stored medium
keep their place with null media fields, so text, media and captions stay aligned.

Bytes are stored losslessly as 8-bit grey PNG images of WIDTH columns; a payload is padded with
byte 255 to whole images of at least one block of 576 bytes.

Nulls and ties: a null or empty payload is one block of padding; a null page has no parts; equal
payloads are one medium; a page may refer to one medium many times.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import short_batches

WIDTH, BLOCK = 24, 576
MEDIUM = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PARTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """payload: a positive multiple of WIDTH bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    """The samples of what to_png wrote; raises ValueError on anything else."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, data, width, height = 8, b"", 0, 0
    while at < len(png):
        (n,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        part = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", part[:8])
        elif kind == b"IDAT":
            data += part
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def padded(payload: bytes) -> bytes:
    return payload + b"\xff" * (-len(payload) % BLOCK or (0 if payload else BLOCK))


def features(samples: bytes) -> str:
    """Size, mean, deviation and an 8x8 mean hash of the image."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    rows = np.linspace(0, len(image), 9).astype(int)
    grid = np.array([image[a:b].mean(axis=0, dtype=np.float64).reshape(8, 3).mean(axis=1) for a, b in zip(rows, rows[1:], strict=False)])
    code = int("".join("1" if x else "0" for x in (grid > grid.mean()).ravel()), 2)
    return f"{WIDTH}x{len(image)};mean={image.mean():.3f};std={image.std():.3f};ahash={code:016x}"


def stored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Maps (digest, payload) to (digest, media, n_bytes): the stored form beside the payload's digest."""
    for part in parts:
        payloads = list(map(bytes, part["payload"]))
        yield pd.DataFrame({"digest": part["digest"], "media": [to_png(padded(p)) for p in payloads], "n_bytes": [len(p) for p in payloads]})


def described(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Maps (digest, media, n_bytes) to what reading the stored bytes back shows."""
    for part in parts:
        out = []
        for digest, media, n in zip(part["digest"], map(bytes, part["media"]), part["n_bytes"], strict=True):
            back = from_png(media)
            out.append((digest, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(back)))
        yield pd.DataFrame(out, columns=["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


class Sequence(HTMLParser):
    """Text and media references of a page in order. A figure's caption goes with its media, not with the text."""

    BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
    SILENT = frozenset(("script", "style", "head", "template"))
    MEDIA = frozenset(("img", "video", "audio", "source"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.words: list[str] = []
        self.silent = self.figure = 0
        self.caption: list[str] | None = None
        self.waiting: list[dict] = []

    def end_text(self) -> None:
        if text := " ".join("".join(self.words).split()):
            self.parts.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self.words = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SILENT:
            self.silent += 1
        elif tag in self.MEDIA:
            named = dict(attrs)
            source = named.get("src") or ""
            self.end_text()
            part = {"kind": "media", "text": None, "digest": source.rpartition("sha256:")[2] if "sha256:" in source else None, "caption": named.get("alt") or None}
            self.parts.append(part)
            if self.figure:
                self.waiting.append(part)
        elif tag == "figcaption":
            self.end_text()
            self.caption = []
        elif tag in self.BLOCKS:
            self.end_text()
            self.figure += tag == "figure"

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for part in self.waiting:
                part["caption"] = text or part["caption"]
            self.caption = None
        elif tag in self.BLOCKS:
            self.end_text()
            if tag == "figure":
                self.figure, self.waiting = max(0, self.figure - 1), []

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    parser = Sequence()
    parser.feed(html or "")
    parser.close()
    parser.end_text()
    return [{"position": k, **p} for k, p in enumerate(parser.parts)]


def sequences(pages: DataFrame, *, id_col: str, html_col: str) -> DataFrame:
    """id and parts (PARTS) of each page."""
    short_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    part = pa.struct([("position", pa.int32()), *[(c, pa.string()) for c in ("kind", "text", "digest", "caption")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([sequence(h) for h in b.column("html").to_pylist()], pa.list_(part))], names=["id", "parts"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, parts {PARTS}")


def resolve(seqs: DataFrame, media: DataFrame) -> DataFrame:
    """A row for each part, with the columns of media (digest and others, each digest once) beside it; parts keep position and caption, and other columns of seqs stay."""
    others = [c for c in seqs.columns if c != "parts"]
    parts = seqs.select(*others, F.explode_outer("parts").alias("_tm_part")).select(*others, "_tm_part.*")
    return parts.join(media, "digest", "left")


def payload(text_col: str = "text") -> Column:
    """The UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def illustrated(text_col: str, digest: Column) -> Column:
    """A page: the text's first line, a figure that refers to the digest with that line as caption, the other lines."""
    safe = F.replace(F.replace(F.col(text_col), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.split(safe, "\n")
    first, rest = F.get(lines, F.lit(0)), F.slice(lines, F.lit(2), F.size(lines))
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), first, F.lit("</figcaption></figure><p>"))
    return F.concat(F.lit("<article><p>"), first, F.lit("</p>"), figure, F.array_join(rest, "</p><p>"), F.lit("</p></article>"))


def store(payloads: DataFrame) -> DataFrame:
    """payloads: binary column ``payload``. digest (SHA-256 of the payload), media (stored bytes) and n_bytes, each payload once.

    Copies meet before the shuffle, and only stored bytes are shuffled.
    """
    short_batches(payloads.sparkSession)
    named = payloads.select(F.sha2("payload", 256).alias("digest"), "payload")
    return named.mapInPandas(stored, "digest string, media binary, n_bytes long").dropDuplicates(["digest"])


def describe(media: DataFrame) -> DataFrame:
    """digest and the columns of MEDIUM, from the stored bytes read back."""
    return media.mapInPandas(described, f"digest string, {MEDIUM}")
