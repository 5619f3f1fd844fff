"""From documents to packed training sequences: quality rules, line dedup, near-dedup, mixing, packing.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns what the
next one gets as docs, after it was written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import line_dedup, mixing, packing, quality, simhash
from tidemark.llm.common import read, staged

#: SQL can't express byte-level BPE or XXH64; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list let through. A null text is empty and goes; equal texts share their fate; without labels only the base rule rejects."""
    return quality.kept_rows(docs, read(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines. A null text stays null, one that has no other lines keeps them; rows of equal texts get equal texts."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest id, null last; of rows with that id that of the least text hash. All texts without words are one component."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document, in training order; ties stand by id and text. Documents without words and those beyond their source's target are not used."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a packed document; a document that is used several times is packed as often, and no rows give no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), special=True).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
