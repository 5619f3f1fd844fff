"""Queries that apply each training-data operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fill_in_middle, hard_negatives, html_text, language_id, line_dedup, media, mixing, packing, pii, quality, sharding, simhash, substring_dedup
from tidemark.llm.common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.curriculum_mix(read(spark, sf_dir, "documents"))
    out = mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.round("position", 6).alias("position"), F.size("uses").cast("long").alias("n_uses"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(read(spark, sf_dir, "documents").select("doc_id"))
    return placed.select("doc_id", F.col("_tm_slot").alias("slot"), F.col("_tm_shard").alias("shard"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_tm_n_lines").alias("n_lines"), F.col("_tm_n_removed").alias("n_removed"), "text")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", *[F.col(f"_tm_{c}").alias(c) for c in (*quality.STATS, "base_failed", "kept", "rule")])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = simhash.simhash_components(read(spark, sf_dir, "documents"))
    return marked.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_components(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.personal_data(read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.PATTERNS)]
    return spans.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.text_of(F.col("base")), 256).alias("base_sha256"), pii.text_of(F.col("spans")).alias("spans"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), special=True)
    return packed.withColumnRenamed("id", "doc_id")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a page of its lines with its own whole text as a medium after the first, which is the caption too; its row comes from resolving that reference."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), media.payload().alias("payload"))
    shown = media.sequences(docs.select("doc_id", media.illustrated("text", F.sha2("payload", 256)).alias("html")), id_col="doc_id", html_col="html")
    parts = media.resolve(shown.withColumn("n_parts", F.size("parts")), media.describe(media.store(docs))).where("kind = 'media'")
    return parts.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "n_parts", "caption")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), hard_negatives.quantised("embedding").alias("embedding"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.restore(fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select("doc_id", *[F.col(f"_tm_{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")])


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    found = language_id.identify(docs.withColumn("held_out", held_out), ~F.col("held_out"))
    return found.select("doc_id", "held_out", F.col("_tm_lang_pred").alias("lang_pred"), F.col("_tm_score").alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_sharding": op2_sharding,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash": op5_simhash,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_pii": op7_pii,
    "op8_packing": op8_packing,
    "op9_media": op9_media,
    "op10_html": op10_html,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_language_id": op13_language_id,
}

def sharding_sql() -> str:
    """The lookup table is a fixed string of two hex digits for each slot; the rest is a hash."""
    table = "".join(f"{k:02x}" for k in sharding.fill(sharding.SHARDS))
    return f"""
WITH s AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents), t AS (SELECT '{table}' AS codes)
SELECT doc_id, slot, printf('shard-%04d', ('0x' || substr(codes, 2 * slot + 1, 2))::INT) AS shard FROM s, t"""


ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: NOT coalesce(isfinite(x), false))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS mate, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE mate QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT mate AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS x FROM d),
c AS (SELECT *, len(units) AS n, least(x[1] % (len(units) + 1), x[2] % (len(units) + 1)) AS a, greatest(x[1] % (len(units) + 1), x[2] % (len(units) + 1)) AS b FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m, coalesce(array_to_string(units[b + 1:], ''), '') AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 100 THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op2_sharding": sharding_sql(),
    "op1_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2, 1][rank % 3 + 1] AS weight, 3 * source_size / [5.0::DOUBLE, 2, 1][rank % 3 + 1] AS ratio FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w WINDOW b AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, rank, least(3 * source_size::DOUBLE, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER () * weight, 3 * source_size)) AS target FROM v),
c AS (SELECT doc_id, size, source_size, rank, target, round(target)::BIGINT AS stop, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, [greatest(0, least(size, stop - start)), greatest(0, least(size, stop - start - source_size)), greatest(0, least(size, stop - start - 2 * source_size))] AS used, CASE WHEN rank % 2 = 0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS w0, CASE WHEN rank % 2 = 0 THEN -1 ELSE 1 END AS slope FROM c)
SELECT doc_id, size, source_size, target, list_sum(used)::BIGINT AS taken,
  CASE WHEN list_sum(used) > 0 THEN round(2 * (start / target) / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * (start / target), 0))), 6) END AS position, len(list_filter(used, lambda x: x > 0))::BIGINT AS n_uses FROM u""",
    "op3_line_dedup": r"""
WITH l AS (SELECT doc_id, text, coalesce('+' || source, '-') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT *, lower(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS norm FROM l),
b AS (SELECT norm FROM n WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT site) >= 5),
t AS (SELECT DISTINCT text, i, line, norm FROM n),
f AS (SELECT t.*, b.norm IS NOT NULL AS spread, bool_and(b.norm IS NOT NULL OR t.norm = '') OVER (PARTITION BY t.text) AS every FROM t LEFT JOIN b ON t.norm = b.norm),
k AS (SELECT text, count(*) AS n_lines, count(*) FILTER (WHERE spread AND NOT every) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE every OR NOT spread) AS kept FROM f GROUP BY text)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text FROM documents d LEFT JOIN k ON d.text = k.text""",
}
