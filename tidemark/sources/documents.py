"""Unknown JSON as rows: every leaf at any depth, the files it refers to, and those that aren't there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.staging import staged

#: Prose, in which a path is no promise.
NOTES = "notes"
EXTENSION = r"\.[A-Za-z0-9]{1,8}$"


def walk(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, name, kind, value) of each leaf of each document: path as in ``a.b[0].c``, name the nearest name above it, value as text.

    Each round opens one level of all documents at once, until none has another. What can't be parsed and null make no
    rows, empty objects and lists neither; a document that is a leaf itself has an empty path.
    """
    spark = rows.sparkSession
    none = F.lit("")
    level, out = staged(rows.select(F.col(key).alias("_key"), none.alias("_path"), none.alias("_name"), F.to_json(F.try_parse_json(json)).alias("_json"))), []
    while True:
        v = level.where("_json IS NOT NULL").withColumn("_v", F.parse_json("_json"))
        v = v.withColumn("_kind", F.lower(F.regexp_extract(F.schema_of_variant("_v"), r"^\w+", 0)))
        inner = F.col("_kind").isin("object", "array")
        out.append(v.where(~inner).select(F.col("_key").alias(key), F.col("_path").alias("path"), F.col("_name").alias("name"), F.col("_kind").alias("kind"), F.try_variant_get("_v", "$", "string").alias("value")))
        opened = v.where(inner).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        path = F.when(F.col("_kind") == "array", F.concat("_path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat_ws(".", F.nullif("_path", none), F.col("key")))
        level = staged(opened.select("_key", path.alias("_path"), F.coalesce("key", "_name").alias("_name"), F.to_json("value").alias("_json")))
        if level.isEmpty():
            break
    total = out[0]
    for d in out[1:]:
        total = total.unionByName(d)
    return total


def is_file(token: Column) -> Column:
    return token.rlike(EXTENSION) & ~token.contains("://") & ~token.rlike(r"\s")


def references(leaves: DataFrame) -> DataFrame:
    """leaves with file and promised: texts that name a file with its extension; of notes the words that look like a path with a folder, which promise nothing."""
    texts = leaves.where("kind = 'string'")
    said = texts.where((F.col("name") != NOTES) & is_file(F.col("value"))).select("*", F.col("value").alias("file"), F.lit(True).alias("promised"))
    word = F.explode(F.array_distinct(F.transform(F.split("value", r"\s+"), lambda w: F.regexp_replace(w, r"^[\"'(\[<]+|[\"')\]>.,;:!?]+$", ""))))
    told = texts.where(F.col("name") == NOTES).select("*", word.alias("file"), F.lit(False).alias("promised")).where(is_file(F.col("file")) & F.col("file").contains("/"))
    return said.unionByName(told)


def missing(found: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, path, file, outcome) of references to files (key, file) that aren't there: FAIL if promised, SKIP if only told, as that may be stale."""
    lost = found.join(files.select(key, "file"), [key, "file"], "left_anti")
    return lost.select(key, "path", "file", F.when(F.col("promised"), "FAIL").otherwise("SKIP").alias("outcome"))
