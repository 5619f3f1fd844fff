"""Small helpers that the training-data operators share.

Column names that operators add to a caller's rows start with ``_tm_``, so extra columns of
any other name pass through untouched.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def body(text: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words. split() gives one empty piece before leading and one after trailing space."""
    edge = lambda c: F.when(c.rlike(SPACE), 1).otherwise(0)
    inner = F.size(F.split(text, SPACE + "+")) - edge(F.substring(text, 1, 1)) - edge(F.substring(text, -1, 1))
    return F.when(text == "", F.lit(0)).otherwise(inner).cast("long")


def id_hash(col: str | Column) -> Column:
    """60 pseudo-random bits of an id, the same in any SQL engine that has md5."""
    value = F.col(col) if isinstance(col, str) else col
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _local.setdefault(app, tempfile.mkdtemp(prefix="tidemark-"))
    return f"{base}/tidemark-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back: it is computed once, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than this share of all rows is joined by broadcast; there are at most 1000 of them.
FREQUENT = 1 / 1000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Inner join of left with right, which has one row for each key and, as n, how many of the left's rows have it.

    Frequent keys are so few that they are broadcast; so none of them meets in one task. rows: of the left, at least.
    """
    frequent = F.col("n") > FREQUENT * rows
    hot = right.where(frequent)
    keys = F.broadcast(hot.select(*on))
    return left.join(F.broadcast(hot), on).unionByName(left.join(keys, on, "left_anti").join(right.where(~frequent), on))


def spread(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions so that each holds about per_task rows, never fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def short_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows, as texts may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
