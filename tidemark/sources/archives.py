"""Zip archives of reports as a data source of their own, extracts of them as CSV, and scenario packs whose faults are named.

An archive is a partition and is read as a stream from wherever it lies, so it may be larger than memory. A box and a
span of time are pushed down to the batches of the stream, and only the columns of the schema are read:

    use(spark)
    spark.read.format("report_archives").load("/shared/archives").where("lat BETWEEN 36 AND 37")
"""

from __future__ import annotations

import operator
import zipfile
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tidemark.functions import times

SCHEMA = "mmsi string, t_abs double, lat double, lon double, sog double, cog double, heading double, archive string"
#: The columns of the files.
HEADERS = {"mmsi": "MMSI", "t_abs": "BaseDateTime", "lat": "LAT", "lon": "LON", "sog": "SOG", "cog": "COG", "heading": "Heading"}
COMPARE = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, EqualTo: operator.eq}


class Archive(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)
        self.uri = uri


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.path, self.tests = schema.fieldNames(), options.get("path"), []
        self.types = {f.name: f.dataType.simpleString() for f in schema.fields}
        self.block = int(options.get("blockBytes", 8 << 20))
        if not self.path:
            raise ValueError("a path of archives is needed")
        if unknown := set(self.names) - {*HEADERS, "archive"}:
            raise ValueError(f"archives have no {', '.join(sorted(unknown))}")
        if wrong := [n for n, t in self.types.items() if t != ("string" if n in ("mmsi", "archive") else "double")]:
            raise ValueError(f"archives have another type of {', '.join(wrong)}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of numbers are worked out batch by batch; the others are left to Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in COMPARE and self.types.get(name) == "double" and isinstance(f.value, (int, float)):
                self.tests.append((name, COMPARE[type(f)], float(f.value)))
            elif isinstance(f, IsNotNull) and self.types.get(name) == "double":
                self.tests.append((name, None, None))
            else:
                yield f

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        at, path = fs.FileSystem.from_uri(self.path)
        info = at.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no archives at {self.path}")
        if info.type == fs.FileType.File:
            return [Archive(self.path)]
        root = self.path.rstrip("/")
        return [Archive(f"{root}/{i.base_name}") for i in sorted(at.get_file_info(fs.FileSelector(path)), key=lambda i: i.base_name) if i.base_name.lower().endswith(".zip")]

    def read(self, partition: Archive | None) -> Iterator:
        """Batches of the first CSV of an archive. Rows without numeric coordinates are left out, as is what the pushed comparisons shut out; a fault of the archive is an error that names it."""
        import pyarrow as pa
        from pyarrow import csv, fs

        if partition is None:  # a folder without archives
            return
        wanted = sorted({*self.names, "lat", "lon", *(t[0] for t in self.tests)} - {"archive"})
        options = csv.ConvertOptions(include_columns=[HEADERS[n] for n in wanted], column_types={HEADERS[n]: pa.string() for n in wanted}, strings_can_be_null=True, null_values=[""])
        at, path = fs.FileSystem.from_uri(partition.uri)
        try:
            with at.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
                member = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                if member is None:
                    raise ValueError("it holds no CSV")
                with z.open(member) as f:
                    for batch in csv.open_csv(f, csv.ReadOptions(block_size=self.block), csv.ParseOptions(newlines_in_values=False), options):
                        yield from self.rows(batch, partition.uri)
        except (zipfile.BadZipFile, pa.ArrowInvalid, pa.ArrowKeyError, KeyError, ValueError) as e:
            raise ValueError(f"archive {partition.uri}: {e}") from e

    def rows(self, batch, uri: str) -> Iterator:
        import pandas as pd
        import pyarrow as pa

        text = {n: batch.column(batch.schema.get_field_index(h)).to_pandas() for n, h in HEADERS.items() if h in batch.schema.names}
        d = {n: v if n == "mmsi" else seconds(v) if n == "t_abs" else pd.to_numeric(v, errors="coerce") for n, v in text.items()}
        keep = d["lat"].notna() & d["lon"].notna()
        for name, compare, value in self.tests:
            keep &= d[name].notna() if compare is None else compare(d[name], value)
        if n := int(keep.sum()):
            columns = [pa.array([uri] * n) if c == "archive" else pa.array(d[c][keep], pa.string() if c == "mmsi" else pa.float64(), from_pandas=True) for c in self.names]
            yield pa.RecordBatch.from_arrays(columns, names=self.names)


def seconds(text):
    """UTC seconds of a pandas Series of ISO 8601 texts, which are UTC without a zone; others are missing."""
    import pandas as pd

    at = pd.to_datetime(text, errors="coerce", utc=True, format="ISO8601")
    return at.astype("datetime64[us, UTC]").astype("int64").where(at.notna()) / 1e6


class ReportArchives(DataSource):
    """The data source ``report_archives``: a zip archive or a folder of them; options path and blockBytes (bytes of text a batch)."""

    @classmethod
    def name(cls) -> str:
        return "report_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(schema, dict(self.options))


def use(spark: SparkSession) -> None:
    """Makes the source known to the session and lets Python sources take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ReportArchives)


def within(reports: DataFrame, box: tuple[float, float, float, float], t0: float, t1: float, pad: float = 300.0) -> DataFrame:
    """reports inside a box (west, south, east, north) and from pad seconds before t0 to pad seconds after t1, edges included."""
    west, south, east, north = box
    inside = F.col("lon").between(west, east) & F.col("lat").between(south, north)
    return reports.where(inside & F.col("t_abs").between(t0 - pad, t1 + pad))


def write_extract(reports: DataFrame, path: str) -> None:
    """reports as CSV with the headers of the archives, so that sources.tables.reports reads them; one folder of files, replaced as a whole."""
    micros = F.round(F.col("t_abs") * 1_000_000).cast("long")
    rest = F.pmod(micros, F.lit(86_400_000_000))
    clock = [F.lpad((F.floor(rest / unit) % size).cast("string"), 2, "0") for unit, size in ((3_600_000_000, 24), (60_000_000, 60), (1_000_000, 60))]
    part = F.when(rest % 1_000_000 != 0, F.concat(F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"))).otherwise("")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / 86_400_000_000).cast("int")).cast("string")
    written = {"t_abs": F.concat(day, F.lit("T"), clock[0], F.lit(":"), clock[1], F.lit(":"), clock[2], part, F.lit("Z"))}
    reports.select(*[written.get(c, F.col(c)).alias(h) for c, h in HEADERS.items() if c in reports.columns]).write.mode("overwrite").csv(path, header=True)


def text_of(pack: Column, name: str) -> Column:
    return F.try_variant_get(pack, f"$.{name}", "string")


def pack_files(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """file, id, pack (VARIANT), t0, t1, west, south, east, north and problem of each scenario pack, whole JSON files.

    problem says what is wrong, beginning with the file: no JSON, no object, no id, or what functions.times finds in
    time_window and bbox; null if nothing is. With required the first such file is an error as soon as its row is read.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("pack"))
    part = lambda n: F.try_variant_get("pack", f"$.{n}", "variant")
    kind = times.kind_of(F.col("pack"))
    d = raw.select("file", "pack", kind.alias("_kind"), text_of("pack", "id").alias("id"), times.window(part("time_window")).alias("_w"), times.box(part("bbox")).alias("_b"))
    fault = (
        F.when(F.col("pack").isNull(), "malformed JSON").when(F.col("_kind") != "object", F.concat(F.lit("the top level is "), F.col("_kind"))).when(F.col("id").isNull() | (F.col("id") == ""), "no id")
        .when(F.col("_w.problem").isNotNull(), F.concat(F.lit("time_window: "), F.col("_w.problem"))).when(F.col("_b.problem").isNotNull(), F.concat(F.lit("bbox: "), F.col("_b.problem")))
    )
    d = d.withColumn("problem", F.when(fault.isNotNull(), F.concat(F.lit("scenario pack "), F.col("file"), F.lit(": "), fault)))
    if required:
        d = d.withColumn("file", F.when(F.col("problem").isNull(), F.col("file")).otherwise(F.raise_error(F.col("problem")).cast("string")))
    return d.select("file", "id", "pack", "_w.t0", "_w.t1", *[F.col(f"_b.{c}").alias(c) for c in ("west", "south", "east", "north")], "problem")
