"""Zip archives as a source: filters that reach the stream, faults that are named, extracts, and packs."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import archives, tables

HEAD = "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("archives")
    for day in (1, 2, 3):
        lines = [f"36{k:07},2024-06-{day:02}T{k // 60 % 24:02}:{k % 60:02}:00,{36 + k / 1000},{-122 + k / 1000},{k % 30},,511,\"A, {k}\"\n" for k in range(1000)]
        lines += ["1,2024-06-01T00:00:00,north,-122,1,1,1,x\n", "2,never,36.5,-121.5,1,1,1,x\n", "3,2024-06-01 00:00:00.25+02:00,36.5,-121.5,1,1,1,x\n"]
        with zipfile.ZipFile(root / f"day{day}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.txt", "no table")
            z.writestr("reports.csv", HEAD + "".join(lines))
            z.writestr("second.csv", HEAD)
    (root / "notes.txt").write_text("no archive")
    return root


def load(spark, path, schema=None, **options):
    archives.use(spark)
    reader = spark.read.format("report_archives").options(**options)
    return (reader.schema(schema) if schema else reader).load(str(path))


def test_archives_are_partitions_and_streams(spark, folder):
    d = load(spark, folder, blockBytes=4096)
    assert d.count() == 3 * 1002 and d.rdd.getNumPartitions() == 3
    r = d.where("mmsi = '3' AND archive LIKE '%day2.zip'").first()
    assert (r.t_abs, r.lat, r.lon) == (1717192800.25, 36.5, -121.5)
    assert d.where("mmsi = '2' AND t_abs IS NULL").count() == 3
    assert d.where("cog IS NULL").count() == 3000
    assert load(spark, folder / "day1.zip").count() == 1002


def test_box_and_time_reach_the_stream(spark, folder):
    d = load(spark, folder)
    t0 = 1717200000.0 + 3600
    near = archives.within(d, (-121.95, 36.02, -121.2, 36.7), t0, t0 + 7200, pad=300.0)
    want = [k for k in range(1000) if 36.02 <= 36 + k / 1000 <= 36.7 and -121.95 <= -122 + k / 1000 <= -121.2 and t0 - 300 <= 1717200000 + k * 60 <= t0 + 7500]
    assert sorted(r.mmsi for r in near.collect()) == [f"36{k:07}" for k in want]
    # Spark keeps no filter of its own on what the source has taken.
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "lat#" in plan and " Filter (" not in plan
    assert " Filter (" in d.where("mmsi = '3'")._jdf.queryExecution().executedPlan().toString()


def test_schema_chooses_columns(spark, folder):
    d = load(spark, folder, "lon double, mmsi string")
    assert d.columns == ["lon", "mmsi"] and d.count() == 3 * 1002
    with pytest.raises(Exception, match="archives have no name"):
        load(spark, folder, "name string").count()
    with pytest.raises(Exception, match="another type of lat"):
        load(spark, folder, "lat string").count()


@pytest.mark.parametrize(("content", "fault"), [(b"no zip" * 100, "File is not a zip file"), ({"a.txt": "x"}, "it holds no CSV"), ({"a.csv": "MMSI,LAT\n1,2\n"}, "does not exist in CSV file"), ({"a.csv": HEAD + "1,2\n"}, "columns")])
def test_faults_name_the_archive(spark, tmp_path, content, fault):
    path = tmp_path / "bad.zip"
    if isinstance(content, bytes):
        path.write_bytes(content)
    else:
        with zipfile.ZipFile(path, "w") as z:
            for n, text in content.items():
                z.writestr(n, text)
    with pytest.raises(Exception, match=f"(?s)bad.zip: .*{fault}"):
        load(spark, path).collect()
    with pytest.raises(Exception, match="no archives at"):
        load(spark, tmp_path / "nowhere").collect()


def test_an_empty_folder_and_an_empty_table(spark, tmp_path):
    assert load(spark, tmp_path).count() == 0
    with zipfile.ZipFile(tmp_path / "empty.zip", "w") as z:
        z.writestr("a.csv", HEAD)
    assert load(spark, tmp_path).count() == 0


def test_an_extract_reads_back(spark, folder, tmp_path):
    d = archives.within(load(spark, folder), (-122.0, 36.0, -121.9, 36.1), 1717200000.0, 1717203600.0, 0.0)
    d = d.withColumn("t_abs", F.col("t_abs") + F.when(F.col("mmsi").endswith("5"), 0.125).otherwise(0.0))
    archives.write_extract(d, str(tmp_path / "out"))
    key = lambda rows: sorted((r.mmsi, r.t_abs, r.lat, r.lon) for r in rows)
    assert key(tables.reports(spark, str(tmp_path / "out")).collect()) == key(d.collect()) != []


def test_packs_and_their_faults(spark, tmp_path):
    good = {"id": "s1", "time_window": {"start": "2024-06-15T06:00:00Z", "end": "2024-06-15T07:00:00+00:00"}, "bbox": {"lon_min": 1, "lat_min": 2, "lon_max": 3, "lat_max": 4}}
    packs = {"s1": json.dumps(good), "s2": "{", "s3": "[1]", "s4": json.dumps({**good, "id": ""}), "s5": json.dumps({**good, "time_window": [5, 4]}), "s6": json.dumps({**good, "bbox": [1, 2]}), "s7": json.dumps({k: v for k, v in good.items() if k != "bbox"})}
    for n, text in packs.items():
        (tmp_path / n).mkdir()
        (tmp_path / n / "pack.json").write_text(text)
    got = {r.file.split("/")[-2]: r for r in archives.pack_files(spark, f"{tmp_path}/*/pack.json").collect()}
    faults = {n: r.problem and r.problem.split("pack.json: ")[1] for n, r in got.items()}
    assert faults == {"s1": None, "s2": "malformed JSON", "s3": "the top level is array", "s4": "no id", "s5": "time_window: the start isn't before the end", "s6": "bbox: a list of 2 corners", "s7": None}
    assert (got["s1"].t0, got["s1"].t1, got["s1"].west, got["s1"].north) == (1718431200.0, 1718434800.0, 1.0, 4.0) and got["s7"].west is None
    with pytest.raises(Exception, match=r"scenario pack .*s2/pack.json: malformed JSON"):
        archives.pack_files(spark, f"{tmp_path}/s2/pack.json", required=True).collect()
