"""Readers on files written by hand."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from nocturne.sources import logs


def write(root, name, lines, bom=True, end="\r\n"):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    text = end.join([";".join(logs.RAW_COLUMNS), *lines]) + end
    with open(path, "wb") as f:
        f.write((b"\xff\xfe" if bom else b"") + text.encode("utf-16-le"))


def line(serial, label="Ind1", unit="CondMod3", dur="1200,5", msg=""):
    row = dict.fromkeys(logs.RAW_COLUMNS, "")
    row |= {"DateTime": serial, "IdRFID": "04A", "IdLabel": label, "unitLabel": unit,
            "eventDuration": dur, "SystemMsg": msg, "MsgValue3": "é"}
    return ";".join(row.values())


@pytest.fixture
def root(tmp_path):
    root = str(tmp_path / "nights")
    write(root, "raw/g1/first night+1.csv", [line(f"42068,{7000 + i // 3:04d}", f"Ind{i}") for i in range(200)])
    write(root, "raw/g2/second.csv", ["#marker" + line("")[0:], line("42069,7", "", dur="")], bom=False, end="\n")
    write(root, "raw/g2/other.csv", [line("42069,9")])
    return root


def manifest(spark, *entries):
    return spark.createDataFrame(list(entries), logs.MANIFEST_SCHEMA)


@pytest.mark.parametrize("split", [333, 128 * 1024 * 1024])
def test_split_files_keep_their_order(spark, root, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        raw = logs.read_raw_logs(spark, root)
        rows = raw.where("path like '%first%'").orderBy("row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.IdLabel for r in rows] == [f"Ind{i}" for i in range(200)]
    assert len({r.row.offset for r in rows}) > 1 or split > 10**6
    assert {r.MsgValue3 for r in rows} == {"é"}


def test_typed_log(spark, root):
    entries = manifest(spark, (2, "/raw/g2/second.csv", None))
    rows = logs.as_log(logs.read_raw_logs(spark, root), entries).collect()
    assert len(rows) == 1  # the marker line and the unlisted file are gone
    row = rows[0]
    assert (row.night, row.raw_label, row.event_duration, row.system_msg) == (2, "", None, "")
    assert row.ts == dt.datetime(2015, 3, 6, 16, 48)


def test_manifest_checks(spark, root):
    files = logs.list_files(spark, root)
    good = manifest(spark, (1, "/raw/g2/second.csv", None), (2, "/raw/g2/other.csv", None))
    logs.check_manifest(good, files)
    with pytest.raises(FileNotFoundError, match="no file"):
        logs.check_manifest(manifest(spark, (1, "/raw/none.csv", None)), files)
    with pytest.raises(FileNotFoundError, match="broken"):
        logs.check_manifest(manifest(spark, (None, "/raw/g2/second.csv", None)), files)
    with pytest.raises(FileNotFoundError, match="broken"):
        logs.check_manifest(good.unionByName(good), files)


def test_path_with_a_space(spark, root):
    entries = manifest(spark, (1, "/raw/g1/first night+1.csv", None))
    logs.check_manifest(entries, logs.list_files(spark, root))
    assert logs.as_log(logs.read_raw_logs(spark, root), entries).count() == 200


def test_metadata_files(spark, tmp_path):
    path = str(tmp_path / "conditions.csv")
    with open(path, "w") as f:
        f.write("night;group_night;IdLabel;IdRFID;weight;sex;group;discard;cond\n"
                "1;0;Ind1;0A1B2C3D4E;12.25;m;mixedA;>22:04;train\n2;1;Ind2;NA;NA;f;groupB;0;test\n")
    rows = logs.read_conditions(spark, path).orderBy("night").collect()
    assert (rows[0].id_label, rows[0].weight, rows[0].cohort, rows[0].discard) == ("Ind1", 12.25, "mixedA", ">22:04")
    assert rows[1].tag is None and rows[1].weight is None


def test_event_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "night int, x string")
    logs.write_events(df, str(tmp_path / "events"))
    assert logs.read_events(spark, str(tmp_path / "events")).where("night = 2").count() == 2
    logs.write_table(df, str(tmp_path / "table"))
    back = spark.read.options(sep=";", header=True).csv(str(tmp_path / "table"))
    assert back.count() == 3


def test_table_as_text_comes_back_typed(spark, tmp_path):
    at = dt.datetime(2015, 3, 6, 16, 48, 1, 250)
    df = spark.createDataFrame([(1, at, 2.5, None), (None, None, None, "x")], "n int, ts timestamp_ntz, v double, s string")
    logs.write_table(df, str(tmp_path / "t"))
    back = logs.read_table(spark, str(tmp_path / "t"), "n int, ts timestamp_ntz, v double, s string")
    assert back.dtypes == df.dtypes and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_a_night_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [(n, i, f"{n}-{i}") for n in (1, 2, 3) for i in range(4)]
    logs.write_events(spark.createDataFrame(rows, "night int, i int, v string"), path)
    again = spark.createDataFrame([(2, 9, "new")], "night int, i int, v string")
    logs.replace_nights(again, path)
    got = sorted(tuple(r) for r in logs.read_events(spark, path).select("night", "i", "v").collect())
    assert got == sorted([r for r in rows if r[0] != 2] + [(2, 9, "new")])
    # a write that fails leaves the old night
    broken = again.withColumn("v", F.when(F.col("i") == 9, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no"):
        logs.replace_nights(broken, path)
    assert sorted(tuple(r) for r in logs.read_events(spark, path).select("night", "i", "v").collect()) == got
    # one night is read from its own folder
    one = logs.read_events(spark, path).where("night = 2")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(night" in plan and one.select(F.input_file_name()).distinct().count() == 1
    assert one.count() == 1
