import os

import pytest
from pyspark.sql import functions as F

from paritas.sources import landing as L
from paritas.sources import readers as R
from paritas.sources import snapshot as SN
from tests.conftest import SF_MID


def test_normalize_frame_dates_and_missings(spark):
    df = spark.createDataFrame([(0.0, "bob  "), (None, ".")], "d DOUBLE, name STRING")
    out = L.normalize_frame(df, date_cols=["d"]).collect()
    assert [r["d"] for r in out] == ["1960-01-01", None]
    assert [r["name"] for r in out] == ["bob", None]


def test_out_of_range_dates_are_counted(spark):
    df = spark.createDataFrame([(1e12,), (5.0,), (None,)], "d DOUBLE")
    assert L.count_out_of_range_dates(df, ["d"]).first()["d"] == 1


def test_digest_tells_null_empty_and_separators_apart(spark):
    rows = [[(None, "a")], [("", "a")], [("~", "a")], [("a\x1f1:b", "c")], [("a", "b\x1f1:c")]]
    got = {SN.content_digest(spark.createDataFrame(r, "x STRING, y STRING")).first()["digest"] for r in rows}
    assert len(got) == 5 and all(len(d) == 64 for d in got)
    nan = spark.createDataFrame([(float("nan"),)], "x DOUBLE"), spark.createDataFrame([(None,)], "x DOUBLE")
    assert len({SN.content_digest(t).first()["digest"] for t in nan}) == 1


def test_digest_order_insensitive_and_duplicate_sensitive(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "x INT, y STRING")
    b = spark.createDataFrame([(2, "b"), (1, "a")], "x INT, y STRING").repartition(3)
    dup = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x INT, y STRING")
    da, db, dd = (SN.content_digest(t).first() for t in (a, b, dup))
    assert da["digest"] == db["digest"] and da["n_rows"] == 2
    assert dd["digest"] != da["digest"]


def test_snapshot_written_once(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a")], "x INT, y STRING")
    p1, d1 = SN.snapshot(df, "t", root=tmpdir_path)
    p2, d2 = SN.snapshot(df, "t", root=tmpdir_path)
    assert p1 == p2 and d1 == d2 and p1.endswith(f"t_{d1}/data")
    assert spark.read.parquet(p1).count() == 1


def test_read_source_csv_and_parquet(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "in.CSV")
    with open(p, "w") as f:
        f.write("x,y\n1,a\n2,b\n")
    df = R.read_source(spark, p)
    assert df.count() == 2 and dict(df.dtypes)["x"] == "int"
    pq = os.path.join(tmpdir_path, "t.parquet")
    df.write.parquet(pq)
    assert R.read_source(spark, pq).count() == 2


def test_read_source_errors(spark, tmpdir_path):
    with pytest.raises(R.MissingDependencyError) as e:
        R.read_source(spark, os.path.join(tmpdir_path, "in.sas7bdat"))
    assert "CSV/Parquet" in str(e.value)
    with pytest.raises(ValueError):
        R.read_source(spark, "x.xlsx")


def test_table_schemas_skips_missing(spark):
    spark.createDataFrame([(1, "a")], "x INT, y STRING").createOrReplaceTempView("ts_a")
    rows = R.table_schemas(spark, ["ts_a", "ts_missing"]).collect()
    assert [(r["table_name"], r["schema"]) for r in rows] == [("ts_a", "x int, y string")]


def test_snapshot_rewrites_an_unfinished_folder(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a")], "x INT, y STRING")
    digest = SN.content_digest(df).first()["digest"]
    df.limit(0).write.parquet(f"{tmpdir_path}/t_{digest}/data")   # a write that died
    path, _ = SN.snapshot(df, "t", tmpdir_path)
    assert spark.read.parquet(path).count() == 1


def test_csv_as_people_export_it(spark, tmpdir_path):
    with open(f"{tmpdir_path}/x.CSV", "w") as f:
        f.write('id,t\n1,"a ""q"" b, c"\n2,"two\nlines"\n')
    got = R.read_source(spark, f"{tmpdir_path}/x.CSV", multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 'a "q" b, c'), (2, "two\nlines")]
    with pytest.raises(ValueError):
        R.read_source(spark, f"{tmpdir_path}/x.xlsx")


def test_csv_types_are_found_in_one_pass(spark, tmpdir_path):
    with open(f"{tmpdir_path}/x.csv", "w") as f:
        f.write("i,l,d,b,s,date,none,mixed,blank\n1,9999999999,1.5,true,x,2024-01-02,,1,\n"
                "-2, 12 ,nan,FALSE,1d,2024-01-03,,x, \n+3,,1e3,,,,,2,5\n")
    df = R.read_source(spark, f"{tmpdir_path}/x.csv")
    assert dict(df.dtypes) == {"i": "int", "l": "bigint", "d": "double", "b": "boolean", "s": "string", "date": "string",
                               "none": "string", "mixed": "string", "blank": "int"}
    rows = df.collect()
    assert [r["l"] for r in rows] == [9999999999, 12, None] and [r["i"] for r in rows] == [1, -2, 3]
    assert [r["b"] for r in rows] == [True, False, None] and rows[2]["d"] == 1000.0 and [r["blank"] for r in rows] == [None, None, 5]
    big = spark.createDataFrame([("99999999999",), ("3",)], "v string")
    assert R.infer_types(big) == {"v": "bigint"} and R.infer_types(big.limit(0)) == {"v": "string"}
    assert R.infer_types(spark.createDataFrame([("9" * 19,)], "v string")) == {"v": "double"}
