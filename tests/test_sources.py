import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimloom.sources import tables as IO
from dimloom.sources.files import Files
from dimloom.sources.manifest import ManifestTable
from dimloom.sources.types import ColumnSpec, TypeMappingError, reject_counts, spark_type, struct_from_specs, typed_ingest
from tests.conftest import rows


@pytest.mark.parametrize("tech,name,p,s,kind", [
    ("sql_server", "bigint", 0, 0, "bigint"), ("sql_server", "TINYINT", 0, 0, "smallint"), ("sql_server", "MONEY", 0, 0, "decimal(19,4)"),
    ("sql_server", "DECIMAL", 10, 2, "decimal(10,2)"), ("sql_server", "BIT", 0, 0, "boolean"), ("sql_server", "DATE", 0, 0, "date"),
    ("sql_server", "DATETIME2", 0, 0, "timestamp_ntz"), ("sql_server", "DATETIMEOFFSET", 0, 0, "timestamp"), ("sql_server", "REAL", 0, 0, "double"),
    ("oracle", "NUMBER", 0, 0, "decimal(38,10)"), ("oracle", "NUMBER", 4, 0, "smallint"), ("oracle", "NUMBER", 9, 0, "int"),
    ("oracle", "NUMBER", 18, 0, "bigint"), ("oracle", "NUMBER", 20, 0, "decimal(20,0)"), ("oracle", "NUMBER", 10, 2, "decimal(10,2)"),
    ("oracle", "DATE", 0, 0, "timestamp_ntz"), ("oracle", "TIMESTAMP(6)", 0, 0, "timestamp_ntz"), ("oracle", "RAW", 0, 0, "binary"),
    ("oracle", "BINARY_DOUBLE", 0, 0, "double")])
def test_type_mapping(tech, name, p, s, kind):
    assert spark_type(tech, name, p, s).simpleString() == kind


@pytest.mark.parametrize("tech,name", [("sql_server", "GEOGRAPHY"), ("oracle", "XMLTYPE"), ("mysql", "INT")])
def test_unsupported_types(tech, name):
    with pytest.raises(TypeMappingError):
        spark_type(tech, name)


def test_text_length_is_kept(spark):
    schema = struct_from_specs("sql_server", [ColumnSpec("a", "NVARCHAR", max_length=50), ColumnSpec("b", "VARCHAR", max_length=-1)])
    assert schema["a"].metadata["max_length"] == 25 and "max_length" not in schema["b"].metadata


def test_typed_ingest_counts_rejects(spark):
    raw = spark.createDataFrame([("1", "2.5", "ab ", ""), ("x", None, "abcd", "n"), ("3", "oops", "ab", "ok")], "a string, b string, c string, d string")
    specs = [ColumnSpec("a", "INT"), ColumnSpec("b", "DECIMAL", precision=9, scale=2), ColumnSpec("c", "CHAR", max_length=3), ColumnSpec("d", "VARCHAR")]
    out = typed_ingest(raw, "sql_server", specs, empty_as_null=True)
    assert [tuple(r) for r in out.select("a", "c", "d", "_rejected").collect()] == [(1, "ab", None, 0), (None, None, "n", 2), (3, "ab", "ok", 1)]
    assert tuple(reject_counts(out).first()) == (3, 3, 2)


def test_orderable_columns():
    schema = T.StructType.fromDDL("a int, b binary, c map<int,int>, d array<int>, e struct<x:binary>, f string")
    assert IO.orderable_columns(schema) == ["a", "d", "f"]


def test_copy_plan_rules(spark):
    tables = {"S.A": lambda: None, "S.B": lambda: None}
    assert [p.name for p in IO.plan_copies(tables, exclude=["s.b"])] == ["s.a"]
    assert IO.plan_copies(tables, select=["s.A"], filters=["S.a= x = 1"])[0].predicate == "x = 1"
    for kw, message in (({"select": ["s.c"]}, "no such table: s.c"), ({"exclude": ["s.c"]}, "no such table"), ({"filters": ["s.a"]}, "not a name=predicate"),
                        ({"filters": ["=x"]}, "not a name=predicate"), ({"exclude": ["s.a"], "filters": ["s.a=x"]}, "not copied: s.a")):
        with pytest.raises(ValueError, match=message):
            IO.plan_copies(tables, **kw)
    with pytest.raises(ValueError, match="1 or more"):
        IO.replicate(spark, tables, str, limit=0)
    assert rows(IO.replicate(spark, tables, str, limit=5, dry_run=True), "fqn", "status") == [("s.a", "planned"), ("s.b", "planned")]


def test_signature_sees_a_value_move_between_columns(spark):
    a, b = (spark.createDataFrame([r], "x string, y string") for r in (("a", None), (None, "a")))
    assert IO.content_signature(a) != IO.content_signature(b)


def test_replace_append_truncate(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert IO.replace_rows(one, path) == 1 and IO.replace_rows(two, path) == 2
    assert rows(spark.read.parquet(path)) == [(2,), (3,)]
    # a table may be replaced by something computed from itself
    assert IO.replace_rows(spark.read.parquet(path).withColumn("x", F.col("x") + 10), path) == 2
    IO.append_rows(one, path)
    assert rows(spark.read.parquet(path)) == [(1,), (12,), (13,)]
    IO.truncate_rows(spark, path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["x"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_failed_replace_keeps_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    IO.replace_rows(spark.createDataFrame([(1,)], "x int"), path)
    bad = spark.range(3).select(F.raise_error(F.lit("stop")).cast("int").alias("x"))
    with pytest.raises(Exception, match="stop"):
        IO.replace_rows(bad, path)
    assert rows(spark.read.parquet(path)) == [(1,)]


def test_half_done_swap_is_taken_back(spark, tmp_path):
    path = str(tmp_path / "t")
    IO.replace_rows(spark.createDataFrame([(1,)], "x int"), path)
    Files(spark, path).move(path, f"{path}__outgoing")
    bad = spark.range(3).select(F.raise_error(F.lit("stop")).cast("int").alias("x"))
    with pytest.raises(Exception, match="stop"):
        IO.replace_rows(bad, path)
    assert rows(spark.read.parquet(path)) == [(1,)]


def test_seed_is_written_only_on_change(spark, tmp_path):
    path = str(tmp_path / "seed")
    df = spark.createDataFrame([(1, "a,\"b\"", dt.date(2020, 1, 1)), (2, None, None), (3, "", None), (4, "two\nlines", None)], "id int, s string, d date")
    assert IO.export_seed(df, path) == (True, 4)
    assert IO.export_seed(df.orderBy(F.col("id").desc()), path) == (False, 4)
    assert rows(IO.read_seed(spark, path, df.schema)) == rows(df)
    assert IO.export_seed(df.where("id < 3"), path) == (True, 2)
    assert IO.export_seed(df.drop("d"), path) == (True, 4)


def test_stable_sample_does_not_depend_on_partitioning(spark):
    df = spark.range(2000).toDF("k")
    one, two = IO.stable_sample(df.repartition(3), ["k"], 20), IO.stable_sample(df.repartition(11), ["k"], 20)
    assert rows(one) == rows(two) and 50 < one.count() < 160
    assert rows(one) != rows(IO.stable_sample(df, ["k"], 20, seed=7))


def test_referential_sample(spark):
    parent, child = spark.range(10).toDF("k"), spark.range(40).select((F.col("id") % 10).alias("k"), "id")
    head, lines = IO.referential_sample(parent, child, "k", 3, ["k"])
    assert rows(head) == [(0,), (1,), (2,)] and lines.count() == 12


def test_create_table(spark, tmp_path):
    path = str(tmp_path / "c")
    IO.create_table(spark, path, T.StructType.fromDDL("a int, b string"))
    assert spark.read.parquet(path).columns == ["a", "b"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        IO.create_table(spark, path, T.StructType.fromDDL("a int"))


def test_manifest_table_is_replaced_whole(spark, tmp_path):
    table = ManifestTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.replace(spark.range(5).toDF("x")) == 5
    reader = table.read()  # resolved before the swap
    assert table.replace(table.read().select((F.col("x") + 10).alias("x"))) == 5
    assert rows(reader, "x") == [(i,) for i in range(5)] and rows(table.read(), "x") == [(i,) for i in range(10, 15)]
    assert table.append(spark.range(1).toDF("x")) == 1 and table.read().count() == 6
    # A writer that fails, before or while it writes its manifest, leaves the table as it was.
    with pytest.raises(Exception):
        table.replace(spark.range(3).select(F.raise_error(F.lit("boom")).cast("bigint").alias("x")))
    broken = tmp_path / "t" / "manifest" / "000000000004.json"
    broken.write_text('{"folders": [')
    assert table.newest() == 3 and table.read().count() == 6
    # The next writer goes on behind it; a second one with the same number fails.
    assert table.replace(spark.range(2).toDF("x")) == 2 and table.newest() == 5
    with pytest.raises(Exception):
        table._files.create_text(table._manifest(5), "again")
    assert table.read(1).count() == 5
    table.vacuum(keep=1)
    assert table.versions() == [5] and table.read().count() == 2 and len(list((tmp_path / "t" / "data").iterdir())) == 1
