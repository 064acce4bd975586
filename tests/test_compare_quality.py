import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimloom.operators import compare as C
from dimloom.operators import quality as Q
from tests.conftest import rows


def df(spark, data, kind="id int, v string"):
    return spark.createDataFrame(data, kind)


@pytest.mark.parametrize("a,b,only_a,only_b", [
    ([(1, "x")], [(1, "x")], 0, 0), ([(1, "x"), (2, "y")], [(1, "x")], 1, 0), ([(1, "x")], [(1, "x"), (2, "y")], 0, 1),
    ([(1, "x"), (1, "x")], [(1, "x")], 1, 0), ([], [], 0, 0), ([(1, "x")], [(2, "y")], 1, 1), ([(None, None)], [(None, None)], 0, 0)])
def test_compare_counts_copies(spark, a, b, only_a, only_b):
    r = C.compare(df(spark, a), df(spark, b)).first()
    assert (r["a_count"], r["b_count"], r["a_minus_b"], r["b_minus_a"]) == (len(a), len(b), only_a, only_b)
    assert r["equivalent"] == (only_a == only_b == 0)


def test_compare_reads_values_as_text_and_columns_by_name(spark):
    a, b = df(spark, [(1, "x")]), spark.createDataFrame([("x", "1")], "v string, id string")
    assert C.compare(a, b).first()["equivalent"]
    with pytest.raises(ValueError):
        C.compare(a, b.withColumnRenamed("v", "w"))


@pytest.mark.parametrize("sql", ["DELETE FROM t", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "", "DROP TABLE t"])
def test_only_queries_are_compared(sql):
    with pytest.raises(ValueError):
        C.require_query(sql)


@pytest.mark.parametrize("sql", ["SELECT 'delete; drop' AS x", "with a as (select 1) select * from a;", "SELECT updated FROM t -- delete"])
def test_queries_pass_the_guard(sql):
    C.require_query(sql)


def test_examples_are_limited_per_side(spark):
    out = C.examples(df(spark, [(i, "a") for i in range(9)]), df(spark, [(i, "b") for i in range(3)]))
    assert rows(out.groupBy("side").count()) == [("a", 5), ("b", 3)]


def test_normalize(spark):
    data = spark.createDataFrame([(True, dt.datetime(2020, 1, 2, 3, 4), 1.005, None)], "A boolean, b timestamp_ntz, c double, d string")
    assert tuple(C.normalize(data).first()) == ("1", "2020-01-02", "1.0", "__NULL__")


def test_parity_ignores_copies_and_small_fractions(spark):
    a = {"t": spark.createDataFrame([(1, 1.001), (1, 1.001)], "id int, v double")}
    assert C.parity(a, {"t": spark.createDataFrame([(1, 1.002)], "id int, v double")}).first()["ok"]
    r = C.parity(a, {"t": spark.createDataFrame([(1, 1.1)], "id int, v double")}).first()
    assert (r["only_a"], r["only_b"], r["ok"]) == (1, 1, False)


def test_snapshot_difference(spark):
    old, new = df(spark, [(1, "a"), (2, "b"), (3, "c"), (5, "Smith"), (6, "x y")]), df(spark, [(1, "a"), (2, "x"), (4, "d"), (5, "SMITH"), (6, "x  y")])
    assert rows(C.snapshot_diff(old, new, ["id"])) == [
        (1, "unchanged"), (2, "changed"), (3, "removed"), (4, "new"), (5, "changed"), (6, "changed")]
    hashed = spark.createDataFrame([(1, None)], "id int, h string"), spark.createDataFrame([(1, "q")], "id int, h string")
    assert rows(C.snapshot_diff(*hashed, ["id"], "h")) == [(1, "changed")]


def test_contract_failures(spark):
    tables = {"child": df(spark, [(1, "a"), (1, "b"), (None, "b"), (3, None)]), "parent": df(spark, [(1, "a")])}
    out = Q.check_contract(tables, {"child": Q.TableContract(["id", "v"], [["id"], ["id", "v"]], {"id": ("parent", "id"), "v": ("missing", "k")})})
    assert rows(out, "column_name", "test", "failures") == [
        ("id", "not_null", 1), ("id", "relationships", 1), ("id", "unique", 1), ("id+v", "unique", 0), ("v", "not_null", 1)]


def test_non_empty(spark):
    tables = {"a": df(spark, [(1, "x")]), "b": df(spark, [])}
    assert rows(Q.check_non_empty(tables, raise_on_empty=False)) == [("a", 1, "ok"), ("b", 0, "empty")]
    with pytest.raises(Exception, match="staging table is empty: b"):
        Q.check_non_empty(tables).collect()


def test_an_empty_table_stops_every_reader(spark):
    """Counting the rows or reading the names alone asks for no status, and must not pass."""
    full, empty = df(spark, [(1, "x"), (2, "y")]), df(spark, [])
    for tables in ({"a": full, "b": empty}, {"b": empty, "a": full}, {"b": empty}):
        for read in (lambda out: out.count(), lambda out: out.select("table_name").collect(), lambda out: out.select("rows").collect()):
            with pytest.raises(Exception, match="staging table is empty: b"):
                read(Q.check_non_empty(tables))
        assert Q.check_non_empty(tables, raise_on_empty=False).count() == len(tables)
    assert Q.check_non_empty({"a": full, "c": full}).count() == 2


@pytest.mark.parametrize("hours,status", [(1, "pass"), (24, "pass"), (25, "warn"), (48, "warn"), (49, "error")])
def test_freshness_levels(spark, hours, status):
    loaded = dt.datetime(2020, 1, 1)
    now = F.lit((loaded + dt.timedelta(hours=hours)).isoformat(" ")).cast("timestamp_ntz")
    assert Q.freshness(spark.createDataFrame([(loaded,)], "ts timestamp_ntz"), "ts", now).first()["status"] == status
    assert Q.freshness(spark.createDataFrame([], "ts timestamp_ntz"), "ts", now).first()["status"] == "error"


def test_pii_actions(spark):
    data = spark.createDataFrame([(1, "Ab1", "k", "keep"), (2, None, None, "keep")], "id int, m string, t string, c string")
    out = Q.apply_pii(data, {"m": "mask", "t": "tokenize", "c": "drop", "id": "keep"}, "salt")
    assert out.columns == ["id", "m", "t"]
    first = out.where("id = 1").first()
    assert first["m"] == "Xxn" and len(first["t"]) == 64 and out.where("id = 2").first()["t"] is None
    again = Q.apply_pii(data, {"t": "tokenize"}, "other").where("id = 1").first()["t"]
    assert again != first["t"]
    with pytest.raises(ValueError):
        Q.apply_pii(data, {"m": "blur"}, "s")


def test_locked_schema(spark):
    data, want = df(spark, [(1, "a")]), T.StructType.fromDDL("id int, v string")
    assert Q.check_schema(data, want) is data
    for bad in ("id bigint, v string", "id int", "v string, id int", "id int, v string, w int"):
        with pytest.raises(ValueError, match="locked"):
            Q.check_schema(data, T.StructType.fromDDL(bad))
