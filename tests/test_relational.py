import pytest
from pyspark.sql import functions as F

from dimloom.functions import scalar as X
from dimloom.operators import relational as R
from tests.conftest import rows


def frame(spark, values, kind="x int"):
    return spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], kind)


@pytest.mark.parametrize("left,right", [
    ([1, 2, None], []), ([1, 2, None], [2]), ([1, 2, None], [2, None]), ([], [1]), ([None], [None]), ([1, 1], [2])])
def test_not_in_follows_sql(spark, left, right):
    a, b = frame(spark, left), frame(spark, right, "y int")
    a.createOrReplaceTempView("not_in_a")
    b.createOrReplaceTempView("not_in_b")
    wanted = rows(spark.sql("SELECT x FROM not_in_a WHERE x NOT IN (SELECT y FROM not_in_b)"))
    assert rows(R.not_in(a, "x", b, "y")) == wanted
    flagged = R.flag_not_in(a, "x", b, "y", "ok")
    assert rows(flagged.where("ok"), "x") == wanted and flagged.count() == len(left)


def test_delete_keeps_unknown(spark):
    df = frame(spark, [1, 2, None])
    assert rows(R.delete_where(df, F.col("x") == 1)) == [(None,), (2,)]


def test_update_where_and_from(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, v string")
    assert rows(R.update_where(df, F.col("id") > 1, {"v": F.lit("Z")})) == [(None, "c"), (1, "a"), (2, "Z")]
    src = spark.createDataFrame([(2, None)], "id int, v string")
    assert rows(R.update_from(df, src, {"id": "id"}, {"v": "v"})) == [(None, "c"), (1, "a"), (2, None)]
    assert rows(R.update_from(df, src, {"id": "id"}, {"v": "v"}, keep_unmatched=False)) == [(2, None)]


def test_delete_top_removes_the_first_n(spark):
    df = frame(spark, list(range(10)))
    left = R.delete_top(df, F.col("x") >= 3, 4, ["x"], ["x"])
    assert rows(left) == [(0,), (1,), (2,), (7,), (8,), (9,)]


def test_apply_forms(spark):
    outer = frame(spark, [1, 2, 3])
    inner = spark.createDataFrame([(1, 5), (1, 9), (1, 7), (1, 8), (2, 4)], "k int, v int")
    top = R.apply_top_k(outer, inner, {"x": "k"}, ["-v"], 3, {"v": "v"})
    assert rows(top) == [(1, 7), (1, 8), (1, 9), (2, 4)]
    assert (3, None) in rows(R.apply_top_k(outer, inner, {"x": "k"}, ["-v"], 1, {"v": "v"}, keep_unmatched=True))
    agg = R.apply_aggregate(outer, inner, {"x": "k"}, {"n": F.count(F.lit(1)), "m": F.max("v")}, {"n": 0})
    assert rows(agg) == [(1, 4, 9), (2, 1, 4), (3, 0, None)]


def test_latest_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    out = R.latest_per_key(df, ["k"], ["-v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("WindowGroupLimit") == 2
    assert rows(out) == [(0, 999), (1, 997), (2, 998)]


def test_allocation_adds_up(spark):
    df = spark.createDataFrame([(1, 9.0), (1, 9.0), (1, 9.0), (2, 5.0)], "k int, amount double").withColumn(
        "amount", F.col("amount").cast("decimal(18,4)"))
    assert [float(r["amount"]) for r in R.allocate(df, ["k"], ["amount"]).orderBy("k").collect()] == [3.0, 3.0, 3.0, 5.0]


def test_pivot_unpivot_roundtrip(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 7), (2, "a", 1)], "d int, c string, v int")
    wide = R.pivot_sum(df, ["d"], "c", {"a": "a", "b": "b"}, {"v": "v"}, fill=0)
    assert rows(wide) == [(1, 5, 7), (2, 1, 0)]
    narrow = R.unpivot_pairs(wide, ["d"], {"a_v": "a", "b_v": "b"}, "c", "v")
    assert R.roundtrip_counts(wide, narrow, 2).first()["ok"]
    gaps = R.pivot_sum(df, ["d"], "c", {"a": "a", "b": "b"}, {"v": "v"})
    dropped = R.unpivot_pairs(gaps, ["d"], {"a_v": "a", "b_v": "b"}, "c", "v")
    assert not R.roundtrip_counts(gaps, dropped, 2).first()["ok"]
    assert R.unpivot_pairs(gaps, ["d"], {"a_v": "a", "b_v": "b"}, "c", "v", drop_nulls=False).count() == 4
    assert rows(R.unpivot_tuples(wide, ["d"], "c", {"A": {"v": "a_v"}, "B": {"v": "b_v"}})) == [
        (1, "A", 5), (1, "B", 7), (2, "A", 1), (2, "B", 0)]


@pytest.mark.parametrize("limit", [100, 4, 1])
def test_axis_of_any_size_gives_every_pair(spark, limit):
    df = frame(spark, [1, 2, 2, None])
    axis = frame(spark, [10, 11, 11, 12, 13, None], "day int")
    out = R.explode_axis(df, axis, "day", limit)
    assert rows(out) == rows(df.crossJoin(axis.distinct()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_batches_and_audit(spark):
    df = spark.range(25)
    sizes = R.assign_batches(df, ["id"], 10).groupBy("batch_id").count()
    assert rows(sizes) == [(1, 10), (2, 10), (3, 5)]
    assert rows(R.assign_batches(df, ["id"], 10, hot_rows=0, segments=4).groupBy("batch_id").count()) == rows(sizes)
    assert "_loaded_at" in R.with_audit(df, "r", F.current_timestamp()).columns
    assert R.with_audit(df, "r", materialization="incremental").columns == ["id", "_run_id"]
    with pytest.raises(ValueError):
        R.with_audit(df, "r")


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ab ", None, 7, 12345)], "a string, b string, n bigint, m bigint")
    out = df.select(
        X.concat_skip_null(F.col("a"), F.col("b"), F.lit("!")), X.length_no_trailing_blanks(F.col("a")), X.left_pad(F.col("n"), 3),
        X.left_pad(F.col("m"), 3), X.decode(F.col("b"), [(None, "none")], "some"), X.int_div(F.lit(-7).cast("bigint"), F.lit(2).cast("bigint")),
        X.int_div(F.col("n"), F.lit(0).cast("bigint")), X.empty_as_null(F.lit("")), X.after_separator(F.lit("x\\y"), "\\", 9),
        X.after_separator(F.lit("xy"), "\\", 9)).first()
    assert tuple(out) == ("ab !", 2, "007", "345", "none", -3, None, None, "y", "xy")


def test_row_hash_ignores_space_and_case(spark):
    df = spark.createDataFrame([(" A  b", "x"), ("a B", "X"), ("a b", None), ("a b", "")], "t string, u string")
    h = [r[0] for r in df.select(X.row_hash(["t", "u"])).collect()]
    assert h[0] == h[1] and len({h[1], h[2], h[3]}) == 3
