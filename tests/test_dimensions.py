import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dimloom.operators import dimensions as D
from tests.conftest import rows


def test_date_dimension_against_the_calendar(spark):
    out = D.date_dim(spark, "2009-12-25", "2013-01-10").collect()
    assert len(out) == (dt.date(2013, 1, 10) - dt.date(2009, 12, 25)).days + 1
    for r in out:
        d = r["date_day"]
        assert r["date_key"] == int(d.strftime("%Y%m%d")) and r["day_of_week"] == d.isoweekday()
        assert r["day_of_week_name"] == d.strftime("%A") and r["month_name"] == d.strftime("%B")
        assert r["week_of_year"] == int(d.strftime("%W")) + 1 and r["day_of_year"] == d.timetuple().tm_yday
        assert r["quarter_number"] == (d.month - 1) // 3 + 1 and r["is_weekend"] == (d.weekday() >= 5)


def test_date_dimension_covers_whole_years(spark):
    df = spark.createDataFrame([(dt.datetime(2012, 5, 1),), (dt.datetime(2013, 2, 1),), (None,)], "ts timestamp_ntz")
    days = D.date_dim_for(df, "ts")
    assert days.count() == 366 + 365


@pytest.mark.parametrize("first,day,year,period", [(7, "2012-06-30", 2012, 12), (7, "2012-07-01", 2013, 1), (1, "2012-07-01", 2012, 7)])
def test_fiscal_columns(spark, first, day, year, period):
    r = D.with_fiscal(D.date_dim(spark, day, day), first).first()
    assert (r["fiscal_year"], r["fiscal_period"]) == (year, period)


def test_holiday_table_with_repeated_days(spark):
    days = D.date_dim(spark, "2012-01-01", "2012-01-03")
    off = spark.createDataFrame([(dt.date(2012, 1, 1),), (dt.date(2012, 1, 1),)], "date_day date")
    assert rows(D.with_fiscal(days, 1, off), "date_key", "is_holiday") == [(20120101, True), (20120102, False), (20120103, False)]


def test_junk_dimension_modes(spark):
    df = spark.createDataFrame([(True, "a"), (True, "b"), (False, "a"), (True, "a")], "x boolean, y string")
    seen, every = D.junk_dim(df, ["x", "y"]), D.junk_dim(df, ["x", "y"], "cross")
    assert seen.count() == 3 and every.count() == 4
    assert seen.join(every, "flag_key").count() == 3
    assert df.withColumn("flag_key", D.junk_key(["x", "y"])).join(seen, "flag_key").count() == 4
    with_null = df.unionByName(spark.createDataFrame([(None, "a")], "x boolean, y string"))
    assert D.junk_dim(with_null, ["x", "y"], "cross").count() == 6
    apart = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "a"), ("a", None), ("", "a")], "x string, y string")
    assert apart.select(D.junk_key(["x", "y"])).distinct().count() == 5


def test_bridge_weights_and_shared_groups(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (2, "a"), (3, "a")], "e int, m string")
    groups, members = D.bridge(pairs, "e", "m")
    g = {r["e"]: r["group_key"] for r in groups.collect()}
    assert g[1] == g[2] != g[3]
    assert all(abs(r["w"] - 1) < 1e-9 for r in members.groupBy("group_key").agg(F.sum("weight").alias("w")).collect())
    fact = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 5.0)], "e int, v double").join(groups, "e")
    total = D.weighted_sum(fact, members, "m", "v", "s").agg(F.sum("s")).first()[0]
    assert abs(total - 35.0) < 1e-9


def test_bands_and_minidimension(spark):
    df = spark.createDataFrame([(1, -5.0), (2, 0.0), (3, 10.0), (4, None)], "id int, v double")
    keyed, mini = D.minidimension(df, {"band": D.band("v", [0, 10], ["neg", "low", "high"])})
    assert rows(keyed.join(mini, "mini_key"), "id", "band") == [(1, "neg"), (2, "low"), (3, "high"), (4, None)]
    assert mini.count() == 4


def test_coverage_and_densify(spark):
    seen = spark.createDataFrame([("a", 1, 5), ("a", 3, 7), ("b", 2, 1)], "e string, p int, v int")
    spine = spark.createDataFrame([(1,), (2,), (3,)], "p int")
    gaps = D.coverage_gaps([seen.select("e"), spine], seen, ["e", "p"])
    assert rows(gaps, "e", "p") == [("a", 2), ("b", 1), ("b", 3)]
    assert rows(D.densify(seen, spine, seen, "e", "p", ["v"])) == [("a", 1, 5), ("a", 2, 0), ("a", 3, 7), ("b", 1, 0), ("b", 2, 1), ("b", 3, 0)]
    assert rows(D.densify(seen, spine, seen, "e", "p", ["v"], "carry")) == [
        ("a", 1, 5), ("a", 2, 5), ("a", 3, 7), ("b", 1, None), ("b", 2, 1), ("b", 3, 1)]


def test_carry_without_a_grid(spark):
    rng = random.Random(5)
    cells = [(e, p, rng.choice([None, rng.randrange(99)]), rng.randrange(99)) for e in "abcde" for p in range(60) if rng.random() < 0.1]
    df = spark.createDataFrame([*cells, ("stranger", 3, 1, 1), (None, 5, 1, 1), ("a", 999, 1, 1)], "e string, p int, v int, w int")
    spine = spark.createDataFrame([(p,) for p in range(0, 60, 2)] * 2, "p int")
    wanted = [*"abcde", "silent"]
    got = D.densify(df, spine, spark.createDataFrame([(e,) for e in wanted], "e string"), "e", "p", ["v", "w"], "carry")
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()
    expected, state = [], {}
    for e in wanted:
        for p in range(0, 60, 2):
            for _, _, v, w in [c for c in cells if c[:2] == (e, p)]:
                old = state.get(e, (None, None))
                state[e] = (old[0] if v is None else v, w)
            expected.append((e, p, *state.get(e, (None, None))))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    # Repeated cells stay, the gap behind them is filled once.
    twice = spark.createDataFrame([("a", 2, 1), ("a", 2, 1)], "e string, p int, v int")
    out = D.densify(twice, spine.where("p < 6"), twice, "e", "p", ["v"], "carry")
    assert rows(out) == [("a", 0, None), ("a", 2, 1), ("a", 2, 1), ("a", 4, 1)]


def test_aggregate_fact_by_additivity(spark):
    df = spark.createDataFrame([("x", 1, 1, 10), ("x", 1, 2, 30), ("x", 2, 1, 5)], "g string, e int, p int, v int").select(
        "*", F.col("v").alias("flow"), F.col("v").alias("level"), F.col("v").alias("ratio"))
    out = D.aggregate_fact(df, ["g"], {"flow": "additive", "level": "semi_additive", "ratio": "non_additive"}, period="p", entity=["e"])
    assert rows(out, "flow", "level", "ratio_sum", "ratio_count") == [(45, 35, 45, 3)]


def test_conformance_subset_is_conformed(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    assert D.conformance(a, b, "k", ["v"]).first()["conformed"]
    c = spark.createDataFrame([(1, "z"), (3, "y")], "k int, v string")
    r = D.conformance(a, c, "k", ["v"]).first()
    assert (r["only_a"], r["only_b"], r["shared"], r["mismatches"], r["conformed"]) == (1, 1, 1, 1, False)


def test_scd_policies_together(spark):
    t0, t1 = dt.datetime(2011, 1, 1), dt.datetime(2012, 1, 1)
    target = spark.createDataFrame([(1, "o", "n", "v", "s", None, t0, None, True)],
                                   "id int, a string, b string, c string, d string, prior_d string, "
                                   "valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean")
    source = spark.createDataFrame([(1, "O", "N", "V", "S")], "id int, a string, b string, c string, d string")
    out = D.apply_scd(target, source, ["id"], {"a": 0, "b": 1, "c": 2, "d": 3}, F.lit("2012-01-01").cast("timestamp_ntz"))
    assert rows(out, "a", "b", "c", "d", "prior_d", "is_current") == [
        ("o", "N", "V", "S", "s", True), ("o", "N", "v", "S", "s", False)]
    again = D.apply_scd(out, source, ["id"], {"a": 0, "b": 1, "c": 2, "d": 3}, F.lit("2013-01-01").cast("timestamp_ntz"))
    assert rows(again) == rows(out)
    assert t1 in {r["valid_from"] for r in out.collect()}
    with pytest.raises(ValueError):
        D.apply_scd(target, source, ["id"], {"a": 4}, F.current_timestamp())


def test_grain(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, None)], "a int, b int")
    r = D.check_grain(df, ["a", "b"]).first()
    assert (r["rows"], r["keys"], r["repeated_keys"], r["rows_with_null_key"], r["grain_holds"]) == (3, 2, 1, 1, False)
