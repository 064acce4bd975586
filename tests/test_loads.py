"""Every branch of the load patterns, idempotence, and the five change scenarios."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dimloom.operators import loads as L
from dimloom.operators.compare import compare
from dimloom.operators.profiling import scd2_health
from tests.conftest import rows

T0, T1, T2 = (dt.datetime(2011, 5, 31), dt.datetime(2012, 1, 1), dt.datetime(2013, 1, 1))
DIM = "sk bigint, id int, name string, city string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean"
SRC = "id int, name string, city string"


def at(t):
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def dim(spark, *data):
    return spark.createDataFrame([(i + 1, *d, T0, None, True) for i, d in enumerate(data)], DIM)


TRACKED = {"name": "null_safe", "city": "null_safe"}


def test_scd2_all_four_cases(spark):
    target = dim(spark, (1, "a", "x"), (2, "b", "y"), (3, None, "z"), (4, "gone", "w"))
    source = spark.createDataFrame([(1, "a", "x"), (2, "B", "y"), (3, "c", "z"), (9, "new", "n")], SRC)
    out = L.scd2_merge(target, source, ["id"], TRACKED, at(T1), surrogate="sk")
    assert rows(out, "sk", "id", "name", "valid_to", "is_current") == rows(spark.createDataFrame([
        (1, 1, "a", None, True), (2, 2, "b", T1, False), (3, 3, None, T1, False), (4, 4, "gone", None, True),
        (5, 2, "B", None, True), (6, 3, "c", None, True), (7, 9, "new", None, True),
    ], "sk bigint, id int, name string, valid_to timestamp_ntz, is_current boolean"))


def test_scd2_keeps_rows_without_a_flag(spark):
    target = dim(spark, (1, "a", "x"), (2, "b", "y"))
    target = target.withColumn("is_current", F.when(F.col("id") != 1, F.col("is_current")))
    source = spark.createDataFrame([(2, "B", "y")], SRC)
    for numbering in ("sequence", "hash"):
        out = L.scd2_merge(target, source, ["id"], TRACKED, at(T1), surrogate="sk", numbering=numbering)
        assert rows(out, "id", "name", "is_current") == [(1, "a", None), (2, "B", True), (2, "b", False)]


def test_scd2_same_batch_twice_changes_nothing(spark):
    target = dim(spark, (1, "a", "x"), (2, "b", "y"))
    source = spark.createDataFrame([(1, "A", "x"), (3, "c", "z")], SRC)
    once = L.scd2_merge(target, source, ["id"], TRACKED, at(T1), surrogate="sk")
    twice = L.scd2_merge(once, source, ["id"], TRACKED, at(T2), surrogate="sk")
    assert compare(once, twice).first()["equivalent"]


def test_scd2_stays_healthy_under_random_batches(spark):
    rng = random.Random(3)
    table = dim(spark, *[(i, "n", "c") for i in range(20)])
    for day in range(1, 5):
        batch = spark.createDataFrame([(i, rng.choice("nmo"), rng.choice(["c", "d", None])) for i in rng.sample(range(30), 15)], SRC)
        table = L.scd2_merge(table, batch, ["id"], TRACKED, at(T1 + dt.timedelta(days=day)), surrogate="sk").checkpoint()
    health = scd2_health(table, ["id"]).first()
    assert health["healthy"] and health["gaps"] == 0 and health["no_current"] == 0 and health["many_current"] == 0
    assert scd2_health(table, ["id"], hot_rows=1, segments=3).first() == health
    assert table.count() == table.select("sk").distinct().count()


def test_scd2_change_modes(spark):
    target = dim(spark, (1, None, "x"), (2, "", "x"), (3, "a", "x"))
    source = spark.createDataFrame([(1, "", "x"), (2, None, "x"), (3, None, "x")], SRC)

    def changed(mode):
        out = L.scd2_merge(target, source, ["id"], {"name": mode}, at(T1))
        return [r["id"] for r in out.where("NOT is_current").orderBy("id").collect()]

    assert changed("null_safe") == [1, 2, 3]
    assert changed(("sentinel", "")) == [3]
    assert changed("plain") == []


def test_repeated_source_key_fails_or_is_deduplicated(spark):
    target, source = dim(spark, (1, "a", "x")), spark.createDataFrame([(1, "b", "x"), (1, "c", "x")], SRC)
    with pytest.raises(Exception, match="repeated key"):
        L.scd2_merge(target, source, ["id"], TRACKED, at(T1)).collect()
    with pytest.raises(Exception, match="repeated key"):
        L.scd1_merge(target, source, ["id"]).collect()
    out = L.scd2_merge(target, source, ["id"], TRACKED, at(T1), duplicates="latest")
    assert rows(out.where("is_current"), "name") == [("c",)]


def test_scd2_empty_sides(spark):
    target, none = dim(spark, (1, "a", "x")), spark.createDataFrame([], SRC)
    assert compare(L.scd2_merge(target, none, ["id"], TRACKED, at(T1)), target).first()["equivalent"]
    first = L.scd2_merge(spark.createDataFrame([], DIM), spark.createDataFrame([(1, "a", "x")], SRC), ["id"], TRACKED, at(T1), surrogate="sk")
    assert rows(first, "sk", "id", "is_current") == [(1, 1, True)]


def test_scd2_hash_keys_are_stable(spark):
    target, source = dim(spark, (1, "a", "x")), spark.createDataFrame([(1, "b", "x"), (2, "c", "y")], SRC)
    one, two = (L.scd2_merge(target, source, ["id"], TRACKED, at(T1), surrogate="sk", numbering="hash") for _ in range(2))
    assert rows(one) == rows(two) and one.select("sk").distinct().count() == 3


def test_scd1_branches(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "id int, name string, extra int")
    source = spark.createDataFrame([(1, "A"), (2, None), (4, "d")], "id int, name string")
    assert rows(L.scd1_merge(target, source, ["id"])) == [(1, "A", 10), (2, None, 20), (3, "c", 30), (4, "d", None)]
    assert rows(L.scd1_merge(target, source, ["id"], on_missing="delete")) == [(1, "A", 10), (2, None, 20), (4, "d", None)]
    assert rows(L.scd1_merge(target, source, ["id"], insert=False)) == [(1, "A", 10), (2, None, 20), (3, "c", 30)]
    gone = L.scd1_merge(target, source, ["id"], on_missing="expire", expire={"name": F.lit("expired")})
    assert rows(gone, "id", "name") == [(1, "A"), (2, None), (3, "expired"), (4, "d")]


def test_incremental_append_twice_loads_once(spark):
    source = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, 1, "c")], "o int, l int, v string")
    empty = spark.createDataFrame([], "o int, l int, v string")
    first = L.incremental_append(empty, source, ["o", "l"], dedup_order=["v"])
    assert rows(first) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    assert L.incremental_append(first, source, ["o", "l"], dedup_order=["v"]).count() == 0
    assert rows(L.incremental_append(empty, source, ["o", "l"], since=F.col("o") >= 2)) == [(2, 1, "c")]


def test_accumulating_snapshot_fills_once(spark):
    kind = "id int, ordered date, shipped date, invoiced date"
    d = [dt.date(2020, 1, n) for n in range(1, 10)]
    target = spark.createDataFrame([(1, d[0], d[1], None), (2, d[0], None, None)], kind)
    source = spark.createDataFrame([(1, d[5], d[6]), (2, d[5], d[3]), (3, d[2], None)], "id int, ordered date, shipped date")
    out = L.accumulating_snapshot(target, source, ["id"], ["shipped", "invoiced"],
                                  [("invoiced", lambda c: F.date_add(c, 5), "shipped")], {"lag": ("ordered", "shipped")})
    assert rows(out) == [(1, d[0], d[1], d[6], 1), (2, d[0], d[3], d[8], 3), (3, d[2], None, None, None)]
    assert rows(L.accumulating_snapshot(out.drop("lag"), source, ["id"], ["shipped", "invoiced"])) == rows(out.drop("lag"))


def test_periodic_snapshot_and_partition_overwrite(spark, tmp_path):
    old = spark.createDataFrame([(1, "d1", 5), (1, "d2", 6)], "id int, day string, n int")
    new = spark.createDataFrame([(1, "d2", 7), (2, "d2", 8)], "id int, day string, n int")
    assert rows(L.periodic_snapshot(old, new, "day")) == [(1, "d1", 5), (1, "d2", 7), (2, "d2", 8)]
    assert rows(L.periodic_snapshot(old, new, "day", F.lit("d2"))) == rows(L.periodic_snapshot(old, new, "day"))
    path = str(tmp_path / "snap")
    L.write_periods(old, path, "day")
    L.write_periods(new, path, "day")
    assert rows(spark.read.parquet(path), "id", "day", "n") == [(1, "d1", 5), (1, "d2", 7), (2, "d2", 8)]


@pytest.mark.parametrize("strategy", ["merge", "microbatch", "delete+insert"])
def test_keyed_strategies_agree(spark, strategy):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, ts int")
    source = spark.createDataFrame([(2, "B", 2), (3, "c", 2)], "id int, v string, ts int")
    assert rows(L.incremental(target, source, strategy, keys=["id"], watermark="ts")) == [(1, "a", 1), (2, "B", 2), (3, "c", 2)]


def test_strategy_arguments_are_checked(spark):
    df = spark.createDataFrame([(1,)], "id int")
    for strategy, kw in (("merge", {}), ("microbatch", {"keys": ["id"]}), ("insert_overwrite", {}), ("other", {})):
        with pytest.raises(ValueError):
            L.incremental(df, df, strategy, **kw)
    assert L.choose_materialization("dim_scd2") == "snapshot"
    assert L.choose_materialization("fact_transaction", "ts") == "incremental"
    assert L.choose_materialization("dim_scd1") == "table" and L.choose_materialization("x", is_view=True) == "view"
    assert [L.choose_strategy(k) for k in ("timestamp", "bigint")] == ["microbatch", "merge"]
    assert L.choose_strategy(None, append_only=True) == "append"
    assert L.choose_strategy("date", date_partitioned=True) == "insert_overwrite"


def test_snapshot_strategies(spark):
    kind = "id int, v string, updated timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean"
    target = spark.createDataFrame([(1, "a", T0, T0, None, True), (2, "b", T1, T1, None, True)], kind)
    source = spark.createDataFrame([(1, "A", T1), (2, "stale", T0), (3, "c", T1)], "id int, v string, updated timestamp_ntz")
    out = L.snapshot(target, source, ["id"], "timestamp", updated_at="updated")
    assert rows(out, "id", "v", "valid_to", "is_current") == [(1, "A", None, True), (1, "a", T1, False), (2, "b", None, True), (3, "c", None, True)]
    out = L.snapshot(target, source, ["id"], "check", check_cols=["v"], now=at(T2))
    assert rows(out.where("is_current"), "id", "v") == [(1, "A"), (2, "stale"), (3, "c")]


def test_apply_changes_takes_the_last_operation(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    feed = spark.createDataFrame([(1, "x", 1, "U"), (1, "y", 2, "U"), (2, None, 3, "D"), (4, "n", 1, "I"), (4, None, 2, "D"), (5, "m", 1, "I")],
                                 "id int, v string, seq int, op string")
    assert rows(L.apply_changes(target, feed, ["id"], "seq", "op")) == [(1, "y"), (3, "c"), (5, "m")]


def test_unknown_members(spark):
    target = L.with_unknown_members(dim(spark, (1, "a", "x")), "sk", "name")
    assert {r["sk"]: r["name"] for r in target.collect()}[-1] == "Not Applicable" and target.count() == 4
    fact = spark.createDataFrame([(10, 1), (11, 7), (12, None)], "f int, id int")
    out = L.resolve_key(fact, dim(spark, (1, "a", "x")), {"id": "id"}, "sk")
    assert rows(out, "f", "sk") == [(10, 1), (11, -1), (12, -1)]


def test_steps_report_and_name_the_failing_one(spark):
    report = L.run_steps(spark, [("one", lambda: 3), ("two", lambda: None)])
    assert rows(report, "step", "name", "status", "rows") == [(0, "one", "ok", 3), (1, "two", "ok", None)]
    with pytest.raises(RuntimeError, match=r"step 1 \(bad\)"):
        L.run_steps(spark, [("one", lambda: 1), ("bad", lambda: 1 / 0)])
    failed = L.run_steps(spark, [("one", lambda: 1), ("bad", lambda: 1 / 0), ("two", lambda: 2)], on_error="report")
    assert rows(failed, "name", "status", "rows", "error") == [
        ("bad", "error", None, "division by zero"), ("one", "ok", 1, None), ("two", "skipped", None, None)]


@pytest.mark.parametrize("empty", ["customer", "part", "orders", "supplier", None])
def test_full_load_stops_before_it_writes_if_an_input_is_empty(spark, tmp_path, empty):
    from dimloom.plans.reports import full_load
    from dimloom.plans.staging import TABLES, Staging

    day = dt.datetime(1998, 3, 1)
    given = {
        "customer": [(1, "Customer#1", 3, 10.0, "BUILDING"), (2, "Customer#2", 4, -1.0, "MACHINERY")],
        "supplier": [(1, "Supplier#1", 1, 5.0)], "part": [(1, "red gear", "Brand#11", "ECONOMY", 7, 10.0)],
        "orders": [(1, 1, "O", 9.0, day, "5-LOW"), (2, 2, "F", 9.0, day, "1-URGENT")],
        "lineitem": [(o, 1, 1, n, 3.0, 100.25, 0.1, 0.0, "N", "O", day) for o, n in ((1, 1), (1, 2), (2, 1))]}
    for name, table in given.items():
        spark.createDataFrame([] if name == empty else table, TABLES[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    t, out = Staging(spark, str(tmp_path)), tmp_path / "out"
    if empty is None:
        report = rows(full_load(t, str(out)), "step", "name", "status", "rows")
        assert report[0] == (0, "validate_staging_counts", "ok", 4) and report[3] == (3, "fct_sales", "ok", 3) and len(report) == 7
    else:
        with pytest.raises(RuntimeError, match=r"step 0 \(validate_staging_counts\) failed: .*staging table is empty: stg_"):
            full_load(t, str(out))
        assert not out.exists()


# ---- the five change scenarios ------------------------------------------------------
def test_delta_new_customer_gets_a_current_row(spark):
    out = L.scd2_merge(dim(spark, (1, "a", "x")), spark.createDataFrame([(1, "a", "x"), (99901, "new", "n")], SRC), ["id"], TRACKED, at(T1), surrogate="sk")
    assert rows(out.where("id = 99901"), "sk", "is_current") == [(2, True)]


def test_delta_address_change_makes_two_rows(spark):
    out = L.scd2_merge(dim(spark, (1, "a", "x")), spark.createDataFrame([(1, "a", "moved")], SRC), ["id"], {"city": "plain"}, at(T1), surrogate="sk")
    assert rows(out, "city", "valid_from", "valid_to", "is_current") == rows(spark.createDataFrame(
        [("x", T0, T1, False), ("moved", T1, None, True)], "c string, a timestamp_ntz, b timestamp_ntz, d boolean"))


@pytest.mark.parametrize("policy,expected", [(1, [("fixed", True)]), (2, [("a", False), ("fixed", True)])])
def test_delta_name_correction_by_policy(spark, policy, expected):
    from dimloom.operators.dimensions import apply_scd

    out = apply_scd(dim(spark, (1, "a", "x")).drop("sk"), spark.createDataFrame([(1, "fixed", "x")], SRC), ["id"], {"name": policy, "city": 1}, at(T1))
    assert rows(out, "name", "is_current") == expected


@pytest.mark.parametrize("mode,key", [("as_of", 1), ("current", 2)])
def test_delta_late_fact(spark, mode, key):
    versions = spark.createDataFrame([(1, 1, "a", "x", T0, T1, False), (2, 1, "b", "x", T1, None, True)], DIM)
    fact = spark.createDataFrame([(99901, 1, dt.datetime(2011, 6, 15))], "o int, id int, ts timestamp_ntz")
    out = L.as_of_join(fact, versions, {"id": "id"}, "ts", {"sk": "sk"}, mode=mode)
    assert rows(out, "o", "sk") == [(99901, key)]


def test_as_of_bounds_are_half_open(spark):
    versions = spark.createDataFrame([(1, 1, "a", "x", T0, T1, False), (2, 1, "b", "x", T1, None, True)], DIM)
    fact = spark.createDataFrame([(1, 1, T0), (2, 1, T1), (3, 1, dt.datetime(2000, 1, 1))], "o int, id int, ts timestamp_ntz")
    out = L.as_of_join(fact, versions, {"id": "id"}, "ts", {"sk": "sk"}, mode="as_of", how="left")
    assert rows(out, "o", "sk") == [(1, 1), (2, 2), (3, None)]


def test_delta_duplicate_staging_loads_one_row(spark):
    lines = spark.createDataFrame([(99902, 1, 5), (99902, 1, 5)], "o int, l int, q int")
    assert L.dedup(lines, ["o", "l"], ["q"]).count() == 1
