"""Streams give what the batch operators give, over several batches and after replays."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimloom.operators.compare import compare
from dimloom.operators.loads import scd2_history
from dimloom.streaming import loads as S
from dimloom.streaming.unique import UniqueTable
from tests.conftest import rows

KIND = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()), T.StructField("ts", T.TimestampNTZType())])


def day(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


@pytest.fixture()
def inbox(spark, tmp_path):
    """Three files, read one per batch in the order they were written."""
    batches = [[(1, "a", day(1)), (2, "b", day(1)), (2, "b", day(1))], [(1, "A", day(2)), (3, "c", day(2))], [(1, "A", day(3)), (2, "B", day(3)), (2, "b", day(1))]]
    path = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, KIND).coalesce(1).write.mode("append").parquet(path)
    return path, batches


def stream(spark, path):
    return S.read_stream(spark, path, KIND, files_per_batch=1)


def test_upsert_log(spark, inbox, tmp_path):
    log = S.UpsertLog(spark, str(tmp_path / "log"), KIND, ["id"], ["-ts"])
    S.run(stream(spark, inbox[0]), log.on_batch, str(tmp_path / "cp"))
    assert len(log.table.batches()) == 3
    assert rows(log.current(), "id", "v") == [(1, "A"), (2, "B"), (3, "c")]
    assert rows(log.compact(str(tmp_path / "log2")).current()) == rows(log.current())


def test_replayed_batch_leaves_the_same_table(spark, inbox, tmp_path):
    log = S.UpsertLog(spark, str(tmp_path / "log"), KIND, ["id"], ["-ts"])
    dim = S.Scd2Stream(spark, str(tmp_path / "dim"), T.StructType.fromDDL(DIM), ["id"], {"v": "null_safe"}, "ts")
    for i, b in enumerate(inbox[1]):
        df = spark.createDataFrame(b, KIND)
        for target in (log, dim):
            target.on_batch(df, i)
            before = rows(target.table.read())
            target.on_batch(df, i)
            assert rows(target.table.read()) == before


DIM = "id bigint, v string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean"


def scd2(spark, path):
    return S.Scd2Stream(spark, str(path), T.StructType.fromDDL(DIM), ["id"], {"v": "null_safe"}, "ts")


def test_scd2_stream_versions_and_late_rows(spark, inbox, tmp_path):
    dim = scd2(spark, tmp_path / "dim")
    S.run(stream(spark, inbox[0]), dim.on_batch, str(tmp_path / "cp"))
    assert rows(dim.read().where("is_current"), "id", "v") == [(1, "A"), (2, "B"), (3, "c")]
    assert rows(dim.read().where("NOT is_current"), "id", "v", "valid_to") == [(1, "a", day(2)), (2, "b", day(3))]
    # the last batch repeats a row of the first: not newer, so it is set aside
    assert rows(dim.late.read(), "id", "v", "ts") == [(2, "b", day(1))]
    before = rows(dim.read())
    dim.trim()
    assert rows(dim.read()) == before
    # Of the first batch only what a replay of the newest would look at is left.
    assert rows(dim.table.read().where("is_current and batch = 0"), "id") == [(2,)]


def test_scd2_stream_touches_only_its_buckets(spark, tmp_path):
    dim = scd2(spark, tmp_path / "dim")
    dim.on_batch(spark.createDataFrame([(i, "a", day(1)) for i in range(300)], KIND), 0)
    for n in range(1, 10):
        change = [(n, f"v{n}", day(1 + n)), (1000 + n, "new", day(1 + n))]
        for _ in range(1 + n % 2):  # a replay changes nothing
            dim.on_batch(spark.createDataFrame(change, KIND), n)
        touched = dim.table.read().where(f"batch = {n} and is_current").select("_bucket").distinct().count()
        assert touched <= 2 and dim.table.read().where(f"batch = {n} and is_current").count() < 40
    assert dim.read().where("is_current").count() == 309 and dim.read().where("not is_current").count() == 9
    assert dim.read().where("is_current").select("id").distinct().count() == 309
    whole = scd2(spark, tmp_path / "whole")
    whole.on_batch(spark.createDataFrame([(i, "a", day(1)) for i in range(300)] + [r for n in range(1, 10) for r in (
        (n, f"v{n}", day(1 + n)), (1000 + n, "new", day(1 + n)))], KIND), 0)
    assert rows(whole.read()) == rows(dim.read())
    dim.trim()
    assert rows(whole.read()) == rows(dim.read())


def test_scd2_stream_does_not_depend_on_batch_borders(spark, tmp_path):
    data = [(1, "a", day(1)), (1, "b", day(2)), (1, "b", day(3)), (1, "a", day(4)), (2, "x", day(1)), (2, None, day(5))]
    one, many = scd2(spark, tmp_path / "one"), scd2(spark, tmp_path / "many")
    one.on_batch(spark.createDataFrame(data, KIND), 0)
    for i, row in enumerate(sorted(data, key=lambda r: r[2])):
        many.on_batch(spark.createDataFrame([row], KIND), i)
    assert compare(one.read(), many.read()).first()["equivalent"]
    assert rows(one.read(), "id", "v", "valid_to") == rows(spark.createDataFrame([
        (1, "a", day(2)), (1, "b", day(4)), (1, "a", None), (2, "x", day(5)), (2, None, None)], "id bigint, v string, t timestamp_ntz"))
    hot = scd2_history(spark.createDataFrame([], DIM), spark.createDataFrame(data, KIND), ["id"], {"v": "null_safe"}, "ts", hot_rows=1, segments=3)
    assert compare(hot, one.read()).first()["equivalent"]


def unique(spark, path, **kw):
    return UniqueTable(spark, str(path), KIND, kw.pop("keys", ["id", "v"]), ["ts"], buckets=4, slots=8, **kw)


def test_append_new_across_batches(spark, inbox, tmp_path):
    loaded = spark.createDataFrame([(3, "c")], "id bigint, v string")
    table = unique(spark, tmp_path / "t", corrections=False, loaded=loaded)
    S.run(stream(spark, inbox[0]), table.on_batch, str(tmp_path / "cp"))
    assert rows(table.read(), "id", "v") == [(1, "A"), (1, "a"), (2, "B"), (2, "b")]
    table.on_batch(spark.createDataFrame([(1, "a", day(0)), (7, "new", day(0))], KIND), 9)
    # What came first stays, and the keys loaded before never come back.
    assert rows(table.read().where("id in (1, 7)"), "id", "v", "ts") == [(1, "A", day(2)), (1, "a", day(1)), (7, "new", day(0))]


HOURS = [(1, "a", dt.datetime(2020, 1, 1, h)) for h in (9, 0, 5)] + [(2, "b", None), (2, "b", None), (None, None, day(3)), (None, None, day(2)), (3, None, day(1)),
         (3, "x", day(1)), (3, None, day(9))] + [(i, "n", day(i % 5)) for i in range(10, 40)] * 2


@pytest.mark.parametrize("cuts", [1, 3, 9])
def test_duplicates_do_not_depend_on_the_batches(spark, tmp_path, cuts):
    table = unique(spark, tmp_path / "t")
    for i in range(cuts):
        batch = spark.createDataFrame(HOURS[i::cuts], KIND)
        for _ in range(1 + (i == 1)):  # a replay changes nothing
            table.on_batch(batch, i)
    # Null times come first in the order; a null is a key value.
    want = [(1, "a", dt.datetime(2020, 1, 1, 0)), (2, "b", None), (3, None, day(1)), (3, "x", day(1)), (None, None, day(2))]
    assert rows(table.read().where("id < 10 or id is null")) == sorted(want, key=lambda r: tuple((v is not None, str(v)) for v in r))
    assert rows(table.read().where("id >= 10")) == rows(spark.createDataFrame([(i, "n", day(i % 5)) for i in range(10, 40)], KIND))


def test_only_files_that_may_hold_a_key_are_read(spark, tmp_path):
    table = unique(spark, tmp_path / "t", keys=["id"])
    for i in range(6):
        table.on_batch(spark.createDataFrame([(i * 100 + j, "v", day(j % 9)) for j in range(50)], KIND), i)
        assert table.files_read == []  # all new: nothing stored is read
    table.on_batch(spark.createDataFrame([(207, "v", day(1)), (999_999, "v", day(1))], KIND), 6)
    assert [b for b, _ in table.files_read] == [2]
    plan = table._files(6)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "batch" in filters and "_bucket" in filters
    assert len(table._files(6).inputFiles()) >= 1 and table.read().count() == 301


def test_late_rows_read_no_stored_row(spark, tmp_path):
    good, late = (S.BatchTable(spark, str(tmp_path / x), KIND) for x in ("good", "late"))
    step = S.route_late(good, late, "ts", "2 days", spark.createDataFrame([(0, "old", day(4))], KIND))
    for i, days in enumerate([(1, 5), (2, 9), (3, 8), (None, 6)]):
        for _ in range(2):
            step(spark.createDataFrame([(i, "v", day(d) if d else None) for d in days], KIND), i)
    assert rows(late.read(), "ts") == [(day(1),), (day(2),), (day(3),), (day(6),)]
    # The newest time is all that later batches look at.
    files = S.Files(spark, good.path)
    files.remove(good.path)
    step(spark.createDataFrame([(9, "v", day(1))], KIND), 4)
    assert late.read().where("id = 9").count() == 1


def test_upsert_ignores_older_rows_of_later_batches(spark, tmp_path):
    log = S.UpsertLog(spark, str(tmp_path / "log"), KIND, ["id"], ["-ts"])
    log.on_batch(spark.createDataFrame([(1, "new", day(10))], KIND), 0)
    log.on_batch(spark.createDataFrame([(1, "old", day(5))], KIND), 1)
    assert rows(log.current(), "id", "v") == [(1, "new")]
    assert rows(log.compact(str(tmp_path / "log2")).current(), "id", "v") == [(1, "new")]


def test_late_rows_are_kept_apart(spark, inbox, tmp_path):
    good, late = S.BatchTable(spark, str(tmp_path / "good"), KIND), S.BatchTable(spark, str(tmp_path / "late"), KIND)
    S.run(stream(spark, inbox[0]), S.route_late(good, late, "ts", "12 hours"), str(tmp_path / "cp"))
    assert rows(late.read(), "id", "v") == [(2, "b")] and good.read().count() == 7


def test_change_feed_stream(spark, tmp_path):
    kind = "id bigint, v string, seq int, op string"
    start = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "id bigint, v string")
    feed = S.ChangeFeed(spark, str(tmp_path / "t"), start.schema, ["id"], "seq", "op", T.IntegerType(), start)
    feed.on_batch(spark.createDataFrame([(1, "x", 1, "U"), (2, None, 10, "D")], kind), 0)
    feed.on_batch(spark.createDataFrame([(3, "n", 3, "I"), (2, "back?", 5, "U")], kind), 1)
    # The older update does not bring the deleted key back; a newer one does.
    assert rows(feed.current(), "id", "v") == [(1, "x"), (3, "n"), (4, "d")]
    feed.on_batch(spark.createDataFrame([(2, "again", 11, "U")], kind), 2)
    assert rows(feed.current(), "id", "v") == [(1, "x"), (2, "again"), (3, "n"), (4, "d")]


def test_freshness_of_the_stream_so_far(spark, tmp_path):
    table = S.BatchTable(spark, str(tmp_path / "t"), T.StructType.fromDDL("max_loaded_at timestamp_ntz, status string"))
    step = S.monitor_freshness(table, "ts", F.lit(str(day(4))).cast("timestamp_ntz"))
    for i, at in enumerate((1, 3, 2)):
        step(spark.createDataFrame([(1, "a", day(at))], KIND), i)
    assert [r["status"] for r in table.read().orderBy("batch").collect()] == ["error", "pass", "pass"]


def test_half_written_batch_is_invisible(spark, inbox, tmp_path):
    table = S.BatchTable(spark, str(tmp_path / "t"), KIND)
    df = spark.createDataFrame(inbox[1][0], KIND)
    table.write(df, 0)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", False).parquet(table.folder(1))
    assert table.batches() == [0] and table.read().count() == 3
