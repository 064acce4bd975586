"""Snapshots compared by digests, and profiles merged from sketches, against plain recomputation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dimloom.operators import profiling as P
from dimloom.operators.digests import Snapshot, changed_rows, differing_buckets, same_rows
from dimloom.operators.sketches import ProfileLog
from dimloom.session import scratch_path

SCHEMA = "id int, part string, v string"


def stored(spark, rows, bits=8, keys=("id", "part")):
    return Snapshot(spark, scratch_path(spark, "snapshot")).write(spark.createDataFrame(rows, SCHEMA), keys, bits)


def by_brute_force(old, new):
    def grouped(rows):
        out = {}
        for r in rows:
            out.setdefault(r[:2], []).append(str(r[2:]))
        return {k: sorted(v) for k, v in out.items()}

    a, b = grouped(old), grouped(new)
    return sorted(((*k, "new" if k not in a else "removed" if k not in b else "changed") for k in {*a, *b} if a.get(k) != b.get(k)), key=str)


@pytest.mark.parametrize("bits", [(8, 8), (4, 8), (8, 4)])
def test_changes_against_brute_force(spark, bits):
    rng = random.Random(5)
    old = [(i % 300, rng.choice(["a", "b", None]), rng.choice([None, "", "x", "X "])) for i in range(600)]
    old += [(None, None, "n"), (None, "a", None)] + [(7, "hot", f"v{i % 5}") for i in range(900)]
    new = [(i, p, "changed" if i == 12 else v) for i, p, v in old if i != 40] + [(1000, "a", "y"), (1000, "a", "y"), (None, "z", "n")]
    # A copy more of one row, and one of the hot key's rows gone.
    new += [old[3]]
    new.remove((7, "hot", "v1"))
    got = changed_rows(stored(spark, old, bits[0]), stored(spark, new, bits[1]))
    assert sorted(map(tuple, got.collect()), key=str) == by_brute_force(old, new)


def test_only_changed_buckets_are_read(spark):
    old = [(i, "a", f"v{i}") for i in range(2000)]
    new = [*old[:77], (77, "a", "other"), *old[78:]]
    a, b = stored(spark, old), stored(spark, new)
    bits, buckets = differing_buckets(a, b)
    assert bits == 8 and len(buckets) == 1
    plan = changed_rows(a, b)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(rf"PartitionFilters: \[[^\]]*_bucket#\d+ = {buckets[0]}\b", plan)) == 2
    assert changed_rows(a, b).collect() == [(77, "a", "changed")]


def test_equal_and_empty_snapshots(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, None, None)]
    a, b, empty = stored(spark, rows), stored(spark, rows[::-1], 4), stored(spark, [])
    assert same_rows(a, b) and not same_rows(a, empty) and same_rows(empty, stored(spark, []))
    assert not same_rows(a, stored(spark, rows[1:]))
    assert changed_rows(a, b).count() == 0
    assert sorted(map(tuple, changed_rows(empty, a).collect()), key=str) == [(1, "a", "new"), (2, None, "new")]
    assert {r.status for r in changed_rows(a, empty).collect()} == {"removed"}


def test_snapshots_of_other_columns_are_refused(spark):
    other = Snapshot(spark, scratch_path(spark, "snapshot")).write(spark.createDataFrame([(1, "a")], "id int, part string"), ["id"])
    with pytest.raises(ValueError):
        differing_buckets(stored(spark, [(1, "a", "x")]), other)
    with pytest.raises(ValueError):
        stored(spark, [(1, "a", "x")], 5)


def test_profile_of_batches_equals_a_fresh_one(spark):
    df = spark.range(30000).select(
        F.col("id").cast("int").alias("n"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 700)).alias("s"),
        (F.col("id") / 7 - 1000).alias("d"), F.lit(None).cast("string").alias("none"), F.timestamp_seconds(F.col("id")).alias("at"))
    log = ProfileLog(spark, scratch_path(spark, "profile"))
    for i in range(3):
        log.record(df.where(F.col("n") % 3 == i), i)
    log.record(df.where("n % 3 = 1"), 1)
    assert log.batches() == [0, 1, 2]
    got = {r.column_name: r for r in log.read().collect()}
    want = {r.column_name: r for r in P.profile_columns(df).collect()}
    assert set(got) == set(want)
    for name, w in want.items():
        g = got[name]
        assert (g.type, g.rows, g.nulls, g.null_share) == (w.type, w.rows, w.nulls, w.null_share)
        assert abs(g.distinct_values - w.distinct_values) <= 0.08 * w.distinct_values
        assert (g.least, g.greatest) == (w.least, w.greatest)
    assert got["none"].quantiles is None and got["s"].quantiles is None
    for name, low, high in (("n", 0, 29999), ("d", -1000, 30000 / 7 - 1000)):
        for share, value in zip((0.25, 0.5, 0.75), got[name].quantiles):
            assert abs((value - low) / (high - low) - share) < 0.03


def test_recording_reads_only_the_batch(spark):
    log = ProfileLog(spark, scratch_path(spark, "profile"))
    log.record(spark.createDataFrame([(9,), (10,)], "n int"), 1)
    log.record(spark.createDataFrame([], "n int"), 2)
    row = log.read().first()
    assert (row.rows, row.least, row.greatest, row.distinct_values) == (2, "9", "10", 2)
