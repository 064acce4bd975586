"""The segmented windows must give what a plain window gives, whatever the skew."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dimloom.operators.ordered import Out, ntile, ordered_window, rank, row_numbers, running_sum
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, a NULL group, small groups, many equal values."""
    rng = random.Random(5)
    data = []
    for i in range(900):
        group = "hot" if i % 3 == 0 else None if i % 17 == 0 else f"g{rng.randrange(40)}"
        data.append((i, group, rng.choice([1, 1, 1, 2, 3, None]) if i % 5 else None, rng.randrange(1000)))
    return spark.createDataFrame(data, "id int, g string, v int, x int").repartition(5)


@pytest.mark.parametrize("segments", [1, 3, 16])
def test_segmented_row_number_lag_and_sum(skewed, segments):
    w = W.partitionBy("g").orderBy("x", "id")
    plain = skewed.select("id", F.row_number().over(w).cast("bigint").alias("rn"), F.lag("v").over(w).alias("p"),
                          F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"),
                          F.count(F.lit(1)).over(W.partitionBy("g")).alias("n"))
    got = ordered_window(skewed, ["g"], ["x", "id"], [Out("rn", "row_number"), Out("p", "lag", "v"), Out("s", "running_sum", "v"),
                                          Out("n", "group_rows")], hot_rows=20, segments=segments)
    assert rows(got, "id", "rn", "p", "s", "n") == rows(plain)


def test_descending_order(skewed):
    w = W.partitionBy("g").orderBy(F.col("x").desc(), F.col("id"))
    plain = skewed.select("id", F.row_number().over(w).cast("bigint").alias("rn"), F.lag("x").over(w).alias("p"))
    got = ordered_window(skewed, ["g"], ["-x", "id"], [Out("rn", "row_number"), Out("p", "lag", "x")], hot_rows=10, segments=7)
    assert rows(got, "id", "rn", "p") == rows(plain)


def test_global_row_number(skewed):
    w = W.orderBy("x", "id")
    got = row_numbers(skewed, ["x", "id"], "rn", hot_rows=0, segments=6)
    assert rows(got, "id", "rn") == rows(skewed.select("id", F.row_number().over(w).cast("bigint").alias("rn")))


@pytest.mark.parametrize("buckets", [1, 4, 7, 1000])
def test_ntile_matches_the_window_function(skewed, buckets):
    plain = skewed.select("id", F.ntile(buckets).over(W.orderBy(F.col("x").desc(), F.col("id"))).alias("t"))
    got = ntile(skewed, buckets, ["-x", "id"], "t", hot_rows=0, segments=5)
    assert rows(got, "id", "t") == rows(plain)


def test_rank_of_a_large_tie(skewed):
    plain = skewed.select("id", F.rank().over(W.partitionBy("g").orderBy(F.col("v").desc())).cast("bigint").alias("r"))
    got = rank(skewed, ["g"], ["-v"], "r", hot_rows=10, segments=5)
    assert rows(got, "id", "r") == rows(plain)


@pytest.mark.parametrize("frame", ["range", "rows"])
def test_running_sum_frames(skewed, frame):
    order = ["v"] if frame == "range" else ["v", "id"]
    w = W.partitionBy("g").orderBy(*order)
    w = w.rangeBetween(W.unboundedPreceding, 0) if frame == "range" else w.rowsBetween(W.unboundedPreceding, 0)
    got = running_sum(skewed, ["g"], order, "x", "s", frame=frame, hot_rows=10, segments=5)
    plain = running_sum(skewed, ["g"], order, "x", "s", frame=frame)
    assert got.schema["s"].dataType == plain.schema["s"].dataType
    assert rows(got, "id", "s") == rows(skewed.select("id", F.sum("x").over(w).alias("s")))


def test_bound_skips_the_look_for_hot_groups(skewed):
    got = rank(skewed, ["g"], ["-v"], "r", group_bound=10, hot_rows=10)
    assert got.count() == 900


def test_empty_input(spark):
    empty = spark.createDataFrame([], "id int, g string, v int")
    assert row_numbers(empty, ["id"], "rn", hot_rows=-1, segments=3).count() == 0
    assert ordered_window(empty, ["g"], ["id"], [Out("p", "lag", "v")], hot_rows=-1).count() == 0
