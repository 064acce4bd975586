"""Helpers the training-data operators share."""

from __future__ import annotations

import gc
import os
import time
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dimloom.session import SCALE_CONF, materialize

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])
# A word, by the ASCII white space of the contracts.
WORD = r"[^\x20\x09-\x0D]+"
# Rows that may be sent to every task. At some tens of bytes a row this is a few MB.
BROADCAST_ROWS = 50_000


def prepare(spark: SparkSession) -> None:
    """Settings for whole texts: small Arrow batches, so that long texts do not pile up in a worker."""
    for key, value in (SCALE_CONF | {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024"}).items():
        if spark.conf.get(key, None) is None or (key.endswith("PerBatch") and int(spark.conf.get(key)) > int(value)):
            spark.conf.set(key, value)
    # Python workers import this package from where the driver has it, unless it is installed for them.
    seen = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in seen:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, seen)])


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage: Spark removes shuffle files once their plans are gone.

    For between the phases of a job that moves whole texts, when the phase before has been written out. It only
    saves disk; nothing depends on it.
    """
    for _ in range(2):  # the first round lets go of what Python held, the second finds it gone
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column; null is empty. Nothing is decoded."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def join_small(rows: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
               limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table that is usually small.

    ``small`` should be written out (``materialize``), so that counting it is cheap. Up to ``limit`` rows it is sent to
    every task; beyond that both sides are shuffled, and the adaptive planner splits hot keys.
    """
    if small.count() <= limit:
        small = F.broadcast(small)
    return rows.join(small, list(on), how)


def running_totals(df: DataFrame, order: Sequence[str], values: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Add ``before_<value>``: the sum of ``value`` over the rows that come earlier in the group's order.

    No group has to fit into a task. Rows are range-partitioned by (group, order) into segments, summed inside each
    segment, and linked by a table of one row per (group, segment). ``df`` must be written out before (the bounds come
    from a sample, which reads it once more), ``group`` columns must not be null, and ``order`` should break ties.
    """
    cut = materialize(df.repartitionByRange(*group, *order).withColumn("_seg", F.spark_partition_id()))
    totals = cut.groupBy("_seg", *group).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    earlier = W.partitionBy(*(group or [F.lit(0)])).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    carry = materialize(totals.select("_seg", *group, *[
        F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_carry_{v}") for v in values]))
    inside = W.partitionBy("_seg", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = cut.withColumns({f"_in_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    joined = join_small(rows, carry, ["_seg", *group])
    return joined.select(*df.columns, *[(F.col(f"_in_{v}") + F.col(f"_carry_{v}")).alias(f"before_{v}") for v in values])
