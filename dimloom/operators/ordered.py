"""Ordered window functions that survive hot groups.

A plain window puts each group into one task. That is right for most groups, so
groups of up to ``hot_rows`` rows use it. Larger groups are cut into segments by a
range partitioning on (group, order); the window runs inside each segment and a small
table of carried totals (at most two rows per segment) links the segments. No rows
are dropped and no group has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dimloom.session import materialize

HOT_ROWS = 2_000_000


@dataclass(frozen=True)
class Out:
    """One output column: ``row_number``, ``lag`` (previous row), ``running_sum`` or
    ``group_rows`` (rows in the whole group)."""

    name: str
    kind: str
    column: str | None = None


def sort_column(name: str) -> Column:
    """``"x"`` ascending, ``"-x"`` descending."""
    return F.col(name[1:]).desc() if name.startswith("-") else F.col(name).asc()


def bare(names: Sequence[str]) -> list[str]:
    return [n.lstrip("-") for n in names]


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str,
               broadcast: bool = False) -> DataFrame:
    """Join on keys where NULL equals NULL; the right side's key columns are left out."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"_r_{k}"])
    joined = left.join(F.broadcast(renamed) if broadcast else renamed, cond, how)
    return joined.drop(*[f"_r_{k}" for k in keys])


def ordered_window(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str],
                   outputs: Sequence[Out], *, keys_from: DataFrame | None = None, group_bound: int | None = None,
                   hot_rows: int = HOT_ROWS, segments: int | None = None) -> DataFrame:
    """Add window columns. ``order_by`` should end in a column that breaks ties.

    ``keys_from`` is a cheaper relation with at least as many rows per group, for
    instance the one table the group key comes from, to look for hot groups in.
    ``group_bound`` is a known limit on the rows of a group; at or below ``hot_rows`` it
    saves that look.
    """
    if group_bound is not None and group_bound <= hot_rows:
        return _plain(df, partition_by, order_by, outputs)
    if not partition_by:
        rows = (keys_from if keys_from is not None else df).count()
        if rows > hot_rows:
            return _segmented(df.withColumn("_all", F.lit(0)), ["_all"], order_by, outputs, segments).drop("_all")
        return _plain(df, [], order_by, outputs)
    counted = (keys_from if keys_from is not None else df).groupBy(*partition_by).count()
    hot = counted.where(F.col("count") > hot_rows).select(*partition_by)
    if hot.isEmpty():
        return _plain(df, partition_by, order_by, outputs)
    hot = materialize(hot)
    # There are at most total rows / hot_rows hot keys, so this side stays small.
    cold = match_keys(df, hot, partition_by, "left_anti", broadcast=True)
    large = match_keys(df, hot, partition_by, "left_semi", broadcast=True)
    return _plain(cold, partition_by, order_by, outputs).unionByName(
        _segmented(large, partition_by, order_by, outputs, segments))


def _plain(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str],
           outputs: Sequence[Out]) -> DataFrame:
    w = W.partitionBy(*partition_by).orderBy(*[sort_column(c) for c in order_by])
    cols = {}
    for out in outputs:
        if out.kind == "row_number":
            cols[out.name] = F.row_number().over(w).cast("bigint")
        elif out.kind == "lag":
            cols[out.name] = F.lag(out.column).over(w)
        elif out.kind == "running_sum":
            cols[out.name] = F.sum(out.column).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
        elif out.kind == "group_rows":
            cols[out.name] = F.count(F.lit(1)).over(W.partitionBy(*partition_by))
        else:
            raise ValueError(f"unknown window output {out.kind}")
    return df.withColumns(cols)


def _segmented(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str],
               outputs: Sequence[Out], segments: int | None) -> DataFrame:
    spark = df.sparkSession
    n = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds come from a sample, so the cut is written once and then read.
    cut = materialize(
        df.repartitionByRange(n, *partition_by, *[sort_column(c) for c in order_by])
        .withColumn("_seg", F.spark_partition_id())
    )
    part = list(partition_by)
    # A group in more than one segment is the last group of one and the first of another.
    edges = cut.groupBy("_seg").agg(F.min(F.struct(*part)).alias("lo"), F.max(F.struct(*part)).alias("hi"))
    spanning = (
        edges.select("_seg", F.explode(F.array("lo", "hi")).alias("g")).distinct()
        .groupBy("g").count().where("count > 1").select("g.*")
    )
    w = W.partitionBy("_seg", *part).orderBy(*[sort_column(c) for c in order_by])
    lag_cols = sorted({o.column for o in outputs if o.kind == "lag"})
    sum_cols = sorted({o.column for o in outputs if o.kind == "running_sum"})
    inner = match_keys(cut, spanning, part, "left_semi", broadcast=True)
    totals = inner.withColumn("_pos", F.row_number().over(w)).groupBy("_seg", *part).agg(
        F.max("_pos").alias("_rows"),
        *[F.sum(c).alias(f"_sum_{c}") for c in sum_cols],
        *([F.max_by(F.struct(*lag_cols), "_pos").alias("_tail")] if lag_cols else []),
    )
    before = W.partitionBy(*part).orderBy("_seg")
    earlier = before.rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        "_seg", *part,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_rows").over(W.partitionBy(*part)).alias("_rows_all"),
        *[F.sum(f"_sum_{c}").over(earlier).alias(f"_before_{c}") for c in sum_cols],
        *([F.lag("_tail").over(before).alias("_tail_before")] if lag_cols else []),
    )
    local = cut.withColumn("_pos", F.row_number().over(w))
    for out in outputs:
        if out.kind == "lag":
            local = local.withColumn(out.name, F.lag(out.column).over(w))
        elif out.kind == "running_sum":
            local = local.withColumn(
                out.name, F.sum(out.column).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
        elif out.kind == "group_rows":
            local = local.withColumn(out.name, F.count(F.lit(1)).over(W.partitionBy("_seg", *part)))
    # At most two rows per segment: bounded by the number of partitions.
    linked = match_keys(local, carried, ["_seg", *part], "left", broadcast=True)
    cols = {}
    for out in outputs:
        if out.kind == "row_number":
            cols[out.name] = F.col("_pos") + F.coalesce(F.col("_rows_before"), F.lit(0))
        elif out.kind == "lag":
            cols[out.name] = F.when(F.col("_pos") == 1, F.col(f"_tail_before.{out.column}")).otherwise(F.col(out.name))
        elif out.kind == "running_sum":
            start = F.col(f"_before_{out.column}")
            cols[out.name] = F.when(start.isNull(), F.col(out.name)).otherwise(
                start + F.coalesce(F.col(out.name), F.lit(0)))
        elif out.kind == "group_rows":
            cols[out.name] = F.coalesce(F.col("_rows_all"), F.col(out.name))
        else:
            raise ValueError(f"unknown window output {out.kind}")
        if out.kind == "running_sum":
            # Adding the carried total would widen a decimal: the type is that of the plain window.
            cols[out.name] = cols[out.name].cast(local.schema[out.name].dataType)
    return linked.withColumns(cols).select(*df.columns, *[o.name for o in outputs])


def row_numbers(df: DataFrame, order_by: Sequence[str], name: str = "row_number", **kw) -> DataFrame:
    """1-based positions over the whole relation without a single-task sort of large data."""
    return ordered_window(df, [], order_by, [Out(name, "row_number")], **kw)


def ntile(df: DataFrame, buckets: int, order_by: Sequence[str], name: str, *,
          keys_from: DataFrame | None = None, hot_rows: int = HOT_ROWS,
          segments: int | None = None) -> DataFrame:
    """NTILE over the whole relation: the first (rows mod buckets) buckets get one row more."""
    rows = (keys_from if keys_from is not None else df).count()
    if rows <= hot_rows:
        w = W.orderBy(*[sort_column(c) for c in order_by])
        return df.withColumn(name, F.ntile(buckets).over(w))
    numbered = row_numbers(df, order_by, "_rn", keys_from=keys_from, hot_rows=hot_rows, segments=segments)
    if keys_from is not None:
        rows = numbered.agg(F.max("_rn")).first()[0]
    size, longer = divmod(rows, buckets)
    boundary = longer * (size + 1)
    zero_based = F.col("_rn") - 1
    tile = F.when(
        zero_based < boundary, F.call_function("div", zero_based, F.lit(size + 1).cast("bigint")) + 1
    ).otherwise(
        F.call_function("div", zero_based - boundary, F.lit(max(size, 1)).cast("bigint")) + longer + 1)
    return numbered.withColumn(name, tile.cast("int")).drop("_rn")


def has_hot_group(df: DataFrame, partition_by: Sequence[str], hot_rows: int, keys_from: DataFrame | None,
                  group_bound: int | None) -> bool:
    if group_bound is not None and group_bound <= hot_rows:
        return False
    counted = (keys_from if keys_from is not None else df).groupBy(*partition_by).count()
    return not counted.where(F.col("count") > hot_rows).isEmpty()


def rank(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], name: str, *,
         keys_from: DataFrame | None = None, group_bound: int | None = None, hot_rows: int = HOT_ROWS,
         segments: int | None = None) -> DataFrame:
    """RANK with gaps. Hot groups are ranked over their distinct values, with the row counts
    of equal values added up first, so neither a large group nor a large tie is one task."""
    if not has_hot_group(df, partition_by, hot_rows, keys_from, group_bound):
        w = W.partitionBy(*partition_by).orderBy(*[sort_column(c) for c in order_by])
        return df.withColumn(name, F.rank().over(w).cast("bigint"))
    keys = [*partition_by, *bare(order_by)]
    values = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    upto = ordered_window(values, partition_by, order_by, [Out("_upto", "running_sum", "_n")],
                          hot_rows=hot_rows, segments=segments)
    return match_keys(df, upto.select(*keys, (F.col("_upto") - F.col("_n") + 1).alias(name)), keys, "inner")


def running_sum(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], column: str,
                name: str, *, frame: str = "range", keys_from: DataFrame | None = None, group_bound: int | None = None,
                hot_rows: int = HOT_ROWS, segments: int | None = None) -> DataFrame:
    """Cumulative sum. ``range`` gives rows that tie in the order the same total (the SQL
    default); ``rows`` counts row by row and needs a tie-breaking order."""
    kind = df.select(F.sum(column)).schema[0].dataType
    if frame == "rows":
        return ordered_window(df, partition_by, order_by, [Out(name, "running_sum", column)],
                              keys_from=keys_from, group_bound=group_bound, hot_rows=hot_rows, segments=segments)
    if frame != "range":
        raise ValueError(f"unknown frame {frame}")
    if not has_hot_group(df, partition_by, hot_rows, keys_from, group_bound):
        w = W.partitionBy(*partition_by).orderBy(*[sort_column(c) for c in order_by])
        return df.withColumn(name, F.sum(column).over(w.rangeBetween(W.unboundedPreceding, W.currentRow)))
    keys = [*partition_by, *bare(order_by)]
    values = df.groupBy(*keys).agg(F.sum(column).alias("_v"))
    upto = ordered_window(values, partition_by, order_by, [Out(name, "running_sum", "_v")],
                          hot_rows=hot_rows, segments=segments)
    return match_keys(df, upto.select(*keys, F.col(name).cast(kind).alias(name)), keys, "inner")
