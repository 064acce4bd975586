"""Statement forms (UPDATE, DELETE, APPLY, NOT IN, PIVOT) as relations over relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimloom.operators.ordered import match_keys, row_numbers, sort_column


def pieces(spark: SparkSession, rows: int, most: int) -> int:
    """Partitions for that many rows: up to the session's own number, and more where a task would get over ``most`` rows.

    A number given to ``repartition`` stays, while the adaptive planner would join partitions again by their compressed bytes, whatever a hash table of their rows takes.
    """
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // most), min(own, -(-rows // 50_000)))


def update_where(df: DataFrame, cond: Column, sets: Mapping[str, Column]) -> DataFrame:
    """UPDATE … SET … WHERE: every row, changed where the condition is true."""
    return df.withColumns({c: F.when(cond, v).otherwise(F.col(c)) for c, v in sets.items()})


def update_from(target: DataFrame, source: DataFrame, on: Mapping[str, str], sets: Mapping[str, str],
                keep_unmatched: bool = True) -> DataFrame:
    """UPDATE … FROM a join. ``on`` and ``sets`` map target columns to source columns.

    ``keep_unmatched=False`` gives the inner form: only the rows a join would touch.
    """
    src = source.select(
        *[F.col(s).alias(f"_on_{t}") for t, s in on.items()],
        *[F.col(s).alias(f"_set_{t}") for t, s in sets.items()],
        F.lit(True).alias("_hit"),
    )
    cond = F.lit(True)
    for t in on:
        cond = cond & (target[t] == src[f"_on_{t}"])
    joined = target.join(src, cond, "left" if keep_unmatched else "inner")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_set_{c}")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c)
        for c in target.columns
    ])


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    """Survivors of DELETE … WHERE: a condition that is NULL does not delete."""
    return df.where(~F.coalesce(cond, F.lit(False)))


def delete_top(df: DataFrame, cond: Column, n: int, order_by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Survivors of DELETE TOP (n). The order makes the choice of victims repeatable;
    ``key`` must identify a row."""
    victims = df.where(cond).orderBy(*[sort_column(c) for c in order_by]).limit(n).select(*key)
    return match_keys(df, victims, key, "left_anti")


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row per key in the given order.

    Spark keeps one row per key in every task before the shuffle, so a key with many
    copies sends one row per task, not all its rows.
    """
    return top_k_per_group(df, keys, order_by, 1)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], k: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*[sort_column(c) for c in order_by])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def apply_top_k(outer: DataFrame, inner: DataFrame, on: Mapping[str, str], order_by: Sequence[str], k: int,
                take: Mapping[str, str], keep_unmatched: bool = False) -> DataFrame:
    """CROSS / OUTER APPLY (SELECT TOP k … ORDER BY …): up to ``k`` rows per outer row."""
    top = top_k_per_group(inner, list(on.values()), order_by, k).select(
        *[F.col(i).alias(f"_on_{o}") for o, i in on.items()],
        *[F.col(src).alias(name) for name, src in take.items()],
    )
    cond = F.lit(True)
    for o in on:
        cond = cond & (outer[o] == top[f"_on_{o}"])
    return outer.join(top, cond, "left" if keep_unmatched else "inner").drop(*[f"_on_{o}" for o in on])


def apply_aggregate(outer: DataFrame, inner: DataFrame, on: Mapping[str, str], aggs: Mapping[str, Column],
                    defaults: Mapping[str, object] | None = None, keep_unmatched: bool = True) -> DataFrame:
    """A correlated aggregate per outer row: aggregate once per key, then a join.

    ``defaults`` fills the outer rows without a match (COUNT gives 0, not NULL). Without ``keep_unmatched`` those rows go (CROSS
    APPLY of a grouped aggregate).
    """
    grouped = inner.groupBy(*[F.col(i).alias(f"_on_{o}") for o, i in on.items()]).agg(
        *[expr.alias(name) for name, expr in aggs.items()])
    cond = F.lit(True)
    for o in on:
        cond = cond & (outer[o] == grouped[f"_on_{o}"])
    out = outer.join(grouped, cond, "left" if keep_unmatched else "inner").drop(*[f"_on_{o}" for o in on])
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def partition_aggregate(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column],
                        keys_not_null: bool = False) -> DataFrame:
    """agg(…) OVER (PARTITION BY keys) as aggregate plus join.

    The aggregate combines before its shuffle and the adaptive planner can split a hot
    key of the join, which a window cannot. ``keys_not_null`` says that no key is NULL; the join is then one on plain
    equality, which leaves the rows where a further join on the same keys needs them.
    """
    grouped = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    return df.join(grouped, list(keys)).select(*df.columns, *aggs) if keys_not_null else match_keys(df, grouped, keys, "inner")


def allocate(df: DataFrame, keys: Sequence[str], amounts: Sequence[str], places: int = 4) -> DataFrame:
    """Spread header amounts evenly over the rows of a key."""
    out = partition_aggregate(df, keys, {"_rows": F.count(F.lit(1))})
    kind = T.DecimalType(19, places)
    return out.withColumns({
        a: F.round(F.col(a) / F.nullif(F.col("_rows"), F.lit(0).cast("bigint")), places).cast(kind) for a in amounts
    }).drop("_rows")


def not_in(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """x NOT IN (subquery) with SQL's NULL rules, as a distributed anti join.

    An empty right side keeps every row; a NULL on the right keeps none; a NULL on the
    left is dropped otherwise. The built-in form broadcasts its right side whatever its size.
    """
    values = right.select(F.col(right_col).alias("_v"))
    kept = left.join(values.where(F.col("_v").isNotNull()).distinct(), left[left_col] == F.col("_v"), "left_anti")
    return with_scalar(kept, _in_facts(values)).where(
        (F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(left_col).isNotNull())
    ).drop("_n", "_nulls")


def flag_not_in(left: DataFrame, left_col: str, right: DataFrame, right_col: str, name: str) -> DataFrame:
    """The same test as a column: every row stays and says whether it would pass."""
    values = right.select(F.col(right_col).alias("_v"))
    known = values.where(F.col("_v").isNotNull()).distinct().withColumn("_hit", F.lit(True))
    marked = with_scalar(left.join(known, left[left_col] == F.col("_v"), "left"), _in_facts(values))
    passes = (F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(left_col).isNotNull() & F.col("_hit").isNull())
    return marked.select(*left.columns, passes.alias(name))


def _in_facts(values: DataFrame) -> DataFrame:
    return values.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_v").isNull()).alias("_nulls"))


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Attach the columns of a one-row relation as an uncorrelated scalar subquery."""
    row = scalar.select(F.struct(*scalar.columns).alias("_scalar")).scalar()
    return df.withColumn("_scalar", row).select(
        *df.columns, *[F.col(f"_scalar.{c}").alias(c) for c in scalar.columns])


def explode_axis(df: DataFrame, axis: DataFrame, column: str, max_values: int = 100_000) -> DataFrame:
    """Every row once per distinct value of an axis (CROSS JOIN with the axis).

    Up to ``max_values`` values travel as one array, so the rows neither move nor meet in a
    nested loop. A longer axis is cut into chunks and the rows are salted; an equi join on
    (chunk, salt) then makes the same pairs, spread over all tasks.
    """
    values = axis.select(column).distinct()
    size = values.limit(max_values + 1).count()
    if size <= max_values:
        array = values.agg(F.collect_set(F.struct(column)).alias("_axis"))
        spread = with_scalar(df, array).withColumn("_axis", F.explode("_axis"))
        return spread.select(*df.columns, F.col(f"_axis.{column}").alias(column))
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = -(-values.count() // max_values)
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))))
    right = values.withColumn("_chunk", F.pmod(F.xxhash64(column), F.lit(chunks))).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.join(right, ["_chunk", "_salt"]).select(*df.columns, column)


def compare_to_group(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Rows with an aggregate of their group beside them (correlated threshold in WHERE)."""
    return partition_aggregate(df, keys, {name: value})


def unpivot_pairs(df: DataFrame, ids: Sequence[str], columns: Mapping[str, str], name: str, value: str,
                  drop_nulls: bool = True) -> DataFrame:
    """UNPIVOT one value column. ``columns`` maps a column to the label it gets."""
    rows = F.array(*[F.struct(F.lit(label).alias(name), F.col(c).alias(value)) for c, label in columns.items()])
    out = df.select(*ids, F.inline(rows))
    return out.where(F.col(value).isNotNull()) if drop_nulls else out


def unpivot_tuples(df: DataFrame, ids: Sequence[str], label: str,
                   rows: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Lateral VALUES: per label one output row with several columns."""
    return df.select(*ids, F.inline(F.array(*[
        F.struct(F.lit(tag).alias(label), *[F.col(src).alias(out) for out, src in cols.items()])
        for tag, cols in rows.items()
    ])))


def pivot_sum(df: DataFrame, ids: Sequence[str], column: str, values: Mapping[object, str],
              measures: Mapping[str, str], fill: object | None = None) -> DataFrame:
    """PIVOT with a fixed value list: ``<label>_<measure>`` columns in one aggregation.

    Without ``fill`` a missing combination is NULL, as PIVOT gives it.
    """
    aggs = []
    for value, label in values.items():
        for measure, source in measures.items():
            cell = F.sum(F.when(F.col(column) == value, F.col(source)))
            if fill is not None:
                cell = F.coalesce(cell, F.lit(fill))
            aggs.append(cell.alias(f"{label}_{measure}"))
    return df.groupBy(*ids).agg(*aggs)


def roundtrip_counts(wide: DataFrame, narrow: DataFrame, width: int) -> DataFrame:
    """One row: pivot rows, unpivot rows and whether they agree (width rows each)."""
    a = wide.agg(F.count(F.lit(1)).alias("pivot_rows"))
    b = narrow.agg(F.count(F.lit(1)).alias("unpivot_rows"))
    return with_scalar(a, b).withColumn("ok", F.col("unpivot_rows") == F.col("pivot_rows") * width)


def page(df: DataFrame, order_by: Sequence[str], offset: int, size: int) -> DataFrame:
    """One OFFSET … FETCH page."""
    return df.orderBy(*[sort_column(c) for c in order_by]).offset(offset).limit(size)


def assign_batches(df: DataFrame, order_by: Sequence[str], size: int, name: str = "batch_id", **kw) -> DataFrame:
    """The batch each row would load in, ceil(position / size), numbered without a global sort."""
    numbered = row_numbers(df, order_by, "_rn", **kw)
    return numbered.withColumn(name, F.call_function("div", F.col("_rn") - 1, F.lit(size).cast("bigint")) + 1).drop("_rn")


def with_audit(df: DataFrame, run_id: str, loaded_at: Column | None = None, materialization: str = "table") -> DataFrame:
    """Control columns: the run on every model, the load time only on tables and snapshots."""
    out = df.withColumn("_run_id", F.lit(run_id))
    if materialization in ("table", "snapshot"):
        if loaded_at is None:
            raise ValueError("tables and snapshots need loaded_at")
        out = out.withColumn("_loaded_at", loaded_at)
    elif materialization != "incremental":
        raise ValueError(f"unknown materialization {materialization}")
    return out
