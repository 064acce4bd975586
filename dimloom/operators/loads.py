"""Load patterns as functions from tables to tables.

Each takes the current target and a source and returns the whole new target, or the
rows to append. Parquet has no MERGE, so a writer (``sources.tables``) persists the
result; keep ``is_current`` as a partition column to leave closed history untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dimloom.functions.scalar import changed
from dimloom.operators.ordered import Out, ordered_window, row_numbers
from dimloom.operators.relational import delete_where, latest_per_key, with_scalar
from dimloom.session import materialize

FROM, TO, CURRENT = "valid_from", "valid_to", "is_current"

# How a tracked attribute is compared: "null_safe", "plain" or ("sentinel", value).
Tracked = Mapping[str, "str | tuple[str, object]"]


def change_test(tracked: Tracked, old: Callable[[str], Column], new: Callable[[str], Column]) -> Column:
    out = F.lit(False)
    for name, how in tracked.items():
        mode, sentinel = (how, None) if isinstance(how, str) else how
        out = out | changed([(old(name), new(name))], mode, [sentinel])
    return out


def dedup(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, chosen by the order: what a load does with repeated staging rows."""
    return latest_per_key(df, keys, order_by)


def unique_or_error(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows pass through; a repeated key fails the job, as MERGE does."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        return counted.where(F.when(F.col("_n") > 1, F.raise_error(F.lit("merge source has a repeated key"))
                                    .cast("boolean")).otherwise(F.lit(True))).select(*keys)
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(*rest)).alias("_row"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("merge source has a repeated key"))).otherwise(F.col("_row"))
    return one.withColumn("_row", checked).select(*keys, "_row.*").select(*df.columns)


def sides(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    t = target.select(F.struct(*target.columns).alias("t"))
    s = source.select(F.struct(*source.columns).alias("s"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"t.{k}") == F.col(f"s.{k}"))
    return t.join(s, cond, "full_outer")


def append_batch(*batches: DataFrame) -> DataFrame:
    """Several INSERT … SELECT into one target."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out


def incremental_append(target: DataFrame, source: DataFrame, keys: Sequence[str], *,
                       dedup_order: Sequence[str] | None = None, since: Column | None = None) -> DataFrame:
    """The new rows only: not loaded yet, optionally inside a look-back window."""
    if since is not None:
        source = source.where(since)
    if dedup_order:
        source = dedup(source, keys, dedup_order)
    return source.join(target.select(*keys).distinct(), list(keys), "left_anti").select(*source.columns)


def scd1_merge(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None, *,
               on_missing: str = "keep", insert: bool = True, duplicates: str = "error",
               set_matched: Mapping[str, Column] | None = None,
               set_inserted: Mapping[str, Column] | None = None,
               expire: Mapping[str, Column] | None = None) -> DataFrame:
    """MERGE that overwrites.

    ``on_missing`` treats target rows without a source row: keep, delete or expire
    (the columns of ``expire``). ``set_*`` give extra columns on update or insert.
    """
    if on_missing not in ("keep", "delete", "expire"):
        raise ValueError(f"unknown on_missing {on_missing}")
    source = one_per_key(source, keys, duplicates)
    update = list(update if update is not None else [c for c in source.columns if c not in keys])
    joined = sides(target, source, keys)
    in_t, in_s = F.col("t").isNotNull(), F.col("s").isNotNull()
    if not insert:
        joined = joined.where(in_t)
    if on_missing == "delete":
        joined = joined.where(in_s)
    out = []
    for field in target.schema.fields:
        c = field.name
        old = F.col(f"t.{c}")
        new = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        both = (set_matched or {}).get(c, new if c in update else old)
        fresh = (set_inserted or {}).get(c, new)
        gone = (expire or {}).get(c, old) if on_missing == "expire" else old
        out.append(F.when(in_t & in_s, both).when(in_t, gone).otherwise(fresh).cast(field.dataType).alias(c))
    return joined.select(*out)


def one_per_key(source: DataFrame, keys: Sequence[str], duplicates: str,
                 order_by: Sequence[str] | None = None) -> DataFrame:
    if duplicates == "error":
        return unique_or_error(source, keys)
    if duplicates == "latest":
        return dedup(source, keys, order_by or [f"-{c}" for c in source.columns if c not in keys])
    if duplicates == "trusted":
        return source
    raise ValueError(f"unknown duplicates mode {duplicates}")


def insert_only_merge(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MERGE with only WHEN NOT MATCHED."""
    return target.unionByName(incremental_append(target, source, keys), allowMissingColumns=True)


def scd2_merge(target: DataFrame, source: DataFrame, keys: Sequence[str], tracked: Tracked, effective: Column | str, *,
               open_end: Column | None = None, surrogate: str | None = None, numbering: str = "sequence",
               on_missing: str = "keep", duplicates: str = "error",
               latest_by: Sequence[str] | None = None) -> DataFrame:
    """Close changed versions, open new ones, add new keys, leave the rest alone.

    One full outer join over the current rows decides all four cases, so running the
    same batch again changes nothing. ``effective`` is the change time, or the source
    column that holds it. ``open_end`` replaces the NULL end of an open version.
    ``surrogate`` names the surrogate key: numbered on from the highest one
    (``sequence``) or a hash of key and start (``hash``). A repeated source key is an error, or
    with ``duplicates="latest"`` the first row in the order of ``latest_by`` counts.
    """
    if on_missing not in ("keep", "expire"):
        raise ValueError(f"unknown on_missing {on_missing}")
    source = one_per_key(source, keys, duplicates, latest_by)
    # A row without a flag is not current; it stays as it is.
    flag = F.coalesce(F.col(CURRENT), F.lit(False))
    current, history = target.where(flag), target.where(~flag)
    joined = sides(current, source, keys)
    in_t, in_s = F.col("t").isNotNull(), F.col("s").isNotNull()
    when = F.col(f"s.{effective}") if isinstance(effective, str) else effective
    end = open_end if open_end is not None else F.lit(None)
    differs = change_test(tracked, lambda c: F.col(f"t.{c}"), lambda c: F.col(f"s.{c}"))

    kinds = {f.name: f.dataType for f in target.schema.fields}

    def row(values: Callable[[str], Column]) -> Column:
        return F.struct(*[values(c).cast(kinds[c]).alias(c) for c in target.columns])

    def opened(c: str) -> Column:
        if c == FROM:
            return when
        if c == TO:
            return end
        if c == CURRENT:
            return F.lit(True)
        return F.col(f"s.{c}") if c in source.columns else F.lit(None)

    def closed(at: Column) -> Column:
        over = {TO: at, CURRENT: F.lit(False)}
        return row(lambda c: over.get(c, F.col(f"t.{c}")))

    kept = row(lambda c: F.col(f"t.{c}"))
    versions = F.when(in_t & in_s & differs, F.array(closed(when), row(opened))).when(
        ~in_t, F.array(row(opened)))
    if on_missing == "expire":
        if isinstance(effective, str):
            raise ValueError("expiring missing keys needs an effective time that does not come from the source")
        versions = versions.when(~in_s, F.array(closed(effective)))
    merged = joined.select(F.inline(versions.otherwise(F.array(kept))))
    if surrogate is None:
        return history.unionByName(merged)
    if numbering == "hash":
        # 64 bits: two of n rows get one key with a chance of n * n / 2**65.
        parts = [x for k in [*keys, FROM] for x in (F.col(k), F.col(k).isNull())]
        return history.unionByName(merged.withColumn(surrogate, F.coalesce(F.col(surrogate), F.xxhash64(*parts).cast(kinds[surrogate]))))
    # Only current rows are written out for the numbering; closed history is not touched.
    merged = materialize(merged)
    numbered = assign_surrogate_keys(
        merged.where(F.col(surrogate).isNull()), surrogate, keys,
        start=target.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("_start")))
    return history.unionByName(merged.where(F.col(surrogate).isNotNull())).unionByName(
        numbered.withColumn(surrogate, F.col(surrogate).cast(kinds[surrogate])))


def scd2_history(current: DataFrame, changes: DataFrame, keys: Sequence[str], tracked: Tracked, effective: str,
                 **window) -> DataFrame:
    """SCD2 where one batch may hold several changes of a key: each makes its own version.

    The current row and the changes of a key are put in order; a change equal to the one
    before it makes no version, and each version ends where the next begins. Changes must
    be newer than the current version (see ``split_late``).
    """
    skip = {FROM, TO, CURRENT}
    have = set(changes.columns)
    kinds = {f.name: f.dataType for f in current.schema.fields}
    rest = [c for c in changes.columns if c not in keys and c != effective]
    single = dedup(changes, [*keys, effective], rest) if rest else changes.distinct()
    fresh = single.select(*[
        (F.col(effective) if c == FROM else F.lit(True) if c == CURRENT
         else F.col(c) if c in have and c not in skip else F.lit(None)).cast(kinds[c]).alias(c) for c in current.columns])
    rows = current.unionByName(fresh)
    seen = ordered_window(rows, keys, [FROM], [
        Out("_pos", "row_number"), *[Out(f"_p_{c}", "lag", c) for c in tracked]], **window)
    moved = change_test(tracked, lambda c: F.col(f"_p_{c}"), F.col)
    kept = seen.where((F.col("_pos") == 1) | moved).select(*current.columns)
    # The next start is the previous row of the reversed order.
    chained = ordered_window(kept, keys, [f"-{FROM}"], [Out("_next", "lag", FROM)], **window)
    return chained.withColumns({
        TO: F.coalesce(F.col("_next"), F.col(TO)), CURRENT: F.col("_next").isNull()}).select(*current.columns)


def split_late(current: DataFrame, changes: DataFrame, keys: Sequence[str], effective: str) -> tuple[DataFrame, DataFrame]:
    """(changes newer than their key's current version, the others)."""
    starts = current.select(*keys, F.col(FROM).alias("_from"))
    marked = changes.join(starts, list(keys), "left")
    late = F.coalesce(F.col(effective) <= F.col("_from"), F.lit(False))
    return marked.where(~late).select(*changes.columns), marked.where(late).select(*changes.columns)


def assign_surrogate_keys(new_rows: DataFrame, name: str, order_by: Sequence[str], start: DataFrame | int = 0,
                          **kw) -> DataFrame:
    """Number only the new rows, from ``start`` (a number or a one-row relation) + 1 upwards."""
    numbered = row_numbers(new_rows.drop(name), order_by, "_rn", **kw)
    if isinstance(start, int):
        out = numbered.withColumn(name, F.col("_rn") + start)
    else:
        out = with_scalar(numbered, start.toDF("_start")).withColumn(
            name, F.col("_rn") + F.col("_start")).drop("_start")
    out = out.drop("_rn")
    return out.select(*new_rows.columns) if name in new_rows.columns else out


def snapshot(target: DataFrame, source: DataFrame, keys: Sequence[str], strategy: str, *,
             updated_at: str | None = None, check_cols: Sequence[str] | str | None = None,
             now: Column | None = None) -> DataFrame:
    """A snapshot by ``timestamp`` (a later update time makes a version) or by ``check``
    (a change in the given columns, or in ``"all"``)."""
    if strategy == "timestamp":
        if not updated_at:
            raise ValueError("the timestamp strategy needs updated_at")
        # A row that is not newer than its current version must not open one.
        current = target.where(F.col(CURRENT)).select(*keys, F.col(updated_at).alias("_seen"))
        newer = source.join(current, list(keys), "left").where(
            F.col("_seen").isNull() | (F.col(updated_at) > F.col("_seen"))).select(*source.columns)
        return scd2_merge(target, newer, keys, {updated_at: "null_safe"}, updated_at)
    if strategy == "check":
        if now is None or not check_cols:
            raise ValueError("the check strategy needs check_cols and now")
        skip = {*keys, FROM, TO, CURRENT}
        cols = [c for c in source.columns if c not in skip] if check_cols == "all" else list(check_cols)
        return scd2_merge(target, source, keys, {c: "null_safe" for c in cols}, now)
    raise ValueError(f"unknown snapshot strategy {strategy}")


def accumulating_snapshot(target: DataFrame, source: DataFrame, key: Sequence[str], milestones: Sequence[str],
                          derived: Sequence[tuple[str, Callable[[Column], Column], str]] = (),
                          lags: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per process instance: a milestone is filled once and never overwritten.

    ``derived`` lists (milestone, function, earlier milestone) in order; ``lags`` names
    day counts between two milestones.
    """
    joined = sides(target, source, key)
    has = set(source.columns)
    out = joined.select(*[
        F.when(F.col("t").isNull(), F.col(f"s.{c}") if c in has else F.lit(None))
        .otherwise(F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")) if c in milestones and c in has else F.col(f"t.{c}"))
        .cast(target.schema[c].dataType).alias(c)
        for c in target.columns
    ])
    for name, rule, base in derived:
        out = out.withColumn(name, F.coalesce(F.col(name), rule(F.col(base))))
    for name, (start, stop) in (lags or {}).items():
        out = out.withColumn(name, F.datediff(F.col(stop), F.col(start)))
    return out


def periodic_snapshot(target: DataFrame, rows: DataFrame, period: str, as_of: Column | None = None) -> DataFrame:
    """Replace the periods the new rows cover; every other period stays.

    With ``as_of`` only that period is replaced: a filter that prunes partitions, no join.
    """
    if as_of is not None:
        return delete_where(target, F.col(period) == as_of).unionByName(rows)
    kept = target.join(rows.select(period).distinct(), period, "left_anti").select(*target.columns)
    return kept.unionByName(rows)


def write_periods(rows: DataFrame, path: str, period: str) -> None:
    """The same on disk: only the partitions present in ``rows`` are rewritten."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path))


def incremental(target: DataFrame, source: DataFrame, strategy: str, *, keys: Sequence[str] = (),
                watermark: str | None = None, partition: str | None = None) -> DataFrame:
    """The new target under one of the incremental strategies."""
    if strategy == "append":
        return target.unionByName(source)
    if strategy in ("merge", "microbatch", "delete+insert") and not keys:
        raise ValueError(f"{strategy} needs keys")
    if strategy == "merge":
        return scd1_merge(target, source, keys, duplicates="error")
    if strategy == "microbatch":
        if not watermark:
            raise ValueError("microbatch needs a watermark")
        return scd1_merge(target, dedup(source, keys, [f"-{watermark}"]), keys, duplicates="trusted")
    if strategy == "delete+insert":
        gone = source.select(*keys).distinct()
        return target.join(gone, list(keys), "left_anti").select(*target.columns).unionByName(source)
    if strategy == "insert_overwrite":
        if not partition:
            raise ValueError("insert_overwrite needs a partition column")
        return periodic_snapshot(target, source, partition)
    raise ValueError(f"unknown strategy {strategy}")


def after_watermark(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Source rows past the highest value already loaded (all rows for an empty target)."""
    high = target.agg(F.max(column).alias("_high"))
    return with_scalar(source, high).where(
        F.col("_high").isNull() | (F.col(column) > F.col("_high"))).drop("_high")


def choose_materialization(kind: str, watermark: str | None = None, is_view: bool = False) -> str:
    """snapshot, incremental, view or table."""
    if is_view:
        return "view"
    if kind == "dim_scd2":
        return "snapshot"
    return "incremental" if watermark else "table"


def choose_strategy(watermark_type: str | None, *, append_only: bool = False, date_partitioned: bool = False) -> str:
    """The incremental strategy for a kind of watermark."""
    if append_only:
        return "append"
    if date_partitioned:
        return "insert_overwrite"
    if watermark_type in ("timestamp", "timestamp_ntz", "date"):
        return "microbatch"
    if watermark_type in ("bigint", "int", "smallint"):
        return "merge"
    raise ValueError(f"no strategy for watermark type {watermark_type}")


def apply_changes(target: DataFrame, feed: DataFrame, keys: Sequence[str], sequence: str, op: str) -> DataFrame:
    """Apply a change feed: the last operation per key wins, ``D`` deletes."""
    last = dedup(feed, keys, [f"-{sequence}"])
    joined = sides(target, last, keys)
    deleted = F.coalesce(F.col(f"s.{op}") == "D", F.lit(False))
    return joined.where(~deleted).select(*[
        F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns
    ])


def as_of_join(fact: DataFrame, dim: DataFrame, key: Mapping[str, str], at: str | None, take: Mapping[str, str], *,
               mode: str = "current", how: str = "inner") -> DataFrame:
    """Look up dimension columns by natural key: the current version, or the version valid
    at the fact's time (``[valid_from, valid_to)``).

    Both are equi joins on the natural key; the validity test runs on the matches.
    """
    if mode not in ("current", "as_of"):
        raise ValueError(f"unknown mode {mode}")
    side = dim if mode == "as_of" else dim.where(F.col(CURRENT))
    side = side.select(
        *[F.col(d).alias(f"_on_{f}") for f, d in key.items()],
        *[F.col(d).alias(name) for name, d in take.items()],
        *([F.col(FROM).alias("_from"), F.col(TO).alias("_to")] if mode == "as_of" else []),
    )
    cond = F.lit(True)
    for f in key:
        cond = cond & (fact[f] == side[f"_on_{f}"])
    if mode == "as_of":
        cond = cond & (fact[at] >= F.col("_from")) & (F.col("_to").isNull() | (fact[at] < F.col("_to")))
    out = fact.join(side, cond, how).drop(*[f"_on_{f}" for f in key])
    return out.drop("_from", "_to") if mode == "as_of" else out


def with_unknown_members(dim: DataFrame, key: str, label: str,
                         members: Mapping[int, str] = {0: "Unknown", -1: "Not Applicable", -2: "Not Yet Known"}) -> DataFrame:
    """Add the rows that stand for a missing reference."""
    kinds = {f.name: f.dataType for f in dim.schema.fields}
    rows = dim.sparkSession.createDataFrame(list(members.items()), "_k bigint, _l string")
    extra = rows.select(*[
        (F.col("_k") if c == key else F.col("_l") if c == label else F.lit(None)).cast(kinds[c]).alias(c)
        for c in dim.columns
    ])
    return dim.unionByName(extra)


def resolve_key(fact: DataFrame, dim: DataFrame, natural: Mapping[str, str], key: str, default: int = -1) -> DataFrame:
    """The surrogate key of the current version, or the unknown member's."""
    out = as_of_join(fact, dim, natural, None, {key: key}, how="left")
    return out.withColumn(key, F.coalesce(F.col(key), F.lit(default)))


STEP_REPORT = "step int, name string, status string, rows bigint, error string"


def run_steps(spark: SparkSession, steps: Sequence[tuple[str, Callable[[], DataFrame | int | None]]],
              write: Callable[[str, DataFrame], int] | None = None, on_error: str = "raise") -> DataFrame:
    """Run load steps in order. A step's error names the step and stops the run.

    A step returns a DataFrame for ``write`` to persist (which returns its row count) or does
    its own work. With ``on_error="report"`` the run stops all the same, but ends in a report: the failed step has its error, those
    after it are ``skipped``.
    """
    if on_error not in ("raise", "report"):
        raise ValueError(f"unknown on_error {on_error}")
    report = []
    for number, (name, step) in enumerate(steps):
        if report and report[-1][2] != "ok":
            report.append((number, name, "skipped", None, None))
            continue
        try:
            result = step()
            rows = write(name, result) if write is not None and isinstance(result, DataFrame) else result
        except Exception as error:
            if on_error == "raise":
                raise RuntimeError(f"step {number} ({name}) failed: {error}") from error
            report.append((number, name, "error", None, str(error).splitlines()[0]))
            continue
        report.append((number, name, "ok", rows if isinstance(rows, int) else None, None))
    return spark.createDataFrame(report, STEP_REPORT)
