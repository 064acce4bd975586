"""Builders for the parts of a dimensional model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dimloom.functions.scalar import exact_key
from dimloom.operators.loads import CURRENT, one_per_key, scd2_merge, sides
from dimloom.operators.ordered import match_keys, row_numbers
from dimloom.operators.relational import explode_axis, with_scalar


def _calendar(days: DataFrame) -> DataFrame:
    d = F.col("date_day")
    dow = F.weekday(d)
    return days.select(
        (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int").alias("date_key"),
        d.alias("date_day"),
        (dow + 1).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_of_week_name"),
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofyear(d).alias("day_of_year"),
        # week of the year with Monday first, days before the first Monday in week 1
        (F.floor((F.dayofyear(d) + 6 - dow) / 7) + 1).cast("int").alias("week_of_year"),
        F.month(d).alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).alias("quarter_number"),
        F.year(d).alias("year_number"),
        (dow >= 5).alias("is_weekend"),
    )


def date_dim(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day, both ends included."""
    return _calendar(spark.sql(
        "SELECT explode(sequence(CAST(:a AS DATE), CAST(:b AS DATE))) AS date_day", args={"a": start, "b": end}))


def date_dim_for(df: DataFrame, column: str) -> DataFrame:
    """The date dimension over the whole years a column touches."""
    span = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    days = span.select(F.explode(F.sequence(
        F.trunc("lo", "year"), F.date_sub(F.add_months(F.trunc("hi", "year"), 12), 1))).alias("date_day"))
    return _calendar(days)


def with_fiscal(dates: DataFrame, first_month: int, holidays: DataFrame | None = None,
                as_of: Column | None = None) -> DataFrame:
    """Fiscal year, quarter and period, a holiday flag and rolling-window flags."""
    shifted = F.pmod(F.col("month_number") - first_month, F.lit(12))
    fiscal_year = F.col("year_number") + F.when(
        (F.lit(first_month) > 1) & (F.col("month_number") >= first_month), 1).otherwise(0)
    out = dates.withColumns({
        "fiscal_period": (shifted + 1).cast("int"),
        "fiscal_quarter": (F.floor(shifted / 3) + 1).cast("int"),
        "fiscal_year": fiscal_year.cast("int"),
        "is_month_end": F.col("date_day") == F.last_day("date_day"),
    })
    if holidays is not None:
        flags = holidays.select(F.col("date_day").alias("_h"), F.lit(True).alias("_is")).distinct()
        out = out.join(flags, out["date_day"] == flags["_h"], "left").withColumn(
            "is_holiday", F.coalesce(F.col("_is"), F.lit(False))).drop("_h", "_is")
    if as_of is not None:
        age = F.datediff(as_of, F.col("date_day"))
        out = out.withColumns({
            "is_last_30_days": (age >= 0) & (age < 30),
            "is_current_year": F.year(as_of) == F.col("year_number"),
        })
    return out


def apply_scd(target: DataFrame, source: DataFrame, keys: Sequence[str], policy: Mapping[str, int],
              effective: Column, *, duplicates: str = "error") -> DataFrame:
    """SCD by attribute: 0 keep the first value, 1 overwrite, 2 version, 3 overwrite and keep
    the previous value in ``prior_<column>``.

    Type 1 columns are corrected on every version of the key, type 2 opens a new one.
    """
    bad = {c: p for c, p in policy.items() if p not in (0, 1, 2, 3)}
    if bad:
        raise ValueError(f"unknown SCD types {bad}")
    versioned = {c: "null_safe" for c, p in policy.items() if p == 2}
    source = one_per_key(source, keys, duplicates)
    # Types 0, 1 and 3 first, on all versions; the source then agrees with them, so
    # the version test of type 2 sees only its own columns.
    s = source.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                      *[F.col(c).alias(f"_s_{c}") for c in policy], F.lit(True).alias("_hit"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (target[k] == s[f"_k_{k}"])
    joined = target.join(s, cond, "left")
    hit = F.col("_hit").isNotNull()
    out = []
    for c in target.columns:
        base = c[len("prior_"):] if c.startswith("prior_") else None
        if policy.get(c) in (1, 3):
            out.append(F.when(hit, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c))
        elif base and policy.get(base) == 3:
            moved = hit & ~F.col(base).eqNullSafe(F.col(f"_s_{base}"))
            out.append(F.when(moved, F.col(base)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    corrected = joined.select(*out)
    carried = [c for c in target.columns if policy.get(c) == 0
               or (c.startswith("prior_") and policy.get(c[len("prior_"):]) == 3)]
    if carried:
        # A new version inherits what the source does not decide.
        first = corrected.where(F.col(CURRENT)).select(*keys, *[F.col(c).alias(f"_t_{c}") for c in carried],
                                                       F.lit(True).alias("_known"))
        source = source.join(first, list(keys), "left")
        for c in carried:
            fresh = F.col(c) if c in source.columns else F.lit(None)
            source = source.withColumn(c, F.when(F.col("_known"), F.col(f"_t_{c}")).otherwise(fresh))
        source = source.drop("_known", *[f"_t_{c}" for c in carried])
    return scd2_merge(corrected, source, keys, versioned, effective, duplicates="trusted")


def junk_dim(df: DataFrame, flags: Sequence[str], mode: str = "distinct", key: str = "flag_key") -> DataFrame:
    """Flag combinations under one key: those that occur, or every possible one.

    The key is a hash of the flags, so fact rows compute it without a join. With ``cross`` the result is as long as
    the product of the flags' numbers of values.
    """
    if mode == "distinct":
        combos = df.select(*flags).distinct()
    elif mode == "cross":
        combos = df.select(flags[0]).distinct()
        for c in flags[1:]:
            combos = explode_axis(combos, df, c)
    else:
        raise ValueError(f"unknown mode {mode}")
    return combos.select(junk_key(flags).alias(key), *flags)


def junk_key(flags: Sequence[str]) -> Column:
    """The junk dimension key of a row; each value goes in with its length, so no two rows share a text."""
    return F.md5(exact_key(flags))


def role_play(fact: DataFrame, dim: DataFrame, key: str, roles: Mapping[str, str],
              take: Sequence[str], small: bool = False) -> DataFrame:
    """Join one dimension once per role; columns come out as ``<role>_<column>``.

    ``small`` broadcasts the dimension: only for one of fixed size, such as a calendar.
    """
    out = fact
    for role, fk in roles.items():
        side = dim.select(F.col(key).alias(f"_k_{role}"), *[F.col(c).alias(f"{role}_{c}") for c in take])
        out = out.join(F.broadcast(side) if small else side, out[fk] == side[f"_k_{role}"], "left").drop(f"_k_{role}")
    return out


def bridge(pairs: DataFrame, entity: str, member: str) -> tuple[DataFrame, DataFrame]:
    """(entity → group key) and (group key, member, weight = 1/n).

    Entities with the same members share a group. The key is built from order-free
    aggregates (count and three hash sums over the members), so no member list of an
    entity is ever put together in one task.
    """
    distinct = pairs.select(entity, member).distinct()
    text = F.col(member).cast("string")
    h = [F.xxhash64(text, F.lit(salt)).cast("decimal(20,0)") for salt in (1, 2, 3)]
    groups = distinct.groupBy(entity).agg(
        F.count(F.lit(1)).alias("members"), *[F.sum(x).alias(f"_h{i}") for i, x in enumerate(h)])
    groups = groups.select(
        entity, "members",
        F.md5(F.concat_ws("|", F.col("members").cast("string"),
                          *[F.col(f"_h{i}").cast("string") for i in range(3)])).alias("group_key"))
    # One entity stands for each group, so its members are listed once.
    leader = groups.groupBy("group_key", "members").agg(F.min(entity).alias(entity))
    members = distinct.join(leader, entity).select(
        "group_key", member, (F.lit(1.0) / F.col("members")).alias("weight"))
    return groups.select(entity, "group_key"), members


def weighted_sum(fact: DataFrame, members: DataFrame, by: str, amount: str, name: str) -> DataFrame:
    """An amount through the bridge without counting it twice: the weights of a group add up to 1."""
    return fact.join(members, "group_key").groupBy(by).agg(F.sum(F.col(amount) * F.col("weight")).alias(name))


def band(column: str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the half-open interval [edge, next edge) a value falls in; NULL stays NULL."""
    if len(labels) != len(edges) + 1:
        raise ValueError("bands need one label more than edges")
    out = None
    for edge, label in zip(edges, labels):
        cond = F.col(column) < edge
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return F.when(F.col(column).isNull(), None).otherwise(out.otherwise(labels[-1]))


def minidimension(df: DataFrame, bands: Mapping[str, Column], key: str = "mini_key") -> tuple[DataFrame, DataFrame]:
    """Volatile attributes as bands: (rows with the key, distinct band combinations)."""
    banded = df.withColumns(dict(bands))
    keyed = banded.withColumn(key, junk_key(list(bands)))
    return keyed.drop(*bands), keyed.select(key, *bands).distinct()


def coverage_gaps(expected: Sequence[DataFrame], events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected combinations without an event.

    The first of ``expected`` may have several columns, each further one is an axis of one
    column. The combinations are what the report is about; they are spread, not looped over.
    """
    spine = expected[0].distinct()
    for axis in expected[1:]:
        spine = explode_axis(spine, axis, axis.columns[0])
    return spine.join(events.select(*keys).distinct(), list(keys), "left_anti")


def densify(df: DataFrame, spine: DataFrame, entities: DataFrame, entity: str, period: str, measures: Sequence[str],
            fill: str = "zero") -> DataFrame:
    """A row per entity and period. Gaps become 0 or carry the last known value forward.

    To fill with zeros the entities are spread over the calendar ``spine``. To carry values forward nothing is crossed: each known row
    makes its own cells up to the entity's next one. Rows of unknown entities or of periods off the spine take no part.
    """
    if fill == "carry":
        return _carried(df, spine, entities, entity, period, measures)
    if fill != "zero":
        raise ValueError(f"unknown fill {fill}")
    grid = explode_axis(entities.select(entity).distinct(), spine, period)
    out = grid.join(df.select(entity, period, *measures), [entity, period], "left")
    return out.withColumns({m: F.coalesce(F.col(m), F.lit(0)) for m in measures})


def _carried(df: DataFrame, spine: DataFrame, entities: DataFrame, entity: str, period: str, measures: Sequence[str]) -> DataFrame:
    places = row_numbers(spine.select(period).distinct(), [period], "_place")
    length = places.agg(F.count(F.lit(1)).alias("_length"))
    # Every entity begins at place 0, before the calendar, with nothing known.
    begin = entities.select(entity).distinct().select(entity, F.lit(0).cast("bigint").alias("_place"), *[
        F.lit(None).cast(df.schema[m].dataType).alias(m) for m in measures])
    known = df.where(F.col(entity).isNotNull()).select(entity, period, *measures).join(places, period).select(
        entity, F.col("_place").cast("bigint").alias("_place"), *measures)
    # An entity has at most a row per place, unless the input repeats cells.
    order = W.partitionBy(entity).orderBy("_place")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = begin.unionByName(known).withColumns(
        {f"_known_{i}": F.last(m, ignorenulls=True).over(so_far) for i, m in enumerate(measures)}
        | {"_first": F.min("_place").over(so_far), "_next": F.lead("_place").over(order)})
    rows = with_scalar(rows.where(F.col("_first") == 0), length)
    start = F.greatest(F.col("_place"), F.lit(1))
    # Of a repeated cell only the last row has a gap to fill, the others make themselves.
    end = F.greatest(F.coalesce(F.col("_next") - 1, F.col("_length")), F.col("_place"))
    cells = rows.where(start <= end).select(
        entity, F.explode(F.sequence(start, end)).alias("_place"), *[F.col(f"_known_{i}").alias(m) for i, m in enumerate(measures)])
    return cells.join(places, "_place").select(entity, period, *measures)


def aggregate_fact(df: DataFrame, grain: Sequence[str], measures: Mapping[str, str], *,
                   period: str | None = None, entity: Sequence[str] = ()) -> DataFrame:
    """Coarser facts. ``additive`` sums; ``semi_additive`` takes each entity's last value in the
    grain and adds those up; ``non_additive`` keeps sum and count so a ratio can be rebuilt."""
    kinds = set(measures.values())
    if not kinds <= {"additive", "semi_additive", "non_additive"}:
        raise ValueError(f"unknown additivity {kinds}")
    aggs = []
    for m, kind in measures.items():
        if kind == "additive":
            aggs.append(F.sum(m).alias(m))
        elif kind == "non_additive":
            aggs += [F.sum(m).alias(f"{m}_sum"), F.count(m).alias(f"{m}_count")]
    semi = [m for m, kind in measures.items() if kind == "semi_additive"]
    if not semi:
        return df.groupBy(*grain).agg(*aggs)
    if period is None or not entity:
        raise ValueError("semi-additive measures need the period and the entity")
    last = df.groupBy(*dict.fromkeys([*grain, *entity])).agg(
        *[F.max_by(m, period).alias(m) for m in semi]).groupBy(*grain).agg(*[F.sum(m).alias(m) for m in semi])
    return match_keys(df.groupBy(*grain).agg(*aggs), last, grain, "inner") if aggs else last


def split_by_type(df: DataFrame, type_col: str, key: str, core: Sequence[str],
                  extensions: Mapping[str, Sequence[str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """One core table for all types and an extension per type with only its own columns."""
    parts = {kind: df.where(F.col(type_col) == kind).select(key, *cols) for kind, cols in extensions.items()}
    return df.select(key, type_col, *core), parts


def null_density(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """Share of NULLs per column (and per type): half or more says the column is not for that type."""
    total = F.count(F.lit(1))
    aggs = [(F.count_if(F.col(c).isNull()) / total).alias(c) for c in columns]
    wide = df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_share")) for c in columns])
    return wide.select(*([by] if by else []), F.inline(rows)).withColumn(
        "type_specific", F.col("null_share") >= 0.5)


def conformance(a: DataFrame, b: DataFrame, key: str, attrs: Sequence[str]) -> DataFrame:
    """How far two copies of a dimension agree: keys on one side only, differing values per attribute."""
    joined = sides(a.select(key, *attrs), b.select(key, *attrs), [key])
    both = F.col("t").isNotNull() & F.col("s").isNotNull()
    counts = joined.agg(
        F.count_if(F.col("s").isNull()).alias("only_a"), F.count_if(F.col("t").isNull()).alias("only_b"),
        F.count_if(both).alias("shared"),
        *[F.count_if(both & ~F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}"))).alias(f"_d_{c}") for c in attrs])
    rows = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(f"_d_{c}").alias("mismatches")) for c in attrs])
    return counts.select("only_a", "only_b", "shared", F.inline(rows)).withColumn(
        "conformed", (F.col("mismatches") == 0) & ((F.col("only_a") == 0) | (F.col("only_b") == 0)))


def drill_across(facts: Mapping[str, tuple[DataFrame, Mapping[str, Column]]], dims: Sequence[str]) -> DataFrame:
    """Facts aggregated apart at the shared dimensions, then joined full outer."""
    out = None
    for df, measures in facts.values():
        part = df.groupBy(*dims).agg(*[expr.alias(n) for n, expr in measures.items()])
        out = part if out is None else out.join(part, list(dims), "full_outer")
    return out


def bus_matrix(facts: Mapping[str, DataFrame], dims: Mapping[str, tuple[DataFrame, str]],
               links: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Which fact uses which dimension: distinct fact keys, and how many the dimension knows.

    ``links`` maps fact and dimension to the fact's column.
    """
    out = None
    for fact, per_dim in links.items():
        for dim, fk in per_dim.items():
            side, key = dims[dim]
            keys = facts[fact].select(F.col(fk).alias("_k")).where("_k IS NOT NULL").distinct()
            known = side.select(F.col(key).alias("_k"), F.lit(1).alias("_in")).distinct()
            row = keys.join(known, "_k", "left").agg(
                F.count(F.lit(1)).alias("fact_keys"), F.count("_in").alias("found")
            ).select(F.lit(fact).alias("fact"), F.lit(dim).alias("dimension"), "fact_keys", "found",
                     ((F.col("fact_keys") > 0) & (F.col("fact_keys") == F.col("found"))).alias("uses"))
            out = row if out is None else out.unionByName(row)
    return out


def check_grain(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, keys that repeat and rows with an incomplete key."""
    incomplete = F.lit(False)
    for k in keys:
        incomplete = incomplete | F.col(k).isNull()
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_null", incomplete)
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("_n") > 1).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).alias("rows_with_null_key"),
    ).withColumn("grain_holds", (F.col("repeated_keys") == 0) & (F.col("rows_with_null_key") == 0))

