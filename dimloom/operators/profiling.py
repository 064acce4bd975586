"""Answering catalog questions from the data: keys, relationships, watermarks, table kinds."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimloom.operators.ordered import Out, ordered_window
from dimloom.operators.relational import with_scalar

# Name parts of personal data.
PII_NAMES = ["email", "ssn", "dob", "phone", "mobile", "address", "zip", "postal_code", "credit_card", "card_number", "passport",
             "national_id", "ip_address", "birth_date", "first_name", "last_name", "full_name"]
# Our additions.
MORE_PII_NAMES = ["social_security"]
PII_VALUES = {  # the first match names the column
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "ip_address": r"^(?:\d{1,3}\.){3}\d{1,3}$",
    "credit_card": r"^(?:\d[ -]?){13,16}$",
    "phone": r"^(?=.*[() .-])\+?[\d(][\d() .-]{6,17}\d$",
}
# Names of load times, whole names first, then endings.
WATERMARK_NAMES = ["modified_at", "updated_at", "load_date", "etl_date", "batch_date"]
WATERMARK_ENDINGS = ["_dt", "_ts", "_dttm"]
# Our additions.
MORE_WATERMARK_NAMES = ["modified_date", "modifieddate", "updated_date", "updateddate", "load_at", "etl_at", "batch_at"]
MORE_WATERMARK_ENDINGS = ["_at", "date"]
START_NAMES = r"^(valid|effective|start)_?(from|date|start)$"
END_NAMES = r"^(valid|effective|end|expiry)_?(to|end|date)$"
FLAG_NAMES = r"^(is_current|current_flag)$"
SNAPSHOT_NAMES = r"^(snapshot|as_of|period|period_end|balance|month_end|reporting)_date$"
SURROGATE_NAMES = r"(_sk|_guid|_key)$"
NATURAL_NAMES = r"(_code|_number|_id|_nk)$"
BALANCE_NAMES = r"(balance|on_hand|inventory|headcount|level|stock|market_share|acctbal)"
FLOW_NAMES = r"(amount|qty|quantity|sales|revenue|freight|discount|price|total|tax|value)"

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _comparable(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.BinaryType))]


def profile_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: rows, NULLs, distinct values, least and greatest value, flag-like or not.

    NULLs, least and greatest come from one pass. Exact distinct counts run as one grouped
    aggregation over (column, value) pairs, combined before the shuffle; ``exact=False``
    uses a sketch in the same pass instead.
    """
    fields = _comparable(df)
    one_pass = df.agg(F.count(F.lit(1)).alias("_rows"), *[a for i, f in enumerate(fields) for a in (
        F.count(F.col(f"`{f.name}`")).alias(f"n{i}"),
        F.min(F.col(f"`{f.name}`")).cast("string").alias(f"lo{i}"),
        F.max(F.col(f"`{f.name}`")).cast("string").alias(f"hi{i}"),
        *([] if exact else [F.approx_count_distinct(F.col(f"`{f.name}`")).alias(f"d{i}")]),
    )])
    rows = F.array(*[F.struct(
        F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"),
        F.col("_rows").alias("rows"), (F.col("_rows") - F.col(f"n{i}")).alias("nulls"),
        F.col(f"lo{i}").alias("least"), F.col(f"hi{i}").alias("greatest"),
        (F.lit(None).cast("bigint") if exact else F.col(f"d{i}")).alias("distinct_values"),
    ) for i, f in enumerate(fields)])
    base = one_pass.select(F.inline(rows))
    if exact:
        base = base.drop("distinct_values").join(F.broadcast(distinct_counts(df)), "column_name", "left").withColumn(
            "distinct_values", F.coalesce(F.col("distinct_values"), F.lit(0)))
    return base.select(
        "column_name", "type", "rows", "nulls", "distinct_values", "least", "greatest",
        F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).alias("null_share"),
        F.col("distinct_values").between(2, 5).alias("flag_like"))


def distinct_counts(df: DataFrame) -> DataFrame:
    """(column_name, distinct_values): at most one row per column."""
    fields = _comparable(df)
    pairs = df.select(F.explode(F.array(*[F.struct(
        F.lit(f.name).alias("column_name"), F.col(f"`{f.name}`").cast("string").alias("value")) for f in fields])).alias("p")
    ).select("p.*").where("value IS NOT NULL").distinct()
    return pairs.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"))


def key_kind(df: DataFrame, column: str, load_order: str | None = None) -> DataFrame:
    """surrogate or natural: integer, dense, rising with the load, and what the name says."""
    integral = isinstance(df.schema[column].dataType, INTEGRAL)
    stats = df.agg(F.count(column).alias("n"), F.countDistinct(column).alias("d"),
                   *([F.min(column).alias("lo"), F.max(column).alias("hi")] if integral else []))
    dense = (F.col("hi") - F.col("lo") + 1 == F.col("d")) & (F.col("n") == F.col("d")) if integral else F.lit(False)
    score = F.lit(int(integral)) + dense.cast("int") + F.lit(
        1 if re.search(SURROGATE_NAMES, column) else -1 if re.search(NATURAL_NAMES, column) else 0)
    if integral and load_order:
        stats = with_rising(stats, df, column, load_order)
        score = score + F.col("rising").cast("int")
    return stats.select(F.lit(column).alias("column_name"), F.lit(integral).alias("is_integer"), dense.alias("is_dense"),
                        score.alias("score"), F.when(score >= 2, "surrogate").otherwise("natural").alias("kind"))


def with_rising(stats: DataFrame, df: DataFrame, column: str, load_order: str) -> DataFrame:
    """Does the key rise with the load order? Judged by correlation, which needs no sort."""
    corr = df.agg((F.coalesce(F.corr(F.col(column).cast("double"), F.unix_seconds(F.col(load_order).cast("timestamp"))
                                     .cast("double")), F.lit(0.0)) > 0.9).alias("rising"))
    return with_scalar(stats, corr)


def _is_load_time(name: str) -> bool:
    return name.endswith(tuple(WATERMARK_NAMES + MORE_WATERMARK_NAMES + WATERMARK_ENDINGS + MORE_WATERMARK_ENDINGS)) or name == "ts"


def find_watermark(df: DataFrame) -> DataFrame:
    """Datetime columns that could drive an incremental load, best first."""
    fields = [f for f in df.schema.fields if isinstance(f.dataType, TEMPORAL)]
    if not fields:
        return df.sparkSession.createDataFrame(
            [], "column_name string, type string, complete boolean, distinct_values bigint, name_match boolean, score int")
    probe = df.agg(F.count(F.lit(1)).alias("_rows"), *[a for i, f in enumerate(fields) for a in (
        F.count(f.name).alias(f"n{i}"), F.approx_count_distinct(f.name).alias(f"d{i}"))])
    rows = F.array(*[F.struct(
        F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"),
        (F.col(f"n{i}") == F.col("_rows")).alias("complete"), F.col(f"d{i}").alias("distinct_values"),
        F.lit(_is_load_time(f.name.lower())).alias("name_match")) for i, f in enumerate(fields)])
    return probe.select(F.inline(rows)).withColumn(
        "score", F.col("complete").cast("int") * 2 + F.col("name_match").cast("int") + (F.col("distinct_values") > 1).cast("int"))


def find_foreign_keys(tables: Mapping[str, DataFrame], keys: Mapping[str, str],
                      candidates: Mapping[str, Sequence[str]] | None = None, min_coverage: float = 1.0) -> DataFrame:
    """Columns whose values lie in another table's key, with the share that does.

    Only columns of a key's type are tried. One pass: the distinct (column, value) pairs of all tables meet the distinct
    (key, value) pairs of all parents in one join, so copies of a value never reach it and no table is read per pair of columns.
    """
    def kind_of(table: str, column: str) -> str:
        return tables[table].schema[column].dataType.simpleString()

    wanted = {kind_of(p, k) for p, k in keys.items()}
    own = {(p, k) for p, k in keys.items()}

    def pairs(table: str, columns: Sequence[str]) -> DataFrame:
        items = [F.struct(F.lit(table).alias("_t"), F.lit(c).alias("_c"), F.lit(kind_of(table, c)).alias("_kind"),
                          F.col(f"`{c}`").cast("string").alias("_v")) for c in columns]
        return tables[table].select(F.inline(F.array(*items))).where("_v IS NOT NULL").distinct()

    chosen = {t: [c for c in (candidates or {}).get(t, df.columns) if kind_of(t, c) in wanted] for t, df in tables.items()}
    sides = [pairs(t, columns) for t, columns in chosen.items() if columns]
    if not sides:
        raise ValueError("no column pairs to test")
    children = reduce(DataFrame.unionByName, sides).toDF("child", "column_name", "_kind", "_v")
    known = reduce(DataFrame.unionByName, [pairs(p, [k]) for p, k in keys.items()]).toDF("parent", "key", "_kind", "_v")
    sizes = children.groupBy("child", "column_name").agg(F.count(F.lit(1)).alias("values"))
    hits = children.join(known, ["_kind", "_v"]).groupBy("child", "column_name", "parent", "key").agg(F.count(F.lit(1)).alias("found"))
    itself = reduce(lambda x, y: x | y, [(F.col("child") == p) & (F.col("column_name") == k) & (F.col("parent") == p) for p, k in own])
    stem = lambda c: F.regexp_replace(c, "^[a-z]{1,2}_", "")
    out = hits.where(~itself).join(sizes, ["child", "column_name"]).select(
        "child", "column_name", "parent", "key", "values", "found", (stem("column_name") == stem("key")).alias("name_match"))
    return out.where(F.col("found") >= F.col("values") * min_coverage).withColumn("coverage", F.col("found") / F.col("values"))


def foreign_key_types(fks: DataFrame) -> DataFrame:
    """standard or role_playing: two or more columns of a table that point at the same key."""
    per = fks.groupBy("child", "parent", "key").agg(F.countDistinct("column_name").alias("_c"))
    return fks.join(per, ["child", "parent", "key"]).withColumn(
        "fk_type", F.when(F.col("_c") > 1, "role_playing").otherwise("standard")).drop("_c")


def find_degenerate(df: DataFrame, columns: Sequence[str], fk_columns: Sequence[str], min_share: float = 0.05) -> DataFrame:
    """Ids with many values, no target table, and more than one row per value."""
    tried = [c for c in columns if c not in fk_columns]
    # All columns' distinct values in one shuffle of (column, value) pairs.
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return with_scalar(distinct_counts(df.select(*tried)), rows).select(
        "column_name", "distinct_values", "rows",
        ((F.col("distinct_values") >= F.col("rows") * min_share) & (F.col("distinct_values") < F.col("rows"))).alias("degenerate"))


def find_pii(df: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Columns with personal data, by name or by the share of all their values that match a pattern."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs: list[Column] = []
    for i, c in enumerate(texts):
        aggs.append(F.count(c).alias(f"n{i}"))
        aggs += [F.count_if(F.col(c).rlike(p)).alias(f"h{i}_{k}") for k, p in PII_VALUES.items()]
    named = {f.name: next((p for p in PII_NAMES + MORE_PII_NAMES if p in _snake(f.name)), None) for f in df.schema.fields}
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    rows = []
    for f in df.schema.fields:
        by_value = F.lit(None).cast("string")
        if f.name in texts:
            i = texts.index(f.name)
            for k in reversed(list(PII_VALUES)):
                hit = (F.col(f"n{i}") > 0) & (F.col(f"h{i}_{k}") >= F.col(f"n{i}") * min_share)
                by_value = F.when(hit, F.lit(k)).otherwise(by_value)
        rows.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(named[f.name]).cast("string").alias("by_name"),
                             by_value.alias("by_value")))
    return wide.select(F.inline(F.array(*rows))).where("by_name IS NOT NULL OR by_value IS NOT NULL").withColumn(
        "suggested_action", F.lit("mask"))


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def measure_additivity(df: DataFrame, measures: Sequence[str], entity: str, period: str) -> DataFrame:
    """Balance or flow: name rules first, else whether a value stays close to its predecessor.

    A balance moves little between periods, so lag-1 autocorrelation per entity is high.
    """
    lagged = ordered_window(df.select(entity, period, *measures), [entity], [period, *measures],
                            [Out(f"_p_{m}", "lag", m) for m in measures])
    wide = lagged.agg(*[F.corr(F.col(m).cast("double"), F.col(f"_p_{m}").cast("double")).alias(m) for m in measures])
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("autocorrelation"), F.lit(
        "balance" if re.search(BALANCE_NAMES, _snake(m)) else "flow" if re.search(FLOW_NAMES, _snake(m)) else None
    ).cast("string").alias("by_name")) for m in measures])
    return wide.select(F.inline(rows)).withColumn("semantics", F.coalesce(
        F.col("by_name"), F.when(F.col("autocorrelation") > 0.8, "balance").otherwise("flow"))).withColumn(
        "additivity", F.when(F.col("semantics") == "balance", "semi_additive").otherwise("additive"))


def snapshot_density(df: DataFrame, entity: str, period: str) -> DataFrame:
    """Rows per possible (entity, period) pair: near 1 for a periodic snapshot."""
    pairs = df.groupBy(entity, period).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("pairs"),
        F.countDistinct(entity).alias("entities"), F.countDistinct(period).alias("periods"),
    ).withColumn("density", F.col("pairs") / F.nullif(F.col("entities") * F.col("periods"), F.lit(0).cast("bigint"))).withColumn(
        "kind", F.when((F.col("density") > 0.8) & (F.col("rows") == F.col("pairs")), "fact_periodic_snapshot")
        .otherwise("fact_transaction"))


def scd2_health(df: DataFrame, keys: Sequence[str], start: str = "valid_from", end: str = "valid_to",
                current: str = "is_current", **window) -> DataFrame:
    """One row of counts: keys with several versions, overlaps, gaps, keys without exactly one
    current row, and open versions not marked current.

    A version is compared with the one before it, so each pair of neighbours is looked at once.
    """
    lagged = ordered_window(df, keys, [start], [Out("_prev_end", "lag", end), Out("_pos", "row_number")], **window)
    has_prev = F.col("_pos") > 1
    # The keys are in place already: adding up per key first costs no shuffle.
    per_key = lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(current)).alias("_cur"),
        F.count_if(has_prev & (F.col("_prev_end").isNull() | (F.col("_prev_end") > F.col(start)))).alias("_overlaps"),
        F.count_if(has_prev & (F.col("_prev_end") < F.col(start))).alias("_gaps"),
        F.count_if(F.col(end) < F.col(start)).alias("_inverted"),
        F.count_if(F.col(end).isNull() != F.col(current)).alias("_mismatch"))

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return per_key.agg(
        total("_n").alias("versions"), total("_overlaps").alias("overlaps"), total("_gaps").alias("gaps"),
        total("_inverted").alias("inverted"), total("_mismatch").alias("flag_mismatch"), F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("_n") > 1).alias("versioned_keys"), F.count_if(F.col("_cur") > 1).alias("many_current"),
        F.count_if(F.col("_cur") == 0).alias("no_current"),
    ).withColumn("healthy", (F.col("overlaps") == 0) & (F.col("many_current") == 0) & (F.col("inverted") == 0)
                 & (F.col("flag_mismatch") == 0))


def classify_table(df: DataFrame, *, natural_key: Sequence[str] = (), foreign_keys: Sequence[str] = (),
                   entity: str | None = None, period: str | None = None, has_group_by: bool = False) -> DataFrame:
    """The table kind, from column shape and data evidence: (kind, confidence, rationale).

    ``dim_scd2`` needs two of three: a surrogate beside a natural key, versioning columns,
    and several versions per natural key in the data. ``unknown`` is a valid answer.
    """
    names = {c: _snake(c) for c in df.columns}

    def having(pattern: str) -> list[str]:
        return [c for c, n in names.items() if re.search(pattern, n)]

    kinds = {f.name: f.dataType for f in df.schema.fields}
    surrogate = having(SURROGATE_NAMES)
    versioned = (bool(having(START_NAMES)) and bool(having(END_NAMES))) or bool(having(FLAG_NAMES))
    snapshot_col = having(SNAPSHOT_NAMES)
    milestones = [c for c, k in kinds.items() if isinstance(k, TEMPORAL)
                  and c not in having(START_NAMES) + having(END_NAMES) and re.search(r"date$|_at$", names[c])]
    measures = [c for c, k in kinds.items() if isinstance(k, NUMERIC) and c not in foreign_keys and c not in natural_key
                and re.search(FLOW_NAMES + "|" + BALANCE_NAMES, names[c])]
    profile = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.approx_count_distinct(c).alias(f"d_{c}") for c in df.columns],
                     *[F.count(c).alias(f"n_{c}") for c in milestones]).first()
    rows = profile["_rows"]
    several = False
    if natural_key:
        several = not df.groupBy(*natural_key).count().where("count > 1").isEmpty()
    scd2 = [bool(surrogate) and bool(natural_key), versioned, several]
    flags = [c for c, k in kinds.items() if c not in natural_key and (
        isinstance(k, (T.BooleanType, *INTEGRAL)) and profile[f"d_{c}"] <= 5
        or isinstance(k, T.StringType) and 2 <= profile[f"d_{c}"] <= 5)]
    open_milestones = [c for c in milestones if profile[f"n_{c}"] < rows]

    def answer(kind: str, confidence: str, why: str) -> DataFrame:
        return df.sparkSession.createDataFrame([(kind, confidence, why)], "kind string, confidence string, rationale string")

    if sum(scd2) >= 2 and (versioned or several) and not measures:
        return answer("dim_scd2", "high" if all(scd2) else "medium", "surrogate key, versioning columns, versions in data: "
                      + ", ".join("yes" if s else "no" for s in scd2))
    if foreign_keys and len(milestones) >= 3 and len(open_milestones) >= 2:
        return answer("fact_accumulating_snapshot", "medium", "milestones still open: " + ", ".join(open_milestones))
    if (snapshot_col or (entity and period)) and measures:
        e, p = entity, period or snapshot_col[0]
        dense = e is not None and snapshot_density(df, e, p).first()["kind"] == "fact_periodic_snapshot"
        balance = any(re.search(BALANCE_NAMES, names[m]) for m in measures)
        if sum([bool(snapshot_col), dense, balance]) >= 2:
            return answer("fact_periodic_snapshot", "high" if dense else "medium", f"one row per {e} and {p}")
    if has_group_by and measures:
        return answer("fact_aggregate", "medium", "rows are aggregated before they are written")
    if foreign_keys and measures:
        return answer("fact_transaction", "high", "foreign keys and measures at event grain")
    if len(flags) >= 2 and len(flags) >= len(df.columns) - 1:
        return answer("dim_junk", "medium", "only low-cardinality flags: " + ", ".join(flags))
    if natural_key and not several:
        return answer("dim_scd1" if surrogate else "dim_non_scd", "medium", "one row per natural key")
    return answer("unknown", "low", "no rule applies")

