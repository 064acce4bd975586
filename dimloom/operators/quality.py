"""Data-quality checks: contracts, freshness, personal data, schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



@dataclass(frozen=True)
class TableContract:
    """What a table promises. ``relationships`` maps a column to (table, key column)."""

    not_null: Sequence[str] = ()
    unique: Sequence[Sequence[str]] = ()
    relationships: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    watermark: str | None = None
    pii: Mapping[str, str] = field(default_factory=dict)


def contract_from_profile(primary_key: Sequence[str], foreign_keys: Mapping[str, tuple[str, str]],
                          watermark: str | None = None, pii: Mapping[str, str] | None = None) -> TableContract:
    """The tests a table profile asks for: key unique and not null, relationships, recency, PII."""
    return TableContract(list(primary_key), [list(primary_key)] if primary_key else [], dict(foreign_keys),
                         watermark, dict(pii or {}))


def check_contract(tables: Mapping[str, DataFrame], contracts: Mapping[str, TableContract]) -> DataFrame:
    """One row per test with its number of failures.

    All NULL tests of a table share one scan; a uniqueness test is one aggregation and a
    relationship one anti join on distinct keys.
    """
    out = None

    def add(row: DataFrame) -> None:
        nonlocal out
        out = row if out is None else out.unionByName(row)

    def shaped(df: DataFrame, table: str, column: str, test: str) -> DataFrame:
        return df.select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
                         F.lit(test).alias("test"), F.col("failures").cast("bigint").alias("failures"))

    for name, contract in contracts.items():
        df = tables[name]
        if contract.not_null:
            wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in contract.not_null])
            rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("failures"))
                             for c in contract.not_null])
            add(wide.select(F.inline(rows)).select(
                F.lit(name).alias("table_name"), "column_name", F.lit("not_null").alias("test"),
                F.col("failures").cast("bigint").alias("failures")))
        for keys in contract.unique:
            present = F.lit(True)
            for k in keys:
                present = present & F.col(k).isNotNull()
            repeated = df.where(present).groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("failures"))
            add(shaped(repeated, name, "+".join(keys), "unique"))
        for column, (parent, key) in contract.relationships.items():
            if parent not in tables:
                continue  # only relationships to known tables are tested
            # Copies of a value are counted before the join, failures are rows.
            values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(
                F.count(F.lit(1)).alias("_n"))
            known = tables[parent].select(F.col(key).alias("_v")).distinct()
            lost = values.join(known, "_v", "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("failures"))
            add(shaped(lost, name, column, "relationships"))
    return out


def check_non_empty(tables: Mapping[str, DataFrame], raise_on_empty: bool = True) -> DataFrame:
    """Row counts of the inputs of a load; an empty one warns or stops the run.

    The run stops in a filter: a column of its own is dropped, error and all, by a reader that only counts the rows.
    """
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = row if out is None else out.unionByName(row)
    filled = F.col("rows") > 0
    if raise_on_empty:
        stop = F.raise_error(F.concat(F.lit("staging table is empty: "), F.col("table_name"))).cast("boolean")
        out = out.where(F.when(filled, True).otherwise(stop))
    return out.withColumn("status", F.when(filled, "ok").otherwise("empty"))


def freshness(df: DataFrame, column: str, now: Column, warn_hours: int = 24, error_hours: int = 48) -> DataFrame:
    """pass / warn / error by the age of the newest row."""
    newest = df.agg(F.max(column).alias("max_loaded_at"))
    age = F.timestamp_diff("HOUR", F.col("max_loaded_at"), now)
    return newest.withColumn("age_hours", age).withColumn(
        "status", F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_hours), "error")
        .when(F.col("age_hours") > warn_hours, "warn").otherwise("pass"))


def apply_pii(df: DataFrame, actions: Mapping[str, str], salt: str) -> DataFrame:
    """mask, drop, tokenize (a salted hash: equal values still join) or keep, per column."""
    out = df
    for column, action in actions.items():
        text = F.col(column).cast("string")
        if action == "mask":
            out = out.withColumn(column, F.mask(text, F.lit("X"), F.lit("x"), F.lit("n")))
        elif action == "tokenize":
            out = out.withColumn(column, F.when(text.isNotNull(), F.sha2(F.concat(F.lit(salt), text), 256)))
        elif action == "drop":
            out = out.drop(column)
        elif action != "keep":
            raise ValueError(f"unknown PII action {action}")
    return out


def schema_differences(df: DataFrame, contract: T.StructType) -> list[str]:
    """How a relation departs from a locked schema; an empty list means it does not."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in contract.fields}
    out = [f"missing {c}" for c in want if c not in have] + [f"unexpected {c}" for c in have if c not in want]
    out += [f"{c} is {have[c].simpleString()}, not {want[c].simpleString()}"
            for c in want if c in have and have[c] != want[c]]
    if not out and list(have) != list(want):
        out.append("columns are in another order")
    return out


def check_schema(df: DataFrame, contract: T.StructType) -> DataFrame:
    """The relation itself, if it has exactly the columns of the contract."""
    problems = schema_differences(df, contract)
    if problems:
        raise ValueError("schema is locked: " + "; ".join(problems))
    return df
