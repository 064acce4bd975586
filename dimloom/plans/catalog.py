"""The registry of queries and, where SQL can say the same, their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimloom.plans.staging import Staging, with_stage
from dimloom.session import tune


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[Staging], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(staging) -> DataFrame`` under ``name``.

    ``covers`` lists the inventory ids the query exercises. ``sql`` may use any
    staging relation by name; the needed CTEs are put in front.
    """

    def register(fn: Callable[[Staging], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(name, fn, with_stage(sql) if sql else None, tuple(covers.split()))
        return fn

    return register


def plain_types(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and decimals as DOUBLE, for reports that leave the warehouse."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            out.append(col.cast("double").alias(field.name))
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(col.cast("bigint").alias(field.name))
        else:
            out.append(col)
    return df.select(*out)


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Entry):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return plain_types(entry.build(Staging(spark, sf_dir)))

        return run

    return {name: bind(entry) for name, entry in REGISTRY.items()}


def check_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in REGISTRY.items() if entry.sql}
