"""Reading, sampling and writing tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimloom.sources.files import Files


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               schema: T.StructType | str | None = None) -> DataFrame:
    """Full scan; only the listed columns reach the file reader. A declared schema saves the
    job that would look at the files."""
    df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    return df.select(*columns) if columns else df


def read_database_table(spark: SparkSession, url: str, table: str, columns: Sequence[str] | None = None,
                        *, split_on: str | None = None, lower: int | None = None, upper: int | None = None,
                        partitions: int | None = None, **options: str) -> DataFrame:
    """Scan a database table over JDBC. ``split_on`` with its bounds reads in parallel;
    the bounds only set the stride, every row is read."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split_on is not None:
        if lower is None or upper is None or not partitions:
            raise ValueError("split_on needs lower, upper and partitions")
        reader = (reader.option("partitionColumn", split_on).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", partitions))
    df = reader.load()
    return df.select(*columns) if columns else df


def orderable_columns(schema: T.StructType) -> list[str]:
    """Columns a stable sort can use: no bytes, maps or variants, at any depth."""

    def ok(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return ok(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(ok(f.dataType) for f in kind.fields)
        return not isinstance(kind, (T.BinaryType, T.MapType, T.VariantType))

    return [f.name for f in schema.fields if ok(f.dataType)]


def capped_scan(df: DataFrame, limit: int, predicate: str | Column | None = None,
                columns: Sequence[str] | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first ``limit`` rows in a total order. Spark keeps ``limit`` rows per task
    and merges them, so nothing is sorted as a whole."""
    if predicate is not None:
        df = df.where(predicate)
    if columns:
        df = df.select(*columns)
    return df.orderBy(*(order_by or orderable_columns(df.schema))).limit(limit)


@dataclass(frozen=True)
class CopyPlan:
    name: str
    source: Callable[[], DataFrame]
    predicate: str | None = None
    columns: tuple[str, ...] = field(default_factory=tuple)


COPY_REPORT = "fqn string, status string, rows bigint, error string"


def plan_copies(tables: Mapping[str, Callable[[], DataFrame]], *, select: Iterable[str] | None = None,
                exclude: Iterable[str] | None = None, filters: Iterable[str] | None = None) -> list[CopyPlan]:
    """Choose the tables to copy, in the order they are given. Letter case of names does not matter.

    A filter reads ``name=predicate``. Everything that is wrong with a request is reported at once.
    """
    picked, left_out = ({n.lower() for n in names or ()} for names in (select, exclude))
    cuts = [re.fullmatch(r"\s*([^=\s][^=]*?)\s*=\s*(\S.*?)\s*", text, re.S) for text in filters or ()]
    problems = [f"not a name=predicate filter: {text}" for text, cut in zip(filters or (), cuts) if cut is None]
    predicates = {cut[1].lower(): cut[2] for cut in cuts if cut}
    plans = []
    for name, source in tables.items():
        key = name.lower()
        if key not in left_out and (key in picked or select is None):
            plans.append(CopyPlan(key, source, predicates.pop(key, None)))
    existing = {name.lower() for name in tables}
    problems += [f"no such table: {name}" for name in sorted((picked | left_out) - existing)]
    problems += [f"filter on a table that is not copied: {name}" for name in sorted(predicates)]
    if problems:
        raise ValueError("; ".join(problems))
    return plans


def replicate(spark: SparkSession, tables: Mapping[str, Callable[[], DataFrame]],
              target_path: Callable[[str], str], *, limit: int | None = None,
              select: Iterable[str] | None = None, exclude: Iterable[str] | None = None,
              filters: Iterable[str] | None = None, dry_run: bool = False) -> DataFrame:
    """Copy tables, one Spark job each. A table that fails is reported and the rest go on.

    Whole tables are copied; ``limit`` keeps the first rows of a total order of each instead.
    """
    if limit is not None and limit < 1:
        raise ValueError("a limit must be 1 or more")
    plans = plan_copies(tables, select=select, exclude=exclude, filters=filters)
    if dry_run:
        return spark.createDataFrame([(p.name, "planned", None, None) for p in plans], COPY_REPORT)
    report = []
    for plan in plans:
        try:
            df = plan.source()
            if limit is not None:
                df = capped_scan(df, limit, plan.predicate)
            elif plan.predicate:
                df = df.where(plan.predicate)
            path = target_path(plan.name)
            rows = replace_rows(df, path)
            report.append((plan.name, "ok", rows, None))
        except Exception as error:  # noqa: BLE001 - one table must not stop the others
            report.append((plan.name, "error", None, str(error).splitlines()[0]))
    return spark.createDataFrame(report, COPY_REPORT)


def replace_rows(df: DataFrame, path: str, partition_by: Sequence[str] = (), **options: str) -> int:
    """Replace a table's rows and return how many were written. ``options`` go to the writer.

    The new rows are written next to the target first and only then put in its place,
    so a failed write leaves the old table whole. The count is taken by the write itself.
    """
    path = path.rstrip("/")
    incoming, outgoing = f"{path}__incoming", f"{path}__outgoing"
    files = Files(df.sparkSession, path)
    if not files.exists(path) and files.exists(outgoing):
        # An earlier swap stopped half way: the old table is still whole, take it back.
        files.move(outgoing, path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").options(**options).partitionBy(*partition_by).parquet(incoming)
    if files.exists(path):
        files.remove(outgoing)
        if not files.move(path, outgoing):
            raise OSError(f"cannot move {path} aside")
    if not files.move(incoming, path):
        if files.exists(outgoing):
            files.move(outgoing, path)
        raise OSError(f"cannot put the new rows in place at {path}")
    files.remove(outgoing)
    return seen.get["rows"]


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def truncate_rows(spark: SparkSession, path: str) -> None:
    """Keep the schema, drop every row."""
    replace_rows(spark.createDataFrame([], spark.read.parquet(path).schema), path)


def create_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty table; an existing one is an error."""
    spark.createDataFrame([], schema).write.mode("errorifexists").parquet(path)


def create_table_as(df: DataFrame, path: str) -> DataFrame:
    """SELECT INTO: write the result and return the new table."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staging_view(df: DataFrame, name: str) -> None:
    """A pass-through view over a source: no cast, rename, filter or join."""
    df.createOrReplaceTempView(name)


def inline_values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def content_signature(df: DataFrame) -> tuple[int, str]:
    """Row count and an order-free content hash, in one aggregation.

    A null is hashed as such, so a value that moves to another column changes the hash.
    """
    marked = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    hashed = F.xxhash64(*marked).cast("decimal(38,0)")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hashed), F.lit(0)).alias("h")).first()
    return row["n"], str(row["h"])


# Doubled quotes, NULL apart from the empty string, line breaks inside quotes.
SEED_FORMAT = {"header": "true", "nullValue": "\\N", "escape": '"', "multiLine": "true"}


def export_seed(df: DataFrame, path: str) -> tuple[bool, int]:
    """Write a table as CSV with a header, only if its content changed.

    Returns (written, rows). The old file is read with the new schema, so the test
    costs one scan of each and no sort.
    """
    spark = df.sparkSession
    rows, digest = content_signature(df)
    if Files(spark, path).exists(path):
        try:
            if content_signature(read_seed(spark, path, df.schema)) == (rows, digest):
                return False, rows
        except Exception:  # noqa: BLE001 - an earlier export of another shape is replaced
            pass
    df.write.mode("overwrite").options(**SEED_FORMAT).csv(path)
    return True, rows


def read_seed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**SEED_FORMAT).option("enforceSchema", False).csv(path)


def referential_sample(parent: DataFrame, child: DataFrame, key: str, n: int,
                       order_by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` parents and every child row that belongs to one of them."""
    head = parent.orderBy(*order_by).limit(n)
    return head, child.join(head.select(key).distinct(), key, "left_semi")


def stable_sample(df: DataFrame, key: Sequence[str], one_in: int, seed: int = 42) -> DataFrame:
    """About one row in ``one_in``, chosen by a hash of the key: the same rows on every
    run, whatever the partitioning."""
    return df.where(F.pmod(hash_number(key, seed), F.lit(one_in)) == 0)


def hash_number(key: Sequence[str], seed: int) -> Column:
    """28 bits of MD5 over the key and the seed, a number other engines can compute too."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint")


def derive_returns(details: DataFrame, reasons: Sequence[str], *, one_in: int = 20, seed: int = 42,
                   sold_on: str = "modified_date") -> DataFrame:
    """Returns for about one sale in ``one_in``: quantity capped by the sold quantity,
    a reason and a delay of 1 to 30 days drawn from the same hash."""
    key = ["sales_order_id", "sales_order_detail_id"]
    # the draw of the sample is 0 modulo one_in, so the other draws use its quotient
    pick = F.call_function("div", hash_number(key, seed), F.lit(one_in).cast("bigint"))
    reason = F.array(*[F.lit(r) for r in reasons])
    return stable_sample(details, key, one_in, seed).select(
        *key,
        F.expr(f"{sold_on} + make_dt_interval(1)").alias("_first_day"),
        pick.alias("_pick"), "order_qty",
    ).select(
        *key,
        F.expr("_first_day + make_dt_interval(cast(pmod(_pick, 30) as int))").alias("return_date"),
        F.least(F.col("order_qty"), F.pmod(F.col("_pick"), F.lit(3)) + 1).alias("return_qty"),
        reason[F.pmod(F.col("_pick"), F.lit(len(reasons))).cast("int")].alias("return_reason"),
    )
