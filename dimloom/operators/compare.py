"""Comparing relations: equivalence, snapshot difference, parity of many tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimloom.functions.scalar import exact_hash

COUNT_NAMES = ("a_count", "b_count", "a_minus_b", "b_minus_a", "equivalent")


def copies(a: DataFrame, b: DataFrame, as_text: bool = True) -> DataFrame:
    """Every distinct row with its number of copies on either side.

    One scan of each side and one shuffle: both are counted together, so copies of a row are
    added up before they move.
    """
    cols = sorted(a.columns)
    if cols != sorted(b.columns):
        raise ValueError("the relations have different columns")

    def side(df: DataFrame, in_a: int) -> DataFrame:
        vals = [F.col(f"`{c}`").cast("string").alias(c) if as_text else F.col(f"`{c}`") for c in cols]
        return df.select(*vals, F.lit(in_a).alias("_a"), F.lit(1 - in_a).alias("_b"))

    return side(a, 1).unionByName(side(b, 0)).groupBy(*[f"`{c}`" for c in cols]).agg(
        F.sum("_a").alias("a_copies"), F.sum("_b").alias("b_copies"))


def multiset_diff(a: DataFrame, b: DataFrame, as_text: bool = True) -> DataFrame:
    """Rows whose number of copies differs, with both counts.

    ``as_text`` compares values by their text, columns by name.
    """
    return copies(a, b, as_text).where(F.col("a_copies") != F.col("b_copies"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: row counts, rows only on either side (with multiplicity), equivalent."""
    def total(c) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    extra = F.col("a_copies") - F.col("b_copies")
    return copies(a, b).agg(
        total("a_copies").alias("a_count"), total("b_copies").alias("b_count"),
        total(F.greatest(extra, F.lit(0))).alias("a_minus_b"), total(F.greatest(-extra, F.lit(0))).alias("b_minus_a"),
    ).withColumn("equivalent", (F.col("a_minus_b") == 0) & (F.col("b_minus_a") == 0))


# Words that make a statement more than a query.
WRITE_WORDS = ("INSERT", "UPDATE", "DELETE", "MERGE", "TRUNCATE", "DROP", "ALTER", "CREATE", "GRANT", "REVOKE",
               "EXEC", "EXECUTE", "CALL")


def require_query(sql: str) -> str:
    """Only one SELECT or WITH statement may be compared."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", " ", re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S))
    text = bare.strip().rstrip(";").strip()
    if not re.match(r"(?is)^(with|select)\b", text) or ";" in text:
        raise ValueError("only a single SELECT or WITH statement can be compared")
    words = set(re.findall(r"[A-Za-z_]+", text.upper()))
    bad = sorted(words & set(WRITE_WORDS))
    if bad:
        raise ValueError(f"a compared statement must not contain {', '.join(bad)}")
    return sql.strip().rstrip(";")


def compare_sql(spark: SparkSession, sql_a: str, sql_b: str, views: Mapping[str, DataFrame]) -> DataFrame:
    """Run two queries over the same input views and compare their rows."""
    require_query(sql_a), require_query(sql_b)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return compare(spark.sql(sql_a), spark.sql(sql_b))


def compare_scenarios(spark: SparkSession, sql_a: str, sql_b: str,
                      scenarios: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """``compare_sql`` once per scenario of input views."""
    out = None
    for name, views in scenarios.items():
        row = compare_sql(spark, sql_a, sql_b, views).select(F.lit(name).alias("scenario"), *COUNT_NAMES)
        out = row if out is None else out.unionByName(row)
    return out


def normalize(df: DataFrame, places: int = 2) -> DataFrame:
    """Values as they compare across databases: NULL as a token, booleans as 0/1, times as
    days, fractions rounded, lower-case column names, all as text."""
    out = []
    for field in df.schema.fields:
        c: Column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.BooleanType):
            c = c.cast("int")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = c.cast("date")
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.bround(c.cast("double"), places)
        elif isinstance(kind, T.BinaryType):
            c = F.lower(F.hex(c))
        out.append(F.coalesce(c.cast("string"), F.lit("__NULL__")).alias(field.name.lower()))
    return df.select(*out)


def parity(tables_a: Mapping[str, DataFrame], tables_b: Mapping[str, DataFrame], places: int = 2) -> DataFrame:
    """Per table: row counts, and distinct normalised rows on one side only (copies are ignored)."""
    out = None
    for name in sorted(tables_a):
        a, b = normalize(tables_a[name], places), normalize(tables_b[name], places)
        cols = sorted(a.columns)
        both = a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
            b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
        row = both.groupBy(*cols).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).agg(
            F.coalesce(F.sum("_a"), F.lit(0)).alias("a_count"), F.coalesce(F.sum("_b"), F.lit(0)).alias("b_count"),
            F.count_if(F.col("_b") == 0).alias("only_a"), F.count_if(F.col("_a") == 0).alias("only_b"),
        ).select(F.lit(name).alias("table_name"), "*").withColumn(
            "ok", (F.col("only_a") == 0) & (F.col("only_b") == 0))
        out = row if out is None else out.unionByName(row)
    return out


def examples(a: DataFrame, b: DataFrame, n: int = 5) -> DataFrame:
    """Up to ``n`` differing rows per side, for a report."""
    diff = multiset_diff(a, b)
    cols = [c for c in diff.columns if c not in ("a_copies", "b_copies")]
    left = diff.where("a_copies > b_copies").orderBy(*cols).limit(n).withColumn("side", F.lit("a"))
    right = diff.where("b_copies > a_copies").orderBy(*cols).limit(n).withColumn("side", F.lit("b"))
    return left.unionByName(right)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], hash_col: str | None = None) -> DataFrame:
    """new / changed / unchanged / removed per key. A missing old hash counts as changed.

    Values are compared as they are, letter case and white space included, unless ``hash_col`` holds hashes of another kind.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        rest = sorted(c for c in df.columns if c not in keys)
        digest = F.col(hash_col) if hash_col else exact_hash(rest)
        return df.select(*keys, digest.alias(f"_{name}"), F.lit(True).alias(f"_in_{name}"))

    joined = side(old, "old").join(side(new, "new"), list(keys), "full_outer")
    return joined.select(*keys, F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), "removed")
                         .when(F.col("_old").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")), "changed")
                         .otherwise("unchanged").alias("status"))
