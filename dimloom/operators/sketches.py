"""Column profiles of tables that grow: a sketch per batch, merged on read, so that old batches are never read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimloom.operators.profiling import NUMERIC, TEMPORAL, _comparable
from dimloom.sources.files import Files

# Precision of the distinct counts: 2 ** 12 registers, a standard error of 1.6 %.
REGISTERS = 12
# Shares at which quantiles are given.
QUANTILES = (0.25, 0.5, 0.75)


def _as_number(field: T.StructField):
    """The column as a number for quantiles; NULL for other types and for values that are no numbers."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, NUMERIC):
        return F.nanvl(col.cast("double"), F.lit(None).cast("double"))
    if isinstance(field.dataType, TEMPORAL):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    return F.lit(None).cast("double")


class ProfileLog:
    """One small folder per batch below ``path``. A batch that is recorded again replaces what it recorded before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = Files(spark, self.path)

    def record(self, batch: DataFrame, batch_id: int) -> None:
        """Profile one batch in a single pass: counts, least and greatest, a sketch of distinct values and one of quantiles per column."""
        fields = _comparable(batch)
        sums = batch.agg(F.count(F.lit(1)).alias("_rows"), *[a for i, f in enumerate(fields) for a in (
            F.count(F.col(f"`{f.name}`")).alias(f"n{i}"),
            F.min(F.col(f"`{f.name}`")).alias(f"lo{i}"), F.max(F.col(f"`{f.name}`")).alias(f"hi{i}"),
            F.hll_sketch_agg(F.col(f"`{f.name}`").cast("string"), F.lit(REGISTERS)).alias(f"d{i}"),
            F.kll_sketch_agg_double(_as_number(f)).alias(f"q{i}"))])
        rows = F.array(*[F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.col("_rows").alias("rows"),
            (F.col("_rows") - F.col(f"n{i}")).alias("nulls"),
            *[(F.col(f"{e}{i}") if isinstance(f.dataType, NUMERIC) else F.lit(None)).cast("double").alias(f"{n}_number")
              for e, n in (("lo", "least"), ("hi", "greatest"))],
            *[F.col(f"{e}{i}").cast("string").alias(n) for e, n in (("lo", "least"), ("hi", "greatest"))],
            F.col(f"d{i}").alias("distinct_sketch"), F.col(f"q{i}").alias("quantile_sketch")) for i, f in enumerate(fields)])
        sums.select(F.inline(rows)).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={int(batch_id)}")

    def batches(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self._files.children(self.path) if n.startswith("batch="))

    def read(self) -> DataFrame:
        """The profile of all recorded batches: a row per column, from as many sketches as there are batches.

        ``distinct_values`` is an estimate, the counts, least and greatest values are exact. Numbers are ordered as numbers.
        """
        stored = self.spark.read.parquet(self.path)

        def extreme(pick, text: str):
            return F.coalesce(pick(F.col(text), F.col(f"{text}_number")), pick(F.col(text), F.col(text))).alias(text)

        merged = stored.groupBy("column_name", "type").agg(
            F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), extreme(F.min_by, "least"), extreme(F.max_by, "greatest"),
            F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch", F.lit(True))).alias("distinct_values"),
            F.kll_merge_agg_double("quantile_sketch").alias("_quantiles"))
        return merged.select(
            "column_name", "type", "rows", "nulls", "distinct_values", "least", "greatest",
            F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).alias("null_share"),
            F.when(F.kll_sketch_get_n_double("_quantiles") > 0, F.kll_sketch_get_quantile_double(
                "_quantiles", F.array(*map(F.lit, QUANTILES)))).alias("quantiles"))
