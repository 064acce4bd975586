"""The load patterns on streams, through foreachBatch and Trigger.AvailableNow.

foreachBatch may run a batch again after a failure. Every writer here names its output by
the batch id and overwrites it, and reads only what earlier batches wrote, so a replay
leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimloom.operators.loads import Tracked, dedup, scd2_history, split_late
from dimloom.operators.quality import freshness
from dimloom.operators.relational import latest_per_key, with_scalar
from dimloom.sources.files import Files


def read_stream(spark: SparkSession, path: str, schema: T.StructType | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    """New files of a table as a stream. The schema is declared, or taken from the table."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if Files(spark, path).is_file(path):  # a stream watches a folder
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work through everything that has arrived, then stop."""
    query = (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


class BatchTable:
    """A parquet table with one folder per batch: ``<path>/batch=<id>``.

    A batch is complete when its ``_SUCCESS`` marker exists; a half-written one is
    invisible and is overwritten by the replay.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def folder(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def batches(self, before: int | None = None) -> list[int]:
        files = Files(self.spark, self.path)
        named = [int(n.removeprefix("batch=")) for n in files.children(self.path) if n.startswith("batch=")]
        return sorted(b for b in named if (before is None or b < before) and files.exists(f"{self.folder(b)}/_SUCCESS"))

    def write(self, df: DataFrame, batch: int, partition_by: Sequence[str] = ()) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(
            self.folder(batch))

    def read(self, before: int | None = None) -> DataFrame:
        """The rows of all complete batches, with the batch id as a column."""
        done = self.batches(before)
        full = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        if not done:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", self.path).parquet(*[self.folder(b) for b in done])


class UpsertLog:
    """SCD1 on a stream: each batch appends its own rows, readers take the newest per key.

    The newest row is the first in ``order_by`` over all batches, so a row that arrives late does not replace a newer one; only
    between equals does the later batch count. A batch costs its own size, whatever the size of the target. ``compact`` folds the
    log into one folder from time to time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order_by: Sequence[str]):
        self.table = BatchTable(spark, path, schema)
        self.keys, self.order_by = list(keys), list(order_by)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        self.table.write(dedup(batch.select(*self.table.schema.names), self.keys, self.order_by), batch_id)

    def current(self, before: int | None = None) -> DataFrame:
        return latest_per_key(self.table.read(before), self.keys, [*self.order_by, "-batch"]).select(*self.table.schema.names)

    def compact(self, path: str) -> UpsertLog:
        """Write the current rows as the first batch of a new log."""
        new = UpsertLog(self.table.spark, path, self.table.schema, self.keys, self.order_by)
        new.table.write(self.current(), max(self.table.batches(), default=0))
        return new


class Scd2Stream:
    """SCD2 on a stream. A batch writes the versions it closed and the current rows of the key buckets it touches.

    Several changes of a key in one batch make several versions, so the result does not
    depend on where one batch ends. A change that is not newer than its key's current version
    goes to the late table. Closed versions are never read or rewritten by later batches. Current rows lie in hash buckets of the key; a small table
    beside them says, per batch, which batch wrote each bucket last. Buckets without changes are neither read nor written, so with enough buckets
    a batch costs what its own keys' buckets hold.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], tracked: Tracked,
                 effective: str, start: DataFrame | None = None, buckets: int = 64):
        root = path.rstrip("/")
        self.schema, self.buckets = schema, buckets
        self.table = BatchTable(spark, f"{root}/versions", T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())]))
        self.places = BatchTable(spark, f"{root}/places", T.StructType.fromDDL("_bucket int, written bigint"))
        change = T.StructType([f for f in schema.fields if f.name not in ("valid_from", "valid_to", "is_current")]
                              + [T.StructField(effective, schema["valid_from"].dataType)])
        self.late = BatchTable(spark, f"{root}/late", change)
        self.keys, self.tracked, self.effective = list(keys), tracked, effective
        if start is not None and not self.places.batches():
            rows = self._bucketed(start.select(*schema.names))
            self._write(rows, -1, [r["_bucket"] for r in rows.select("_bucket").distinct().collect()], {})

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def written(self, before: int | None = None) -> dict[int, int]:
        """For each bucket the batch that wrote its current rows: at most ``buckets`` rows."""
        done = self.places.batches(before)
        if not done:
            return {}
        newest = self.places.read(before).where(F.col("batch") == done[-1])
        return {r["_bucket"]: r["written"] for r in newest.collect()}

    def _write(self, rows: DataFrame, batch: int, touched: Sequence[int], before: dict[int, int]) -> None:
        self.table.write(rows, batch, ["is_current", "_bucket"])
        now = sorted((before | dict.fromkeys(touched, batch)).items())
        self.places.write(self.table.spark.createDataFrame(now, self.places.schema).coalesce(1), batch)

    def _current(self, written: dict[int, int]) -> Column:
        """Marks the current rows that count, by folders alone."""
        by_batch: dict[int, list[int]] = {}
        for bucket, batch in written.items():
            by_batch.setdefault(batch, []).append(bucket)
        here = F.lit(False)
        for batch, some in by_batch.items():
            here = here | ((F.col("batch") == batch) & F.col("_bucket").isin(some))
        return F.col("is_current") & here

    def read(self, before: int | None = None) -> DataFrame:
        rows = self.table.read(before).where(~F.col("is_current") | self._current(self.written(before)))
        return rows.select(*self.schema.names)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        changes = self._bucketed(batch.select(*self.late.schema.names))
        touched = [r["_bucket"] for r in changes.select("_bucket").distinct().collect()]
        before = self.written(batch_id)
        stored = self.table.read(before=batch_id).where(self._current({k: v for k, v in before.items() if k in touched}))
        current = stored.select(*self.schema.names)
        newer, late = split_late(current, changes.drop("_bucket"), self.keys, self.effective)
        self.late.write(late, batch_id)
        self._write(self._bucketed(scd2_history(current, newer, self.keys, self.tracked, self.effective)), batch_id, touched, before)

    def trim(self, keep: int = 2) -> None:
        """Remove current rows that the newest ``keep`` batches no longer look at. Keep at least two, so the newest
        batch can still be replayed."""
        if keep < 2:
            raise ValueError("a replay of the newest batch needs the current rows before it")
        done = self.places.batches()
        used = {pair for b in done[-keep:] for pair in self.written(before=b + 1).items()}
        files = Files(self.table.spark, self.table.path)
        for batch in done[:-keep]:
            folder = f"{self.table.folder(batch)}/is_current=true"
            for name in files.children(folder):
                if (int(name.removeprefix("_bucket=")), batch) not in used:
                    files.remove(f"{folder}/{name}")


def route_late(target: BatchTable, late: BatchTable, event_time: str, allowed: str,
               loaded: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """Rows older than the newest loaded row by more than ``allowed`` go to a table of their own
    instead of being dropped.

    The newest time so far is stored with every batch, in one row; the stored rows are not read again. ``loaded``, rows loaded
    before the stream, are read by the first batch only.
    """
    newest = BatchTable(target.spark, f"{target.path}-newest", T.StructType([T.StructField("newest", target.schema[event_time].dataType)]))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        done = newest.batches(before=batch_id)
        if done:
            before = newest.read(before=batch_id).where(F.col("batch") == done[-1]).select("newest")
        else:
            before = target.spark.createDataFrame([], newest.schema)
            if loaded is not None:
                before = loaded.select(F.col(event_time).alias("newest"))
        marked = with_scalar(batch, before.agg((F.max("newest") - F.expr(f"interval {allowed}")).alias("_limit")))
        too_late = F.coalesce(F.col(event_time) < F.col("_limit"), F.lit(False))
        target.write(marked.where(~too_late).select(*target.schema.names), batch_id)
        late.write(marked.where(too_late).select(*late.schema.names), batch_id)
        newest.write(batch.select(F.col(event_time).alias("newest")).unionByName(before).agg(F.max("newest").alias("newest")), batch_id)

    return on_batch


class ChangeFeed:
    """A table kept up to date from a change feed with inserts, updates and deletes.

    A batch appends its newest change per key, deletes included, and costs its own size. Readers take the change with the highest
    sequence per key over all batches and leave deleted keys out, so changes may arrive in any order: an older
    update does not bring a deleted key back. Rows of ``start`` are older than every change.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], sequence: str, op: str,
                 sequence_type: T.DataType, start: DataFrame | None = None):
        full = T.StructType([*[f for f in schema.fields if f.name not in (sequence, op)], T.StructField(sequence, sequence_type),
                             T.StructField(op, T.StringType())])
        self.table = BatchTable(spark, path, full)
        self.columns, self.keys, self.sequence, self.op = schema.names, list(keys), sequence, op
        if start is not None and not self.table.batches():
            first = start.withColumns({sequence: F.lit(None).cast(sequence_type), op: F.lit("I")})
            self.table.write(first.select(*full.names), -1)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        self.table.write(dedup(batch.select(*self.table.schema.names), self.keys, [f"-{self.sequence}"]), batch_id)

    def current(self, before: int | None = None) -> DataFrame:
        newest = latest_per_key(self.table.read(before), self.keys, [f"-{self.sequence}", "-batch"])
        return newest.where(F.coalesce(F.col(self.op), F.lit("U")) != "D").select(*self.columns)


def monitor_freshness(table: BatchTable, column: str, now: Column, warn_hours: int = 24,
                      error_hours: int = 48) -> Callable[[DataFrame, int], None]:
    """One verdict per batch on the whole stream so far: a batch of old rows does not make a fresh table stale.

    ``table`` must hold ``max_loaded_at``, in which the newest time is carried on.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        done = table.batches(before=batch_id)
        newest = batch.agg(F.max(column).alias(column))
        if done:
            last = table.read(before=batch_id).where(F.col("batch") == done[-1])
            newest = newest.unionByName(last.select(F.col("max_loaded_at").alias(column)))
        table.write(freshness(newest, column, now, warn_hours, error_hours).select(*table.schema.names), batch_id)

    return on_batch
