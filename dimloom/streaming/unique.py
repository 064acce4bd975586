"""One row per key over all batches of a stream, by an index of the stored keys.

Every batch is stored in folders by key bucket, and beside it a Bloom filter of its keys in pages of 32,768 bits. A later batch tests its keys
against the pages of its own keys' slots, all stored batches merged into one. What no page knows is new, and nothing stored is read for it. The rest, copies
and a few false hits, are looked up in just the files whose pages know them. So the cost follows the batch, and nothing
depends on when a row happened or arrived.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimloom.operators.relational import latest_per_key
from dimloom.session import materialize
from dimloom.streaming.loads import BatchTable

PAGE_BITS = 32_768
PROBES = 3


def _bit(hashed: Column, probe: int) -> Column:
    return F.pmod(F.xxhash64(hashed, F.lit(probe)), F.lit(PAGE_BITS)).cast("int")


def _set(page: Column, bit: Column) -> Column:
    """Whether the page has the bit: the lowest bit of a byte comes first, as ``bitmap_construct_agg`` writes it."""
    byte = F.conv(F.hex(F.substring(page, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.get(F.array(*[F.lit(1 << i) for i in range(8)]), F.pmod(bit, F.lit(8))).bitwiseAND(byte) != 0


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


class UniqueTable:
    """Each key once, the row that is first in ``order_by``, however the rows are cut into batches.

    A null is a key value like any other. Rows that ``order_by`` holds equal are told apart by their other columns. A copy that comes later but is first in
    the order is stored as a correction, and readers settle corrected keys; with ``corrections=False`` the row that came first stays.
    ``loaded`` has keys that are in another table already: their rows are left out. ``slots`` is the number of pages; about 4,000 keys a
    page keep false hits at three in a hundred, more keys cost reads, not results. ``buckets`` divides ``slots``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order_by: Sequence[str], *,
                 corrections: bool = True, loaded: DataFrame | None = None, buckets: int = 16, slots: int = 256):
        if slots % buckets:
            raise ValueError("buckets must divide slots")
        self.columns, self.keys, self.corrections, self.buckets, self.slots = schema.names, list(keys), corrections, buckets, slots
        named = {c.lstrip("-") for c in order_by}
        self.order = [*order_by, *[c for c in self.columns if c not in named and c not in self.keys]]
        stored = T.StructType([*schema.fields, T.StructField("_kind", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        self.rows = BatchTable(spark, f"{path.rstrip('/')}/rows", stored)
        self.pages = BatchTable(spark, f"{path.rstrip('/')}/pages", T.StructType.fromDDL("slot int, page binary"))
        # (batch, bucket) of the stored files the last batch had to read.
        self.files_read: list[tuple[int, int]] = []
        if loaded is not None and not self.rows.batches():
            known = self._placed(loaded.select(*self.keys).distinct())
            self._store(known.select(*[F.col(c) if c in self.keys else F.lit(None).cast(schema[c].dataType).alias(c) for c in self.columns],
                                     F.lit("known").alias("_kind"), "_bucket", "_hash", "_slot"), -1)

    def _placed(self, df: DataFrame) -> DataFrame:
        hashed = df.withColumn("_hash", F.xxhash64(*[x for k in self.keys for x in (F.col(k), F.col(k).isNull())]))
        return hashed.withColumn("_slot", F.pmod("_hash", F.lit(self.slots)).cast("int")).withColumn("_bucket", F.pmod("_slot", F.lit(self.buckets)).cast("int"))

    def _store(self, rows: DataFrame, batch: int) -> None:
        rows = materialize(rows)
        self.rows.write(rows.drop("_hash", "_slot"), batch, ["_kind", "_bucket"])
        bits = rows.select(F.col("_slot").alias("slot"), F.explode(F.array(*[_bit(F.col("_hash"), i) for i in range(PROBES)])).alias("bit"))
        self.pages.write(bits.groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("page")), batch)

    def _known_to(self, page: str) -> Column:
        return reduce(lambda a, b: a & b, [_set(F.col(page), _bit(F.col("_hash"), i)) for i in range(PROBES)])

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        rows = materialize(self._placed(latest_per_key(batch.select(*self.columns), self.keys, self.order)))
        pages = self.pages.read(before=batch_id).withColumnRenamed("slot", "_slot")
        own = pages.join(rows.select("_slot").distinct(), "_slot", "left_semi")
        merged = own.groupBy("_slot").agg(F.bitmap_or_agg("page").alias("_page"))
        tested = materialize(rows.join(merged, "_slot", "left").withColumn("_maybe", F.coalesce(self._known_to("_page"), F.lit(False))).drop("_page"))
        maybe = tested.where("_maybe").drop("_maybe")
        # One row per stored file at most.
        files = maybe.join(pages, "_slot").where(self._known_to("page")).select("batch", "_bucket").distinct().collect()
        self.files_read = sorted((f["batch"], f["_bucket"]) for f in files)
        fresh = tested.where("not _maybe").drop("_maybe").withColumn("_kind", F.lit("row"))
        if files:
            fresh = fresh.unionByName(self._settled(materialize(maybe), batch_id))
        self._store(fresh.select(*self.columns, "_kind", "_bucket", "_hash", "_slot"), batch_id)

    def _files(self, batch_id: int) -> DataFrame:
        """The stored rows of the files to read, picked by folder."""
        by_bucket: dict[int, list[int]] = {}
        for batch, bucket in self.files_read:
            by_bucket.setdefault(bucket, []).append(batch)
        here = reduce(lambda a, b: a | b, [(F.col("_bucket") == k) & F.col("batch").isin(v) for k, v in by_bucket.items()])
        return self.rows.read(before=batch_id).where(here)

    def _settled(self, maybe: DataFrame, batch_id: int) -> DataFrame:
        """The rows among ``maybe`` whose key is not stored, and those that go before the stored row of their key."""
        found = materialize(self._files(batch_id).alias("s").join(maybe.select(*self.keys).alias("m"), _same("s", "m", self.keys), "left_semi"))
        unknown = maybe.alias("m").join(found.select(*self.keys).distinct().alias("s"), _same("m", "s", self.keys), "left_anti").withColumn("_kind", F.lit("row"))
        if not self.corrections:
            return unknown
        known = found.where("_kind = 'known'").select(*self.keys)
        copies = maybe.alias("m").join(found.select(*self.keys).distinct().alias("s"), _same("m", "s", self.keys), "left_semi")
        copies = copies.alias("m").join(known.alias("k"), _same("m", "k", self.keys), "left_anti").withColumn("_new", F.lit(1))
        stored = found.where("_kind <> 'known'").select(*self.columns, *[F.lit(None).cast(copies.schema[c].dataType).alias(c) for c in (
            "_hash", "_slot", "_bucket")], F.lit(0).alias("_new"))
        first = latest_per_key(stored.unionByName(copies), self.keys, [*self.order, "_new"])
        return unknown.unionByName(first.where("_new = 1").drop("_new").withColumn("_kind", F.lit("again")))

    def read(self, before: int | None = None) -> DataFrame:
        """One row per key. Only keys that were corrected are compared."""
        stored = self.rows.read(before).where("_kind <> 'known'")
        if not self.corrections:
            return stored.select(*self.columns)
        again = stored.where("_kind = 'again'").select(*self.keys).distinct()
        if again.isEmpty():
            return stored.select(*self.columns)
        rest = stored.alias("s").join(again.alias("a"), _same("s", "a", self.keys), "left_anti")
        changed = stored.alias("s").join(again.alias("a"), _same("s", "a", self.keys), "left_semi")
        return rest.unionByName(latest_per_key(changed, self.keys, self.order)).select(*self.columns)
