"""Comparing large snapshots by a tree of digests written with them.

Rows are stored by the leading bits of a hash of their key. Each bucket has a digest that does not depend on the order of its rows, and so has
every prefix of its bits, up to the root. Two snapshots are compared from the root down: only below nodes whose digests differ are nodes looked at,
and only rows of buckets that differ are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dimloom.functions.scalar import exact_hash
from dimloom.session import materialize

# Levels of the tree lie four bits apart.
STEP = 4
MOST_BITS = 16


def _pieces(cols: Sequence[str]) -> list[Column]:
    """Two numbers of 60 bits from the exact hash of a row; their sums have room for 10^19 rows."""
    digest = exact_hash(cols)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(28,0)") for at in (1, 16)]


def _digest(cols: Sequence[str]) -> list[Column]:
    a, b = _pieces(cols)
    return [F.count(F.lit(1)).alias("rows"), F.sum(a).alias("sum_a"), F.sum(b).alias("sum_b")]


class Snapshot:
    """``path``/rows, in one folder per bucket, and ``path``/digests, written last: a snapshot without them is not finished."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, df: DataFrame, keys: Sequence[str], bits: int = 8) -> Snapshot:
        """Store ``df`` by ``2 ** bits`` buckets of its keys. Keys may be null or repeated, whole rows, too."""
        if bits % STEP or not 0 < bits <= MOST_BITS:
            raise ValueError(f"bits must be a multiple of {STEP} up to {MOST_BITS}")
        if {"_bucket", "rows", "sum_a", "sum_b", "level", "node"} & set(df.columns):
            raise ValueError("the column names _bucket, rows, sum_a, sum_b, level and node are taken")
        # The adaptive planner splits a bucket that a hot key makes large.
        placed = df.withColumn("_bucket", F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits).cast("int")).hint("rebalance", "_bucket")
        placed.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/rows")
        cols = sorted(df.columns)
        leaves = self.spark.read.schema(placed.schema).parquet(f"{self.path}/rows").groupBy("_bucket").agg(*_digest(cols))
        leaves = materialize(leaves)
        tree = None
        for level in range(0, bits + 1, STEP):
            nodes = leaves.groupBy(F.shiftright("_bucket", bits - level).alias("node")).agg(*[F.sum(c).cast(leaves.schema[c].dataType).alias(c) for c in ("rows", "sum_a", "sum_b")])
            nodes = nodes.select(F.lit(level).alias("level"), "node", "rows", "sum_a", "sum_b")
            tree = nodes if tree is None else tree.unionByName(nodes)
        tree.withColumns({"keys": F.array(*map(F.lit, keys)), "columns": F.array(*map(F.lit, cols))}).coalesce(1).sortWithinPartitions(
            "level", "node").write.mode("overwrite").parquet(f"{self.path}/digests")
        return self

    def digests(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/digests")

    def described(self) -> tuple[int, list[str], list[str]]:
        """(bits, keys, columns); an empty snapshot has no bits."""
        top = self.digests().agg(F.max("level").alias("bits"), F.first("keys").alias("keys"), F.first("columns").alias("columns")).first()
        return top["bits"] or 0, top["keys"] or [], top["columns"] or []

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")


def _differing(old: Snapshot, new: Snapshot, level: int, below: Sequence[int] | None) -> list[int]:
    """Nodes of a level, children of the nodes ``below`` one level up, whose digests differ."""
    def side(s: Snapshot) -> DataFrame:
        nodes = s.digests().where(F.col("level") == level)
        return nodes.where(F.shiftright("node", STEP).isin(list(below))) if below is not None else nodes

    counts = ["rows", "sum_a", "sum_b"]
    both = side(old).select("node", *counts).unionByName(side(new).select("node", *[(-F.col(c)).alias(c) for c in counts]))
    differ = both.groupBy("node").agg(*[F.sum(c).alias(c) for c in counts]).where(" OR ".join(f"{c} <> 0" for c in counts))
    return sorted(r.node for r in differ.select("node").collect())  # at most 2 ** MOST_BITS numbers


def differing_buckets(old: Snapshot, new: Snapshot) -> tuple[int, list[int]]:
    """(bits, buckets of so many bits that differ). Trees of other depth are compared down to the shallower one's leaves."""
    (a, keys_a, cols_a), (b, keys_b, cols_b) = old.described(), new.described()
    if a and b and (keys_a != keys_b or cols_a != cols_b):
        raise ValueError("the snapshots have different keys or columns")
    bits = min(a, b)
    found = None
    for level in range(0, bits + 1, STEP):
        found = _differing(old, new, level, found)
        if not found:
            return bits, []
    return bits, found or []


def same_rows(old: Snapshot, new: Snapshot) -> bool:
    """Whether both hold the same rows as often, by the roots alone. No row is read."""
    return not _differing(old, new, 0, None)


def changed_rows(old: Snapshot, new: Snapshot) -> DataFrame:
    """(keys, status): new, changed or removed, for the keys that are. Rows of equal buckets are not read.

    A key that has several rows counts as changed if their number or any of them differs. Values are compared as they are. One shuffle of what
    was read; rows of a key are added up before they move.
    """
    bits_old, keys_old, cols_old = old.described()
    bits_new, keys_new, cols_new = new.described()
    bits, buckets = differing_buckets(old, new)
    keys, cols = (keys_old, cols_old) if bits_old else (keys_new, cols_new)
    if not cols:
        raise ValueError("both snapshots are empty")

    def side(s: Snapshot, own: int, name: str) -> DataFrame | None:
        if not own:
            return None
        # Leaves below the differing nodes, as literals, so that the scan lists only their folders.
        spread = 1 << (own - bits)
        wanted = [n * spread + i for n in buckets for i in range(spread)]
        a, b = _pieces(cols)
        rows = s.rows().where(F.col("_bucket").isin(wanted) if wanted else F.lit(False))
        other = "new" if name == "old" else "old"
        return rows.select(*keys, *[F.lit(1).alias(f"_n_{name}"), a.alias(f"_a_{name}"), b.alias(f"_b_{name}")],
                           *[F.lit(0).cast(t).alias(f"_{c}_{other}") for c, t in (("n", "int"), ("a", "decimal(28,0)"), ("b", "decimal(28,0)"))])

    sides = [s for s in (side(old, bits_old, "old"), side(new, bits_new, "new")) if s is not None]
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    names = [f"_{c}_{s}" for s in ("old", "new") for c in ("n", "a", "b")]
    summed = both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    return summed.where("_n_old <> _n_new OR _a_old <> _a_new OR _b_old <> _b_new").select(
        *keys, F.when(F.col("_n_old") == 0, "new").when(F.col("_n_new") == 0, "removed").otherwise("changed").alias("status"))
