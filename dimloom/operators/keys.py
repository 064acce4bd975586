"""Keys and composite relationships found in whole tables, level by level."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimloom.operators.relational import pieces

SAMPLE = 2_000
WITNESSES = 4
# Digests in a slice that is tested before whole tables, and the most digests or values that one task groups.
SLICE = 4_000_000
PIECE = 1_000_000
# Pieces of a frequent value.
SALTS = 16


def key_columns(df: DataFrame) -> list[str]:
    """Columns that can be part of a key: comparable, and no floating-point numbers."""
    odd = (T.MapType, T.ArrayType, T.StructType, T.BinaryType, T.FloatType, T.DoubleType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, odd)]


def maximal(sets: Iterable[int]) -> list[int]:
    """The bit sets that lie in no other one."""
    out: list[int] = []
    for s in sorted(set(sets), key=int.bit_count, reverse=True):
        if not any(s & o == s for o in out):
            out.append(s)
    return out


def least_sets(agreeing: Iterable[int], columns: int) -> list[int]:
    """The smallest column sets that no set of agreeing columns holds: for each of them they have a column outside."""
    full, found = (1 << columns) - 1, [0]
    for agree in maximal(agreeing):
        outside = [1 << i for i in range(columns) if not agree >> i & 1]
        hit, missed = [f for f in found if f & ~agree & full], [f for f in found if not f & ~agree & full]
        grown = {m | o for m in missed for o in outside}
        found = hit + [g for g in grown if not any(h & g == h for h in hit)]
        found = [f for f in found if not any(g != f and g & f == g for g in found)]
    return sorted(f for f in found if f) if found != [0] else [1 << i for i in range(columns)]


def agreements(rows: Sequence[tuple]) -> set[int]:
    """For every pair of rows the set of columns in which they agree."""
    import numpy as np

    if not rows:
        return set()
    codes = np.array([np.unique(np.array([str(x) for x in column]), return_inverse=True)[1] for column in zip(*rows)])
    weight = 1 << np.arange(len(codes), dtype=object)
    small = len(codes) < 62
    out: set[int] = set()
    for i in range(codes.shape[1] - 1):
        same = codes[:, i + 1:] == codes[:, i:i + 1]
        masks = (same * weight.astype(np.int64)[:, None]).sum(axis=0) if small else (same * weight[:, None]).sum(axis=0)
        out.update(int(m) for m in set(masks.tolist()))
    return out


def find_keys(df: DataFrame, sample: int = SAMPLE, slice_rows: int = SLICE) -> DataFrame:
    """All minimal column sets that identify a row of the whole table, however many columns they have.

    Two rows that agree in some columns rule out every set of those columns. Pairs from a bounded sample give the first such evidence; the smallest sets it leaves
    open are the candidates. Those of one size are tested together, and pairs that break a candidate become evidence for the next round. In a large table a
    slice of the values goes first: all rows of a value are in it or none, so what repeats there is broken beyond doubt, and only what holds there
    is moved whole. A key is confirmed by an exact pass over all rows alone, and the search ends when every candidate is. Columns with NULLs and
    floating-point columns belong to no key. A table with two equal rows, or without rows, has none.
    """
    result = "key string, columns int, rows bigint"
    spark, names = df.sparkSession, key_columns(df)
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)]).first()
    total = counted["n"]
    names = [c for i, c in enumerate(names) if counted[f"n{i}"] == total]
    if not total or not names:
        return spark.createDataFrame([], result)
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    columns = rows.columns

    def digest(members: Sequence[str]):
        """128 bits of the values of some columns."""
        return F.xxhash64(*members).alias("h"), F.xxhash64(F.lit(1), *reversed(members)).alias("g")

    def repeats(sets: Sequence[Sequence[str]], slices: int = 1) -> DataFrame:
        """(i, h, g) of the values that come more than once, in a slice of the values or in all. Keys hardly repeat, so rows are dealt out before they are counted."""
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *digest(m)) for i, m in enumerate(sets)])).alias("x")
        found = rows.select(each).select("x.*")
        if slices > 1:
            found = found.where(F.pmod("g", F.lit(slices)) == 0)
        dealt = found.repartition(pieces(spark, total * len(sets) // slices, PIECE), "i", "h", "g")
        return dealt.groupBy("i", "h", "g").agg(F.count(F.lit(1)).alias("k")).where("k > 1")

    if not repeats([columns]).isEmpty():
        return spark.createDataFrame([], result)
    # A draw by hash, so that reruns agree. A few more or fewer do no harm.
    drawn = rows.where(F.pmod(F.xxhash64(*columns), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, sample / total)))).limit(2 * sample)
    evidence = set(maximal(agreements([tuple(r) for r in drawn.collect()])))
    confirmed: set[int] = set()
    held: set[int] = set()  # not broken in a slice
    while True:
        candidates = least_sets(evidence, len(names))
        waiting = [c for c in candidates if c not in confirmed]
        if not waiting:
            break
        level = min(c.bit_count() for c in waiting)
        tested = [c for c in waiting if c.bit_count() == level]
        fresh = [c for c in tested if c not in held]
        slices = max(1, total * len(fresh) // slice_rows)
        if slices > 1:
            tested = fresh
        members = [[columns[i] for i in range(len(names)) if c >> i & 1] for c in tested]
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *digest(m)) for i, m in enumerate(members)])).alias("x")
        repeated = repeats(members, slices)
        # At most a few broken values per candidate come to the driver, and two rows of each.
        broken = repeated.groupBy("i").agg(F.slice(F.array_sort(F.collect_set(F.when(
            F.pmod("h", F.lit(1 << 10)) < WITNESSES, F.struct("h", "g")))), 1, WITNESSES).alias("some"), F.min(F.struct("h", "g")).alias("least")).collect()
        whole_ones = {c for i, c in enumerate(tested) if i not in {b["i"] for b in broken}}
        if slices > 1:
            held |= whole_ones
        else:
            confirmed |= whole_ones
        values = sorted({(b["i"], w["h"], w["g"]) for b in broken for w in [*b["some"], b["least"]]})
        if not values:
            continue
        wanted = F.broadcast(spark.createDataFrame(values, "i int, h bigint, g bigint"))
        whole = F.struct(*columns)
        pairs = rows.select(each, whole.alias("row")).select("x.*", "row").join(wanted, ["i", "h", "g"]).groupBy("i", "h", "g").agg(
            F.min("row").alias("a"), F.max("row").alias("b")).collect()
        for p in pairs:
            evidence.add(sum(1 << i for i, c in enumerate(columns) if p["a"][c] == p["b"][c]))
    found = [("+".join(n for i, n in enumerate(names) if c >> i & 1), c.bit_count(), total) for c in sorted(confirmed)]
    return spark.createDataFrame(found, result)


def find_composite_foreign_keys(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Column lists of a table whose values all lie in another table's key of several columns.

    Level by level: a list of m columns can only lie in the key's first m columns if its first m - 1 do and the m-th lies in the m-th alone. So each
    level extends what the level before confirmed by the columns that pass alone, and all lists of a level are tested in one pass: distinct
    values of the lists against distinct values of the keys' beginnings. Values are dealt out before they are made distinct, into as many pieces as their
    number asks for; a salt spreads frequent ones first. Columns must have the key column's type; rows with a NULL in the list
    are left out, and a list without any other row does not count. A key is not tested against itself.
    """
    spark = next(iter(tables.values())).sparkSession

    def kind(table: str, column: str) -> str:
        return tables[table].schema[column].dataType.simpleString()

    @cache
    def rows_of(table: str) -> int:
        return tables[table].count()

    def values(by_table: Mapping[str, Sequence[tuple[int, int, Sequence[str]]]], parts: int) -> DataFrame:
        """Distinct (i, head, v) of numbered lists of columns, dealt out by head and v."""
        found = []
        for table, lists in by_table.items():
            items = [F.struct(F.lit(i).alias("i"), F.lit(head).alias("head"), F.array(*[F.col(f"`{c}`").cast("string") for c in cs]).alias("v"))
                     for i, head, cs in lists]
            salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in sorted({c for *_, cs in lists for c in cs})]), F.lit(SALTS)).alias("salt")
            found.append(tables[table].select(salt, F.inline(F.array(*items))).where(~F.exists("v", F.isnull)))
        spread = reduce(DataFrame.unionByName, found).repartition(parts, "head", "v", "salt").distinct()
        return spread.drop("salt").repartition(parts, "head", "v").distinct()

    def confirmed(tests: Sequence[tuple[str, tuple[str, ...], str, tuple[str, ...]]]) -> list[int]:
        """The numbers of the tests (child, columns, parent, key columns) that hold."""
        if not tests:
            return []
        by_child, by_parent = {}, {}
        heads = {h: n for n, h in enumerate(sorted({(p, k) for _, _, p, k in tests}))}
        for i, (child, cs, parent, key) in enumerate(tests):
            by_child.setdefault(child, []).append((i, heads[parent, key], cs))
        for (p, k), n in heads.items():
            by_parent.setdefault(p, []).append((n, n, k))
        sizes = [rows_of(t) * len(lists) for by in (by_child, by_parent) for t, lists in by.items()]
        parts = pieces(spark, sum(sizes), PIECE)
        known = values(by_parent, parts).select("head", "v", F.lit(1).alias("hit"))
        met = values(by_child, parts).join(known, ["head", "v"], "left")
        return [r["i"] for r in met.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("k")).where("n = k").collect()]

    alone = [(t, (c,), p, (k,)) for p, ks in keys.items() for k in ks for t, df in tables.items() for c in df.columns if kind(t, c) == kind(p, k)]
    single = {(t, c[0], p, k[0]) for t, c, p, k in (alone[i] for i in confirmed(alone))}
    found = []
    for parent, ks in keys.items():
        level = [(t, (c,)) for t, c, p, k in sorted(single) if p == parent and k == ks[0]]
        for m in range(1, len(ks)):
            tests = [(t, (*cs, c), parent, tuple(ks[:m + 1])) for t, cs in level for t2, c, p, k in sorted(single)
                     if t2 == t and p == parent and k == ks[m] and c not in cs]
            level = [tests[i][:2] for i in sorted(confirmed(tests))]
        found += [(t, "+".join(cs), parent, "+".join(ks)) for t, cs in level if not (t == parent and tuple(cs) == tuple(ks))]
    return spark.createDataFrame(found, "child string, columns string, parent string, key string")
