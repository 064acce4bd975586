"""Filter interaction audit: what each filter of a chain removes, in every order, and its Shapley value.

A document is a bit mask of the filters it fails. Per part the documents of each mask are counted once, which tabulates what every
coalition of filters removes (32 coalitions for five filters): ``v(S)`` counts the masks that meet ``S``. Everything else comes from these tables. A step
removes ``v(S with its filter) - v(S)``. The Shapley values are the solution of a least-squares problem: the additive game nearest to
``v`` under the Shapley kernel's weights, with the values adding up to ``v`` of all filters. Its normal equations are solved
in rational numbers once (they depend on the number of filters only) and applied to each part's table as whole numbers, so nothing is rounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimloom.llm.common import join_small, texts
from dimloom.session import materialize

MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
LETTERS = "ABCDE"
_CAPITALS = bytes(range(65, 91))


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X with ``matrix`` X = ``right``, exactly."""
    size = len(matrix)
    rows = [[*a, *b] for a, b in zip(matrix, right)]
    for i in range(size):
        pivot = next(r for r in range(i, size) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(size):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [row[size:] for row in rows]


def shapley_matrix(n: int) -> list[list[Fraction]]:
    """For each of ``n`` filters the factors of v(S), S = 0 .. 2**n - 1, in its Shapley value.

    The values x minimise the sum over coalitions of weight(S) * (v(S) - sum of x in S)**2 while all x add up to v of all
    filters; the last unknown is that condition's multiplier.
    """
    full = (1 << n) - 1
    weight = {s: Fraction(n - 1, comb(n, k) * k * (n - k)) for s in range(1, full) if (k := s.bit_count())}
    left = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    right = [[Fraction(0)] * (full + 1) for _ in range(n + 1)]
    for s, w in weight.items():
        members = [i for i in range(n) if s >> i & 1]
        for i in members:
            right[i][s] += w
            for j in members:
                left[i][j] += w
    for i in range(n):
        left[i][n] = left[n][i] = Fraction(1)
    right[n][full] = Fraction(1)
    return solve(left, right)[:n]


def text_failures(df: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``id``, ``part`` and ``mask`` per row: which of the conditions A to E (bits 0 to 4) its text fails.

    A: under 50 words. B: under 65 different words in 100. C: over 5 of 100 code points are capitals A-Z. D: holds one of ``#$%&*|``.
    E: a row of the whole table with a smaller id has the same text. A null text is empty; words are cut at ASCII white space, case counts. A null
    part is the empty string. A null id is larger than any id, and rows of one id are not copies of each other. Texts are the same when their
    SHA-256 is.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            masks, digests = [], []
            for raw in texts(batch.column(2)):
                words = raw.split()
                capitals = len(raw) - len(raw.translate(None, _CAPITALS))
                # Only within 5 percent of the bytes can the number of code points decide.
                many = 100 * capitals > CAPITAL_PERCENT * len(raw) or (
                    capitals > 0 and not raw.isascii() and 100 * capitals > CAPITAL_PERCENT * len(raw.decode()))
                masks.append((len(words) < MIN_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
                             | many << 2 | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3)
                digests.append(sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                                             ["id", "part", "mask", "digest"])

    plain = df.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                      F.col(f"`{text}`").alias("text"))
    rows = materialize(plain.mapInArrow(run, f"id {kind}, part string, mask int, digest binary"))
    # A row per text that occurs under more than one id.
    copied = materialize(rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count_if(F.col("id").isNull()).alias("nulls"))
                         .where("first < last or (first is not null and nulls > 0)").select("digest", "first"))
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    return join_small(rows, copied, ["digest"], "left").select("id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame, losses: Sequence[str]) -> DataFrame:
    """Per ``part`` and ``mask``: ``n`` rows, and for each of ``losses`` (0/1 columns of ``labels``, by ``id``) the rows marked 1.

    A row is marked when any label row of its id is. Labels of unknown or null ids count nothing.
    """
    marks = labels.groupBy("id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in losses]).where(
        " or ".join(f"{c} = 1" for c in losses))
    whole = failed.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.lit(0).cast("bigint").alias(c) for c in losses])
    lost = failed.join(marks, "id").groupBy("part", "mask").agg(F.lit(0).cast("bigint").alias("n"), *[F.sum(c).cast("bigint").alias(c) for c in losses])
    return whole.unionByName(lost).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", *losses)])


def audit(counts: DataFrame, letters: str = LETTERS, losses: Sequence[str] = ()) -> DataFrame:
    """A row per part, order of the filters and step, from the ``mask_counts``.

    ``kept``, ``removed``, ``redundant`` (fail the step's filter, gone before), ``unique_fails`` (fail this filter only), ``<loss>_lost`` per loss and
    ``shapley``: what the step's filter removes, summed over all orders. A part has all its rows, zeros included.
    """
    n = len(letters)
    size, full = 1 << n, (1 << n) - 1
    # Summed over all orders the factors are whole numbers.
    factors = [x * factorial(n) for row in shapley_matrix(n) for x in row]
    assert all(x.denominator == 1 for x in factors)
    numbers = F.transform(F.split(F.lit(",".join(map(str, factors))), ","), lambda x: x.cast("bigint"))
    zero = F.lit(0).cast("bigint")
    every = F.sequence(F.lit(0), F.lit(full))

    def removals(column: str):
        """v(S) for every coalition S, from the counts by mask."""
        by_mask = F.map_from_entries(F.collect_list(F.struct("mask", column)))
        held = lambda s: F.aggregate(every, zero, lambda acc, m: acc + F.when(
            m.bitwiseAND(s) != 0, F.coalesce(F.element_at(F.col(f"_{column}"), m), zero)).otherwise(zero))
        return by_mask.alias(f"_{column}"), F.transform(every, held).alias(f"_v_{column}")

    tables = {c: removals(c) for c in ("n", *losses)}
    parts = counts.groupBy("part").agg(F.sum("n").alias("_total"), *[t[0] for t in tables.values()])
    games = materialize(parts.select("part", "_total", *[t[1] for t in tables.values()]))
    games = games.withColumn("_shapley", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(
        every, zero, lambda acc, s: acc + F.get(numbers, i * size + s) * F.get(F.col("_v_n"), s))))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    rows = games.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bit = lambda at: F.expr(f"shiftleft(1, instr('{letters}', substr(filter_order, {at}, 1)) - 1)")
    rows = rows.withColumn("_own", bit("step")).withColumn(
        "_before", F.expr(f"aggregate(filter(sequence(1, {n}), i -> i < step), 0, (acc, i) -> acc | shiftleft(1, instr('{letters}', substr(filter_order, i, 1)) - 1))"))
    at = lambda column, s: F.get(F.col(f"_v_{column}"), s)
    after, before = F.col("_before").bitwiseOR(F.col("_own")), F.col("_before")
    gone = lambda column: at(column, after) - at(column, before)
    return rows.select(
        "part", "filter_order", "step", (F.col("_total") - at("n", after)).alias("kept"), gone("n").alias("removed"),
        (at("n", F.col("_own")) - gone("n")).alias("redundant"), (at("n", F.lit(full)) - at("n", F.lit(full) - F.col("_own"))).alias("unique_fails"),
        *[gone(c).alias(f"{c}_lost") for c in losses],
        F.get(F.col("_shapley"), F.expr(f"instr('{letters}', substr(filter_order, step, 1)) - 1")).alias("shapley"))
