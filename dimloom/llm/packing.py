"""Packing along a space-filling curve.

Each document becomes token ids and a hashed vector: every token id is hashed to one of ``DIMENSIONS`` random directions
of a space of three dimensions, and the document is the mean direction, stretched by the square root of its length. Its place on a Hilbert
curve through that space is the sort key, so documents with like words lie near each other. The key order is a
range partitioning, never one sorted task: copies share a key, and the document id and a row number break that tie. Whole runs of ``size`` tokens
are sequences of their own; the rests of all documents are laid end to end along the curve and cut
every ``size`` tokens, so that only the very last sequence is shorter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimloom.llm.common import running_totals, texts
from dimloom.llm.tokens import ids
from dimloom.session import materialize

DIMENSIONS = 3
BITS = 16
BUCKETS = 1 << 10


@lru_cache(maxsize=1)
def directions():
    """A random direction per hash bucket; the same everywhere."""
    import numpy as np

    return np.random.default_rng(20).standard_normal((BUCKETS, DIMENSIONS))


def hashed_vector(tokens):
    import numpy as np

    if not len(tokens):
        return np.zeros(DIMENSIONS)
    # Multiplicative hashing of the id; the counts per bucket are the hashed document vector.
    buckets = (tokens * np.uint32(2654435769)) >> np.uint32(32 - 10)
    counted = np.bincount(buckets.astype(np.intp), minlength=BUCKETS)
    return counted @ directions() / np.sqrt(len(tokens))


def hilbert_keys(points):
    """Position on a Hilbert curve of each row of ``points``, an array of integers below 2**BITS.

    Gray-code walk from the highest bit down, with the rotations of the curve undone on the way; all rows at once.
    """
    import numpy as np

    x = points.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (BITS - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (BITS - 1)
    while bit > 1:
        turn = np.where((x[n - 1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors):
    """Hilbert keys of real vectors: each coordinate is squeezed into (0, 1) and cut into 2**BITS cells."""
    import numpy as np

    cells = (0.5 + 0.5 * np.tanh(np.asarray(vectors, float).reshape(-1, DIMENSIONS) / 8)) * (1 << BITS)
    return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1))


def tokenize(df: DataFrame, path: str, size: int, end: int, id_column: str, text: str) -> DataFrame:
    """Per row: id, curve key, number of tokens with the end token, checksums of its whole runs, and the rest's ids."""
    kind = df.schema[id_column].dataType.simpleString()
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        memory = ids(path)
        look = memory.__getitem__
        for batch in batches:
            vectors, sizes, sums, rests = [], [], [], []
            memory.room()
            for raw in texts(batch.column(1)):
                packed = b"".join(map(look, raw.split()))
                vectors.append(hashed_vector(np.frombuffer(packed, "<u4")))
                packed += last
                n = len(packed) // 4
                whole = n - n % size
                sizes.append(n)
                sums.append([zlib.crc32(packed[4 * a:4 * (a + size)]) for a in range(0, whole, size)])
                rests.append(packed[4 * whole:])
            keys = curve_keys(vectors) if vectors else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(sums, pa.list_(pa.int64())), pa.array(rests, pa.binary())],
                ["id", "key", "doc_tokens", "sums", "rest"])

    return df.select(id_column, text).mapInArrow(
        run, f"id {kind}, key bigint, doc_tokens bigint, sums array<bigint>, rest binary")


def pack(df: DataFrame, path: str, size: int = 2048, end: int = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Every token of every document, its end token included, lies in exactly one piece. A null or empty text is the
    end token alone. Rows with equal or null ids are packed one by one. An empty table gives no rows.
    """
    rows = materialize(tokenize(df, path, size, end, id_column, text)
                       .withColumn("row", F.monotonically_increasing_id()))
    rest_size = F.length("rest") / F.lit(4)
    order = rows.select("row", "key", "id", rest_size.cast("bigint").alias("rest_size"),
                        F.size("sums").cast("bigint").alias("wholes"))
    placed = materialize(running_totals(order, ["key", "id", "row"], ["rest_size", "wholes"]))
    total = placed.agg(F.sum("rest_size")).first()[0] or 0
    # Sequences of rests come first, then those that are whole runs of one document.
    first_whole = -(-total // size)
    placed = placed.select("row", F.col("before_rest_size").alias("at"), F.col("before_wholes").alias("whole_at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            col = {n: batch.column(n).to_pylist() for n in ("doc_tokens", "sums", "rest", "at", "whole_at")}
            source, start, length, crc, tokens, sequence, offset = [], [], [], [], [], [], []

            def piece(i, *values):
                source.append(i)
                for out, value in zip((start, length, crc, sequence, offset), values):
                    out.append(value)
                tokens.append(col["doc_tokens"][i])

            for i, rest in enumerate(col["rest"]):
                for k, checksum in enumerate(col["sums"][i]):
                    piece(i, k * size, size, checksum, first_whole + col["whole_at"][i] + k, 0)
                done, n, base = 0, len(rest) // 4, len(col["sums"][i]) * size
                while done < n:
                    at = col["at"][i] + done
                    take = min(n - done, size - at % size)
                    piece(i, base + done, take, zlib.crc32(rest[4 * done:4 * (done + take)]), at // size, at % size)
                    done += take
            arrays = [batch.column("id").take(pa.array(source, pa.int32()))]
            arrays += [pa.array(x, pa.int64()) for x in (start, length, crc, tokens, sequence, offset)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = df.schema[id_column].dataType.simpleString()
    out = rows.drop("key").join(placed, "row").mapInArrow(
        cut, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_column)
