"""Removal of repeated byte strings by blockwise suffix sorting with a cover sample.

Wanted are the places where a document starts a string of ``length`` bytes that an earlier document starts, too. Sorting
all suffixes of all documents would move one record per byte. Instead a cover sample of the suffixes is sorted first: of the
grams of ``GRAM`` bytes inside every window of ``length`` bytes the one with the least hash is sampled, so two equal windows always
hold the same sampled gram at the same offset. (A difference cover of positions has that property for all pairs of windows and samples 6 of
31 positions; choosing by content samples about 1 of 14.) Sampled suffixes are dealt into buckets by a mix of their
names, as many as the size of the input asks for, and a task sorts one bucket at a time; a gram that two different texts share is a tie. Only suffixes whose window's sample is
tied are then sorted in the same way, by names of the whole window. Every record is a name of fixed size, so a bucket's memory does not depend on
how long its strings agree. Exact copies are settled beforehand by their SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimloom.llm.common import free_shuffles, texts
from dimloom.session import materialize

LENGTH = 50
GRAM = 24
# Bytes of a name that a record keeps: all for windows. For samples fewer do; a false tie is looked at again with the windows.
WINDOW_RECORD, SAMPLE_RECORD = 8, 6
# Odd constants of the hash, one for each 8 bytes.
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD,
        0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
# Names that are worked on at once.
SLAB = 1 << 20
# Bytes of text whose names a bucket holds at most, about: this bounds a task, whatever the number of shuffle partitions is.
BUCKET_BYTES = 24 << 20


def names(data, length: int):
    """A 64-bit name for each of the strings of ``length`` bytes (8 or more) in an array of bytes."""
    import numpy as np

    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    out = np.zeros(n, np.uint64)
    for i, at in enumerate([*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]):
        out += np.ndarray((n,), "<u8", data, at, (1,)) * np.uint64(_ODD[i])
        out ^= out >> np.uint64(29)
        out *= np.uint64(_ODD[-1 - i % 3])
    out ^= out >> np.uint64(32)
    return out


def spread(x, width: int, pick):
    """out[i] = pick over x[i : i + width], by doubling."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:]) if step < len(out) else out[:0]
        done += step
    return out


def window_samples(data, length: int, gram: int):
    """For every window of ``length`` bytes the name of its sampled gram."""
    import numpy as np

    return spread(names(data, gram), length - gram + 1, np.minimum)


def sample(data, length: int, gram: int):
    """The distinct names of the sampled grams of a text."""
    import numpy as np

    least = window_samples(data, length, gram)
    if not len(least):
        return least
    # Neighbouring windows mostly share their sample.
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    return np.unique(least[new])


def bucket_of(name, buckets: int):
    """Buckets by a second mix of the name. Sampled names are least hashes, so their own leading bits would crowd the first buckets."""
    import numpy as np

    mixed = (name ^ (name >> np.uint64(31))) * np.uint64(_ODD[3])
    return ((mixed >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def packed(name, width: int) -> bytes:
    """The lower ``width`` bytes of each name."""
    import numpy as np

    return np.ascontiguousarray(name.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


class Dealer:
    """Collects the names of texts by bucket and hands them on as few large records."""

    names = ["bucket", "keys", "owners", "sizes", "records"]
    schema = "bucket int, keys binary, owners binary, sizes binary, records binary"

    def __init__(self, buckets: int, width: int):
        self.buckets, self.width = buckets, width
        self.clear()

    def clear(self):
        self.keys, self.owners, self.held, self.parts = [], [], 0, []

    def add(self, key: bytes, owner: int, name):
        self.parts.append(name)
        self.keys.append(key)
        self.owners.append(owner)
        self.held += len(name)

    def rows(self) -> pa.RecordBatch:
        """One row per bucket: the texts with names in it, how many each, and the names, in the order of their texts."""
        import numpy as np

        name = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
        text = np.repeat(np.arange(len(self.parts)), [len(p) for p in self.parts])
        bucket = bucket_of(name, self.buckets)
        order = np.argsort(bucket, kind="stable")
        name, text, bucket = name[order], text[order], bucket[order]
        keys = np.frombuffer(b"".join(self.keys), "S16") if self.keys else np.zeros(0, "S16")
        owners = np.array(self.owners, np.int64)
        out = []
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(bucket)] if len(bucket) else [0]
        for a, b in zip(edges, edges[1:]):
            own, sizes = np.unique(text[a:b], return_counts=True)
            out.append((int(bucket[a]), keys[own].tobytes(), owners[own].tobytes(), sizes.astype("<u4").tobytes(), packed(name[a:b], self.width)))
        self.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()), *[pa.array([r[i] for r in out], pa.binary()) for i in range(1, 5)]], self.names)


def each_bucket(batches: Iterator[pa.RecordBatch], width: int):
    """The records of the bucket that a partition holds: its number, keys, owners, sizes per text, and the names.

    Buffers are used as they come and let go of as soon as they are joined: a bucket is the largest thing a task holds.
    """
    import numpy as np

    held, number = [], None
    for batch in batches:
        number = batch.column(0)[0].as_py() if batch.num_rows else number
        held += [[batch.column(j)[i].as_buffer() for j in range(1, 5)] for i in range(batch.num_rows)]
    if not held:
        return
    del batch
    keys, owners, sizes, records = (b"".join(h[i] for h in held) for i in range(4))
    held.clear()
    if width == 8:
        name = np.frombuffer(records, "<u8")
    else:
        name = np.zeros((len(records) // width, 8), np.uint8)
        name[:, :width] = np.frombuffer(records, np.uint8).reshape(-1, width)
        name = name.view("<u8").ravel()
    yield number, (np.frombuffer(keys, "V16"), np.frombuffer(owners, np.int64), np.frombuffer(sizes, "<u4").astype(np.int64), name)


def sorted_runs(name):
    """The order of the names, and for each place in it the number of its run of equal names."""
    import numpy as np

    order = np.argsort(name, kind="stable")
    ranked = name[order]
    new = np.ones(len(name), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    del ranked
    return order, new, np.cumsum(new, dtype=np.int32) - 1


def answers(bucket: int, keys: list[bytes], data: list[bytes], slots: int) -> pa.RecordBatch:
    """What a bucket says about its texts, as one row per slot of texts, so that rows do not multiply by buckets."""
    import numpy as np

    slot = np.array([int.from_bytes(k[:4], "little") % slots for k in keys])
    rows = []
    for x in np.unique(slot).tolist():
        own = np.flatnonzero(slot == x)
        rows.append((x, bucket, b"".join(keys[i] for i in own), np.array([len(data[i]) for i in own], "<u4").tobytes(),
                     b"".join(data[i] for i in own)))
    columns = list(zip(*rows)) or [[]] * 5
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ANSWER)


ANSWER = ["slot", "bucket", "keys", "sizes", "data"]
ANSWER_SCHEMA = "slot int, bucket int, keys binary, sizes binary, data binary"


def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, answers): the answers of all buckets to the texts of the slot that a partition holds, put together per text."""
    import numpy as np

    held: dict[bytes, list] = {}
    for batch in batches:
        for _, bucket, keys, sizes, data in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            at = 0
            for i, n in enumerate(np.frombuffer(sizes, "<u4").tolist()):
                held.setdefault(keys[16 * i:16 * i + 16], []).append({"bucket": bucket, "data": data[at:at + n]})
                at += n
    if held:
        item = pa.struct([("bucket", pa.int32()), ("data", pa.binary())])
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(item))],
                                         ["key", "answers"])


def tied_samples(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """Per text its sampled grams that another text has, too."""
    import numpy as np

    for bucket, (keys, _, sizes, name) in each_bucket(batches, SAMPLE_RECORD):
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        head = keys.view("<u8").reshape(-1, 2)[:, 0]
        order, new, run = sorted_runs(name)
        content = head[text[order]]
        differs = np.zeros(len(name), bool)
        differs[1:] = (content[1:] != content[:-1]) & ~new[1:]
        del content
        tied = np.zeros(int(run[-1]) + 1, bool)
        tied[run[differs]] = True
        hit = np.zeros(len(name), bool)
        hit[order] = tied[run]
        del order, run
        counts = np.bincount(text[hit], minlength=len(sizes))
        chosen, ends = name[hit], np.cumsum(counts)
        # Copies of one text in the bucket get one answer.
        found = {keys[i].tobytes(): chosen[ends[i] - counts[i]:ends[i]].tobytes() for i in np.flatnonzero(counts)}
        yield answers(bucket, list(found), list(found.values()), slots)


def earlier_windows(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """Per text, for its windows in the bucket in order, one bit each: whether an earlier document has the window."""
    import numpy as np

    for bucket, (keys, owners, sizes, name) in each_bucket(batches, WINDOW_RECORD):
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order, new, run = sorted_runs(name)
        del name
        place = np.unique(owners, return_inverse=True)[1].astype(np.int32)
        owner = place[text[order]]
        least = np.minimum.reduceat(owner, np.flatnonzero(new))
        hit = np.zeros(len(text), bool)
        hit[order] = least[run] < owner
        del order, run, owner, least
        ends = np.cumsum(sizes)
        found = {keys[i].tobytes(): np.packbits(hit[ends[i] - sizes[i]:ends[i]]).tobytes() for i in np.unique(text[hit])}
        yield answers(bucket, list(found), list(found.values()), slots)


def as_bytes(text: bytes):
    import numpy as np

    return np.frombuffer(text, np.uint8)


def open_windows(text: bytes, tied: bytes, length: int, gram: int):
    """Starts of the windows whose sample is tied, and the windows' names."""
    import numpy as np

    data = as_bytes(text)
    least = window_samples(data, length, gram) & np.uint64((1 << 8 * SAMPLE_RECORD) - 1)
    starts = np.flatnonzero(np.isin(least, np.frombuffer(tied, "<u8")))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    return starts, names(data, length)[starts]


def sort_buckets(dealt: DataFrame, buckets: int, fn) -> DataFrame:
    """Deal records to buckets, sort each, and bring the answers back together per text: (key, answers)."""
    one = dealt.repartitionById(buckets, "bucket").mapInArrow(lambda batches: fn(batches, buckets), ANSWER_SCHEMA)
    return one.repartitionById(buckets, "slot").mapInArrow(by_text, "key binary, answers array<struct<bucket:int,data:binary>>")


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``.

    Removed is every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id, judged on
    the input. A null or empty text has no bytes. A null id counts as larger than every other. Rows with equal ids do not remove
    from one another. Names have 64 bits, so two different windows are taken for equal with a chance of n * n / 2**65.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(body, 256)
    largest = (1 << 63) - 1
    docs = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(id_column).cast("bigint"), F.lit(largest)).alias("owner"),
                     body.alias("body"), F.substring(F.unhex(digest), 1, 16).alias("key"), digest.alias("sha"))
    ids = materialize(docs.select("id", "owner", "key", "sha", F.octet_length("body").cast("bigint").alias("n_bytes")))
    size = ids.agg(F.sum("n_bytes").alias("n")).first().n or 0
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, -(-size // BUCKET_BYTES))
    firsts = materialize(ids.groupBy("key").agg(F.min("owner").alias("first")))

    def deal_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(buckets, SAMPLE_RECORD)
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                found = sample(as_bytes(raw), length, gram)
                if len(found):
                    dealer.add(key, 0, found)
                if dealer.held > SLAB:
                    yield dealer.rows()
        if dealer.held:
            yield dealer.rows()

    samples = docs.where(F.octet_length("body") >= length).select("key", "body").mapInArrow(deal_samples, Dealer.schema)
    tied = materialize(sort_buckets(samples, buckets, tied_samples).join(firsts, "key"))
    del samples
    free_shuffles(spark)
    # Texts that may repeat something, once each: from here on only these are read.
    open_docs = materialize(docs.select("key", "owner", "body").join(
        tied.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & (F.col("owner") == F.col("first")))
        .select("key", "owner", F.col("body").cast("binary").alias("body"), F.unhex(F.array_join(F.transform(
            "answers", lambda t: F.hex(t["data"])), "")).alias("tied")))
    free_shuffles(spark)

    def deal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(buckets, WINDOW_RECORD)
        for batch in batches:
            for key, owner, raw, own in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                found = open_windows(raw, own, length, gram)[1]
                if len(found):
                    dealer.add(key, owner, found)
                if dealer.held > SLAB:
                    yield dealer.rows()
        if dealer.held:
            yield dealer.rows()

    hits = materialize(sort_buckets(open_docs.mapInArrow(deal_windows, Dealer.schema), buckets, earlier_windows))
    free_shuffles(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows = []
            for key, raw, own, hit in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                starts, name = open_windows(raw, own, length, gram)
                bucket = bucket_of(name, buckets)
                bits = {h["bucket"]: h["data"] for h in hit}
                earlier = np.zeros(len(starts), bool)
                for b, packed_bits in bits.items():
                    place = np.flatnonzero(bucket == b)
                    earlier[place] = np.unpackbits(np.frombuffer(packed_bits, np.uint8), count=len(place)).astype(bool)
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, starts[earlier], 1)
                np.add.at(edge, starts[earlier] + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                kept = as_bytes(raw)[~gone].tobytes()
                rows.append((key, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)] if rows else [
                pa.array([], t) for t in (pa.binary(), pa.int64(), pa.int64(), pa.string())], ["key", "removed", "spans", "kept"])

    partly = materialize(open_docs.join(hits, "key").select("key", "body", "tied", "answers").mapInArrow(
        cut, "key binary, removed bigint, spans bigint, kept string").dropDuplicates(["key"]))
    joined = ids.join(firsts, "key").join(partly, "key", "left")
    copy = F.col("owner") > F.col("first")
    whole = copy & (F.col("n_bytes") >= length)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select(
        F.col("id").alias(id_column), "n_bytes",
        F.when(whole, F.col("n_bytes")).when(copy, F.lit(0)).otherwise(F.coalesce("removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, F.lit(1)).when(copy, F.lit(0)).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, none).when(copy, F.col("sha")).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))
