"""A hidden Markov language model: Baum-Welch counts added up across partitions, scored by the scaled forward recursion.

Texts are written once as blocks: the distinct words of some megabytes of text, and each text as places in that list. A block is what a task works on, so the
vocabulary, which grows with the corpus without end, is never in one place: words meet by the word, and each block gets the counts of its own.

The states emit word buckets, a fixed number of them (hashes of words), and a bucket emits its words by their counts whatever the
state, one share kept for words never seen. So the parameters have a fixed size, and a text's probability is exact: the
forward recursion over its buckets, times the words' shares of their buckets. The end of a text has a bucket of its own.

In training, texts are cut into passages, every token in one, so that passages of many texts go through the recursions in step.
A passage that goes on from another starts from a distribution of its own. Scoring cuts nothing: a long text is taken in passages, too, but once from each
state, and the passages are multiplied up, which is the same sum.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimloom.llm.common import texts
from dimloom.session import materialize

SEED = 42
# Buckets whose sums go in one row.
SLICE = 1_024


@dataclass(frozen=True)
class HmmRules:
    """``rounds`` of Baum-Welch over all learning texts; ``block``: bytes of text in a block, a longer text is one by itself; ``passage``: tokens of a
    passage, ``together``: passages that go through the recursions at once; ``long``: tokens from which a text is scored in passages; ``prior``: times the number of different
    words, tokens of the corpus's mean that each state is given besides its own; ``buckets`` is
    a power of two."""

    states: int = 8
    rounds: int = 4
    buckets: int = 1 << 15
    block: int = 8 << 20
    passage: int = 256
    together: int = 2_048
    long: int = 4_096
    prior: float = 0.2


def encode(df: DataFrame, id_column: str, text: str, held_out: Column, rules: HmmRules) -> DataFrame:
    """A row per block: ``ids``, ``held`` and ``lengths`` of its texts, its distinct ``words``, their ``counts`` in learning texts, their ``bucket`` numbers, and
    ``seq``, the texts' tokens as places in ``words``, packed. The word b"" stands for the end of a text."""
    id_type = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId() << 24, 0

        def block(ids, held, lengths, places, seq):
            words = list(places)
            seq = np.array(seq, np.int64)
            learned = seq[~np.repeat(np.array(held, bool), lengths)]
            bucket = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64) % np.uint64(rules.buckets)
            bucket[0] = rules.buckets  # the end
            row = [[part + made], [ids], [held], [lengths], [words], [np.bincount(learned, minlength=len(words))], [bucket.astype("<u4").tobytes()],
                   [packed(seq)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (
                pa.int64(), pa.list_(id_arrow), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64()),
                pa.binary(), pa.binary()))], ["block", "ids", "held", "lengths", "words", "counts", "bucket", "seq"])

        def fresh():
            places: Any = defaultdict()
            places.default_factory = places.__len__
            places[b""]
            return [], [], [], places, []

        state, size, id_arrow = fresh(), 0, pa.int64()
        for batch in batches:
            id_arrow = batch.column(0).type
            for key, held, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                ids, helds, lengths, places, seq = state
                words = raw.lower().split()  # bytes: lower-cases A-Z only and cuts at ASCII white space
                seq.extend(map(places.__getitem__, words))
                seq.append(0)
                ids.append(key)
                helds.append(held)
                lengths.append(len(words) + 1)
                size += len(raw) + 1
                if size >= rules.block:
                    yield block(*state)
                    state, size, made = fresh(), 0, made + 1
        if state[0]:
            yield block(*state)

    schema = (f"block bigint, ids array<{id_type}>, held array<boolean>, lengths array<int>, words array<binary>, counts array<bigint>, "
              "bucket binary, seq binary")
    rows = df.select(F.col(f"`{id_column}`"), F.coalesce(held_out, F.lit(False)), F.col(f"`{text}`"))
    return materialize(rows.toDF("id", "held", "text").mapInArrow(run, schema))


def packed(places) -> bytes:
    """Numbers below 2**32, compressed. Common words come early in a list, so the upper bytes, which lie together, are mostly zero."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(places.astype("<u4").view("u1").reshape(-1, 4).T.tobytes())


def unpacked(raw: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def word_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """``c``, the count in all learning texts, of each word that has one, for every block (``home``) and place (``pos``) in its word list.

    Words go by the word, once per block that has them. One row of each word has its ``bucket``, the others a null.
    """
    pairs = blocks.select(F.col("block").alias("home"), F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "x")).select(
        "home", "pos", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    same = Window.partitionBy("word")
    bucket = F.when(F.octet_length("word") == 0, buckets).otherwise(F.pmod(F.xxhash64("word"), F.lit(buckets)))
    counted = pairs.withColumns({"c": F.sum("n").over(same), "nth": F.row_number().over(same.orderBy("home"))}).where("c > 0")
    return materialize(counted.select("home", "pos", "c", F.when(F.col("nth") == 1, bucket).cast("int").alias("bucket")))


def tokens_of(block: dict[str, Any]):
    """(places in the word list, buckets) of all tokens of a block."""
    import numpy as np

    seq = unpacked(block["seq"])
    return seq, np.frombuffer(block["bucket"], "<u4").astype(np.int64)[seq]


def passages(starts, lengths, size: int):
    """(starts, lengths, whether it begins a text, number of its text) of the passages of texts; longest first."""
    import numpy as np

    pieces = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    length = np.minimum(size, lengths[owner] - nth * size)
    order = np.argsort(-length, kind="stable")
    return (starts[owner] + nth * size)[order], length[order], (nth == 0)[order], owner[order]


@dataclass
class Model:
    """``first``, ``next``: states at the start of a text and of a later passage; ``move[i, j]``: from state i to j; ``emit[bucket, state]``."""

    first: Any
    next: Any
    move: Any
    emit: Any


def start_model(mass, rules: HmmRules) -> Model:
    """States that differ by chance around the corpus's own shares of the buckets, and like to stay."""
    import numpy as np

    random = np.random.default_rng(SEED)
    k = rules.states
    emit = (mass / mass.sum())[:, None] * random.uniform(0.2, 1.8, (len(mass), k))
    even = np.full(k, 1 / k)
    return Model(even, even, 0.2 / k + 0.8 * np.eye(k), emit / emit.sum(axis=0))


def active(lengths):
    """For each step the number of sequences that have it; ``lengths`` descend."""
    import numpy as np

    return len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0] if len(lengths) else 0), side="right")


def forward(model: Model, buckets, starts, lengths, begin):
    """(natural logarithm of the scale, vector over states) after each sequence; ``begin`` has the states of its first token.

    The probability of a sequence is exp(scale) * the vector's sum. Lengths descend, and are 1 at least.
    """
    import numpy as np

    alpha, scale = begin.copy(), np.zeros(len(starts))
    for t, n in enumerate(active(lengths).tolist()):
        now = alpha[:n] @ model.move if t else alpha[:n]
        now = now * model.emit[buckets[starts[:n] + t]]
        if t % 8 == 7:
            total = now.sum(axis=1)
            scale[:n] += np.log(total)
            now /= total[:, None]
        alpha[:n] = now
    return scale, alpha


def log_likelihoods(model: Model, buckets, starts, lengths, rules: HmmRules):
    """The exact natural log probability of each text's buckets."""
    import numpy as np

    out = np.zeros(len(starts))
    short = lengths < rules.long
    order = np.flatnonzero(short)[np.argsort(-lengths[short], kind="stable")]
    if len(order):
        scale, alpha = forward(model, buckets, starts[order], lengths[order], np.tile(model.first, (len(order), 1)))
        out[order] = scale + np.log(alpha.sum(axis=1))
    k = len(model.first)
    for text in np.flatnonzero(~short).tolist():
        # Every passage from every state at once; then the passages are multiplied up in turn.
        at, size, begins, _ = passages(starts[text:text + 1], lengths[text:text + 1], rules.passage)
        begin = np.where(np.repeat(begins, k)[:, None], np.tile(model.first, (len(at) * k, 1)), np.tile(model.move, (len(at), 1)))
        scale, alpha = forward(model, buckets, np.repeat(at, k), np.repeat(size, k), begin)
        scale, alpha = scale.reshape(-1, k), alpha.reshape(-1, k, k)
        total = 0.0
        for i in np.argsort(at).tolist():
            most = scale[i].max()
            weight = np.exp(scale[i] - most)
            now = weight[0] * alpha[i, 0] if begins[i] else (weight * state) @ alpha[i]  # noqa: F821 - set by the first passage
            total += most + np.log(now.sum())
            state = now / now.sum()  # noqa: F841
        out[text] = total
    return out


def expected_counts(model: Model, buckets, starts, lengths, begins):
    """Baum-Welch sums over passages (longest first): (first, next, moves, emissions, natural log likelihood).

    The recursions run in the model's own precision, the sums are doubles.
    """
    import numpy as np

    k, kind = len(model.first), model.emit.dtype
    steps = active(lengths).tolist()
    alphas, seen, scales = [], [], []
    likelihood = 0.0
    for t, n in enumerate(steps):
        seen.append(model.emit[buckets[starts[:n] + t]])
        now = (alphas[-1][:n] @ model.move if t else np.where(begins[:, None], model.first, model.next)) * seen[-1]
        total = now.sum(axis=1)
        alphas.append(now / total[:, None])
        scales.append(total)
        likelihood += float(np.log(total).sum())
    moves = np.zeros((k, k))
    shares = np.empty((int(lengths.sum()), k), kind)
    where = np.empty(len(shares), np.int64)
    at = len(shares)
    beta = np.ones((0, k), kind)
    for t in range(len(steps) - 1, -1, -1):
        n = steps[t]
        if t + 1 < len(steps):
            m = steps[t + 1]
            later = seen[t + 1] * beta / scales[t + 1][:, None]
            moves += alphas[t][:m].T @ later
            beta = np.concatenate([later @ model.move.T, np.ones((n - m, k), kind)])
        else:
            beta = np.ones((n, k), kind)
        shares[at - n:at] = alphas[t] * beta
        where[at - n:at] = buckets[starts[:n] + t]
        at -= n
    opening = shares[:steps[0]]
    emitted = np.stack([np.bincount(where, weights=shares[:, i], minlength=len(model.emit)) for i in range(k)], axis=1)
    opened = [opening[begins == b].sum(axis=0, dtype=np.float64) for b in (True, False)]
    return *opened, moves * model.move, emitted, likelihood


def gather(blocks: DataFrame, model: Model, rules: HmmRules):
    """The sums of ``expected_counts`` over all learning texts.

    Each task adds up its blocks and hands its sums on in slices, which are added up by slice, one row at a time. Only the sums, whose size the rules fix,
    come to the driver.
    """
    import numpy as np

    k = rules.states
    small = Model(*[x.astype(np.float32) for x in (model.first, model.next, model.move, model.emit)])
    shared = blocks.sparkSession.sparkContext.broadcast(small)
    columns = ["key", "sums"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            for block in batch.to_pylist():
                held, lengths = np.array(block["held"], bool), np.array(block["lengths"], np.int64)
                _, buckets = tokens_of(block)
                starts = np.cumsum(lengths) - lengths
                at, size, begins, _ = passages(starts[~held], lengths[~held], rules.passage)
                for i in range(0, len(at), rules.together):
                    some = slice(i, i + rules.together)
                    found = expected_counts(shared.value, buckets, at[some], size[some], begins[some])
                    sums = found if sums is None else [a + b for a, b in zip(sums, found)]
        if sums is not None:
            # Row -1 has the small sums, the others slices of the emissions.
            emitted = sums[3].astype(np.float32)
            parts = [np.concatenate([np.ravel(x) for x in (*sums[:3], [sums[4]])])] + [emitted[i:i + SLICE] for i in range(0, len(emitted), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(parts) - 1), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Any] = {}
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = np.frombuffer(raw.as_buffer(), np.float64 if key < 0 else np.float32).astype(np.float64)
                total[key] = total[key] + value if key in total else value
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], columns)

    parts = blocks.select("held", "lengths", "bucket", "seq").mapInArrow(count, "key int, sums binary").repartition("key")
    got = parts.mapInArrow(add, "key int, sums binary").toArrow().sort_by("key").column(1)
    shared.unpersist()
    head, *rest = [np.frombuffer(x.as_buffer(), np.float64) for x in got]
    first, later, moves, likelihood = np.split(head, [k, 2 * k, 2 * k + k * k])
    return first, later, moves.reshape(k, k), np.concatenate(rest).reshape(-1, k), float(likelihood[0])


def train(blocks: DataFrame, mass, different: int, rules: HmmRules) -> tuple[Model, list[float]]:
    """The model after ``rounds`` of Baum-Welch, and the log likelihood before each. ``mass``: the tokens of each bucket."""
    import numpy as np

    mean = (mass + 1) / (mass + 1).sum()
    model, likelihoods = start_model(mass + 1.0, rules), []
    for _ in range(rules.rounds if mass.sum() else 0):
        first, later, moves, emitted, likelihood = gather(blocks, model, rules)
        likelihoods.append(likelihood)
        share = lambda x: x / x.sum(axis=-1, keepdims=True)
        emitted = emitted + rules.prior * different * mean[:, None]
        model = Model(share(first + 0.1), share(later + 0.1), share(moves + 0.1), emitted / emitted.sum(axis=0))
    return model, likelihoods


def score_texts(df: DataFrame, held_out: Column, id_column: str = "doc_id", text: str = "text", rules: HmmRules = HmmRules()) -> DataFrame:
    """Score every row's whole text by models learned from the rows that ``held_out`` does not mark.

    Returns the id, ``held_out``, ``n_tokens`` (words and one end), ``n_known`` (tokens seen in learning), ``train_tokens``, ``base_score`` (log10 by
    counts with one added) and ``score`` (log10 probability of the text by the hidden Markov model). A null text is empty and has just its end. A null
    mark learns. Repeated rows count and are scored each. Without any learning text the models know nothing and spread evenly.
    """
    import numpy as np

    blocks = encode(df, id_column, text, held_out, rules)
    known = word_counts(blocks, rules.buckets)
    # A row per bucket.
    per_bucket = known.where("bucket is not null").groupBy("bucket").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()
    mass, kinds = np.zeros(rules.buckets + 1), np.zeros(rules.buckets + 1)
    place = per_bucket.column("bucket").to_numpy()
    mass[place], kinds[place] = per_bucket.column("n").to_numpy(), per_bucket.column("v").to_numpy()
    total, different = int(mass.sum()), int(kinds.sum())
    model, _ = train(blocks, mass, different, rules)
    # With a bucket's emission goes what all its words share: the sum under their counts.
    under = mass + kinds + 1
    under[rules.buckets] = 1
    model.emit = model.emit / under[:, None]
    shared = df.sparkSession.sparkContext.broadcast(model)
    id_type = df.schema[id_column].dataType.simpleString()

    def score(blocks_: pa.Table, counts: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        for block in blocks_.to_pylist():
            lengths = np.array(block["lengths"], np.int64)
            starts = np.cumsum(lengths) - lengths
            seq, buckets = tokens_of(block)
            c = np.zeros(len(block["bucket"]) // 4, np.int64)
            c[counts.column("pos").to_numpy()] = counts.column("c").to_numpy()
            logs = np.log10(c + 1.0)
            words = logs.copy()
            words[0] = 0  # the end has a bucket to itself
            likelihood = log_likelihoods(shared.value, buckets, starts, lengths, rules) / np.log(10)
            out[0] += block["ids"]
            out[1] += block["held"]
            out[2] += lengths.tolist()
            out[3] += np.add.reduceat(c[seq] > 0, starts, dtype=np.int64).tolist()
            out[4] += (np.add.reduceat(logs[seq], starts) - lengths * np.log10(total + different + 1.0)).tolist()
            out[5] += (np.add.reduceat(words[seq], starts) + likelihood).tolist()
        types = (blocks_.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("id", "held_out", "n_tokens", "n_known", "base_score", "score"), out, types)})

    held = blocks.select("block", "ids", "held", "lengths", "bucket", "seq")
    scored = held.groupBy("block").cogroup(known.select("home", "pos", "c").groupBy("home")).applyInArrow(
        score, f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"),
                         "base_score", "score")
