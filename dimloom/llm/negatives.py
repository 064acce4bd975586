"""Hard negatives by inner product, from candidate lists that the anchors of a cluster share.

Anchors are clustered by direction. No row x can have a larger inner product with an anchor q of a cluster than
``|q| * |x| * cos(max(0, angle(x, centre) - radius))``, where the radius is the widest angle between the centre and any of the
cluster's anchors. So one list per cluster, sorted by that bound without ``|q|``, serves all its anchors: each walks it from the top and stops
once the bound of what is left, times its own length, is below the last score it still wants. That end is certified, so results are exact.

On Spark a list is never one piece. It is cut at quantiles of the bound into segments that grow fourfold; a round takes the next segment of every cluster
with open anchors, deals it and the anchors out in tiles of bounded size, walks each tile in the list's order, and merges
what the tiles found. Anchors certified after a round drop out, and so do clusters without open anchors. The walk is made twice: for the
positives (same label), and then, with the windows of scores that these set, for the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimloom.llm.common import join_small
from dimloom.session import materialize


@dataclass(frozen=True)
class MiningRules:
    """``positives`` per anchor, ``negatives`` per positive, whose scores lie between ``low`` and ``high`` percent of the positive's.

    ``scale``: components are multiplied by it and rounded down. ``sample``: most anchors that the centres are fitted on, and most rows from which
    the cuts of the lists are estimated; both only steer the work. ``cluster``: anchors a cluster should have, ``clusters``: most of them.
    ``piece`` and ``anchors``: rows and anchors of a tile. ``block``: rows a walk takes at once.
    """

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    sample: int = 20_000
    cluster: int = 512
    clusters: int = 1_024
    piece: int = 16_384
    anchors: int = 2_048
    block: int = 512


# Squared lengths from here on would not leave room for scores times 100 in 64 bits.
LONGEST = float(1 << 55)
# Bounds are sums of roundings; this share of the length is added so that none is too small.
SLACK = 1e-9


def whole_vectors(df: DataFrame, anchors: Column, id_column: str, label: str, vector: str, rules: MiningRules) -> tuple[DataFrame, str]:
    """(id, label, asks, vec): one usable row per id, with its whole-number components packed; and their number type."""
    value = F.col(f"`{vector}`").cast("array<double>")
    whole = F.transform(value, lambda x: F.floor(x * rules.scale).cast("double"))
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    squares = F.aggregate(whole, F.lit(0.0), lambda acc, x: acc + x * x)
    rows = df.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{label}`").alias("label"),
                     F.coalesce(anchors, F.lit(False)).alias("asks"), whole.alias("vector"),
                     F.coalesce(value.isNotNull() & ~bad & (squares < LONGEST), F.lit(False)).alias("_good"))
    rows = rows.where("id is not null and label is not null and _good").drop("_good")
    rows = materialize(rows.withColumns({"n": F.size("vector"), "most": F.coalesce(F.array_max(F.transform("vector", F.abs)), F.lit(0.0))}))
    sizes = rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.max("most").alias("most")).orderBy(F.desc("rows"), "n").first()
    kind = "<i2" if not sizes or sizes.most < 1 << 15 else "<i4"
    rows = rows.where(F.col("n") == (sizes.n if sizes else 0)).select("id", "label", "asks", "vector")
    # One row per id. Only ids that repeat are moved.
    again = materialize(rows.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id", F.lit(True).alias("again")))
    if not again.isEmpty():
        marked = join_small(rows, again, ["id"], "left")
        least = marked.where("again").groupBy("id").agg(F.min(F.struct("label", "vector", "asks")).alias("x")).select("id", "x.*")
        rows = marked.where("again is null").select("id", "label", "asks", "vector").unionByName(least)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if batch.num_rows:
                flat = np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, -1).astype(kind)
                packed = pa.array([x.tobytes() for x in flat], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], ["id", "label", "asks", "vec"])

    label_type = rows.schema["label"].dataType.simpleString()
    return materialize(rows.mapInArrow(pack, f"id bigint, label {label_type}, asks boolean, vec binary")), kind


def unpack(column, kind: str):
    """Packed vectors as rows of doubles, which hold their components exactly."""
    import numpy as np

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def directions(vectors):
    """(unit vectors, lengths); a zero vector stays zero."""
    import numpy as np

    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors / np.where(lengths > 0, lengths, 1)[:, None], lengths


def bounds(vectors, centres, radius):
    """The list bound of every vector in every cluster."""
    import numpy as np

    unit, lengths = directions(vectors)
    gap = np.arccos(np.clip(unit @ centres.T, -1, 1)) - radius
    return lengths[:, None] * (np.cos(np.maximum(gap, 0)) + SLACK)


def fit_centres(rows: DataFrame, kind: str, rules: MiningRules):
    """Spherical k-means on a bounded sample of the anchors."""
    import numpy as np

    total, vectors = sampled(rows.where("asks"), rules.sample)
    points = np.unique(directions(unpack(vectors, kind))[0], axis=0) if len(vectors) else np.zeros((0, 1))
    k = min(rules.clusters, max(1, -(-total // rules.cluster)), max(1, len(points)))
    if not len(points):
        return np.zeros((1, 1))
    centres = points[np.random.default_rng(11).choice(len(points), k, replace=False)]
    for _ in range(10):
        own = (points @ centres.T).argmax(axis=1)
        centres = directions(np.array([points[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(k)]))[0]
    return centres


def sampled(rows: DataFrame, most: int):
    """(number of rows, the packed vectors of at most about ``most`` of them, drawn by a hash of the id)."""
    total = rows.count()
    if total > most:
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit("mining")), F.lit(1_000_000)) < int(1_000_000 * most / total))
    return total, rows.select("vec").toArrow().column(0)


def top(owner, scores, ids, k: int):
    """Places of each owner's ``k`` best entries: higher scores first, ties by smaller id."""
    import numpy as np

    order = np.lexsort((ids, -scores, owner))
    sorted_owner = owner[order]
    first = np.searchsorted(sorted_owner, sorted_owner)
    return order[np.arange(len(order)) - first < k]


def walk_tile(candidates: pa.Table, asked: pa.Table, kind: str, same: bool, k: int, block: int):
    """Walk a tile of a list with some of its cluster's anchors: (anchor, slot, score, id) of the rows that may be among the best.

    ``asked`` has a row per anchor and slot (a window of scores) with ``need``, the score of the last row it has so far, if it has ``k``.
    """
    import numpy as np

    bound = candidates.column("bound").to_numpy()
    order = np.argsort(-bound, kind="stable")
    bound, ids = bound[order], candidates.column("id").to_numpy()[order]
    labels = candidates.column("label").to_numpy()[order]
    vectors = unpack(candidates.column("vec"), kind)[order]
    anchor, slot = asked.column("anchor").to_numpy(), asked.column("slot").to_numpy()
    low, high = asked.column("low").to_numpy(), asked.column("high").to_numpy()
    need = np.asarray(asked.column("need").to_pandas(), np.float64)
    need = np.where(np.isnan(need), -np.inf, need)
    _, place, own = np.unique(anchor, return_index=True, return_inverse=True)
    asks = unpack(asked.column("vec").take(pa.array(place)), kind)
    own_label = asked.column("label").to_numpy()[place]
    lengths = directions(asks)[1]
    exact = np.float64 if lengths.max() * np.sqrt((vectors * vectors).sum(axis=1).max()) < 2 ** 53 else np.int64
    asks, vectors = asks.astype(exact), vectors.astype(exact)
    found = [np.zeros(0, np.int64)] * 3
    for at in range(0, len(ids), block):
        open_ = np.flatnonzero(lengths[own] * bound[at] >= np.maximum(need, low))
        if not len(open_):
            break
        used, row = np.unique(own[open_], return_inverse=True)
        scores = (asks[used] @ vectors[at:at + block].T).astype(np.int64)
        fits = own_label[used][:, None] == labels[at:at + block]
        if not same:
            fits = ~fits
        fits &= anchor[place][used][:, None] != ids[at:at + block]
        score = scores[row]
        hit = fits[row] & (score >= low[open_][:, None]) & (score <= high[open_][:, None]) & (score >= need[open_][:, None])
        x, y = np.nonzero(hit)
        if not len(x):
            continue
        found = [np.concatenate(pair) for pair in zip(found, (open_[x], score[x, y], ids[at + y]))]
        best = top(*found, k)
        found = [f[best] for f in found]
        owner, first, many = np.unique(found[0], return_index=True, return_counts=True)
        full = many == k
        need[owner[full]] = np.maximum(need[owner[full]], found[1][first[full] + k - 1])
    return anchor[found[0]], slot[found[0]], found[1], found[2]


def walk(rows: DataFrame, asked: DataFrame, kind: str, centres, radius, same: bool, k: int, rules: MiningRules) -> DataFrame:
    """(anchor, slot, rank, score, id): for every anchor and slot its ``k`` best rows of the same label, or of another one.

    ``asked``: anchor, slot, label, vec, length, cluster, and the window ``low`` to ``high`` of scores; a slot of an anchor is a row.
    """
    import numpy as np

    spark = rows.sparkSession
    label_type = rows.schema["label"].dataType.simpleString()
    by_need = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    empty = "anchor bigint, slot int, score bigint, id bigint"
    state = spark.createDataFrame([], empty + ", rank int")
    upper, waiting = np.full(len(centres), np.inf), materialize(asked.withColumn("need", F.lit(None).cast("bigint")))
    if waiting.isEmpty():
        return state
    total, drawn = sampled(rows, rules.sample)
    estimate = np.sort(bounds(unpack(drawn, kind), centres, radius), axis=0)[::-1] if len(drawn) else np.zeros((1, len(centres)))
    share = min(1.0, max(1 / 1024, rules.piece / 4 / max(total, 1)))
    while True:
        counts = {r.cluster: r.n for r in waiting.groupBy("cluster").agg(F.count_distinct("anchor").alias("n")).collect()}  # a row per cluster
        if not counts:
            break
        last = share >= 1
        cut = min(len(estimate) - 1, int(share * len(estimate)))
        lower = np.full(len(centres), -np.inf) if last else np.minimum(upper, estimate[cut])
        here = ((estimate >= lower) & (estimate < upper)).sum(axis=0) * (total / len(estimate))
        pieces = {c: 1 + int(1.5 * here[c] / rules.piece) for c in counts}
        groups = {c: -(-n // rules.anchors) for c, n in counts.items()}

        def spread(batch, columns, cluster, piece, group):
            """Rows once per (cluster, piece, group)."""
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int32()) for x in (cluster, piece, group))],
                                              [*batch, "cluster", "piece", "grp"])

        def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            for batch in batches:
                if not batch.num_rows:
                    continue
                bound, ids = bounds(unpack(batch.column(2), kind), centres, radius), batch.column(0).to_numpy()
                for c in counts:
                    row = np.flatnonzero((bound[:, c] >= lower[c]) & (bound[:, c] < upper[c]))
                    row, group = np.repeat(row, groups[c]), np.tile(np.arange(groups[c]), len(row))
                    if len(row):
                        yield spread(["id", "label", "vec", "bound"], [x.take(pa.array(row)) for x in batch.columns] + [pa.array(bound[row, c])],
                                     np.full(len(row), c), mixed(ids[row]) % pieces[c], group)

        def askers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            for batch in batches:
                if not batch.num_rows:
                    continue
                cluster = batch.column("cluster").to_numpy()
                each = np.array([pieces[c] for c in cluster.tolist()])
                row = np.repeat(np.arange(len(each)), each)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                group = mixed(batch.column("anchor").to_numpy()) % np.array([groups[c] for c in cluster.tolist()])
                names = ["anchor", "slot", "low", "high", "need", "label", "vec"]
                yield spread(names, [batch.column(n).take(pa.array(row)) for n in names], cluster[row], piece, group[row])

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            out = walk_tile(left, right, kind, same, k, rules.block) if left.num_rows and right.num_rows else [[], [], [], []]
            return pa.table({n: pa.array(x, t) for n, x, t in zip(
                ("anchor", "slot", "score", "id"), out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))})

        keys = ["cluster", "piece", "grp"]
        tail = ", cluster int, piece int, grp int"
        listed = rows.select("id", "label", "vec").mapInArrow(segment, f"id bigint, label {label_type}, vec binary, bound double{tail}")
        asking = waiting.mapInArrow(askers, f"anchor bigint, slot int, low bigint, high bigint, need bigint, label {label_type}, vec binary{tail}")
        new = materialize(listed.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(meet, empty))
        state = materialize(state.drop("rank").unionByName(new).withColumn("rank", F.row_number().over(by_need)).where(F.col("rank") <= k))
        if last:
            break
        # Open: what is left of the list could still hold a row at least as good as the last one wanted.
        ends = materialize(state.where(F.col("rank") == k).select("anchor", "slot", F.col("score").alias("_need")))
        edge = F.element_at(F.array(*[F.lit(float(x)) for x in lower]), F.col("cluster") + 1)
        waiting = materialize(waiting.drop("need").join(ends, ["anchor", "slot"], "left").withColumnRenamed("_need", "need").where(
            F.col("length") * edge >= F.greatest("need", "low")))
        upper, share = lower, share * 4
    return state


def mixed(ids):
    """A hash of ids, never negative."""
    import numpy as np

    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(33)).astype(np.int64)


def mine(df: DataFrame, anchors: Column, id_column: str = "vec_id", label: str = "label", vector: str = "embedding",
         rules: MiningRules = MiningRules()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hard negatives of every row that ``anchors`` marks.

    A score is the inner product of whole-number components. Positives are the anchor's best other rows of its label; a
    positive's negatives are the best rows of other labels in its window. Higher scores come first, ties by smaller id. Take no part: rows with a
    null id or label, a null vector, null or infinite components, another number of components than most, or a squared length of 2**55 or more
    (scores would leave 64 bits). Rows of one id count once, the one with the least label, then vector. Fewer rows give fewer results,
    an empty table none. A positive whose score is below zero has an empty window.
    """
    rows, kind = whole_vectors(df, anchors, id_column, label, vector, rules)
    centres = fit_centres(rows, kind, rules)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if batch.num_rows:
                unit, lengths = directions(unpack(batch.column(2), kind))
                near = unit @ centres.T
                own = near.argmax(axis=1)
                # A zero anchor scores 0 with everything and needs no radius.
                angle = np.where(lengths > 0, np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1)), 0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths), pa.array(own, pa.int32()), pa.array(angle)],
                                                 ["anchor", "label", "vec", "length", "cluster", "angle"])

    label_type = rows.schema["label"].dataType.simpleString()
    asked = materialize(rows.where("asks").select(F.col("id").alias("anchor"), "label", "vec").mapInArrow(
        assign, f"anchor bigint, label {label_type}, vec binary, length double, cluster int, angle double"))
    import numpy as np

    radius = np.zeros(len(centres))
    for r in asked.groupBy("cluster").agg(F.max("angle").alias("angle")).collect():  # a row per cluster
        radius[r.cluster] = r.angle + SLACK
    asked = asked.drop("angle")
    any_score = {"low": F.lit(-(1 << 60)).cast("bigint"), "high": F.lit(1 << 60).cast("bigint")}
    positives = walk(rows, asked.withColumns({"slot": F.lit(0), **any_score}), kind, centres, radius, True, rules.positives, rules)
    windows = positives.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                               F.expr(f"({rules.low} * score + 99) div 100").alias("low"), F.expr(f"({rules.high} * score) div 100").alias("high")
                               ).where("positive_score >= 0 and low <= high")
    windows = materialize(windows)
    slots = asked.join(windows.select("anchor", "slot", "low", "high"), "anchor")
    negatives = walk(rows, slots, kind, centres, radius, False, rules.negatives, rules)
    return negatives.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        windows, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
