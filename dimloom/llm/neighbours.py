"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row is then sent down to its leaf. A leaf that got more than a set number of rows
is split again by a tree of its own, fitted on a bounded sample of the leaf, until all leaves are small: their number grows
with the rows, the work of a query does not. A query takes nodes from a priority queue, nearest
centre first, and so ranks the leaves; below, the leaves of all trees it came to are ranked together. How many of them are visited is calibrated
level by level: for a bounded set of trial queries
the true neighbours are found over all rows, and the number of visits is widened until the leaves visited hold the wanted share
of them. Rows and queries meet by (leaf, piece of the leaf, piece of its queries), so a leaf that cannot be split
is searched in pieces of bounded size.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dimloom.llm.common import join_small
from dimloom.session import materialize


@dataclass(frozen=True)
class TreeRules:
    """``sample``: most rows a tree is fitted on; ``trials``: most trial queries; both bound what the driver holds.

    ``leaf``: most rows of the sample in a leaf; ``rows``: a leaf with more rows of the table than this is split again.
    """

    sample: int = 20_000
    branching: int = 16
    leaf: int = 256
    rows: int = 4_096
    trials: int = 200
    recall: float = 0.95
    piece: int = 2_048
    query_piece: int = 1_024


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


class Tree:
    """Centres of all nodes, their children, and the leaf number of childless ones."""

    def __init__(self, points, rules: TreeRules):
        import numpy as np

        self.random = np.random.default_rng(7)
        self.centres, self.children, self.leaf = [points.mean(axis=0) if len(points) else points.sum(axis=0)], [[]], [-1]
        self.leaves = 0
        open_nodes = [(0, points)]
        while open_nodes:
            node, own = open_nodes.pop()
            parts = self._part(own, rules) if len(own) > rules.leaf else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for centre, members in parts:
                self.children[node].append(len(self.centres))
                open_nodes.append((len(self.centres), members))
                self.centres.append(centre)
                self.children.append([])
                self.leaf.append(-1)
        self.centres = np.array(self.centres)
        self.half_norms = (self.centres ** 2).sum(axis=1) / 2

    def _part(self, points, rules: TreeRules) -> list:
        import numpy as np

        k = min(rules.branching, -(-len(points) // rules.leaf))
        centres = points[self.random.choice(len(points), k, replace=False)]
        for _ in range(8):
            own = (points @ centres.T - (centres ** 2).sum(axis=1) / 2).argmax(axis=1)
            used = np.unique(own)
            centres = np.array([points[own == i].mean(axis=0) for i in used])
        own = (points @ centres.T - (centres ** 2).sum(axis=1) / 2).argmax(axis=1)
        return [(centres[i], points[own == i]) for i in np.unique(own)]

    def assign(self, points):
        """The leaf of each point."""
        import numpy as np

        node = np.zeros(len(points), np.int64)
        while True:
            inner = [n for n in np.unique(node) if self.children[n]]
            if not inner:
                return np.array(self.leaf, np.int64)[node]
            for n in inner:
                rows = np.flatnonzero(node == n)
                kids = np.array(self.children[n])
                node[rows] = kids[(points[rows] @ self.centres[kids].T - self.half_norms[kids]).argmax(axis=1)]

    def visits(self, point, most: int | None) -> list[tuple[int, float]]:
        """The first leaves that best-bin-first search comes to, with their distances (less a constant of the point)."""
        far = (self.half_norms - self.centres @ point).tolist()
        queue, out = [(far[0], 0)], []
        while queue and (most is None or len(out) < most):
            value, node = heapq.heappop(queue)
            if self.children[node]:
                for kid in self.children[node]:
                    heapq.heappush(queue, (far[kid], kid))
            else:
                out.append((self.leaf[node], value))
        return out


def matrix(column: pa.Array):
    """Rows of a list column as doubles."""
    import numpy as np

    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1)


def unit(x):
    import numpy as np

    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(rows, query):
    """Cosine of each row with the query; equal rows get equal numbers, whatever stands around them."""
    import numpy as np

    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def best(ids, vectors, own_ids, queries, k: int):
    """For each query the k nearest rows but its own, as (query's place, rows' places, scores): nearest first, ties to the smaller id.

    One matrix product sorts out who can be among the k; the exact cosines decide between those.
    """
    import numpy as np

    rough = unit(vectors) @ unit(queries).T
    for i, own in enumerate(own_ids):
        keep = np.flatnonzero(ids != own)
        if len(keep) > k:
            near = rough[keep, i]
            keep = keep[near >= np.partition(near, len(keep) - k)[len(keep) - k] - 1e-9]
        score = cosines(vectors[keep], queries[i])
        order = np.lexsort((ids[keep], -score))[:k]
        yield i, keep[order], score[order]


def grown(points, rules: TreeRules) -> Tree:
    """A tree on the different directions of the points."""
    import numpy as np

    return Tree(np.unique(unit(points), axis=0), rules)


def fit(rows: DataFrame, rules: TreeRules) -> Tree:
    """A tree on at most about ``rules.sample`` rows, drawn by a hash of their numbers."""
    import numpy as np

    got = drawn(rows, F.lit(rules.sample / max(1, rows.count())), "sample").select("vector").toArrow()
    if not got.num_rows:
        return Tree(np.zeros((0, 1)), rules)
    return grown(matrix(got.column(0).combine_chunks()), rules)


def drawn(rows: DataFrame, share: Column, salt: str) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(1 << 40)) < share * (1 << 40))


def split(index: DataFrame, rules: TreeRules) -> DataFrame | None:
    """Trees (leaf, tree) for the leaves with more than ``rules.rows`` rows; None if no such leaf can be parted.

    Each is fitted in a task of its own on at most about ``rules.sample`` rows of its leaf.
    """
    large = materialize(index.groupBy("leaf").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > rules.rows))
    if large.isEmpty():
        return None
    sample = drawn(join_small(index, large, ["leaf"]), rules.sample / F.col("held"), "split")

    def plant(rows_):
        import numpy as np
        import pandas as pd

        share = len(rows_) / rows_["held"].iloc[0]
        tree = grown(np.stack(rows_["vector"].to_numpy()), replace(rules, leaf=max(rules.leaf, int(share * rules.rows / 2))))
        # Few different vectors make one leaf, which stays as it is.
        return pd.DataFrame([(rows_["leaf"].iloc[0], pickle.dumps(tree))] if tree.leaves > 1 else [], columns=["leaf", "tree"])

    trees = materialize(sample.select("leaf", "vector", "held").groupBy("leaf").applyInPandas(plant, "leaf string, tree binary"))
    return None if trees.isEmpty() else trees


def under_trees(rows: DataFrame, trees: DataFrame, piece: int, work: Callable, schema: str) -> DataFrame:
    """``work(tree, rows)`` for the rows whose leaf has a tree, in pieces of about ``piece`` rows; the other rows as they are."""
    sizes = materialize(join_small(rows.select("leaf"), trees.select("leaf"), ["leaf"]).groupBy("leaf").agg(
        F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("pieces")))
    left = join_small(rows, sizes, ["leaf"]).withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")).drop("pieces")
    right = trees.join(sizes, "leaf").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")

    columns = rows.columns

    def run(rows_, trees_):
        import pandas as pd

        return work(pickle.loads(trees_["tree"].iloc[0]), rows_) if len(rows_) else pd.DataFrame(columns=columns)

    gone = left.groupBy("leaf", "piece").cogroup(right.groupBy("leaf", "piece")).applyInPandas(run, schema)
    return join_small(rows, trees.select("leaf"), ["leaf"], "left_anti").select(*rows.columns).unionByName(gone)


INDEX = "row bigint, id bigint, vector array<double>, leaf string"
FRONTIER = INDEX + ", far double"


def deeper(index: DataFrame, trees: DataFrame, rules: TreeRules) -> DataFrame:
    """Rows of split leaves sent on to the leaves of their leaf's tree."""

    def work(tree, rows_):
        import numpy as np

        leaves = tree.assign(unit(np.stack(rows_["vector"].to_numpy())))
        return rows_.assign(leaf=[f"{a}.{b}" for a, b in zip(rows_["leaf"], leaves)])[["row", "id", "vector", "leaf"]]

    return under_trees(index, trees, rules.piece, work, INDEX)


def seen(frontier: DataFrame, trees: DataFrame, most: int | None, rules: TreeRules) -> DataFrame:
    """Split leaves on a query's way replaced by the leaves of their trees, of each tree the ``most`` first ones."""

    def work(tree, rows_):
        import numpy as np
        import pandas as pd

        out = []
        for row in zip(rows_["row"], rows_["id"], rows_["vector"], rows_["leaf"]):
            out += [(*row[:3], f"{row[3]}.{n}", far) for n, far in tree.visits(unit(np.asarray(row[2])[None])[0], most)]
        return pd.DataFrame(out, columns=["row", "id", "vector", "leaf", "far"])

    return under_trees(frontier, trees, rules.query_piece, work, FRONTIER)


def ranked(frontier: DataFrame) -> DataFrame:
    return frontier.withColumn("place", F.row_number().over(W.partitionBy("row").orderBy("far", "leaf")))


def trial_answers(trials: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(trial, row): the true neighbours, over all rows, of a bounded number of trial queries."""
    got = trials.select("row", "id", "vector").toArrow()
    numbers, own = got.column(0).to_numpy(), got.column(1).to_numpy()
    points = matrix(got.column(2).combine_chunks()) if got.num_rows else None

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows or points is None:
                continue
            row, ids, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            for i, at, score in best(ids, vectors, own, points, k):
                top[i] = sorted(top.get(i, []) + list(zip((-score).tolist(), ids[at].tolist(), row[at].tolist())))[:k]
        out = [(numbers[i], *x) for i, found in top.items() for x in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["trial", "far", "id", "row"])

    # Each task hands on k rows per trial.
    found = rows.select("row", "id", "vector").mapInArrow(nearest, "trial bigint, far double, id bigint, row bigint")
    place = F.row_number().over(W.partitionBy("trial").orderBy("far", "id", "row"))
    return materialize(found.withColumn("place", place).where(F.col("place") <= k).select("trial", "row"))


def enough_visits(tried: DataFrame, index: DataFrame, answers: DataFrame, share: float) -> int:
    """Visits after which the leaves that the trials came to hold the share of their true neighbours.

    ``tried`` holds the trials' ways with ``place``, ``answers`` at most k rows per trial.
    """
    homes = index.select("row", "leaf").join(F.broadcast(answers), "row").select(F.col("trial").alias("row"), "leaf")
    places = homes.join(tried.select("row", "leaf", "place"), ["row", "leaf"], "left").select("place").collect()
    known = sorted(p.place for p in places if p.place is not None)
    if not known:
        return tried.agg(F.max("place")).first()[0] or 1
    return known[min(len(known), max(1, math.ceil(share * len(places) - 1e-9))) - 1]


def search(df: DataFrame, queries: Column, k: int, id_column: str = "vec_id", vector: str = "embedding",
           rules: TreeRules = TreeRules()) -> DataFrame:
    """The ``k`` nearest rows by cosine for every row that ``queries`` marks: query_id, rank, id, score.

    Rows without an id and vectors that are null, zero or not finite, or of another length than most, take no part. A query never
    finds rows with its own id. Ties go to the smaller id; so of equal vectors the rows of the ``k`` + 1 smallest ids are all that any
    query can find, and only they are indexed. Fewer rows than ``k`` give fewer results. Query rows with the same id are answered one by one.
    """
    rows = df.where(F.col(id_column).isNotNull() & usable(F.col(vector))).select(
        F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asks"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vector") == (common.n if common else 0))
    copy = F.dense_rank().over(W.partitionBy("vector").orderBy("id"))
    held = materialize(rows.select("row", "id", "vector").withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"))
    tree = fit(held, rules)

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = [str(x) for x in tree.assign(unit(matrix(batch.column(2))))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.string())], ["row", "id", "vector", "leaf"])

    def start(asks: DataFrame, most: int | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ways = [tree.visits(q, most) for q in unit(matrix(batch.column(2)))]
                source = pa.array([i for i, way in enumerate(ways) for _ in way], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    *[c.take(source) for c in batch.columns], pa.array([str(x) for way in ways for x, _ in way], pa.string()),
                    pa.array([far for way in ways for _, far in way], pa.float64())], ["row", "id", "vector", "leaf", "far"])

        return asks.select("row", "id", "vector").mapInArrow(run, FRONTIER)

    index = materialize(held.mapInArrow(to_leaf, INDEX))
    tried = materialize(drawn(rows, F.lit(rules.trials / max(1, rows.count())), "trial").select("row", "id", "vector"))
    asked = rows.where("asks")
    answers, step, left = trial_answers(tried, held, k), start, 1 - rules.recall
    while True:
        trees = split(index, rules)
        tried = materialize(ranked(step(tried, None)))
        # Each level but the last may lose half of what is left to lose.
        left = left / 2 if trees is not None else 0.0
        visits = enough_visits(tried, index, answers, rules.recall + left)
        tried = tried.where(F.col("place") <= visits).drop("place")
        asked = step(asked, visits)
        asked = materialize(asked if step is start else ranked(asked).where(F.col("place") <= visits).drop("place"))
        if trees is None:
            break
        index = materialize(deeper(index, trees, rules))
        step = lambda frontier, most, own=trees: seen(frontier, own, most, rules)
    # One row per leaf that is visited.
    pieces = materialize(
        index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / rules.piece).cast("int").alias("pieces"))
        .join(asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / rules.query_piece).cast("int").alias("query_pieces")), "leaf"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    near = join_small(index, pieces, ["leaf"]).withColumn("piece", one("pieces")).withColumn("query_piece", every("query_pieces"))
    asks = join_small(asked, pieces, ["leaf"]).withColumn("query_piece", one("query_pieces")).withColumn("piece", every("pieces"))
    names = ["leaf", "piece", "query_piece"]

    def meet(rows_, asks_):
        import numpy as np
        import pandas as pd

        out = []
        if len(rows_) and len(asks_):
            row, own, ids = asks_["row"].to_numpy(), asks_["id"].to_numpy(), rows_["id"].to_numpy()
            for i, at, score in best(ids, np.stack(rows_["vector"].to_numpy()), own, np.stack(asks_["vector"].to_numpy()), k):
                out += [(row[i], own[i], x, y) for x, y in zip(ids[at], score)]
        return pd.DataFrame(out, columns=["row", "query_id", "id", "score"])

    met = near.select(*names, "id", "vector").groupBy(*names).cogroup(
        asks.select(*names, "row", "id", "vector").groupBy(*names)).applyInPandas(
            meet, "row bigint, query_id bigint, id bigint, score double")
    order = W.partitionBy("row").orderBy(F.desc("score"), "id")
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_column), "score"))
