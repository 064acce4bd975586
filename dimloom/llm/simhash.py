"""SimHash near-duplicates: fingerprints, a self-join over binary tries, and classes of linked documents.

Two fingerprints that differ in at most ``budget`` bits agree on one of ``budget + 1`` blocks of bits. So there is a trie
for each block, with that block's bits at the top, and only pairs below one and the same block value can link: the tries fall apart
into subtries, which Spark deals out by (block, value). Inside a task a subtrie is a range of a sorted array. Pairs of nodes go down together, one bit at a time;
each keeps the bits in which its two paths differ, and is dropped as soon as they are more than the budget. A pair of
nodes whose fingerprints are all in one class already is dropped too, which keeps dense groups of near copies cheap without losing a link
that matters. Each task hands on a forest: at most one link per fingerprint and block.

The pipeline's stage (``keep_one``) asks for more: five-word shingles of a Jaccard similarity of 0.8. Its candidates are the classes that the tries find among
fingerprints of such shingles. Pairs of that similarity differ in up to 13 bits, though, where blocks are too short to keep pairs apart, so bands of MinHash values add
the candidates beyond the budget. All are confirmed on the exact sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from dimloom.llm.common import texts
from dimloom.session import materialize

SHINGLE = 4
SEED = 42
BUDGET = 4
# Near copies of the pipeline: words of a shingle, the least Jaccard similarity, bands of MinHash values and values in a band.
WORDS, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 30, 5
# Pivots that the keys of a dense group have between them, and the most nodes of each side of a tile.
PIVOTS, TILE = 3, 512
# A subtrie with more fingerprints is dealt out as pairs of its own subtries.
SPLIT = 200_000
# Node pairs that are taken down one level at once, and the leaf size below which pairs are compared bit by bit.
FRONT = 400_000
LEAF = 48


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of the text's word shingles as a signed integer; 0 without words."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # bytes: lower-cases A-Z only and cuts at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, seed)).astype(np.int64))
    starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
    ends = ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    n, counts = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, 100_000):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:at + 100_000], ends[at:at + 100_000])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``fp`` for every row. A null text has no words."""
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["fp bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(raw) for raw in texts(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(found, pa.int64())], [*keep, "fp"])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(text)).mapInArrow(run, schema)


def merge(label, a, b):
    """Union the classes of a[i] and b[i]. ``label`` points to class members of smaller index; it is flat on return."""
    import numpy as np

    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        la, lb = la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            flat = label[label]
            if np.array_equal(flat, label):
                break
            label = flat


def trie_classes(values, units, starts, budget: int):
    """Classes of linked fingerprints in a slab of subtries.

    ``values`` are rotated fingerprints (unsigned), ascending inside each range of ``units``. ``units`` lists node pairs
    (a_low, a_high, b_low, b_high, differing bits, depth); ``starts`` marks where a new range begins. Returns a label per value.
    """
    import numpy as np

    n = len(values)
    label = np.arange(n)
    near = np.bitwise_count(values[1:] ^ values[:-1]) <= budget
    near &= ~starts[1:]
    where = np.flatnonzero(near)
    label = merge(label, where, where + 1)
    depth0 = min(u[5] for u in units)
    # ones[d][i]: values before i whose bit at depth d is set; inside a node the zeros come first.
    ones = np.zeros((64 - depth0, n + 1), np.int32)
    for d in range(depth0, 64):
        np.cumsum((values >> np.uint64(63 - d)) & np.uint64(1), out=ones[d - depth0, 1:])

    def changes():
        out = np.zeros(n, np.int64)
        np.cumsum(label[1:] != label[:-1], out=out[1:])
        return out

    changed = changes()
    byd: dict[int, list] = {}
    for u in units:
        byd.setdefault(u[5], []).append(u[:5])
    stack = [(d, np.array(rows, np.int64).reshape(-1, 5).T) for d, rows in sorted(byd.items(), reverse=True)]
    while stack:
        d, front = stack.pop()
        if front.shape[1] > FRONT:
            half = front.shape[1] // 2
            stack += [(d, front[:, half:]), (d, front[:, :half])]
            continue
        al, ah, bl, bh, err = front
        # Drop pairs that are one class throughout.
        one = (changed[ah - 1] == changed[al]) & (changed[bh - 1] == changed[bl]) & (label[al] == label[bl])
        if one.any():
            front = front[:, ~one]
            al, ah, bl, bh, err = front
        if not len(al):
            continue
        small = (ah - al) * (bh - bl) <= LEAF
        if d == 64:
            small[:] = True
        if small.any():
            sa, sn, sb, sm = al[small], (ah - al)[small], bl[small], (bh - bl)[small]
            sizes = sn * sm
            item = np.repeat(np.arange(len(sizes)), sizes)
            k = np.arange(len(item)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            i, j = sa[item] + k // sm[item], sb[item] + k % sm[item]
            linked = (np.bitwise_count(values[i] ^ values[j]) <= budget) & (label[i] != label[j])
            if linked.any():
                label = merge(label, i[linked], j[linked])
                changed = changes()
            front = front[:, ~small]
            al, ah, bl, bh, err = front
        if not len(al):
            continue
        c = ones[d - depth0]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        twin = (al == bl) & (ah == bh)
        children = [
            np.stack([al, am, bl, bm, err]), np.stack([am, ah, bm, bh, err]),
            np.stack([al, am, bm, bh, err + 1]),
            np.stack([am, ah, bl, bm, err + 1])[:, ~twin],
        ]
        below = np.concatenate(children, axis=1)
        below = below[:, (below[1] > below[0]) & (below[3] > below[2]) & (below[4] <= budget)]
        if below.shape[1]:
            stack.append((d + 1, below))
    return label


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """First bit and width of each block."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def trie_links(fps: DataFrame, budget: int = BUDGET, split: int = SPLIT) -> DataFrame:
    """Links (a, b) that connect just the classes of fingerprints linked by at most ``budget`` differing bits.

    ``fps`` has distinct values in ``fp`` and should be written out.
    """
    blocks = block_bounds(budget + 1)
    rotated = fps.select(F.explode(F.array(*[
        F.struct(F.lit(j).alias("block"), rotate(F.col("fp"), first).alias("r")) for j, (first, _) in enumerate(blocks)])).alias("x")
    ).select("x.*")
    width = F.element_at(F.array(*[F.lit(w) for _, w in blocks]), F.col("block") + 1)
    top = lambda bits: F.call_function("shiftrightunsigned", F.col("r"), (64 - bits).cast("int"))
    keyed = rotated.withColumn("value", top(width))
    # Subtries above the split size go out as pairs of their own subtries, three bits further down.
    hot = materialize(keyed.groupBy("block", "value").count().where(F.col("count") > split).select("block", "value"))
    deeper = 3
    if hot.isEmpty():
        dealt = keyed.withColumn("pair", F.lit(-1))
    else:
        marked = keyed.join(hot.withColumn("hot", F.lit(True)), ["block", "value"], "left")
        child = top(width + deeper) % (1 << deeper)
        partners = F.transform(F.sequence(F.lit(0), F.lit((1 << deeper) - 1)), lambda other: (
            F.least(child.cast("int"), other) * (1 << deeper) + F.greatest(child.cast("int"), other)))
        pairs = F.when(F.col("hot"), partners).otherwise(F.array(F.lit(-1)))
        dealt = marked.withColumn("pair", F.explode(pairs)).drop("hot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        block, value, pair = (whole.column(c).to_numpy() for c in ("block", "value", "pair"))
        r = whole.column("r").to_numpy().view(np.uint64)
        order = np.lexsort((r, pair, value, block))
        block, value, pair, r = block[order], value[order], pair[order], r[order]
        new = np.ones(len(r), bool)
        new[1:] = (block[1:] != block[:-1]) | (value[1:] != value[:-1]) | (pair[1:] != pair[:-1])
        edges = np.append(np.flatnonzero(new), len(r)).tolist()
        at = 0
        while at < len(edges) - 1:  # a slab of whole subtries
            to = at + 1
            while to < len(edges) - 1 and edges[to + 1] - edges[at] <= 100_000:
                to += 1
            low, high = edges[at], edges[to]
            units = []
            for a, b in zip(edges[at:to], edges[at + 1:to + 1]):
                depth = blocks[block[a]][1]
                a, b = a - low, b - low
                if pair[low + a] < 0:
                    if b - a > 1:
                        units.append((a, b, a, b, 0, depth))
                    continue
                ca, cb = divmod(int(pair[low + a]), 1 << deeper)
                bits = (r[low + a:low + b] >> np.uint64(64 - depth - deeper)) & np.uint64((1 << deeper) - 1)
                mid = a + int(np.searchsorted(bits, cb)) if ca != cb else b
                if ca == cb:
                    units.append((a, b, a, b, 0, depth + deeper))
                elif a < mid < b and (ca ^ cb).bit_count() <= budget:
                    units.append((a, mid, mid, b, (ca ^ cb).bit_count(), depth + deeper))
            if units:
                values = r[low:high]
                label = trie_classes(values, units, new[low:high], budget)
                child = np.flatnonzero(label != np.arange(len(label)))
                if len(child):
                    first = np.array([blocks[j][0] for j in block[low:high][child]], np.uint64)
                    both = [turn_back(values[x], first).view(np.int64) for x in (child, label[child])]
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])
            at = to

    return dealt.repartition("block", "value", "pair").mapInArrow(run, "a bigint, b bigint")


def rotate(column, bits: int):
    """The 64 bits turned left by ``bits``."""
    if not bits:
        return column
    return F.shiftleft(column, bits).bitwiseOR(F.shiftrightunsigned(column, 64 - bits))


def turn_back(values, bits):
    import numpy as np

    return np.where(bits == 0, values, (values >> bits) | (values << ((np.uint64(64) - bits) & np.uint64(63))))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; the root is the smallest node of its component and has a row, too.

    Alternates large and small stars. Every round is written out, so a lost executor costs one round at most.
    """
    def both(e):
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def mark(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # a is the larger end of every link.
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = mark(edges)
    while True:
        near = both(edges)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
            .alias("x")).select("x.*").where("a <> b").distinct()
        edges = materialize(small)
        now = mark(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def near_duplicates(hashed: DataFrame, id_column: str = "doc_id", budget: int = BUDGET, split: int = SPLIT) -> DataFrame:
    """Add ``component_id``, the smallest id among all rows reachable over links, and ``class_fp``, a name of the class.

    ``hashed`` holds ``fp`` and should be written out. Equal fingerprints are one node, whatever their number.
    Rows with a null id link like others and count as larger than any id; a component of null ids only has a null.
    """
    nodes = materialize(hashed.groupBy("fp").agg(F.min(id_column).alias("_first")))
    parts = materialize(components(trie_links(nodes.select("fp"), budget, split)))
    linked = parts.join(nodes.withColumnRenamed("fp", "node"), "node")
    least = linked.groupBy("root").agg(F.min("_first").alias("component_id"))
    by_node = parts.join(least, "root").select(F.col("node").alias("fp"), "component_id", "root")
    final = materialize(nodes.join(by_node, "fp", "left").select(
        "fp", F.coalesce("component_id", "_first").alias("component_id"), F.coalesce("root", "fp").alias("class_fp")))
    return hashed.join(final, "fp")


def shingle_set(text: bytes, words: int = WORDS):
    """The sorted distinct hashes of the text's word shingles. A shorter text is one shingle, a text without words none."""
    import numpy as np
    import xxhash

    parts = text.lower().split()
    shingles = {b" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def band_keys(hashes, bands: int = BANDS, rows: int = BAND_ROWS):
    """A key for each band of MinHash values: sets of Jaccard similarity s share one with a chance of s ** rows, band by band."""
    import numpy as np

    seeds, odds = np.random.default_rng(SEED).integers(0, 1 << 64, (2, bands * rows, 1), np.uint64)
    odds |= np.uint64(1)
    least = np.full(bands * rows, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[at:at + 1024] ^ seeds) * odds).min(axis=1), out=least)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in least.reshape(bands, rows).T:
        key = (key ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes with ``jaccard``, the similarity of their sets, counted exactly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.float64())], ["a", "b", "jaccard"])

    first, second = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"set_{c}")) for c in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a bigint, b bigint, jaccard double")


def tile_links(nodes, roots, first, sets, similarity: float) -> list[tuple[int, int]]:
    """A forest of links between nodes of different classes in a tile.

    ``first`` marks the rows of the tile's first piece. Those are compared with the others, or with each other if there are no others. Intersections are products of 0/1
    matrices over the shingles that more than one set has, some thousand shingles at a time.
    """
    import numpy as np

    inside = bool(first.all())
    left = np.flatnonzero(first)
    right = left if inside else np.flatnonzero(~first)
    sizes = np.array(list(map(len, sets)))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = many[token] > 1
    number = np.cumsum(many > 1) - 1
    owner, token = owner[common], number[token[common]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    place_left, place_right = np.full(len(sets), -1), np.full(len(sets), -1)
    place_left[left], place_right[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    step = 4_096
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, step):
        low, high = np.searchsorted(token, [at, at + step])
        width = int(token[high - 1]) - at + 1
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        for matrix, place in ((x, place_left), (y, place_right)):
            own = place[owner[low:high]]
            matrix[own[own >= 0], token[low:high][own >= 0] - at] = 1
        both += x @ y.T
    union = sizes[left][:, None] + sizes[right] - both
    near = (both >= similarity * union - 1e-9) & (roots[left][:, None] != roots[right])
    label: dict[int, int] = {}

    def find(r: int) -> int:
        while label.get(r, r) != r:
            r = label[r]
        return r

    out = []
    for i, j in zip(*np.nonzero(near)):
        x, y = int(left[i]), int(right[j])
        p, q = find(int(roots[x])), find(int(roots[y]))
        if p != q:
            label[max(p, q)] = min(p, q)
            out.append((int(nodes[x]), int(nodes[y])))
    return out


def class_links(placed: DataFrame, sets: DataFrame, similarity: float, piece: int = TILE) -> DataFrame:
    """Links (a, b) between nodes of different classes that share a key.

    ``placed``: key, node, root (its class so far), dist (Jaccard distance to the key's pivot, with which all have been compared) and size. A key's
    outsiders, the nodes outside its largest class, are compared with each other and with those of the largest class that can be near one: distances
    obey the triangle inequality, and sizes may differ by the similarity at most. Pieces of the nodes meet in tiles, and a
    tile hands on a forest, so no pair leaves a task that joins nothing.
    """
    slack = 1 - similarity + 1e-9
    others = placed.where("dist > 0")  # the pivot is done
    sizes = others.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).getField("root").alias("main")).where("roots > 1")
    marked = materialize(others.join(main.select("key", "main"), "key").withColumn("out", F.col("root") != F.col("main")))
    spans = marked.where("out").groupBy("key").agg(
        F.count(F.lit(1)).alias("n_out"), F.min("dist").alias("d0"), F.max("dist").alias("d1"), F.min("size").alias("s0"), F.max("size").alias("s1"))
    near = marked.join(spans, "key").where(F.col("out") | (
        F.col("dist").between(F.col("d0") - slack, F.col("d1") + slack)
        & F.col("size").between(F.col("s0") * similarity - 1e-9, F.col("s1") / similarity + 1e-9)))
    rest = near.where("not out").groupBy("key").agg(F.count(F.lit(1)).alias("n_main"))
    near = materialize(near.join(rest, "key", "left").na.fill(0, ["n_main"]).where("n_out + n_main > 1"))
    out_pieces, main_pieces = (F.ceil(F.col(n) / piece).cast("int") for n in ("n_out", "n_main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("out"), out_pieces).otherwise(main_pieces)).cast("int")
    # Pieces of outsiders count from 0, those of the largest class go on from there; a tile is two of them, the first an outsider's.
    tile = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda x: x < n)
    tiles = F.when(F.col("out"), F.concat(
        F.transform(upto(out_pieces), lambda q: tile(F.least(q, F.col("own")), F.greatest(q, F.col("own")))),
        F.transform(upto(main_pieces), lambda q: tile(F.col("own"), q + out_pieces)))).otherwise(
        F.transform(upto(out_pieces), lambda q: tile(q, F.col("own") + out_pieces)))
    dealt = near.withColumn("own", own).withColumn("t", F.explode(tiles)).select(
        "key", "t.i", "t.j", "node", "root", (F.when(F.col("out"), F.col("own")).otherwise(F.col("own") + out_pieces) == F.col("t.i")).alias("first"))
    with_sets = dealt.join(sets.select("node", "hashes"), "node").select("key", "i", "j", "node", "root", "first", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def done(rows: list):
            first = np.array([r[2] for r in rows], bool)
            if len(rows) < 2 or not first.any():
                return []
            return tile_links(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), first,
                              [np.frombuffer(r[3], np.uint64) for r in rows], similarity)

        here, rows = None, []
        for batch in batches:
            found = []
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != here:
                    found += done(rows)
                    here, rows = (key, i, j), []
                rows.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])
        if found := done(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    names = ["key", "i", "j"]
    return with_sets.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a bigint, b bigint")


def class_keys(hashed: DataFrame) -> DataFrame:
    """A key (node, key) for every class of nodes whose fingerprints the tries link. ``hashed`` has a row per distinct set: ``node`` and ``fp``."""
    found = near_duplicates(materialize(hashed), "node")
    return materialize(found.select("node", F.xxhash64("class_fp", F.lit("class")).alias("key")))


def overlap_links(nodes: DataFrame, similarity: float, classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect the classes of nodes whose shingle sets are similar.

    ``nodes`` has a row per distinct set: ``node``, ``bands`` (keys) and ``text``, and should be written out; ``classes`` adds a key per node. Nodes that share a key are compared in
    two passes. In the first each meets the pivots of its keys, which makes one class of a dense group for a few pairs a
    node. The second (``class_links``) looks for links between the classes that still share a key.
    """
    keyed = nodes.select("node", F.explode("bands").alias("key")).unionByName(classes)
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[
        F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node")).getField("node").alias(f"p{i}") for i in range(PIVOTS)]).where("n > 1")
    pivots = F.element_at(F.array(*[F.col(f"p{i}") for i in range(PIVOTS)]), (F.pmod("key", F.lit(PIVOTS)) + 1).cast("int"))
    members = materialize(keyed.join(shared.select("key", "n", pivots.alias("pivot")), "key"))
    both = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tested = members.where("node <> pivot").select(*both("node", "pivot")).distinct()
    close = members.select("node").distinct()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(raw) for raw in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary()),
                                              pa.array(list(map(len, found)), pa.int64())], ["node", "hashes", "size"])

    sets = materialize(nodes.join(close, "node", "left_semi").select("node", "text").mapInArrow(hashes, "node bigint, hashes binary, size bigint"))
    distances = materialize(measured(tested, sets).withColumn("dist", 1 - F.col("jaccard")))
    links = distances.where(F.col("jaccard") >= similarity - 1e-12).select("a", "b")
    parts = materialize(components(links))
    # Keys of two nodes are done: one of them is the pivot.
    large = members.where("n > 2 and node <> pivot").select("key", "node", *both("node", "pivot"))
    placed = large.join(distances.select("a", "b", "dist"), ["a", "b"]).join(parts, "node", "left").join(
        sets.select("node", "size"), "node").select("key", "node", F.coalesce("root", "node").alias("root"), "dist", "size")
    return materialize(links.unionByName(class_links(materialize(placed), sets, similarity)))


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with one row of each group of near copies: the one with the smallest id, null last; of repeated rows any one.

    Near copies share ``similarity`` of their five-word shingles (Jaccard), or are linked by a chain of such pairs. Candidates are the classes of SimHash
    fingerprints that the tries link and, for pairs of more differing bits, bands of MinHash values; all are confirmed on the exact sets. A pair at a similarity of 0.8 is missed with a chance of 7 in a million, nearer ones
    less often; texts with equal sets, among them all without words, never are.
    """
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    own_id, own_text = (f"_c{df.columns.index(c)}" for c in (id_column, text))
    rows = plain.withColumn("_row", F.monotonically_increasing_id())
    at = rows.columns.index(own_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            nodes, fps, bands = [], [], []
            for raw in texts(batch.column(at)):
                hashes = shingle_set(raw)
                fps.append(fingerprint(raw, WORDS) if len(hashes) else None)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                bands.append(band_keys(hashes).view("<i8") if len(hashes) else [])
            node = pa.array(nodes, pa.uint64()).view(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, node, pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                                              [*batch.schema.names, "_node", "_fp", "_bands"])

    schema = StructType([*rows.schema.fields, StructField("_node", LongType()), StructField("_fp", LongType()), StructField("_bands", ArrayType(LongType()))])
    rows = materialize(rows.mapInArrow(run, schema))
    one = rows.groupBy("_node").agg(F.min("_row").alias("_row"))
    distinct = rows.join(one.select("_row"), "_row", "left_semi")
    nodes = distinct.select(F.col("_node").alias("node"), F.col("_bands").alias("bands"), F.col(own_text).alias("text"))
    classes = class_keys(distinct.where("_fp IS NOT NULL").select(F.col("_node").alias("node"), F.col("_fp").alias("fp")))
    parts = materialize(components(overlap_links(nodes, similarity, classes)))
    found = rows.select(F.col(own_id).alias("_id"), "_row", F.col("_node").alias("node")).join(parts, "node", "left")
    first = found.groupBy(F.coalesce("root", "node").alias("class")).agg(
        F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_row")).getField("_row").alias("_row"))
    return rows.join(first.select("_row"), "_row", "left_semi").select(*[
        F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)])
