"""Near duplicates, repeats, neighbours, mixing, URLs and pages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimloom.llm import mixing, neighbours, pages, simhash, suffixes, urls
from dimloom.session import materialize


def classes_by_brute_force(values, budget):
    n = len(values)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= budget:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprints_with_neighbours(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = rng.getrandbits(64)
        out.append(x)
        for _ in range(rng.choice([0, 0, 1, 3])):
            for b in rng.sample(range(64), rng.choice([1, 4, 5])):
                x ^= 1 << b
            out.append(x)
    # A dense group inside one subtrie.
    base = rng.getrandbits(64)
    out += [base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    return sorted(set(out))


@pytest.mark.parametrize("split", [200_000, 8])
def test_trie_join_loses_no_link(spark, split):
    values = fingerprints_with_neighbours(150, split)
    want = classes_by_brute_force(values, 4)
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    hashed = materialize(spark.createDataFrame(rows + [(0, rows[0][1]), (None, rows[1][1])], "doc_id bigint, fp bigint"))
    got = simhash.near_duplicates(hashed, split=split).collect()
    assert len(got) == len(rows) + 2
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)


def test_trie_classes_on_one_slab():
    rng = random.Random(4)
    values = np.array(sorted({(rng.getrandbits(10) << 54) | rng.getrandbits(6) for _ in range(400)}), np.uint64)
    starts = np.zeros(len(values), bool)
    starts[0] = True
    label = simhash.trie_classes(values, [(0, len(values), 0, len(values), 0, 0)], starts, 4)
    assert label.tolist() == classes_by_brute_force([int(v) for v in values], 4)


def brute_fingerprint(text):
    import xxhash

    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = [None, "", " \n", "One", "one two", "A b C d", "a b c d e É", "x " * 500, "ÀÉ b\tc\x0bd e"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: r.fp & ((1 << 64) - 1) for r in simhash.fingerprints(df).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


def test_keep_one(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(5, text, "a"), (2, text, "b"), (2, text, "b"), (9, "quite another text of some words", "c"), (None, text, "d"), (7, None, None), (8, "", "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _row string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r._row) for r in got.collect()) == [(2, "b"), (7, None), (9, "c")]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_keep_one_links_by_the_tries(spark, monkeypatch):
    """Without any band, the pairs within the budget of bits are still found, and confirmed on the sets."""
    monkeypatch.setattr(simhash, "band_keys", lambda hashes: np.empty(0, np.uint64))
    words = [f"word{i}" for i in range(600)]
    near = [" ".join(words + [f"end{i}"]) for i in range(6)]
    bits = [simhash.fingerprint(t.encode(), simhash.WORDS) & ((1 << 64) - 1) for t in near]
    assert all((b ^ bits[0]).bit_count() <= simhash.BUDGET for b in bits)
    rows = [(i + 10, t) for i, t in enumerate(near)] + [(3, " ".join(f"other{i}" for i in range(80))), (4, ""), (5, None)]
    found = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in found.collect()) == [3, 4, 10]


def near_copy_classes(texts, similarity=0.8):
    """The number of the first text of each text's class: chains of five-word shingle sets with enough in common."""
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    number = {}
    for x in sets:
        for t in x:
            number.setdefault(t, len(number))
    held = np.zeros((len(sets), len(number)), np.float32)
    for i, x in enumerate(sets):
        held[i, [number[t] for t in x]] = 1
    both = held @ held.T
    sizes = held.sum(axis=1)
    near = both >= similarity * (sizes[:, None] + sizes - both) - 1e-6
    label = np.arange(len(sets))
    while True:  # the least label among neighbours, until nothing changes
        least = np.array([label[near[i]].min() for i in range(len(sets))])
        if (least == label).all():
            return label.tolist()
        label = least


def test_keep_one_reaches_similar_texts(spark):
    rng = random.Random(8)
    base = [f"t{rng.randrange(5000)}" for _ in range(400)]
    rows = [(0, base)]
    for i in range(1, 60):  # one dense group with members on both sides of the limit
        rows.append((i, [f"c{i}x{rng.randrange(9999)}" if rng.random() < rng.choice([0.01, 0.02, 0.05]) else w for w in base]))
    rows += [(100 + i, [f"u{i}x{rng.randrange(300)}" for _ in range(200)]) for i in range(30)]
    rows = [(i, " ".join(w)) for i, w in rows]
    group = near_copy_classes([t for _, t in rows])
    assert 30 < len(set(group)) < len(rows) - 15
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(rows[g][0] for g in set(group))


def test_keep_one_in_a_large_family_below_the_limit(spark):
    """Texts that mostly share 0.6 to 0.8, so that hardly any pair links, with a few near copies among them."""
    rng = random.Random(4)
    base = [f"t{rng.randrange(5000)}" for _ in range(250)]
    rows = [[f"c{i}x{k}" if rng.random() < 0.033 else w for k, w in enumerate(base)] for i in range(900)]
    for i in range(60):
        words = list(rng.choice(rows[:900]))
        words[rng.randrange(250)] = f"n{i}"
        rows.append(words)
    texts = [" ".join(w) for w in rows]
    group = near_copy_classes(texts)
    assert 400 < len(set(group)) < 950
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    found = simhash.keep_one(df).collect()
    assert sorted(r.doc_id for r in found) == sorted(set(group))


@pytest.mark.parametrize("piece", [3, 512])
def test_links_between_classes_in_pieces(spark, piece):
    """A key with a large class, outsiders near and far, and a pivot; however small the pieces, the same classes come out."""
    rng = random.Random(piece)
    pivot = set(range(100))
    sets = [pivot] + [set(rng.sample(sorted(pivot), rng.choice([70, 80, 88, 95]))) | {1000 * i + k for k in range(rng.randrange(30))} for i in range(1, 40)]
    similar = lambda x, y: len(x & y) / len(x | y)
    root = [0 if similar(x, pivot) >= 0.8 else i for i, x in enumerate(sets)]
    placed = spark.createDataFrame([(5, i, root[i], 1 - similar(sets[i], pivot), len(sets[i])) for i in range(1, 40)],
                                   "key bigint, node bigint, root bigint, dist double, size bigint")
    packed = spark.createDataFrame([(i, bytearray(np.array(sorted(x), np.uint64).tobytes())) for i, x in enumerate(sets)], "node bigint, hashes binary")
    links = [(r.a, r.b) for r in simhash.class_links(placed, packed, 0.8, piece).collect()]
    assert all(similar(sets[a], sets[b]) >= 0.8 and root[a] != root[b] for a, b in links)

    def classes(pairs):
        label = list(root)
        for a, b in pairs:
            p, q = label[a], label[b]
            label = [min(p, q) if x in (p, q) else x for x in label]
        return label

    every = [(i, j) for i in range(1, 40) for j in range(1, i) if similar(sets[i], sets[j]) >= 0.8]
    assert classes(links) == classes(every)


def brute_repeats(rows, length):
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            w = data[p:p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if first[data[p:p + length]] < i:
                gone[p:p + length] = True
        spans = sum(1 for k in range(len(data)) if gone[k] and (not k or not gone[k - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["an", "ée", "t", "ing ", "x", "o "]) for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(25)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        if rng.random() < 0.6:
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts.insert(rng.randrange(3), p[a:a + rng.choice([49, 50, 51, 90])])
        rows.append((i, "|".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (204, "x" * 49), (205, "x" * 49), (206, "y" * 50), (207, "y" * 50),
             (208, "z" * 300), (209, "q" + "z" * 120), (210, rows[5][1] + rows[5][1]), (3, rows[3][1]), (4, "other " + rows[7][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(tuple(r) for r in suffixes.remove_repeats(df).collect())
    assert got == brute_repeats(rows, 50)
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_repeats_null_id_is_last(spark):
    df = spark.createDataFrame([(None, "k" * 60), (1, "k" * 60)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in suffixes.remove_repeats(df).collect()} == {None: 60, 1: 0}


def test_samples_cover_every_window():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, 400).astype(np.uint8)
    least = suffixes.window_samples(text, 50, 24)
    grams = suffixes.names(text, 24)
    assert len(least) == 351
    assert all(least[i] == grams[i:i + 27].min() for i in range(len(least)))
    whole = suffixes.names(text, 50)
    by_bytes = [text[i:i + 50].tobytes() for i in range(len(whole))]
    assert len(set(whole.tolist())) == len(set(by_bytes))


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[100:700] = x[50]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16),
                                                         (5150, [1.0, None] + [0.0] * 14), (None, [1.0] * 16), (5200, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    rules = neighbours.TreeRules(sample=800, leaf=32, trials=60, piece=128, query_piece=4)
    got = neighbours.search(df, F.col("vec_id") % 50 == 0, 5, rules=rules).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        score = np.round(unit @ unit[q], 12)
        score[q] = -2
        best = np.lexsort((np.arange(1500), -score))[:5]
        hits += len(set(best.tolist()) & {m[1] for m in mine})
        assert all(abs(score[v] - s) < 1e-9 for _, v, s in mine)
        if score[best[4]] > 0.999999:
            assert [m[1] for m in mine] == best.tolist()
    assert hits >= 0.9 * 150
    assert neighbours.search(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    few = neighbours.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


@pytest.mark.parametrize("size", [600, 6000])
def test_leaves_stay_small_however_many_rows(spark, size):
    rng, step = np.random.default_rng(4), 5 if size < 1000 else 50
    x = rng.standard_normal((40, 12))[rng.integers(0, 40, size)] + 0.3 * rng.standard_normal((size, 12))
    x[::9] = x[0]
    x[size // 2] = 2 * x[1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    rules = neighbours.TreeRules(sample=200, branching=4, leaf=16, rows=60, trials=80, piece=64, query_piece=8)
    held = df.select(F.col("vec_id").alias("row"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit("0").alias("leaf"))
    held = held.where("id % 9 <> 0 or id < 50")
    index, rounds = held, 0
    while (trees := neighbours.split(index, rules)) is not None:
        index, rounds = materialize(neighbours.deeper(index, trees, rules)), rounds + 1
    assert rounds >= 1 and index.count() == held.count()
    assert index.groupBy("leaf").count().agg(F.max("count")).first()[0] <= rules.rows
    got: dict[int, list] = {}
    for r in neighbours.search(df, F.col("vec_id") % step == 0, 5, rules=rules).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, size, step):
        score = np.round(unit @ unit[q], 12)
        score[q] = -2
        hits += len(set(np.lexsort((np.arange(size), -score))[:5].tolist()) & set(got[q]))
    assert len(got) == size // step and all(len(v) == 5 for v in got.values())
    assert hits >= 0.9 * 5 * (size // step)


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", "c", "é", None]) if i % 3 else "hot", "w " * rng.choice([0, 1, 30, 400])) for i in range(900)]
    rows += [(None, "a", "x y"), (5, "zz", None), (5, "zz", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in order}
    taken = {s: 0 for s in order}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 + 0.02 * target[s] for s in order)
    # A document too long for what is left does not end the sample.
    long = [(i, "s", "w " * rng.randrange(100, 900)) for i in range(100)] + [(100, "s", "w " * 20_000)]
    one = spark.createDataFrame(long, "doc_id bigint, source string, text string")
    for seed in ("a", "b", "c", "d"):
        mixed = mixing.mix(one, (1,), 1.3, seed=seed).collect()
        assert abs(sum(r.taken for r in mixed) - mixed[0].target) < 100
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in again)
    assert mixing.mix(df.limit(0)).count() == 0


RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for action, rule in RULES:
        site, start = rule.split("/", 1)
        if (host == site or host.endswith("." + site)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return host, path, best and best[1], best and best[0]


def test_buckets_of_sampled_names_are_even():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, 400_000).astype(np.uint8)
    sizes = np.bincount(suffixes.bucket_of(suffixes.sample(data, suffixes.LENGTH, suffixes.GRAM), 50), minlength=50)
    assert sizes.max() < 1.3 * sizes.mean() and sizes.min() > 0.7 * sizes.mean()


def test_urls(spark):
    odd = [None, "", "no scheme", "http://", "http://A.ORG", "http://a.org/", "x://b.example.org/es/1?q#f", "https://Example.ORG/en/12", "http://É.com/fr/x",
           "http://com/fr/", "http://xcom/fr/", "http://a.com?x=/fr/", "http://a.com/de/#/fr/", "a://b://c/d", "http://org/ \n?", "http://user@org/"]
    good = [f"https://site{i % 9}.org/en/{2 + i % 7}{i}" for i in range(120)]
    bad = [f"http://cheap-pills{i % 8}.com/de/{i}" for i in range(120)]
    new = [f"https://site{i % 9}.net/en/2{i}" for i in range(40)] + [f"http://cheap-pills{i}.net/de/{i}" for i in range(40)]
    rows = list(enumerate(odd + good + bad + new)) + [(None, "http://a.org/x"), (0, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    got = urls.judge_urls(df, RULES).collect()
    assert len(got) == len(rows)
    want = sorted([(i, *brute_url(u)[:3]) for i, u in rows], key=str)
    assert sorted([(r.page_id, r.host, r.path, r.rule) for r in got], key=str) == want
    verdict = {r.page_id: r.verdict for r in got if r.page_id}
    for i, u in rows:
        if i and brute_url(u)[3]:
            assert verdict[i] == brute_url(u)[3]
    at = len(odd) + 240
    assert sum(verdict[at + i] == "allow" for i in range(40)) >= 36 and sum(verdict[at + 40 + i] == "block" for i in range(40)) >= 36
    assert {r.verdict for r in urls.judge_urls(df.where("page_id >= %d" % at), RULES).collect()} == {"allow"}
    assert urls.judge_urls(df.limit(0), RULES).count() == 0


def test_verdicts_of_unruled_urls_by_brute_force(spark):
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))
    made = [f"https://{word('abcdeno')}.org/{word('xyabc')}" for _ in range(60)] + [f"http://{word('vwxenoy')}.com/de/{word('uvwab')}" for _ in range(60)]
    made += [f"https://{word('abcdenovwxy')}.net/{word('xyabcuvw')}" for _ in range(80)] + [None, "", "http://É.net/ü"]
    df = spark.createDataFrame(list(enumerate(made)), "page_id bigint, url string")
    got = {r.page_id: (r.score, r.verdict, r.half) for r in urls.judge_urls(df, RULES).withColumn(
        "half", F.pmod(F.xxhash64("host"), F.lit(2))).collect()}
    judged = [(*brute_url(u), got[i][2]) for i, u in enumerate(made)]

    def padded_grams(text):
        text = "\x02" * urls.ORDER + text + "\x03"
        return [text[i:i + urls.ORDER + 1] for i in range(len(text) - urls.ORDER)]

    def model(kind, halves):
        levels = [{} for _ in range(urls.ORDER + 2)]
        for host, path, _, verdict, half in judged:
            for g in padded_grams(host + path) if verdict == kind and half in halves else ():
                for size in range(1, urls.ORDER + 2):
                    after = levels[size].setdefault(g[-size:-1], {})
                    after[g[-1]] = after.get(g[-1], 0) + 1

        def p(g):
            if not g:
                return 1 / urls.ALPHABET
            after = levels[len(g)].get(g[:-1], {})
            n, t = sum(after.values()), len(after)
            return (after.get(g[-1], 0) + t * p(g[1:])) / (n + t) if n else p(g[1:])

        return p

    def score(text, halves):
        good, bad = model("allow", halves), model("block", halves)
        return float(np.mean([np.log(good(g)) - np.log(bad(g)) for g in padded_grams(text)]))

    labelled = [(int(np.floor(score(host + path, (1 - half,)) * urls.FINENESS)), verdict) for host, path, _, verdict, half in judged if verdict]
    n = {v: sum(x[1] == v for x in labelled) for v in ("allow", "block")}
    best, limit = 0.0, None
    for c in sorted({c for c, _ in labelled}, reverse=True):
        gain = sum(x[0] >= c and x[1] == "allow" for x in labelled) / n["allow"] - sum(x[0] >= c and x[1] == "block" for x in labelled) / n["block"]
        if gain >= best:
            best, limit = gain, c / urls.FINENESS
    verdicts = set()
    for i, (host, path, _, verdict, _) in enumerate(judged):
        own = score(host + path, (0, 1))
        assert got[i][0] == pytest.approx(own, abs=1e-9)
        assert got[i][1] == (verdict or ("allow" if own >= limit else "block"))
        verdicts |= set() if verdict else {got[i][1]}
    assert verdicts == {"allow", "block"}


def test_markov_probabilities_by_hand(spark):
    rows = [("ab", "allow"), ("abc", "allow"), ("ba", "block")]
    counts = {}
    for text, kind in rows:
        padded = "\x02" * urls.ORDER + text + "\x03"
        for i in range(len(padded) - urls.ORDER):
            g = padded[i:i + urls.ORDER + 1]
            counts.setdefault(g, [0, 0, 0, 0])[0 if kind == "allow" else 2] += 1
    df = spark.createDataFrame([(g, *c) for g, c in counts.items()], "gram string, a0 int, a1 int, r0 int, r1 int")
    got = {r.gram: r["all"] for r in urls.ratio_table(df).collect()}

    def p(col, gram):
        if not gram:
            return 1 / urls.ALPHABET
        child = {}
        for g, c in counts.items():
            child[g[-len(gram):]] = child.get(g[-len(gram):], 0) + c[col]
        around = {k: v for k, v in child.items() if k[:-1] == gram[:-1] and v}
        n, t = sum(around.values()), len(around)
        return (child[gram] + t * p(col, gram[1:])) / (n + t) if n else p(col, gram[1:])

    for g in counts:
        assert got[g] == pytest.approx(np.log(p(0, g)) - np.log(p(2, g)))


def page(body, title="t", host_words="fixed words"):
    return (f'<!DOCTYPE html><html><head><title>{title}</title><script>var a="</p>";</script></head><body><nav><ul><li><a>x</a></ul></nav>'
            f'<div class="cookie-notice">we use cookies</div><article><h1>{title}</h1>{body}<p>{host_words}</p></article>'
            f'<aside>side</aside><div id="comments"><p>nice</div><footer>&copy; x</footer></body></html>')


def test_pages(spark):
    rows = [(i, f"http://a.org/{i}", page(f"<p>Text &eacute;{i}\n one<br>two<p>B &lt;{i}&gt;", f"T{i}", "Share this article")) for i in range(12)]
    rows += [(100, "http://b.org/1", page("<p>Only <i>one</i> page", "U")), (101, None, page("<p>no url", "V")), (102, "http://a.org/z", None),
             (103, "http://a.org/y", ""), (104, "http://c.org/", "plain & simple <b>text"), (104, "http://c.org/", "plain & simple <b>text"),
             (105, "http://d.org/", "<article>a<form>f</form><p>b</article><p>c")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in pages.extract_text(df).collect()}
    assert pages.extract_text(df).count() == len(rows)
    for i in range(12):
        assert got[i].text == f"T{i}\nText é{i} one two\nB <{i}>"
        assert got[i].n_chars == len(got[i].text)
    assert got[100].text == "U\nOnly one page\nfixed words"
    assert got[101].text == "V\nno url\nfixed words"
    assert got[102].text == got[103].text == "" and got[104].text == "plain & simple text" and got[105].text == "a\nb"
    assert pages.extract_text(df.limit(0)).count() == 0


def brute_templates(pages_of_host):
    """Classes of equal occurrence vectors over lists of (token, is text), frequent and in one order on every page."""
    of = [p for p in pages_of_host if p]
    vectors = {}
    for token in {t for p in of for t in p}:
        vectors.setdefault(tuple(sum(t == token for t in p) for p in of), []).append(token)
    out = []
    for vector, members in vectors.items():
        on = sum(n > 0 for n in vector)
        if on < pages.LEAST_PAGES or on < pages.SHARE * len(of) or (len(members) == 1 and sum(vector) > on):
            continue
        orders = [[t for t in p if t in members] for p in of]
        first = next(o for o in orders if o)[:len(members)]
        if all(o == first * (len(o) // len(members)) for o in orders):
            out.append(tuple(first))
    return out


def crosses(a, b, page):
    """Whether an instance of one class lies partly inside a gap of the other, both ways."""
    def gaps(x, y):
        step, out = 0, set()
        for t in page:
            if t in x:
                step += 1
            elif t in y:
                out.add((y.index(t) == 0 or step == last, step % len(x)))
                last = step
        return all(same for same, _ in out)
    return not (gaps(a, b) or gaps(b, a))


def random_page(rng, i):
    body = "".join(f"<p>{' '.join(rng.choice('abcdefgh') * rng.randint(1, 5) for _ in range(rng.randint(5, 20)))}</p>" for _ in range(rng.randint(1, 4)))
    extra = rng.choice(["", "<div class=box><b>box</b></div>", "<div class=box><b>box</b></div><div class=box><b>box</b></div>"])
    return f"<body><div class=top>site words</div><div class=main><h1>T{i} {rng.random()}</h1>{extra}{body}<i>end</i></div><div class=last>bye {rng.choice('xy')}</div></body>"


@pytest.mark.parametrize("seed", range(3))
def test_templates_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"http://a.org/{i}", random_page(rng, i)) for i in range(14)] + [(90, "http://a.org/e", ""), (91, "http://a.org/n", None)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "id bigint, url string, html string").withColumn("host", F.lit("a.org"))
    got = materialize(pages.scanned(df))
    classes = [tuple(m.token for m in c) for c in pages.templates(got).first().classes]
    scans = [pages.scan(h or "")[0] for _, _, h in rows]
    want = brute_templates(scans)
    whole = {c for c in want}
    # Text runs may have been left out of a class; what is kept is in a brute-force class, in its order.
    for c in classes:
        assert any([t for t in w if t in c] == list(c) for w in whole)
    for a in classes:
        for b in classes:
            assert a == b or not any(crosses(a, b, [t for t in s if t in a or t in b]) for s in scans)
    # The tags that stand once on every page are one class, which frames the rest.
    assert max(map(len, classes)) == max(map(len, want)) > 8
    out = {r.page_id: r.text for r in pages.extract_text(df.withColumnRenamed("id", "page_id")).collect()}
    for i, _, h in rows[:14]:
        paragraphs = re.findall(r"<(?:h1|p)>(.*?)</", h)
        assert [x for x in out[i].split("\n") if x != "box" and not x.startswith("bye")] == paragraphs
        assert "site words" not in out[i] and "\nend" not in out[i]


def article(paragraphs, wrap="<article>{}</article>", title="Title of it"):
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><body><nav>menu</nav>{wrap.format(body)}<footer>f</footer></body></html>"


def test_near_copies_keep_their_paragraphs(spark):
    same = [f"Paragraph number {i} of the article text." for i in range(5)]
    changed = same[:3] + ["A changed paragraph."] + same[4:]
    rows = [(i, article(same)) for i in range(6)] + [(6, article(changed))]
    rows += [(10 + i, article([f"other text {i} {j} " + "w" * (1 + i + j) for j in range(4)], title=f"Other {i}")) for i in range(5)]
    # A host of near copies only, each with another paragraph changed.
    lone = [(20 + i, article([f"changed {i}" if j == i else p for j, p in enumerate(same)])) for i in range(5)]
    df = spark.createDataFrame([(i, f"http://{'a' if i < 20 else 'b'}.org/{i}", h) for i, h in rows + lone], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in pages.extract_text(df).collect()}
    for i, h in rows + lone:
        assert got[i] == "\n".join(re.findall(r"<(?:h1|p)>(.*?)</", h))


def test_marks_do_not_blank_pages(spark):
    text = [f"Words of paragraph {i} that go on for a while." for i in range(4)]
    whole = "\n".join(["Title of it", *text])
    wraps = ['<article class="no-sidebar">{}</article>', '<article class="share-enabled">{}</article>', '<div class="post has-comments"><article>{}</article></div>',
             '<article id="comments-on-politics">{}</article>', '<div class="layout no-sidebar"><p class="x"></p>{}</div>', "<main>{}</main>", "<div>{}</div>",
             '<article>{}</article><section class="comments"><article><p>' + "reader comment " * 40 + "</p></article></section>"]
    rows = [(i, f"http://h{i}.org/", article(text, w)) for i, w in enumerate(wraps)]
    rows.append((50, "http://x.org/", "<main><h1>Title of it</h1>" + "".join(f"<p>{p}</p>" for p in text) + "<article>teaser</article></main>"))
    rows.append((51, "http://x.org/2", '<div class="content-header"><h1>Title of it</h1></div><article>' + "".join(f"<p>{p}</p>" for p in text) + "</article>"))
    rows.append((52, "http://x.org/3", "<article>" + "".join(f"<p>{p * 2000}</p>" for p in text) + "</article>"))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in pages.extract_text(df).collect()}
    assert {i: got[i] for i in range(len(wraps))} == dict.fromkeys(range(len(wraps)), whole)
    assert got[50] == whole + "\nteaser" and got[51] == whole and got[52] == "\n".join(p * 2000 for p in text)
