"""Hidden Markov scores, the filter audit and hard negatives against brute force."""

import math
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dimloom.llm import hmm, interactions, negatives
from tests.conftest import rows as sorted_rows

SF = os.environ.get("DIMLOOM_SF_DIR", "/root/testdata/sf0.001")
TEXTS = "doc_id bigint, text string, source string, n_tokens string, words string"


# Hidden Markov model.

def tiny_model(k, buckets, seed):
    rng = np.random.default_rng(seed)
    share = lambda x: x / x.sum(axis=-1, keepdims=True)
    emit = rng.uniform(0.1, 1, (buckets, k))
    return hmm.Model(share(rng.uniform(0.1, 1, k)), share(rng.uniform(0.1, 1, k)), share(rng.uniform(0.1, 1, (k, k))), emit / emit.sum(axis=0))


def paths(model, seq, first):
    """Every state path with its joint probability."""
    for path in product(range(len(first)), repeat=len(seq)):
        p = first[path[0]] * model.emit[seq[0], path[0]]
        for a, b, x in zip(path, path[1:], seq[1:]):
            p *= model.move[a, b] * model.emit[x, b]
        yield path, p


def test_forward_is_the_sum_over_all_paths():
    model = tiny_model(3, 5, 1)
    rng = random.Random(2)
    seqs = [[rng.randrange(5) for _ in range(n)] for n in (1, 7, 2, 5, 9, 1, 8)]
    lengths = np.array(list(map(len, seqs)))
    flat, starts = np.array(sum(seqs, [])), np.cumsum(lengths) - lengths
    want = [math.log(sum(p for _, p in paths(model, s, model.first))) for s in seqs]
    for rules in (hmm.HmmRules(states=3), hmm.HmmRules(states=3, long=1, passage=2), hmm.HmmRules(states=3, long=8, passage=3)):
        assert np.allclose(hmm.log_likelihoods(model, flat, starts, lengths, rules), want, rtol=1e-12)


def test_long_sequences_do_not_underflow():
    model = tiny_model(4, 300, 5)
    seq = np.random.default_rng(3).integers(0, 300, 30_000)
    one = hmm.log_likelihoods(model, seq, np.array([0]), np.array([30_000]), hmm.HmmRules(states=4, long=10 ** 9))
    cut = hmm.log_likelihoods(model, seq, np.array([0]), np.array([30_000]), hmm.HmmRules(states=4, long=100, passage=77))
    assert np.isfinite(one).all() and np.allclose(one, cut, rtol=1e-12)


def test_expected_counts_are_those_of_all_paths():
    model = tiny_model(2, 4, 7)
    seqs = [[0, 3, 1, 2, 2], [1, 1, 0], [3, 2, 1], [2]]
    begins = np.array([True, False, True, False])
    lengths = np.array(list(map(len, seqs)))
    got = hmm.expected_counts(model, np.array(sum(seqs, [])), np.cumsum(lengths) - lengths, lengths, begins)
    first, later, moves, emitted, total = np.zeros(2), np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for seq, begin in zip(seqs, begins):
        found = list(paths(model, seq, model.first if begin else model.next))
        mass = sum(p for _, p in found)
        total += math.log(mass)
        for path, p in found:
            (first if begin else later)[path[0]] += p / mass
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / mass
            for state, x in zip(path, seq):
                emitted[x, state] += p / mass
    for a, b in zip(got, (first, later, moves, emitted, total)):
        assert np.allclose(a, b)


def two_languages(n, seed):
    rng = random.Random(seed)
    words = [[f"{c}{i}" for i in range(60)] for c in "xy"]
    return [(i, " ".join(rng.choice(words[i % 2]) for _ in range(rng.choice([3, 40, 700]))), "s", "clash", "clash") for i in range(n)]


ODD = [(None, "x1 X2 x3", "s", "a", "b"), (1001, None, "s", "a", "b"), (1002, "", "s", "a", "b"), (1002, "", "s", "a", "b"), (1003, " \t\r\n\x0b\x0c", "s", "a", "b"),
       (1004, "X1 x1 Éx1 x2", "s", "a", "b"), (1005, "x1 " * 5000, "s", "a", "b"), (1006, "never seen", "s", "a", "b"), (1006, "x1", "s", "a", "b")]


def base_by_hand(data):
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, (_, t, *_) in enumerate(data)}
    held = {i: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for i, (d, *_) in enumerate(data)}
    c = Counter(x for i, ts in tokens.items() if not held[i] for x in ts)
    n, v = sum(c.values()), len(c)
    return sorted(((data[i][0] is not None, data[i][0] or 0, held[i], len(ts), sum(c[x] > 0 for x in ts), n,
                    round(sum(math.log10((c[x] + 1) / (n + (v + 1))) for x in ts), 6)) for i, ts in tokens.items()))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2


def test_scores(spark):
    data = two_languages(60, 1) + ODD
    df = spark.createDataFrame(data, TEXTS).repartition(3)
    whole = hmm.score_texts(df, held_out(), rules=hmm.HmmRules(buckets=256)).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in whole)
    assert got == base_by_hand(data)
    assert all(math.isfinite(r.score) and r.score < 0 for r in whole)
    # However the texts are cut into blocks and passages of scoring, the scores are the same, but for the single precision of the training sums.
    small = hmm.score_texts(df.coalesce(1), held_out(), rules=hmm.HmmRules(buckets=256, block=500, long=50)).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.score)
    assert np.allclose([r.score for r in sorted(whole, key=key)], [r.score for r in sorted(small, key=key)], rtol=1e-5)
    # Two languages: the states tell them apart, and texts held out become likelier than by counts alone.
    held = [r for r in whole if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(held) > 3 and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_likelihood_rises_and_words_of_a_bucket_share_it(spark):
    rules = hmm.HmmRules(buckets=64, states=4, rounds=5, block=3000, prior=0.0)
    df = spark.createDataFrame(two_languages(40, 4), TEXTS)
    blocks = hmm.encode(df, "doc_id", "text", F.lit(False), rules)
    # Python and Spark put words into the same buckets.
    listed = {r.block: (r.words, np.frombuffer(r.bucket, "<u4")) for r in blocks.collect()}
    mass, seen = np.zeros(65), set()
    for r in hmm.word_counts(blocks, 64).collect():
        word, bucket = bytes(listed[r.home][0][r.pos]), listed[r.home][1][r.pos]
        assert bucket == (64 if not word else bucket) and (r.bucket is None or r.bucket == bucket)
        if r.bucket is not None:
            assert word not in seen
            seen.add(word)
            mass[bucket] += r.c
    assert len(seen) == 121 and mass[64] == 40
    model, likelihoods = hmm.train(blocks, mass, 120, rules)
    assert all(b > a for a, b in zip(likelihoods, likelihoods[1:]))
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and math.isclose(model.first.sum(), 1)


def test_probabilities_add_up(spark):
    """Over all texts of up to one word (known words, one unknown per bucket) and a rest, the model's probabilities sum to one."""
    rules = hmm.HmmRules(buckets=4, states=2, rounds=2)
    learned = [(i, t, "s", "", "") for i, t in enumerate(["a b", "b b c", "a", "", "d a b"]) if zlib.crc32(str(i).encode()) % 7 != 2]
    probe = [(10_000 + i, t, "s", "", "") for i, t in enumerate([""] + sorted({w for _, t, *_ in learned for w in t.split()}))]
    df = spark.createDataFrame(learned + probe, TEXTS)
    got = {r.doc_id: r for r in hmm.score_texts(df, F.col("doc_id") >= 10_000, rules=rules).collect()}
    mass = sum(10 ** got[d].score for d, *_ in probe)
    assert 0 < mass < 1


def test_scores_of_nothing(spark):
    none = spark.createDataFrame([], TEXTS)
    assert hmm.score_texts(none, held_out()).collect() == []
    only = spark.createDataFrame([(1, "a b", "s", "", "")], TEXTS)
    row = hmm.score_texts(only, F.lit(True), rules=hmm.HmmRules(buckets=16)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and math.isfinite(row.score)


# Filter audit.

def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {x for x, bad in zip("ABCD", (len(words) < 50, 100 * len(set(words)) < 65 * len(words),
                                         100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)))) if bad}


def audit_by_hand(docs, labels):
    big = float("inf")
    texts = [(d if d is not None else big, t or "", s or "") for d, t, s, *_ in docs]
    failing = [fails(t) | ({"E"} if any(t == u and e < d for e, u, _ in texts) else set()) for d, t, _ in texts]
    good, toxic = ({d for d, q, x in labels if (q, x)[i] == 1 and d is not None} for i in (0, 1))
    out, sums = [], Counter()
    for part in sorted({s for *_, s in texts}):
        rows = [(d, f) for (d, _, s), f in zip(texts, failing) if s == part]
        for order in permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                sums[part, x] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), sum(x in f for _, f in rows) - len(gone), sum(f == {x} for _, f in rows),
                            sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)])
    return sorted((*r, sums[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_against_all_orders(spark):
    rng = random.Random(3)
    plain = " ".join(f"w{i}" for i in range(60))
    pool = [plain, plain.upper(), plain + " # x", "short", "short | A", " ".join("ab"[i % 2] for i in range(80)), "É" * 30 + "AA", "É" * 39 + "AA", None, "",
            " ".join(f"w{i}" for i in range(40_000)), "a " * 49 + "a", " ".join(f"w{i % 65}" for i in range(100)), " ".join(f"w{i % 64}" for i in range(100))]
    docs = [(i if i % 9 else None, rng.choice(pool), rng.choice(["a", "b", None, ""]), "clash", "clash") for i in range(120)]
    docs += [(5, "same id", "a", "", ""), (5, "same id", "b", "", ""), (6, "same id", "c", "", "")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame(docs, TEXTS.replace("n_tokens", "mask").replace("words", "digest"))
    marks = spark.createDataFrame(labels, "id bigint, good int, toxic int")
    failed = interactions.text_failures(df)
    got = interactions.audit(interactions.mask_counts(failed, marks, ["good", "toxic"]), losses=["good", "toxic"])
    assert sorted(tuple(r) for r in got.collect()) == audit_by_hand(docs, labels)


def test_audit_of_nothing(spark):
    none = interactions.text_failures(spark.createDataFrame([], TEXTS))
    labels = spark.createDataFrame([(1, 1, 1)], "id bigint, good int, toxic int")
    assert interactions.audit(interactions.mask_counts(none, labels, ["good"]), losses=["good"]).collect() == []


@pytest.mark.parametrize("n", [2, 3, 5])
def test_least_squares_gives_the_average_over_orders(n):
    rng = random.Random(n)
    value = [0] + [rng.randrange(1000) for _ in range((1 << n) - 1)]
    sums = [0] * n
    for order in permutations(range(n)):
        seen = 0
        for i in order:
            sums[i] += value[seen | 1 << i] - value[seen]
            seen |= 1 << i
    solved = [sum(f * v for f, v in zip(row, value)) for row in interactions.shapley_matrix(n)]
    assert solved == [Fraction(s, math.factorial(n)) for s in sums]


# Hard negatives.

def mined_by_hand(rows, every, rules):
    rows = [r for r in rows if None not in r[:3] and all(x is not None and math.isfinite(x) for x in r[2]) and len(r[2]) == len(rows[0][2])]
    by_id = {}
    for i, label, v in sorted(rows, key=lambda r: (r[0], r[1], [math.floor(rules.scale * x) for x in r[2]])):
        by_id.setdefault(i, (label, [math.floor(rules.scale * x) for x in v]))
    out = []
    for a, (label, q) in by_id.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, (other, v) in by_id.items() if i != a)
        for p, i, _ in [r for r in scored if r[2] == label][:rules.positives]:
            fit = [(-n, j) for n, j, other in scored if other != label and rules.low * -p <= 100 * -n <= rules.high * -p]
            out += [(a, i, k, j, -p, n) for k, (n, j) in enumerate(fit[:rules.negatives], 1)]
    return sorted(out)


SCHEMA = "vec_id bigint, label int, embedding array<float>, rank int, cluster string"


@pytest.mark.parametrize("rules", [negatives.MiningRules(), negatives.MiningRules(cluster=4, piece=40, anchors=3, block=8)])
def test_negatives_against_brute_force(spark, rules):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(400):
        c = i % 7 % 6 if i % 3 else 0  # one group holds more than a third
        v = centres[c] + 0.3 * rng.normal(size=8)
        rows.append((i + 1, int((c + (i % 11 == 0)) % 4), np.float32(v / np.linalg.norm(v) * (1 + i % 4)).tolist()))
    rows += [(1000 + i, int(i % 4), rows[7][2]) for i in range(30)]  # ties
    rows += [(2000, 1, [0.0] * 8), (2010, 1, [0.001] * 8), (2020, None, rows[0][2]), (2030, 1, None), (2040, 1, [None] + [1.0] * 7), (2050, 1, [float("nan")] * 8),
             (2060, 2, [float("inf")] * 8), (2070, 2, [1.0, 2.0]), (2080, 3, []), (None, 1, rows[0][2]), rows[9], rows[19], (10, 3, rows[50][2]),
             (3000, 0, [500.0] * 8), (3001, 0, [400.0] * 8), (3002, 1, [-450.0] * 8), (3003, 1, [300.0] * 8)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, rules=rules)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == mined_by_hand(rows, 10, rules) and len(found) > 200


def test_too_long_vectors_take_no_part(spark):
    rows = [(10, 0, [1.0, 1.0]), (1, 0, [1.0, 1.0]), (2, 1, [0.5, 0.5]), (3, 0, [3e38, 3e38]), (4, 1, [1e6, 0.0])]
    df = spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA)
    got = [tuple(r) for r in negatives.mine(df, F.col("vec_id") == 10).collect()]
    assert got == [(10, 1, 1, 2, 131072, 65536)]


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(none, F.col("vec_id") % 2 == 0).collect() == []
    one = spark.createDataFrame([(2, 1, [1.0, 0.0], 1, "")], SCHEMA)
    assert negatives.mine(one, F.col("vec_id") % 2 == 0).collect() == []
    assert negatives.mine(one, F.lit(False)).collect() == []


# Registered queries.

def test_op12_matches_its_check(spark):
    from tests.oracle import connect, differences

    if not os.path.isdir(SF):
        pytest.skip("needs the given tables")
    assert differences(entry.queries()["op12_filter_interactions"](spark, SF), connect(SF), entry.oracle_sql()["op12_filter_interactions"]) == []


def test_op11_and_op13_on_the_given_tables(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the given tables")
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op11_hidden_markov_scores"](spark, SF).drop("score")
    mine = sorted((True, r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.collect())
    assert mine == base_by_hand(docs)
    vectors = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
               for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = sorted_rows(entry.queries()["op13_shared_list_negatives"](spark, SF))
    assert sorted(found) == mined_by_hand(vectors, 50, negatives.MiningRules())
