import datetime as dt
import random
import re
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from dimloom.operators import hierarchy as H
from dimloom.operators import keys as K
from dimloom.operators import profiling as P
from dimloom.session import materialize
from tests.conftest import rows


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src bigint, dst bigint")


def nodes(spark, n):
    return spark.range(1, n + 1).toDF("node")


def test_hierarchy_levels_paths_and_counts(spark):
    staff = spark.createDataFrame([(1, None, "A"), (2, 1, "B"), (3, 1, "C"), (4, 2, "D"), (8, 9, "X"), (9, 8, "Y")], "id int, up int, name string")
    out = H.hierarchy(staff, "id", "up", "name")
    assert rows(out, "id", "manager_name", "hierarchy_level", "manager_path", "direct_reports_count") == [
        (1, None, 1, "A", 2), (2, "A", 2, "A > B", 1), (3, "A", 2, "A > C", 0), (4, "B", 3, "A > B > D", 0)]
    assert H.hierarchy(staff, "id", "up", "name", max_depth=2).count() == 3
    assert H.hierarchy(staff, "id", "up", "name", path_length=5).where("id = 4").first()["manager_path"] == "A > B"


def test_deep_chain_is_walked_to_its_end(spark):
    chain = spark.range(1, 26).select("id", F.when(F.col("id") > 1, F.col("id") - 1).alias("up"), F.col("id").cast("string").alias("name"))
    assert H.hierarchy(chain, "id", "up", "name").count() == 25
    assert H.hierarchy(chain, "id", "up", "name", max_depth=20).count() == 20


def test_cycle_through_a_repeated_key_is_an_error(spark):
    staff = spark.createDataFrame([(1, None, "A"), (2, 1, "B"), (2, 3, "B"), (3, 2, "C")], "id int, up int, name string")
    with pytest.raises(ValueError, match="cycle"):
        H.hierarchy(staff, "id", "up", "name")


def test_closure_with_a_cycle(spark):
    out = H.transitive_closure(edges(spark, (1, 2), (2, 3), (3, 1), (3, 4)))
    assert rows(out.where("src = 1")) == [(1, 1, 3), (1, 2, 1), (1, 3, 2), (1, 4, 3)]
    assert rows(out.where("src = 4")) == []
    assert H.transitive_closure(edges(spark, (1, 2), (2, 3), (3, 4)), max_depth=2).where("src = 1").count() == 2


def test_long_chain_is_closed_to_its_end(spark):
    chain = edges(spark, *[(i + 1, i) for i in range(1, 31)])
    assert H.transitive_closure(chain).count() == 31 * 30 // 2
    writes = edges(spark, (1, 100))
    assert H.indirect_writers(chain, writes).count() == 30
    assert H.edge_findings(chain, nodes(spark, 31), deep=29).where("finding = 'deep_nesting'").first()["depth"] == 30


def test_closure_in_doubling_rounds(spark):
    chain = edges(spark, *[(i + 1, i) for i in range(1, 300)])
    out = H.transitive_closure(chain)
    rounds = {re.search(r"round=(\d+)", f)[1] for f in out.inputFiles()}
    # 299 hops: the edges, nine rounds that double the reach, and the one that finds nothing.
    assert len(rounds) == 11 and out.where("src - dst <> depth").count() == 0 and out.count() == 300 * 299 // 2


def test_closure_lengths_on_a_random_graph(spark):
    rng = random.Random(8)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(70)}
    want, out = {}, {a: [b for x, b in pairs if x == a] for a in range(40)}
    for a in range(40):
        layer, depth = out[a], 1
        while layer:
            for b in layer:
                want.setdefault((a, b), depth)
            layer, depth = [c for b in set(layer) for c in out[b] if (a, c) not in want], depth + 1
    got = {(r.src, r.dst): r.depth for r in H.transitive_closure(edges(spark, *pairs, *pairs)).collect()}
    assert got == want
    assert {k: v for k, v in want.items() if v <= 3} == {(r.src, r.dst): r.depth for r in H.transitive_closure(edges(spark, *pairs), 3).collect()}


def test_hierarchy_of_a_thousand_levels(spark, monkeypatch):
    written = []
    monkeypatch.setattr(H, "materialize", lambda df: written.append(1) or materialize(df))
    chain = spark.range(1, 1001).select("id", F.when(F.col("id") > 1, F.col("id") - 1).alias("up"), F.col("id").cast("string").alias("name"))
    out = H.hierarchy(chain, "id", "up", "name", path_length=40)
    assert len(written) <= 13
    last = out.where("id = 1000").first()
    assert (last["hierarchy_level"], last["manager_name"], out.count()) == (1000, "999", 1000)
    assert last["manager_path"] == " > ".join(map(str, range(1, 30)))[:40]


def test_long_paths_are_whole(spark):
    staff = spark.createDataFrame([(i, i - 1 if i > 1 else None, "n" * 100) for i in range(1, 8)], "id int, up int, name string")
    assert H.hierarchy(staff, "id", "up", "name").where("id = 7").first()["manager_path"] == " > ".join(["n" * 100] * 7)


def test_topological_levels_and_cycles(spark):
    e = edges(spark, (2, 1), (3, 1), (4, 2), (4, 3), (5, 6), (6, 5), (7, 5), (3, 99))
    assert rows(H.topological_levels(e, nodes(spark, 7))) == [(1, 0), (2, 1), (3, 1), (4, 2), (5, None), (6, None), (7, None)]


def test_edge_findings(spark):
    out = H.edge_findings(edges(spark, (1, 2), (2, 1), (3, 9)), nodes(spark, 3), deep=1)
    assert rows(out, "finding", "node") == [("cycle", 1), ("cycle", 2), ("dangling", 3), ("deep_nesting", 1), ("deep_nesting", 2)]


def test_references(spark):
    refs = spark.createDataFrame([(1, 5, True, None), (1, 5, False, True), (2, 5, None, None)], "src int, dst int, is_selected boolean, is_updated boolean")
    assert rows(H.invert_references(refs)) == [(5, 1, True, True), (5, 2, False, False)]
    calls, writes = edges(spark, (1, 2), (2, 3)), edges(spark, (3, 100), (1, 100), (2, 50))
    assert rows(H.indirect_writers(calls, writes)) == [(1, 50), (2, 100)]


def test_column_profile(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1.5)], "id int, s string, v double")
    out = {r["column_name"]: r for r in P.profile_columns(df).collect()}
    assert (out["v"]["nulls"], out["v"]["distinct_values"], out["s"]["flag_like"], out["id"]["least"]) == (2, 1, True, "1")
    sketch = {r["column_name"]: r["distinct_values"] for r in P.profile_columns(df, exact=False).collect()}
    assert sketch == {"id": 3, "s": 2, "v": 1}
    empty = P.profile_columns(df.limit(0)).collect()
    assert all(r["rows"] == 0 and r["distinct_values"] == 0 and r["null_share"] is None for r in empty)


def test_keys_are_minimal_and_exact(spark):
    df = spark.range(200).select((F.col("id") % 20).alias("a"), F.floor(F.col("id") / 20).alias("b"), F.lit(1).alias("c"))
    assert rows(K.find_keys(df), "key") == [("a+b",)]
    assert rows(K.find_keys(df.withColumn("k", F.monotonically_increasing_id())), "key") == [("a+b",), ("k",)]
    assert K.find_keys(df.unionByName(df.limit(1))).count() == 0
    assert K.find_keys(df.limit(0)).count() == 0
    assert rows(K.find_keys(df.limit(1)), "key") == [("a",), ("b",), ("c",)]


@pytest.mark.parametrize("sample", [0, 30, 5_000])
def test_keys_of_any_size_as_counted_by_hand(spark, sample):
    rng = random.Random(5)
    data = sorted({(i % 4, i // 4 % 4, i // 16, rng.randrange(9), rng.choice("xyz"), i if i % 7 else None) for i in range(64)}, key=str)
    df = spark.createDataFrame(data, "a int, b int, c int, d int, e string, f int").withColumn("g", F.rand(1))
    unique = [set(s) for n in range(1, 6) for s in combinations(range(5), n) if len({tuple(r[i] for i in s) for r in data}) == len(data)]
    want = sorted("+".join("abcde"[i] for i in sorted(s)) for s in unique if not any(u < s for u in unique))
    assert [k for (k,) in rows(K.find_keys(df, sample), "key")] == want and "a+b+c" in want


@pytest.mark.parametrize("slice_rows", [10, 100, 1_000])
def test_keys_by_slices_of_the_values(spark, slice_rows):
    """What a slice leaves unbroken is tested whole, so a single repeated value decides, wherever it lies."""
    df = spark.range(200).select(F.col("id").alias("a"), (F.col("id") % 20).alias("b"), F.floor(F.col("id") / 20).alias("c"),
                                 F.when(F.col("id") == 77, 5).otherwise(F.col("id")).alias("d"))
    assert rows(K.find_keys(df, 0, slice_rows), "key") == [("a",), ("b+c",), ("b+d",), ("c+d",)]
    assert K.find_keys(df.unionByName(df.limit(1)), 0, slice_rows).count() == 0


def test_composite_foreign_keys_in_pieces(spark, monkeypatch):
    """Many pieces and frequent values give what one piece gives."""
    parent = spark.range(300).select((F.col("id") % 3).alias("p"), F.col("id").alias("q"))
    child = spark.range(900).select((F.col("id") % 3).alias("a"), (F.col("id") % 300).alias("b"), (F.col("id") % 301).alias("c"))
    whole = rows(K.find_composite_foreign_keys({"parent": parent, "child": child}, {"parent": ["p", "q"]}), "child", "columns")
    monkeypatch.setattr(K, "PIECE", 500)
    assert rows(K.find_composite_foreign_keys({"parent": parent, "child": child}, {"parent": ["p", "q"]}), "child", "columns") == whole
    assert ("child", "a+b") in whole and ("child", "a+c") not in whole


def test_least_sets_hit_every_difference():
    rng = random.Random(2)
    for _ in range(50):
        n, agree = 6, [rng.randrange(63) for _ in range(rng.randrange(6))]
        good = [s for s in range(1, 64) if all(s & ~a for a in agree)]
        assert K.least_sets(agree, n) == [s for s in good if not any(g != s and g & s == g for g in good)]


def test_composite_foreign_keys(spark):
    parent = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "x"), (3, 3, "x")], "p bigint, q bigint, r string")
    child = spark.createDataFrame([(1, 2, 2, "y"), (2, 1, 1, "x"), (None, 1, 1, None), (1, 1, 3, "x")], "a bigint, b bigint, c bigint, d string")
    found = K.find_composite_foreign_keys({"parent": parent, "child": child}, {"parent": ["p", "q"]})
    assert rows(found, "child", "columns") == sorted(inclusions(parent, child)) and ("child", "a+b") in rows(found, "child", "columns")
    three = K.find_composite_foreign_keys({"parent": parent, "child": child}, {"parent": ["p", "q", "r"]})
    assert ("child", "a+b+d") in rows(three, "child", "columns")


def inclusions(parent, child):
    out = []
    pairs = {(r.p, r.q) for r in parent.collect()}
    for name, df, cols in (("child", child, "abc"), ("parent", parent, "pq")):
        data = df.collect()
        for x, y in permutations(cols, 2):
            got = {(r[x], r[y]) for r in data if r[x] is not None and r[y] is not None}
            if got and got <= pairs and (name, x, y) != ("parent", "p", "q"):
                out.append((name, f"{x}+{y}"))
    return out


def test_key_kind_and_watermark(spark):
    df = spark.createDataFrame([(i, f"C{i}", dt.datetime(2020, 1, 1) + dt.timedelta(days=i)) for i in range(1, 30)],
                               "customer_sk int, customer_code string, updated_at timestamp_ntz")
    assert P.key_kind(df, "customer_sk", "updated_at").first()["kind"] == "surrogate"
    assert P.key_kind(df, "customer_code").first()["kind"] == "natural"
    assert P.find_watermark(df).first()["score"] == 4
    assert P.find_watermark(df.drop("updated_at")).count() == 0


def test_foreign_keys_by_inclusion(spark):
    child = spark.createDataFrame([(1, 2, 9), (2, 2, 9), (None, 1, 9)], "a bigint, b bigint, z bigint")
    parent = spark.range(1, 4).toDF("k")
    found = P.find_foreign_keys({"child": child, "parent": parent}, {"parent": "k"}, {"parent": []})
    assert rows(P.foreign_key_types(found), "column_name", "fk_type") == [("a", "role_playing"), ("b", "role_playing")]
    part = P.find_foreign_keys({"child": child.withColumn("a", F.col("a") + 2), "parent": parent}, {"parent": "k"},
                               {"child": ["a"], "parent": []}, min_coverage=0.5)
    assert part.first()["coverage"] == 0.5


def test_pii_by_name_and_value(spark):
    df = spark.createDataFrame([("a@b.org", "x", "10.0.0.1", "123-45-6789"), ("c@d.com", "y", "n/a", None)], "contact string, EmailAddress string, host string, tax string")
    assert rows(P.find_pii(df), "column_name", "by_name", "by_value") == [
        ("EmailAddress", "email", None), ("contact", None, "email"), ("host", None, "ip_address"), ("tax", None, "ssn")]


@pytest.mark.parametrize("change,field", [("overlap", "overlaps"), ("gap", "gaps"), ("two current", "many_current"), ("inverted", "inverted")])
def test_scd2_health_finds(spark, change, field):
    t = [dt.datetime(2020, m, 1) for m in range(1, 6)]
    first, second = (1, t[0], t[1], False), (1, t[1], None, True)
    data = {"overlap": [(1, t[0], t[2], False), second], "gap": [first, (1, t[2], None, True)],
            "two current": [(1, t[0], None, True), second], "inverted": [(1, t[1], t[0], False), second]}[change]
    r = P.scd2_health(spark.createDataFrame(data, "id int, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean"), ["id"]).first()
    assert r[field] >= 1 and r["healthy"] == (change == "gap")


def test_table_kind_unknown(spark):
    df = spark.createDataFrame([(1.5, "long text")], "x double, y string")
    assert P.classify_table(df).first()["kind"] == "unknown"
