"""The pipeline stage by stage against brute force on the smallest tables, and on tables with odd rows."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
import corpus_pipeline
from dimloom.llm import secrets
from dimloom.session import scratch_path
from tests.llm.test_pairs import near_copy_classes
from tests.llm.test_texts import brute_features

SF = os.environ.get("DIMLOOM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder(spark):
    """The given documents with odd rows added, and an extra column whose name clashes."""
    if not os.path.isdir(SF):
        pytest.skip("needs the given tables")
    path = scratch_path(spark, "odd-tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("n_words", F.lit("clash"))
    plain = " ".join(f"w{i}" for i in range(90))
    odd = spark.createDataFrame([
        (900001, None, "en", "src0", None, None), (900002, "", None, None, 0, None), (None, plain, None, None, 3, "x"),
        (900003, plain, "en", None, 3, "x"), (900003, plain, "en", None, 3, "x"), (900004, plain + " password=hunter2222", "xx", "src0", 9, "y"),
        (900005, "long " + " ".join(f"v{i % 4999}x{i}" for i in range(30000)), "en", "src1", 9, "y"),
    ], T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]))
    docs.unionByName(odd).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = scratch_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
    before = spark.read.parquet(f"{folder}/documents.parquet").collect()
    # Quality: only rows that fail the base rules or a learned cutoff go; rows stay whole.
    kept = seen["quality_rules"]
    assert all(brute_features(r.text or "")[0] >= 50 for r in kept)
    clean = [r for r in before if (f := brute_features(r.text or ""))[0] >= 50 and f[2] == 0 and f[3] == 0 and f[4] == 0]
    assert {(r.doc_id, r.text) for r in clean} <= {(r.doc_id, r.text) for r in kept}
    assert sum(r.doc_id == 900003 for r in kept) == 2 and all(r.n_words in ("clash", "x", "y") for r in kept)
    # Near duplicates: the smallest id of each class.
    groups = {}
    for r, c in zip(kept, near_copy_classes([r.text for r in kept])):
        groups.setdefault(c, []).append(r.doc_id if r.doc_id is not None else float("inf"))
    single = seen["near_duplicates"]
    assert sorted(r.doc_id for r in single) == sorted(min(g) for g in groups.values())
    # Secrets: masked, nothing else changed.
    texts = {r.doc_id: r.text for r in single}
    for r in seen["secret_scan"]:
        spans = [(s, e) for _, s, e in secrets.find_spans(texts[r.doc_id], secrets.EntropyRules())]
        assert r.text == secrets.masked(texts[r.doc_id], spans, "[secret]")
        assert not spans or r.n_chars == len(r.text)
    assert "hunter2222" not in "".join(r.text for r in seen["secret_scan"])
    # Mixture: whole copies, at most two.
    copies = {}
    for r in seen["mix_sources"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= set(texts) and max(copies.values()) <= 2
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    # One text has 30,001 words; a source can miss its target by half of its longest document.
    assert abs(words(seen["mix_sources"]) - 1.5 * words(seen["secret_scan"])) < 0.02 * words(seen["secret_scan"]) + 30_001 / 2
    for name in list(seen)[:-1]:
        assert seen[name][0].__fields__ == columns
    # Packing: every copy whole.
    by_doc = {}
    for p in seen["pack_sequences"]:
        by_doc[p.doc_id] = by_doc.get(p.doc_id, 0) + p.length
        assert p.offset + p.length <= 2048
    totals = {p.doc_id: p.doc_tokens for p in seen["pack_sequences"]}
    assert by_doc == {d: totals[d] * n for d, n in copies.items()}


def test_mixture_tells_null_and_repeated_ids_apart(spark):
    rows = [(None if i % 3 else 7, f"text{i} " + "word " * (20 + i % 9), "src0") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = corpus_pipeline.mix_sources(spark, docs, "")
    assert out.columns == docs.columns
    got = [r.text for r in out.collect()]
    assert all(1 <= got.count(t) <= 2 for _, t, _ in rows)
    total = sum(len(t.split()) for _, t, _ in rows)
    assert abs(sum(len(t.split()) for t in got) - 1.5 * total) <= 30
    # Null ids are drawn one by one, not all before or after the others.
    twice = [i for i, (_, t, _) in enumerate(rows) if got.count(t) == 2]
    assert 0.35 < sum(rows[i][0] is None for i in twice) / 200 < 0.65


def test_registered(spark):
    names = list(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_op6_matches_its_check(spark):
    from tests.oracle import connect, differences

    if not os.path.isdir(SF):
        pytest.skip("needs the given tables")
    assert differences(entry.queries()["op6_pareto_mix"](spark, SF), connect(SF), entry.oracle_sql()["op6_pareto_mix"]) == []
