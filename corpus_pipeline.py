"""From raw documents to packed training sequences: quality, near duplicates, secrets, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimloom.llm import mixing, packing, quality, secrets, simhash
from dimloom.llm.common import prepare, table
from dimloom.llm.queries import SEQUENCE, word_vocabulary
from dimloom.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. The texts are read twice and moved never."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    cutoffs = quality.learn(quality.text_features(docs.select("doc_id", "lang", "text")), labels)
    # Plain names, so that no column of the documents clashes with a feature.
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    place = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    judged = quality.judge(quality.text_features(plain, place["text"], keep_text=True), cutoffs, place["lang"])
    return judged.where("kept").select(*[F.col(p).alias(c) for c, p in place.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    prepare(spark)
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; documents stay."""
    prepare(spark)
    return secrets.mask_secrets(docs, length="n_chars" if "n_chars" in docs.columns else None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it. Ids may be null or repeated: rows are told apart by a key written with them."""
    prepare(spark)
    row = "_mix_row"
    while row in map(str.lower, docs.columns):
        row += "_"
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    draw = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text"))
    mixed = materialize(mixing.mix(keyed, row=row, draw=draw))
    return mixing.repeat_by_copies(keyed, mixed, row).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs, word_vocabulary(), SEQUENCE, 1)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

# Hashed ranks, learned cutoffs and token ids are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
