"""The registered queries of the training-data operators, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimloom.llm import hmm, interactions, mixing, negatives, neighbours, packing, pages, quality, secrets, simhash, suffixes, tokens, urls
from dimloom.llm.common import table
from dimloom.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEQUENCE = 2048


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def word_vocabulary() -> str:
    """The place of the tokenizer file; the package with the files is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_template_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


# The rules of the URL filter: verdict, and host with path.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@query
def op2_markov_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


@query
def op3_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), word_vocabulary(), SEQUENCE)


@query
def op4_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.search(rows, F.col("vec_id") % 50 == 0, 5)


@query
def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), word_vocabulary(), SEQUENCE, 1)


@query
def op8_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    place = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("secrets", lambda x: x["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(F.array_join(F.transform(base, place), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("secrets", place), ",").alias("spans"))


@query
def op9_trie_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = materialize(simhash.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text")))
    found = simhash.near_duplicates(hashed)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op10_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The features are read twice, the texts once.
    features = materialize(quality.text_features(table(spark, sf_dir, "documents", "doc_id", "lang", "text")))
    judged = quality.judge(features, quality.learn(features, table(spark, sf_dir, "labels", "doc_id", "quality")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op11_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    return hmm.score_texts(table(spark, sf_dir, "documents", "doc_id", "text"), held_out)


@query
def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The masks are read twice, the texts once.
    failed = materialize(interactions.text_failures(table(spark, sf_dir, "documents", "doc_id", "source", "text")))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"), "toxic")
    return interactions.audit(interactions.mask_counts(failed, labels, ["good", "toxic"]), losses=["good", "toxic"])


@query
def op13_shared_list_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


ORACLES["op6_pareto_mix"] = r"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
    s AS (SELECT *, CAST([3, 1, 2][1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w
          FROM (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source) x),
    -- In the order in which sources reach their limit: what each would get if just those before it were at theirs.
    k AS (SELECT *, 2.0 * source_size AS most,
                 (SELECT 1.5 * SUM(source_size) FROM s) - coalesce(SUM(2.0 * source_size) OVER before, 0) AS rest,
                 (SELECT SUM(w) FROM s) - coalesce(SUM(w) OVER before, 0) AS weights
          FROM s WINDOW before AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (SELECT CAST(rest / weights AS DOUBLE) AS level FROM k WHERE w * rest / weights <= most
              ORDER BY 2.0 * source_size / w, source NULLS LAST LIMIT 1),
    t AS (SELECT source, source_size, CAST(least(2.0 * source_size, w * level) AS DOUBLE) AS target FROM s, level),
    c AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS wanted,
                 (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || 'mix'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    p AS (SELECT *, CAST(floor(wanted + 1e-12) AS BIGINT) AS certain, least(greatest(wanted - floor(wanted + 1e-12), 1e-9), 1 - 1e-9) AS chance FROM c),
    r AS (SELECT *, (u / (1 - u)) / (chance / (1 - chance)) AS odds, greatest(target - certain * source_size, 0) AS budget FROM p),
    -- Three times along the ranks, each time over what is left and fits the gap.
    q1 AS (SELECT *, size <= budget AND SUM(CASE WHEN size <= budget THEN size ELSE 0 END) OVER w <= budget AS in1
           FROM r WINDOW w AS (PARTITION BY source ORDER BY odds, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    g1 AS (SELECT *, budget - coalesce(SUM(CASE WHEN in1 THEN size END) OVER (PARTITION BY source), 0) AS gap1 FROM q1),
    q2 AS (SELECT *, in1 OR (size <= gap1 AND SUM(CASE WHEN NOT in1 AND size <= gap1 THEN size ELSE 0 END) OVER w <= gap1) AS in2
           FROM g1 WINDOW w AS (PARTITION BY source ORDER BY odds, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    g2 AS (SELECT *, budget - coalesce(SUM(CASE WHEN in2 THEN size END) OVER (PARTITION BY source), 0) AS gap2 FROM q2),
    q3 AS (SELECT *, in2 OR (size <= gap2 AND SUM(CASE WHEN NOT in2 AND size <= gap2 THEN size ELSE 0 END) OVER w <= gap2) AS inside
           FROM g2 WINDOW w AS (PARTITION BY source ORDER BY odds, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    g AS (SELECT *, budget - coalesce(SUM(CASE WHEN inside THEN size END) OVER (PARTITION BY source), 0) AS gap FROM q3),
    f AS (SELECT *, NOT inside AND abs(size - gap) < gap AS fits FROM g),
    h AS (SELECT *, fits AND ROW_NUMBER() OVER (PARTITION BY source, fits ORDER BY abs(size - gap), odds, doc_id) = 1 AS last FROM f)
    SELECT doc_id, size, source_size, target, CAST((certain + CASE WHEN inside OR last THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM h"""


ORACLES["op12_filter_interactions"] = r"""
    WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    d AS (SELECT part, CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
                 + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
                 + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
                 + CASE WHEN MIN(doc_id) OVER (PARTITION BY text) < coalesce(doc_id, 9223372036854775807) THEN 16 ELSE 0 END AS mask,
                 EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND quality = 1) AS good,
                 EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND toxic = 1) AS toxic FROM t),
    m AS (SELECT part, mask, COUNT(*) AS n, COUNT(*) FILTER (good) AS good, COUNT(*) FILTER (toxic) AS toxic FROM d GROUP BY part, mask),
    letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter a, letter b, letter c, letter d, letter e
               WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    bits AS (SELECT o AS filter_order, s AS step, CAST(2 ** (ascii(substr(o, s, 1)) - 65) AS INTEGER) AS own,
                    coalesce(list_sum(list_transform(range(1, s), lambda i: CAST(2 ** (ascii(substr(o, CAST(i AS INTEGER), 1)) - 65) AS INTEGER))), 0)::INTEGER AS earlier
             FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s) x),
    r AS (SELECT part, filter_order, step, own,
                 CAST(SUM(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
                 CAST(SUM(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
                 CAST(SUM(CASE WHEN mask & earlier > 0 AND mask & own > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
                 CAST(SUM(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                 CAST(SUM(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
                 CAST(SUM(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
          FROM m, bits GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           CAST(SUM(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""
