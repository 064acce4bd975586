"""URL filter: host and path rules, and a character language-model ratio for the rest. DataFrame functions only.

Two variable-order Markov models are counted over host and path, one over the URLs that rules accept and one over those they
reject. A character's probability after its last ``order`` characters is smoothed towards the next shorter context
(Witten-Bell: the weight of the shorter one is the number of different characters seen after the context), down to a uniform one, so each context is as
long as the data bears. The score is the mean log-likelihood ratio per character. The limit between allow and block is
calibrated on the labelled URLs, scored by models counted on the other half of the hosts.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimloom.llm.common import join_small
from dimloom.session import materialize

ORDER = 4
# Weight of a character never seen: one of so many.
ALPHABET = 256
# Score classes per nat for the calibration; scores are cut off at +-20 nats, far beyond any mean ratio.
FINENESS, WIDEST = 100, 20
# The three models: counted on hosts of half 1 (for half 0), on half 0 (for half 1), on all.
MODELS = {"x0": ("1",), "x1": ("0",), "all": ("0", "1")}


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a string without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    none = F.lit("")
    return (F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), none), F.coalesce(path, none))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, and its verdict; null without one. ``rules`` holds (verdict, host/path)."""
    rule = verdict = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):  # later ones wrap earlier ones, so the longest wins
        site, slash, start = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def grams(row: DataFrame, text: Column, keep: Sequence[str]) -> DataFrame:
    """One row per character of the text and its end: the character with the ``ORDER`` before it."""
    padded = F.concat(F.lit("\x02" * ORDER), text, F.lit("\x03"))
    return (row.withColumn("_padded", padded)
            .withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_padded") - ORDER)))
            .select(*keep, F.substring("_padded", F.col("_at"), F.lit(ORDER + 1)).alias("gram")))


def ratio_table(counted: DataFrame) -> DataFrame:
    """(gram, one log ratio per model) from (gram, a0, a1, r0, r1), the accepted and rejected counts by half."""
    cells = [f"{c}{h}" for c in "ar" for h in "01"]
    level = None
    for size in range(1, ORDER + 2):
        now = counted.groupBy(F.substring("gram", ORDER + 2 - size, size).alias("gram")).agg(*[F.sum(c).alias(c) for c in cells])
        now = now.withColumn("context", F.substring("gram", 1, size - 1))
        sums = {f"{c}_{m}": sum((F.col(f"{c}{h}") for h in halves), F.lit(0)) for c in "ar" for m, halves in MODELS.items()}
        now = now.select("gram", "context", *[v.alias(k) for k, v in sums.items()])
        around = now.groupBy("context").agg(*[x for k in sums for x in (
            F.sum(k).alias(f"n_{k}"), F.count_if(F.col(k) > 0).alias(f"t_{k}"))])
        now = now.join(around, "context")
        if level is None:
            now = now.withColumns({f"q_{k}": F.lit(1.0 / ALPHABET) for k in sums})
        else:
            shorter = level.select(F.col("gram").alias("_shorter"), *[F.col(f"p_{k}").alias(f"q_{k}") for k in sums])
            now = now.join(shorter, F.substring("gram", 2, size - 1) == F.col("_shorter"))
        level = materialize(now.select("gram", *[
            F.when(F.col(f"n_{k}") > 0, (F.col(k) + F.col(f"t_{k}") * F.col(f"q_{k}")) / (F.col(f"n_{k}") + F.col(f"t_{k}")))
            .otherwise(F.col(f"q_{k}")).alias(f"p_{k}") for k in sums]))
    return level.select("gram", *[(F.ln(f"p_a_{m}") - F.ln(f"p_r_{m}")).alias(m) for m in MODELS])


def calibrated_limit(scored: DataFrame) -> float | None:
    """The score that best parts accepted from rejected labelled URLs; None if one kind is missing.

    Best is the largest difference of the two shares above the limit, ties to the lower limit. The scores are counted in
    classes, so their number is fixed.
    """
    cut = F.least(F.greatest(F.floor(F.col("held_out") * FINENESS), F.lit(-WIDEST * FINENESS)), F.lit(WIDEST * FINENESS))
    counts = scored.where(F.col("by_rule").isNotNull()).groupBy(cut.alias("c")).agg(
        F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad"))
    found = {r.c: (r.good, r.bad) for r in counts.collect()}  # one row per class
    good, bad = (sum(v[i] for v in found.values()) for i in (0, 1))
    if not good or not bad:
        return None
    best, limit, over = 0.0, None, [0, 0]
    for c in sorted(found, reverse=True):
        over[0] += found[c][0]
        over[1] += found[c][1]
        gain = over[0] / good - over[1] / bad
        if gain >= best:
            best, limit = gain, c / FINENESS
    return limit


def judge_urls(df: DataFrame, rules: Sequence[tuple[str, str]], id_column: str = "page_id", url: str = "url",
               broadcast_grams: int = 200_000) -> DataFrame:
    """One row per row of ``df``: id, ``host``, ``path``, ``rule``, ``score`` and ``verdict`` (allow or block).

    The rule's verdict stands where one fits; elsewhere a URL is allowed if its score reaches the calibrated limit. Without
    labelled URLs of both kinds everything else is allowed. Null and empty URLs have an empty host and path and are
    scored as such. Rows with equal or null ids are judged one by one.
    """
    host, path = split_url(F.col(url))
    base = df.select(F.col(id_column).alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    half = F.pmod(F.xxhash64("host"), F.lit(2))
    base = materialize(base.select("*", rule.alias("rule"), verdict.alias("by_rule"), half.alias("half"))
                       .withColumn("_row", F.monotonically_increasing_id()))
    text = F.concat("host", "path")
    cell = lambda kind, h: F.count_if((F.col("by_rule") == kind) & (F.col("half") == h))
    counted = materialize(grams(base, text, ["by_rule", "half"]).groupBy("gram").agg(
        cell("allow", 0).alias("a0"), cell("allow", 1).alias("a1"), cell("block", 0).alias("r0"), cell("block", 1).alias("r1")))
    ratios = materialize(ratio_table(counted))
    each = join_small(grams(base, text, ["_row"]), ratios, ["gram"], limit=broadcast_grams)
    means = each.groupBy("_row").agg(*[F.avg(m).alias(m) for m in MODELS])
    scored = materialize(base.join(means, "_row").withColumn(
        "held_out", F.when(F.col("half") == 0, F.col("x0")).otherwise(F.col("x1"))))
    limit = calibrated_limit(scored)
    own = F.lit("allow") if limit is None else F.when(F.col("all") >= limit, "allow").otherwise("block")
    return scored.select(F.col("_id").alias(id_column), "host", "path", "rule", F.col("all").alias("score"),
                         F.coalesce("by_rule", own).alias("verdict"))
