"""Quality rules: text features, fixed base rules, and cutoffs whose false rejections are bounded.

For every rule (a feature that is high in poor texts) and every stratum a list of candidate cutoffs is tested against the labelled good
documents, from the most lenient to the strictest. A cutoff passes if the exact binomial test rejects "more than
``alpha / rules`` of the good documents are lost" at level ``delta / (rules * strata)`` (the Clopper-Pearson bound, read as a test); the first failure ends the walk, which
keeps the level without a further correction for the number of cutoffs. So, with probability 1 - delta, all rules together reject at
most ``alpha`` of the good documents in every stratum. Among the passing cutoffs the one that gains most is taken: share of
labelled poor documents rejected less share of good ones, ties to the more lenient. A stratum with too few
labels for any bound keeps everything the base rules keep.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimloom.llm.common import join_small, texts
from dimloom.session import materialize

_SPACE = b" \t\n\r\x0b\x0c"
_SPACES = [_SPACE[i:i + 1] for i in range(len(_SPACE))]
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
FEATURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"


@dataclass(frozen=True)
class Risk:
    """``alpha``: most good documents lost per stratum, as a share; ``delta``: chance that a bound fails anywhere."""

    alpha: float = 0.04
    delta: float = 0.05
    # Per rule: candidate cutoffs, from lenient to strict. A document is rejected if the feature reaches the cutoff.
    cutoffs: tuple[tuple[str, tuple[float, ...]], ...] = (
        ("symbol_share", (2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05)),
        ("dup_line_share", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
        ("repeat_share", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
        ("word_length", (20.0, 16.0, 14.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0)),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""
    import numpy as np

    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, n)
    if len(seen) == n:
        return 0
    size = len(seen)
    pairs = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # three ids would not fit into 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * size + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:k + len(windows)] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return len(lines), len(lines) - len(set(lines))


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    chars = len(text.decode("utf-8", "replace")) - sum(map(text.count, _SPACES))
    lines, repeated = duplicate_lines(text)
    return len(words), chars, len(_SYMBOLS.findall(text)), repeated, repeated_words(words), lines


def text_features(df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` with the features, and without its text unless ``keep_text``; every other column is kept.

    A null text counts as empty. Columns named like a feature are replaced by the feature.
    """
    names = [f.split()[0] for f in FEATURES.split(", ")]
    others = [c for c in df.columns if (keep_text or c != text) and c not in names]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others] + [FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(raw) for raw in texts(batch.column(len(others)))]
            found = [pa.array(col, pa.int64()) for col in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(others)], *found], [*others, *names])

    return df.select(*[F.col(f"`{c}`") for c in others], F.col(text)).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    """The features the rules look at; all are high in poor texts."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def tail_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), exact up to rounding. 1 where k is not below the mean."""
    if k >= n * p:
        return 1.0
    log = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    term = total = 1.0
    for i in range(k, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, math.exp(log) * total)


def choose_cutoffs(labelled: DataFrame, stratum: str, good: str, risk: Risk) -> DataFrame:
    """One row per stratum and rule with a certified cutoff: (stratum, rule, cutoff, n_good, lost).

    ``labelled`` holds the stratum, the rules' values and the flag ``good``. Counts for all cutoffs are taken in one
    aggregation; the walk over the cutoffs of a (stratum, rule) sees one row per cutoff.
    """
    tests = [(r, i, c) for r, cuts in risk.cutoffs for i, c in enumerate(cuts)]
    is_good = F.col(good)
    sums = labelled.groupBy(stratum).agg(
        F.count_if(is_good).alias("n_good"), F.count_if(~is_good).alias("n_poor"),
        *[F.count_if(is_good & (F.col(r) >= c)).alias(f"g_{r}_{i}") for r, i, c in tests],
        *[F.count_if(~is_good & (F.col(r) >= c)).alias(f"p_{r}_{i}") for r, i, c in tests])
    rules = len(risk.cutoffs)
    level = F.lit(risk.delta) / (rules * F.greatest(F.lit(1), F.count(F.lit(1)).over(_everything())))
    kind = labelled.schema[stratum].dataType.simpleString()
    share = risk.alpha / rules

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for rule, cuts in risk.cutoffs:
                    best = None
                    for i, cut in enumerate(cuts):
                        lost, caught = row[f"g_{rule}_{i}"], row[f"p_{rule}_{i}"]
                        if tail_at_most(lost, row["n_good"], share) > row["level"]:
                            break
                        gain = caught / max(1, row["n_poor"]) - lost / max(1, row["n_good"])
                        if gain > (best[0] if best else 0):
                            best = (gain, cut, lost)
                    if best:
                        out.append({"stratum": row[stratum], "rule": rule, "cutoff": best[1], "n_good": row["n_good"],
                                    "lost": best[2]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("stratum", batch.schema.field(stratum).type), ("rule", pa.string()), ("cutoff", pa.float64()),
                ("n_good", pa.int64()), ("lost", pa.int64())]))

    return sums.withColumn("level", level).mapInArrow(
        walk, f"stratum {kind}, rule string, cutoff double, n_good bigint, lost bigint").withColumnRenamed("stratum", stratum)


def _everything():
    from pyspark.sql import Window

    # One row per stratum stands here.
    return Window.partitionBy(F.lit(0))


def learn(features: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", risk: Risk = Risk()) -> DataFrame:
    """The certified cutoffs, written out: one row per stratum, one column per rule, null where the rule rejects nothing.

    ``features`` are the rows of ``text_features``. ``labels`` has ``key`` and ``quality`` (1 is good); null keys or qualities
    take no part, and a document labelled both ways counts as both. The tests need independent labels, so an id counts once in a
    stratum however many rows it has; where its rows differ, with the largest value of each rule, which can only make a cutoff harder to certify.
    """
    shown = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).select(
        F.col(key).alias("_key"), (F.col("quality") == 1).alias("_good")).distinct()
    values = rule_values()
    labelled = (features.where(~base_failed())
                .select(F.col(key).alias("_key"), stratum_of(stratum).alias("_stratum"), *[v.alias(k) for k, v in values.items()])
                .join(shown, "_key").groupBy("_key", "_stratum", "_good").agg(*[F.max(k).alias(k) for k in values]))
    chosen = choose_cutoffs(labelled, "_stratum", "_good", risk)
    return materialize(chosen.groupBy("_stratum").agg(*[
        F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in values]))


def stratum_of(column: str) -> Column:
    """A null stratum is a stratum of its own, spelled ''."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def judge(features: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add ``base_failed`` and ``kept`` to the rows of ``text_features``.

    Rows stay one by one, repeated ones too. Without a cutoff nothing but the base rules rejects.
    """
    values = rule_values()
    rows = join_small(features.withColumn("_stratum", stratum_of(stratum)), cutoffs, ["_stratum"], "left")
    rejected = F.lit(False)
    for rule, value in values.items():
        rejected = rejected | F.coalesce(value >= F.col(f"_cut_{rule}"), F.lit(False))
    return (rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)
            .drop("_stratum", *[f"_cut_{r}" for r in values]))
