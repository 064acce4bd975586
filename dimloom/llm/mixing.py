"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target says how often each of its words is wanted. The whole part of that number is a number of certain
copies of every document. The fraction is the inclusion probability of a sample without replacement: documents are ranked by
the odds of a uniform number, drawn from a hash of the id, over the odds of inclusion, and taken in that order until the words that are left to
the target are used up. Documents that did not fit are passed over, and the order is gone through again for what is left, three times in all. One more document, the one whose size fits the last gap best, is taken if that
brings the source nearer to its target. Ranks are summed in range-partitioned segments, so one source may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimloom.llm.common import WORD, join_small, running_totals
from dimloom.session import materialize


# Times that the ranks are gone through.
PASSES = 3


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the MD5 of the key, the same in every run and every engine."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16 ** 12))


def source_targets(rows: DataFrame, weights: Sequence[float], share: float, most: float, source: str, size: str) -> DataFrame:
    """One row per source: ``source_size`` and ``target``.

    Sources in code-point order, null last, weigh ``weights``, repeating. ``share`` times all sizes is dealt out by weight; a target
    stops at ``most`` times its source's size, and what is over goes to the others until none is above.
    """
    sums = rows.groupBy(source).agg(F.sum(size).alias("source_size")).withColumn("_one", F.lit(1))
    sums = sums.withColumn("_null", F.col(source).isNull())
    ranked = running_totals(materialize(sums), ["_null", source], ["_one"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before__one") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select(source, "source_size", F.col("before__one").alias("source_rank"), weight.alias("_weight")))
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("_weight")).first()
    budget = share * (total or 0)
    level = budget / all_weights if all_weights else 0.0
    capped = -1
    while True:  # every round caps one source more at least
        over = F.col("_weight") * level > most * F.col("source_size")
        n, at_cap, free = ranked.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, most * F.col("source_size"))), F.lit(0.0)),
            F.sum(F.when(~over, F.col("_weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (budget - at_cap) / free
    return ranked.withColumn("target", F.least(most * F.col("source_size").cast("double"), F.col("_weight") * level)).drop("_weight")


def mix(df: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, source: str = "source",
        id_column: str = "doc_id", text: str = "text", seed: str = "mix", propensity: Column | None = None,
        row: str | None = None, draw: Column | None = None) -> DataFrame:
    """One row per row of ``df``: id, source, ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken``.

    ``propensity`` scales a document's inclusion probability within its source (1 if not given). Null and empty texts have
    size 0 and take nothing. Documents with equal ids are sampled one by one. Reruns on the same rows agree. ``row`` names a written column that
    is unique and never null, which is handed on; ``draw`` is what the uniform number is drawn from (the id if not given).
    """
    own_row = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = materialize(df.select(
        F.col(id_column).alias("_id"), F.col(source).alias("_source"), word_count(text).alias("size"),
        (F.lit(1.0) if propensity is None else propensity.cast("double")).alias("_propensity"),
        (F.col(id_column) if draw is None else draw).alias("_draw"), own_row.alias("_row")))
    targets = materialize(source_targets(rows, weights, share, most, "_source", "size").withColumnRenamed("_source", "_s")
                          .select("*", F.coalesce("_s", F.lit("")).alias("_k"), F.col("_s").isNull().alias("_n")))
    keyed = rows.select("*", F.coalesce("_source", F.lit("")).alias("_k"), F.col("_source").isNull().alias("_n"))
    joined = join_small(keyed, targets.drop("_s"), ["_k", "_n"]).drop("_k", "_n")

    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("_certain", F.floor(wanted + 1e-12).cast("bigint"))
    chance = F.least(F.greatest((wanted - F.col("_certain")) * F.col("_propensity"), F.lit(1e-9)), F.lit(1 - 1e-9))
    u = uniform(F.col("_draw"), seed)
    joined = joined.withColumns({
        "_odds": (u / (1 - u)) / (chance / (1 - chance)),
        "_left": F.greatest(F.col("target") - F.col("_certain") * F.col("source_size"), F.lit(0.0)),
    }).drop("_propensity", "_draw")
    gapped = materialize(joined.withColumns({"_in": F.lit(False), "_gap": F.col("_left")}))
    for _ in range(PASSES):
        # Along the ranks over what is left and could fit; a document too large for the gap stands in nobody's way.
        fitting = ~F.col("_in") & (F.col("size") <= F.col("_gap"))
        ranked = running_totals(materialize(gapped.withColumn("_size", F.when(fitting, F.col("size")).otherwise(0))),
                                ["_odds", "_id", "size", "_row"], ["_size"], ["source_rank"])
        ranked = materialize(ranked.withColumn("_in", F.col("_in") | (fitting & (F.col("before__size") + F.col("size") <= F.col("_gap")))).drop(
            "before__size", "_size", "_gap"))
        used = materialize(ranked.groupBy("source_rank").agg(F.coalesce(F.sum(F.when(F.col("_in"), F.col("size"))), F.lit(0)).alias("_used")))
        gapped = join_small(ranked, used, ["source_rank"]).withColumn("_gap", F.col("_left") - F.col("_used")).drop("_used")
    inside = F.col("_in")
    miss = F.abs(F.col("size") - F.col("_gap"))
    fits = ~inside & (miss < F.col("_gap"))
    last = materialize(gapped.where(fits).groupBy("source_rank").agg(
        F.min(F.struct(miss, F.col("_odds"), F.col("_id"), F.col("_row"))).getField("_row").alias("_last")))
    chosen = join_small(gapped, last, ["source_rank"], "left")
    extra = (inside | F.coalesce(F.col("_row") == F.col("_last"), F.lit(False))) & (F.col("size") > 0)
    copies = F.col("_certain") + extra.cast("bigint")
    return chosen.select(
        F.col("_id").alias(id_column), F.col("_source").alias(source), "size", "source_size", "target",
        F.when(F.col("size") > 0, copies).otherwise(F.col("_certain")).alias("copies"), (copies * F.col("size")).alias("taken"),
        *([] if row is None else [F.col("_row").alias(row)]))


def repeat_by_copies(df: DataFrame, mixed: DataFrame, row: str) -> DataFrame:
    """``df`` with every row as often as ``mixed`` takes it; rows with no copy go. ``row`` names the row key that both hold."""
    times = mixed.where(F.col("copies") > 0).select(F.col(row).alias("_mix_key"), F.col("copies").cast("int").alias("_mix_copies"))
    # The list of copies is as long as the documents: a merge join at every size, never a broadcast of a list that happens to be short.
    return (df.join(times.hint("merge"), df[row] == F.col("_mix_key"))
            .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*df.columns))
