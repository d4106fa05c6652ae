"""Pool evolution: gates, near-duplicate and subsumption pruning, ablation, acceptance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votelake.operators.analyze import overlap
from votelake.operators.metrics import ratio


def threshold_gate(metrics: DataFrame, min_precision: float = 0.25, min_fires: int = 5) -> DataFrame:
    """Rows whose precision (null is 0) and fires reach the floors."""
    return metrics.filter((F.coalesce("precision", F.lit(0.0)) >= min_precision) & (F.coalesce("fires", F.lit(0)) >= min_fires))


def consistency_gate(metrics: DataFrame, gap: float = 0.30) -> DataFrame:
    """Drops val-overfit: val precision - train precision > gap, one-sided; metrics by split."""
    by = metrics.groupBy("lf").agg(F.max(F.when(F.col("split") == "val", F.col("precision"))).alias("val"), F.max(F.when(F.col("split") == "train", F.col("precision"))).alias("train"))
    return by.withColumn("gap", F.coalesce("val", F.lit(0.0)) - F.coalesce("train", F.lit(0.0))).filter(F.col("gap") <= gap)


def refine_targets(metrics: DataFrame, min_precision: float = 0.55, max_coverage: float = 0.08, k: int = 6) -> DataFrame:
    """Precise annotators of small coverage, the most precise first (top-k)."""
    ok = (F.col("precision") >= min_precision) & (F.col("coverage") > 0) & (F.col("coverage") <= max_coverage)
    return metrics.filter(ok).orderBy(F.desc("precision"), "lf").limit(k)


def low_f1_targets(scores: DataFrame, excluded: list[int], threshold: float = 0.40, k: int = 3) -> DataFrame:
    """The k classes of lowest F1 (null is 0) under the threshold."""
    f1 = F.coalesce("f1", F.lit(0.0))
    kept = scores.filter(f1 < threshold)
    if excluded:
        kept = kept.filter(~F.col("class").isin(*excluded))
    return kept.withColumn("f1", f1).orderBy("f1", "class").limit(k)


def exclude_classes(clusters: DataFrame, excluded: list[int]) -> DataFrame:
    """Clusters whose target is not excluded; those without a target stay."""
    return clusters.filter(F.col("target_label").isNull() | ~F.col("target_label").isin(*(excluded or [-999])))


def greedy_jaccard(existing: DataFrame, candidates: DataFrame, limit: float = 0.95) -> list[str]:
    """Names of candidates kept in name order: each fires and has Jaccard <= limit with all kept before it.

    votes of both in; set sizes and intersections are counted in Spark, the
    order-dependent part runs on the pool x pool table (bounded by the pool).
    """
    votes = existing.select("id", "lf", F.lit(False).alias("new")).unionByName(candidates.select("id", "lf", F.lit(True).alias("new")))
    if votes.select("lf").distinct().limit(5001).count() > 5000:
        raise ValueError("at most 5000 annotators")
    near = {(r["lf_a"], r["lf_b"]) for r in overlap(votes.select("id", "lf")).filter(F.col("jaccard") > limit).select("lf_a", "lf_b").collect()}
    names = {r["lf"]: r["new"] for r in votes.groupBy("lf").agg(F.max("new").alias("new")).collect()}
    kept = {n for n, new in names.items() if not new}
    out = []
    for n in sorted(n for n, new in names.items() if new):
        if not any((min(n, o), max(n, o)) in near for o in kept):
            kept.add(n)
            out.append(n)
    return out


def subsumed(votes: DataFrame, precision: DataFrame, new: DataFrame, jaccard: float = 0.95, gain: float = 0.05, covered: float = 0.95) -> DataFrame:
    """Old annotators that a new one covers with better precision: lf and by.

    New ones are never victims, so order does not matter.
    """
    pairs = overlap(votes)
    both = pairs.select("lf_a", "lf_b", "jaccard", "shared", F.col("fires_a").alias("fires_old")).unionByName(
        pairs.select(F.col("lf_b").alias("lf_a"), F.col("lf_a").alias("lf_b"), "jaccard", "shared", F.col("fires_b").alias("fires_old"))
    )
    names = new.select(F.col("lf").alias("__n")).distinct()
    both = both.join(F.broadcast(names), F.col("lf_b") == F.col("__n"), "left_semi").join(F.broadcast(names), F.col("lf_a") == F.col("__n"), "left_anti")
    p = precision.select("lf", "precision")
    met = both.join(p.withColumnRenamed("lf", "lf_a").withColumnRenamed("precision", "p_old"), "lf_a").join(p.withColumnRenamed("lf", "lf_b").withColumnRenamed("precision", "p_new"), "lf_b")
    hit = ((F.col("jaccard") >= jaccard) | (ratio("shared", "fires_old") >= covered)) & (F.col("p_new") >= F.col("p_old") + gain)
    return met.filter(hit).groupBy(F.col("lf_a").alias("lf")).agg(F.min("lf_b").alias("by"))


def kill_log(scored: DataFrame, kept: DataFrame, gates: list[tuple[str, DataFrame]]) -> DataFrame:
    """Scored but not kept, with the first gate that an annotator fails; gates are (reason, survivors)."""
    gone = scored.join(kept.select("lf"), "lf", "left_anti")
    reason = F.lit(None).cast("string")
    for i, (name, survivors) in reversed(list(enumerate(gates))):
        gone = gone.join(survivors.select("lf", F.lit(True).alias(f"__g{i}")).distinct(), "lf", "left")
        reason = F.when(F.col(f"__g{i}").isNull(), name).otherwise(reason)
    return gone.withColumn("reason", reason).drop(*[f"__g{i}" for i in range(len(gates))])


def ablate(examples: DataFrame, votes: DataFrame, new: list[str], n_classes: int, threshold: float = 0.001) -> list[str]:
    """New annotators to drop: repeatedly the one whose loss raises macro F1 of the majority vote most.

    Examples with equal vote patterns and gold are one row of the collected
    table, so its size follows the pool's patterns; over 200,000 is an error.
    """
    per = votes.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("lf", "vote"))).alias("s"))
    rows = examples.select("id", "gold").join(per, "id", "left").groupBy("gold", "s").agg(F.count(F.lit(1)).alias("n"))
    got = rows.limit(200_001).collect()
    if len(got) > 200_000:
        raise ValueError("too many vote patterns for the driver's ablation")
    names = sorted({v["lf"] for r in got for v in r["s"] or ()})
    at = {n: i for i, n in enumerate(names)}
    tally = np.zeros((len(names), len(got), n_classes))
    for i, r in enumerate(got):
        for v in r["s"] or ():
            if v["vote"] < n_classes:
                tally[at[v["lf"]], i, v["vote"]] = 1
    gold = np.array([-1 if r["gold"] is None else r["gold"] for r in got])
    n = np.array([r["n"] for r in got])

    def macro(total: np.ndarray) -> float:
        label = np.where(total.sum(axis=1) > 0, total.argmax(axis=1), -1)
        f1 = []
        for c in range(n_classes):
            tp, fp, fn = n[(label == c) & (gold == c)].sum(), n[(label == c) & (gold != c)].sum(), n[(label != c) & (gold == c)].sum()
            f1.append(2 * tp / (2 * tp + fp + fn) if tp + fp and tp + fn else 0.0)
        return float(np.sum(f1)) / n_classes

    total, dropped = tally.sum(axis=0), []
    left = [x for x in sorted(new) if x in at]
    while left:
        now = macro(total)
        best, victim = now, None
        for x in left:
            f1 = macro(total - tally[at[x]])
            if f1 > best + threshold:
                best, victim = f1, x
        if victim is None:
            break
        total = total - tally[at[victim]]
        left.remove(victim)
        dropped.append(victim)
    return dropped


def accept(before: float | None, after: float, drop: float = 0.020, min_gain: float = 0.001) -> bool:
    """Do no harm: refuse a drop over ``drop``, and a gain under ``min_gain`` where that is set."""
    if before is None:
        return True
    return not (before - after > drop or (min_gain > 0 and after - before < min_gain))


def set_operations(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """Union, intersection, difference and both-sided union of equal schemas."""
    return {"union": a.unionByName(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "concat": a.unionByName(b)}
