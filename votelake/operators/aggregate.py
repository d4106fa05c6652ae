"""Vote aggregation: majority, weighted, any, or, threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votelake.schema import ABSTAIN


def counts(votes: DataFrame) -> DataFrame:
    """counts(id, split, class, n): the one shuffle on id that later steps reuse."""
    return votes.groupBy("id", "split", F.col("vote").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def _decide(examples: DataFrame, scores: DataFrame, ties: str, slack: float = 0.0) -> DataFrame:
    """The best class by score for every example; scores(id, class, s)."""
    best = F.max(F.struct("s", (-F.col("class")).alias("c")))
    top = scores.groupBy("id").agg(best.alias("best"), F.collect_list("s").alias("all"))
    winners = F.size(F.filter("all", lambda x: F.col("best.s") - x <= slack))
    label = -F.col("best.c")
    if ties == "abstain":
        label = F.when(winners == 1, label).otherwise(ABSTAIN)
    decided = top.select("id", label.cast("int").alias("label"))
    return examples.select("id", "split").join(decided, "id", "left").select("id", "split", F.coalesce("label", F.lit(ABSTAIN)).alias("label"))


def majority(examples: DataFrame, votes: DataFrame, ties: str = "abstain") -> DataFrame:
    """Majority vote; ties abstain or go to the lowest class, no vote abstains."""
    return _decide(examples, counts(votes).select("id", "class", F.col("n").cast("double").alias("s")), ties)


def weighted(examples: DataFrame, votes: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Weighted vote; abstains when the two best are within 1e-9.  weights(lf, weight), 1 where missing."""
    v = votes if weights is not None else votes.withColumn("weight", F.lit(1.0))
    if weights is not None:
        v = votes.join(weights.select("lf", "weight"), "lf", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    scores = v.groupBy("id", F.col("vote").alias("class")).agg(F.sum("weight").alias("s"))
    return _decide(examples, scores, "abstain", 1e-9 * (1 - 1e-6))


def any_vote(examples: DataFrame, votes: DataFrame, target: int = 1) -> DataFrame:
    """``target`` where any annotator votes it, else abstain."""
    hit = votes.filter(F.col("vote") == target).select("id").distinct().withColumn("label", F.lit(target))
    return examples.select("id", "split").join(hit, "id", "left").withColumn("label", F.coalesce("label", F.lit(ABSTAIN)))


def label_sets(examples: DataFrame, votes: DataFrame, threshold: int = 1) -> DataFrame:
    """labels: the classes with at least ``threshold`` votes, ascending (multi-label OR for 1)."""
    sets = counts(votes).filter(F.col("n") >= threshold).groupBy("id").agg(F.array_sort(F.collect_set("class")).alias("labels"))
    return examples.select("id", "split").join(sets, "id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<int>")))


def vote_tensor(votes: DataFrame) -> DataFrame:
    """Distinct (id, lf, class), the sparse form of the votes tensor."""
    return votes.select("id", "lf", F.col("vote").alias("class")).distinct()


def hybrid_scores(examples: DataFrame, votes: DataFrame, precision: DataFrame, n_classes: int) -> DataFrame:
    """Class probabilities by summed annotator precision; uniform where there is no mass.  Long form (id, class, p)."""
    scored = votes.join(precision.select("lf", "precision"), "lf", "left").filter(F.col("vote") < n_classes)
    s = scored.groupBy("id", F.col("vote").alias("class")).agg(F.sum(F.coalesce("precision", F.lit(0.0))).alias("s"))
    total = s.groupBy("id").agg(F.sum("s").alias("total"))
    grid = examples.select("id", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("class"))
    p = grid.join(total, "id", "left").join(s, ["id", "class"], "left")
    return p.select("id", "class", F.when(F.col("total") > 0, F.coalesce("s", F.lit(0.0)) / F.col("total")).otherwise(1.0 / n_classes).alias("p"))


def stored_or_majority(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """A stored label, abstain included, wins over the recomputed one; stored(id, label)."""
    return recomputed.join(stored.select("id", F.col("label").alias("__s")), "id", "left").select("id", "split", F.coalesce("__s", "label").alias("label"))
