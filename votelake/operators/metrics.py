"""Annotator metrics and label metrics on one (class, tp, fp, fn) kernel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelake.schema import ABSTAIN


def annotator_metrics(examples: DataFrame, votes: DataFrame, pool: DataFrame) -> DataFrame:
    """fires, correct, incorrect, coverage and precision of each annotator by split.

    Rows without gold count nowhere; precision is null where it never fires.
    ``pool`` has a column lf, so annotators that never fire have rows, too.
    """
    labeled = examples.filter("gold is not null").select("id", "split", "gold")
    n = labeled.groupBy("split").agg(F.count(F.lit(1)).alias("n_labeled"))
    hit = votes.join(labeled.drop("split"), "id").groupBy("split", "lf").agg(F.count(F.lit(1)).alias("fires"), F.count_if(F.col("vote") == F.col("gold")).alias("correct"))
    # splits times pool: both are small dimensions
    grid = n.join(F.broadcast(pool.select("lf").distinct().withColumn("__one", F.lit(1))), F.col("__one") == F.lit(1)).drop("__one")
    out = grid.join(hit, ["split", "lf"], "left").fillna(0, ["fires", "correct"])
    return out.select("split", "lf", "n_labeled", "fires", "correct", (F.col("fires") - F.col("correct")).alias("incorrect"), ratio("fires", "n_labeled").alias("coverage"), ratio("correct", "fires").alias("precision"))


def vote_histogram(votes: DataFrame) -> DataFrame:
    """(split, lf, vote, n) of votes cast."""
    return votes.groupBy("split", "lf", "vote").agg(F.count(F.lit(1)).alias("n"))


def annotator_class_metrics(examples: DataFrame, votes: DataFrame) -> DataFrame:
    """Multi-label: fires, hits and precision by annotator and class; a hit is a vote in ``labels``."""
    met = votes.join(examples.select("id", "labels"), "id")
    out = met.groupBy("lf", F.col("vote").alias("class")).agg(F.count(F.lit(1)).alias("fires"), F.count_if(F.array_contains("labels", F.col("vote"))).alias("hits"))
    return out.withColumn("precision", ratio("hits", "fires"))


def polarity(votes: DataFrame) -> DataFrame:
    """lf and the classes it ever votes, ascending."""
    return votes.groupBy("lf").agg(F.array_sort(F.collect_set("vote")).alias("polarity"))


def candidate_metrics(examples: DataFrame, votes: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidate scorer: fires, hits, precision (0 where none), predicted class where it votes only one."""
    hit = F.array_contains("labels", F.col("vote")) if "labels" in examples.columns else F.coalesce(F.col("gold") == F.col("vote"), F.lit(False))
    gold = "labels" if "labels" in examples.columns else "gold"
    met = votes.join(examples.select("id", gold), "id").groupBy("lf").agg(F.count(F.lit(1)).alias("fires"), F.count_if(hit).alias("hits"), F.collect_set("vote").alias("v"))
    out = pool.select("lf").join(met, "lf", "left").fillna(0, ["fires", "hits"])
    return out.select("lf", "fires", "hits", F.coalesce(ratio("hits", "fires"), F.lit(0.0)).alias("precision"), F.when(F.size("v") == 1, F.col("v")[0]).alias("predicted_label"))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double, null where b is 0."""
    as_double = lambda x: (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.try_divide(as_double(a), as_double(b))


def confusion(examples: DataFrame, labels: DataFrame, abstain_adds_fn: bool = True) -> DataFrame:
    """(split, class, tp, fp, fn): gold rows only; an abstain is a miss of its gold class."""
    rows = labels.select("id", "label").join(examples.filter("gold is not null").select("id", "split", "gold"), "id")
    if not abstain_adds_fn:
        rows = rows.filter(F.col("label") != ABSTAIN)
    return tally(rows)


def tally(rows: DataFrame) -> DataFrame:
    """(split, class, tp, fp, fn) of rows(split, gold, label); a row with a column n stands for n rows."""
    many = F.col("n") if "n" in rows.columns else F.lit(1)
    hit = F.col("label") == F.col("gold")
    one = F.struct(F.col("gold").alias("class"), hit.cast("int").alias("tp"), F.lit(0).alias("fp"), (~hit).cast("int").alias("fn"))
    two = F.struct(F.col("label").alias("class"), F.lit(0).alias("tp"), (~hit).cast("int").alias("fp"), F.lit(0).alias("fn"))
    parts = rows.select("split", many.alias("n"), F.explode(F.array(one, two)).alias("c")).select("split", "n", "c.*").filter(F.col("class") >= 0)
    return parts.groupBy("split", "class").agg(*[F.sum(F.col(k) * F.col("n")).alias(k) for k in ("tp", "fp", "fn")])


def prf(c: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn; null where undefined."""
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn"))).withColumn("f1", F.when(F.col("tp") + F.col("fn") > 0, F.when(F.col("tp") + F.col("fp") > 0, f1)))


def evaluate(examples: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a split: totals, coverage, accuracy on covered and on all labelled rows."""
    rows = labels.select("id", "label").join(examples.select("id", "split", "gold"), "id")
    has, said = F.col("gold").isNotNull(), F.col("label") != ABSTAIN
    out = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(has).alias("n_labeled"),
        F.count_if(said).alias("n_covered"),
        F.count_if(has & said).alias("n_labeled_covered"),
        F.count_if(has & (F.col("label") == F.col("gold"))).alias("n_correct"),
    )
    return out.withColumns({"coverage": ratio("n_covered", "n_total"), "accuracy_on_covered": ratio("n_correct", "n_labeled_covered"), "accuracy_overall": ratio("n_correct", "n_labeled")})


def label_distribution(labels: DataFrame) -> DataFrame:
    """(split, label, n), abstain included."""
    return labels.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def macro_f1(c: DataFrame, n_classes: int, divide_by: str = "classes", undefined: str = "zero") -> DataFrame:
    """Macro F1 of a confusion table: divided by the class count or by the classes seen; undefined F1 is 0 or left out."""
    scored = prf(c)
    total = F.sum(F.coalesce("f1", F.lit(0.0)))
    seen = F.count(F.lit(1)) if undefined == "zero" else F.count("f1")
    by = F.lit(float(n_classes)) if divide_by == "classes" else seen.cast("double")
    return scored.groupBy("split").agg((total / by).alias("macro_f1"))


# ---------------------------------------------------------------- multi-label


def multilabel_confusion(gold: DataFrame, predicted: DataFrame, n_classes: int) -> DataFrame:
    """(class, tp, fp, fn) over the whole class list; gold(id, labels), predicted(id, labels)."""
    rows = gold.select("id", F.col("labels").alias("y")).join(predicted.select("id", F.col("labels").alias("z")), "id")
    grid = rows.select(F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("class"), "y", "z")
    y, z = F.array_contains("y", F.col("class")), F.array_contains("z", F.col("class"))
    return grid.groupBy("class").agg(F.count_if(y & z).alias("tp"), F.count_if(~y & z).alias("fp"), F.count_if(y & ~z).alias("fn"))


def multilabel_summary(gold: DataFrame, predicted: DataFrame, n_classes: int, empty_pair: float = 0.0) -> DataFrame:
    """One row: macro, micro, weighted and sample F1, subset accuracy, Hamming loss, coverage, cardinalities."""
    per = multilabel_confusion(gold, predicted, n_classes).withColumn("support", F.col("tp") + F.col("fn"))
    f1 = F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    prec, rec = F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(ratio("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    classes = per.agg(
        (F.sum(f1) / n_classes).alias("macro_f1"),
        (F.sum(prec) / n_classes).alias("macro_precision"),
        (F.sum(rec) / n_classes).alias("macro_recall"),
        F.coalesce(ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")), F.lit(0.0)).alias("micro_f1"),
        F.coalesce(ratio(F.sum(f1 * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"),
        F.sum(F.col("fp") + F.col("fn")).alias("wrong"),
    )
    rows = gold.select("id", F.col("labels").alias("y")).join(predicted.select("id", F.col("labels").alias("z")), "id")
    both, one = F.size(F.array_intersect("y", "z")), F.size("y") + F.size("z")
    samples = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(one == 0, F.lit(empty_pair)).otherwise(2.0 * both / one)).alias("sample_f1"),
        F.avg((F.array_sort("y") == F.array_sort("z")).cast("double")).alias("subset_accuracy"),
        F.avg((F.size("z") > 0).cast("double")).alias("coverage_anyone"),
        F.avg(F.size("z").cast("double")).alias("mean_predicted"),
        F.avg(F.size("y").cast("double")).alias("mean_true"),
    )
    # one row each
    joined = classes.withColumn("__k", F.lit(1)).join(samples.withColumn("__k", F.lit(1)), "__k").drop("__k")
    return joined.withColumn("hamming_loss", ratio("wrong", F.col("n") * n_classes)).drop("wrong")


def label_stats(examples: DataFrame, n_classes: int) -> DataFrame:
    """Rows, label count by class, cardinality and density of label sets."""
    total = examples.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.size("labels").cast("double")).alias("cardinality"))
    per = examples.select(F.explode("labels").alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    all_classes = examples.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class"))
    out = all_classes.join(per, "class", "left").fillna(0, ["n"]).withColumn("__k", F.lit(1)).join(total.withColumn("__k", F.lit(1)), "__k").drop("__k")
    return out.withColumn("density", F.col("cardinality") / n_classes)
