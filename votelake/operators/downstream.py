"""Downstream text classifiers: hashed TF-IDF and weighted logistic regression in Spark ML."""

from __future__ import annotations

import functools

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votelake.functions import text as tx
from votelake.operators.labelmodel import agreement
from votelake.operators.metrics import confusion, macro_f1


def confident_rows(labels: DataFrame, votes: DataFrame, min_depth: int = 1, min_agreement: float = 0.0, weighting: bool = True) -> DataFrame:
    """Rows with a label, enough votes and agreement, weighted by agreement * log2(1 + depth)."""
    a = agreement(votes)
    rows = labels.filter("label >= 0").join(a, "id").filter((F.col("depth") >= min_depth) & (F.col("agreement") >= min_agreement))
    weight = F.col("agreement") * F.log2(1 + F.col("depth").cast("double")) if weighting else F.lit(1.0)
    return rows.select("id", "label", weight.alias("weight"))


def soft_rows(examples: DataFrame, soft: DataFrame, hard: DataFrame, n_classes: int) -> DataFrame:
    """(id, class, p): soft labels by id, one-hot of the hard label where there is none; padded with 1e-6, renormalised."""
    met = examples.select("id").join(soft.select("id", "proba"), "id", "left").join(hard.select("id", "label"), "id", "left")
    p = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: F.when(F.col("proba").isNotNull(), F.coalesce(F.get("proba", c), F.lit(1e-6))).otherwise((c == F.col("label")).cast("double")))
    rows = met.filter("proba is not null or label >= 0").withColumn("p", p).withColumn("z", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
    return rows.select("id", F.posexplode(F.transform("p", lambda x: x / F.col("z"))).alias("class", "p"))


def with_tokens(examples: DataFrame) -> DataFrame:
    return examples.withColumn("tokens", tx.tokens(F.col("text")))


def with_tf(examples: DataFrame, n_features: int = 1 << 16) -> DataFrame:
    """tf: hashed term counts, for tables that several fits and predictions read."""
    return HashingTF(inputCol="tokens", outputCol="tf", numFeatures=n_features).transform(with_tokens(examples)).drop("tokens")


def train(rows: DataFrame, n_features: int = 1 << 16, iterations: int = 30, reg: float = 1e-4) -> PipelineModel:
    """rows(tokens or tf, label, weight); soft labels come as one row a class with its probability as weight."""
    lr = LogisticRegression(labelCol="y", weightCol="weight", featuresCol="features", maxIter=iterations, regParam=reg, family="multinomial")
    hashing = [] if "tf" in rows.columns else [HashingTF(inputCol="tokens", outputCol="tf", numFeatures=n_features)]
    return Pipeline(stages=[*hashing, IDF(inputCol="tf", outputCol="features"), lr]).fit(rows.withColumn("y", F.col("label").cast("double")).withColumn("weight", F.col("weight").cast("double")))


def predict(model: PipelineModel, examples: DataFrame) -> DataFrame:
    """id, split, label, proba; ``examples`` have tf if the model was fitted on it, else text."""
    out = model.transform(examples if "tf" in examples.columns else with_tokens(examples))
    return out.select("id", "split", F.col("prediction").cast("int").alias("label"), vector_to_array("probability").alias("proba"))


def clean_then_noisy(noisy: DataFrame, clean: DataFrame, clean_weight: float = 5.0) -> DataFrame:
    """Two-stage fine-tuning as one weighted fit: Spark's regression has no warm start in Python, so clean rows weigh more."""
    only = noisy.join(clean.select("id"), "id", "left_anti")
    return only.unionByName(clean.withColumn("weight", F.col("weight") * clean_weight))


def self_train(examples: DataFrame, seed_rows: DataFrame, rounds: int = 2, confidence: float = 0.9) -> DataFrame:
    """Refits on its own confident predictions; seed rows keep their labels.  Returns final predictions."""
    # seed labels are put beside the texts' counts once; predictions are columns of the same rows, so no round joins or reads texts
    seed = seed_rows.select("id", F.col("label").alias("__label"), F.col("weight").alias("__weight"))
    held = with_tf(examples.select("id", "split", "text")).select("id", "split", "tf").join(seed, "id", "left").cache()
    rows, model = held.filter("__label is not null").select("tf", F.col("__label").alias("label"), F.col("__weight").alias("weight")), None
    for _ in range(rounds + 1):
        model = train(rows)
        out = model.transform(held).withColumn("__p", F.array_max(vector_to_array("probability"))).drop("features")
        mine = F.col("__label").isNotNull()
        rows = out.filter(mine | (F.col("__p") >= confidence)).select("tf", F.when(mine, F.col("__label")).otherwise(F.col("prediction").cast("int")).alias("label"), F.when(mine, F.col("__weight")).otherwise(F.col("__p")).alias("weight"))
    return predict(model, held)


def efficiency_grid(examples: DataFrame, weak: DataFrame, n_classes: int, sizes: tuple[int, ...] = (50, 200)) -> DataFrame:
    """Macro F1 on test of: gold of N rows, weak labels, both by size, and all gold."""
    from votelake.operators.sampling import stratified_proportional

    gold = examples.filter("split = 'train' and gold is not null").select("id", F.col("gold").alias("label"), F.lit(1.0).alias("weight"))
    runs: dict[str, DataFrame] = {"weak": weak, "oracle": gold}
    for n in sizes:
        part = stratified_proportional(gold, n, label="label")
        runs[f"golden_{n}"] = part.select("id", "label", "weight")
        runs[f"both_{n}"] = clean_then_noisy(weak, part.select("id", "label", "weight"))
    # labels and weights of all runs beside the texts' counts, put there once
    tagged = functools.reduce(DataFrame.unionByName, [rows.select("id", F.lit(name).alias("run"), F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight")) for name, rows in runs.items()])
    marks = tagged.groupBy("id").agg(*[F.max(F.when(F.col("run") == name, F.struct("label", "weight"))).alias(f"__{name}") for name in runs])
    used = examples.select("id", "split", "gold", "text").join(marks, "id", "left").filter("split = 'test' or " + " or ".join(f"__{name} is not null" for name in runs))
    held = with_tf(used).drop("text").cache()
    test, out = held.filter("split = 'test'").select("id", "split", "gold", "tf"), None
    for name in runs:
        labels = predict(train(held.filter(F.col(f"__{name}").isNotNull()).select("tf", f"__{name}.label", f"__{name}.weight")), test)
        row = macro_f1(confusion(test, labels), n_classes).select(F.lit(name).alias("run"), "macro_f1")
        out = row if out is None else out.unionByName(row)
    return out


def multilabel_train_predict(examples: DataFrame, sets: DataFrame, n_classes: int) -> DataFrame:
    """One classifier a class on label sets(id, labels); labels with probability of at least one half."""
    tokens = with_tokens(examples).select("id", "split", "tokens").cache()
    out = tokens.select("id", "split")
    for c in range(n_classes):
        y = sets.select("id", F.array_contains("labels", F.lit(c)).cast("int").alias("label"), F.lit(1.0).alias("weight")).join(tokens, "id")
        if y.select("label").distinct().count() < 2:
            out = out.withColumn(f"p{c}", F.lit(0.0))
            continue
        p = train(y).transform(tokens).select("id", F.get(vector_to_array("probability"), F.lit(1)).alias(f"p{c}"))
        out = out.join(p, "id")
    chosen = F.filter(F.array(*[F.when(F.col(f"p{c}") >= 0.5, F.lit(c)) for c in range(n_classes)]), lambda x: x.isNotNull())
    return out.select("id", "split", chosen.alias("labels"))
