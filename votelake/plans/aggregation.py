"""Aggregation by name: majority vote, or the regression on votes with embeddings where a cache has them."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votelake.operators import aggregate as ag
from votelake.operators import labelmodel as lm
from votelake.operators.similarity import embedding_lookup
from votelake.sources.readers import exists

METHODS = ("mv", "model")


def joined_features(examples: DataFrame, votes: DataFrame, pool: list[str], n_classes: int, embeddings: DataFrame | None = None, dim: int = 0) -> DataFrame:
    """features: the embedding (zeros where an id has none), then the one-hot votes; votes only without embeddings."""
    hot = lm.one_hot(examples, votes, pool, n_classes)
    if embeddings is None or dim == 0:
        return hot
    return lm.stack(embedding_lookup(hot.withColumnRenamed("features", "hot"), embeddings, dim), ["emb", "hot"]).drop("emb", "hot")


def normalized(embeddings: DataFrame) -> DataFrame:
    """Embeddings of length 1; zero vectors stay."""
    from votelake.functions.text import dot

    emb = F.col("emb").cast("array<double>")
    # the norm is bound once by an array of one element
    scaled = F.get(F.transform(F.array(F.sqrt(dot(emb, emb))), lambda n: F.transform(emb, lambda x: F.when(n > 0, x / n).otherwise(x))), F.lit(0))
    return embeddings.withColumn("emb", scaled)


def text_aware(examples: DataFrame, votes: DataFrame, pool: list[str], n_classes: int, embeddings: DataFrame, dim: int, grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), folds: int = 5) -> DataFrame:
    """Probabilities from embeddings of length 1 beside dense vote features; val rows by folds that did not see them."""
    val = examples.filter("split = 'val'")
    dense = lm.dense_features(examples, votes, lm.annotator_precision(val, votes), n_classes, len(pool))
    rows = lm.stack(embedding_lookup(dense, normalized(embeddings), dim), ["emb", "dense"])
    return lm.text_vote_regression(rows.select("id", "split", "gold", "features").cache(), n_classes, grid, folds)


def aggregate(examples: DataFrame, votes: DataFrame, pool: list[str], n_classes: int, method: str = "model", multi_label: bool = False, cache: str | None = None, dim: int = 0, folds: int = 5, grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)) -> DataFrame:
    """(id, split, label), or labels for label sets, by the named method.

    ``cache`` is the path of an embedding table (id, emb); where it is missing
    the model runs on votes only and a warning says so.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(METHODS)}")
    if method == "mv":
        return ag.label_sets(examples, votes) if multi_label else ag.majority(examples, votes).select("id", "split", "label")
    embeddings = None
    if cache is not None:
        if exists(examples.sparkSession, cache):
            embeddings = examples.sparkSession.read.parquet(cache)
        else:
            warnings.warn(f"no embeddings at {cache}; votes only", stacklevel=2)
    gold = "labels" if multi_label else "gold"
    rows = joined_features(examples.select("id", "split", gold), votes, pool, n_classes, embeddings, dim).cache()
    if multi_label:
        return lm.decide(lm.multilabel_regression(rows, n_classes), multi_label=True).select("id", "split", "labels")
    return lm.decide(lm.text_vote_regression(rows, n_classes, grid, folds)).select("id", "split", "label")
