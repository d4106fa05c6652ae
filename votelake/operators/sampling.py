"""Sampling and splitting by an arithmetic or 64-bit hash order; deterministic under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_hash(id_: Column, seed: int = 42) -> Column:
    """A linear congruential step on a bigint id, the same in any SQL engine."""
    return F.pmod(F.pmod(id_, F.lit(1 << 31)) * F.lit(1103515245) + F.lit(12345 + seed), F.lit(1 << 31))


def uniform(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement."""
    return df.withColumn("__h", order_hash(F.col("id"), seed)).orderBy("__h", "id").limit(n).drop("__h")


def per_class(df: DataFrame, n: int, label: str = "gold", seed: int = 42) -> DataFrame:
    """Up to n rows of each class (a window-group limit prunes before the shuffle)."""
    w = Window.partitionBy(label).orderBy("__h", "id")
    return df.withColumn("__h", order_hash(F.col("id"), seed)).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__h", "__n")


RANGES = 1024


def with_rank(df: DataFrame, label: str | None, seed: int = 42) -> DataFrame:
    """__h, and __n: the row's rank from 1 in hash order (ties by id) in its class, or in all rows.

    The hash's range is cut into equal parts and ranks are counted within a
    part; what lies before a part comes from the parts' counts, so no class is
    ordered by one task.
    """
    h = df.withColumn("__h", order_hash(F.col("id"), seed)).withColumn("__g", F.coalesce(F.floor(F.col("__h") / F.lit((1 << 31) // RANGES)).cast("int"), F.lit(-1))).withColumn("__l", F.col(label) if label else F.lit(0))
    sizes = h.groupBy("__l", "__g").agg(F.count(F.lit(1)).alias("__m"))
    before = sizes.select(F.col("__l").alias("__l2"), F.col("__g").alias("__g2"), (F.sum("__m").over(Window.partitionBy("__l").orderBy("__g")) - F.col("__m")).alias("__b"))
    inside = h.withColumn("__n", F.row_number().over(Window.partitionBy("__l", "__g").orderBy("__h", "id")))
    met = inside.join(before, F.col("__l").eqNullSafe(F.col("__l2")) & (F.col("__g") == F.col("__g2")))
    return met.withColumn("__n", F.col("__n") + F.col("__b")).drop("__g", "__l", "__l2", "__g2", "__b")


def stratified_equal(df: DataFrame, n: int, n_classes: int, label: str = "gold", seed: int = 42) -> DataFrame:
    """n // n_classes rows of each class, the rest of n from what is left."""
    quota = n // n_classes
    ranked = with_rank(df, label, seed)
    return ranked.withColumn("__f", (F.col("__n") > quota).cast("int")).orderBy("__f", "__h", "id").limit(n).drop("__h", "__n", "__f")


def stratified_clean(df: DataFrame, n: int, n_classes: int, label: str = "gold", seed: int = 42) -> DataFrame:
    """max(n // n_classes, 1) rows of each class, cut to n in hash order; rows without a class are left out."""
    few = per_class(df.filter(F.col(label).isNotNull()), max(n // n_classes, 1), label, seed)
    return uniform(few, n, seed)


def stratified_proportional(df: DataFrame, n: int, label: str = "gold", seed: int = 42) -> DataFrame:
    """max(1, round-half-even(share * n)) of each class, then filled or trimmed to n."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    sizes = sizes.withColumn("__q", F.greatest(F.lit(1), F.bround(F.col("__c").cast("double") / F.sum("__c").over(Window.partitionBy()) * n).cast("long")))
    ranked = with_rank(df, label, seed).join(F.broadcast(sizes), label)
    return ranked.withColumn("__f", (F.col("__n") > F.col("__q")).cast("int")).orderBy("__f", "__h", "id").limit(n).drop("__h", "__n", "__f", "__c", "__q")


def exact_split(df: DataFrame, shares: tuple[float, float] = (0.8, 0.1), val_cap: int | None = None, seed: int = 42) -> DataFrame:
    """train/val/test by exact rank in hash order: the first floor(share * n) rows, the next, the rest; ``val_cap`` keeps the first of val."""
    n = df.agg(F.count(F.lit(1)).alias("__t")).withColumn("__k", F.lit(1))
    # one row
    ranked = with_rank(df, None, seed).withColumn("__k", F.lit(1)).join(F.broadcast(n), "__k")
    one, two = F.floor(F.lit(shares[0]) * F.col("__t")), F.floor(F.lit(shares[0]) * F.col("__t")) + F.floor(F.lit(shares[1]) * F.col("__t"))
    out = ranked.withColumn("split", F.when(F.col("__n") <= one, "train").when(F.col("__n") <= two, "val").otherwise("test"))
    if val_cap is not None:
        out = out.filter((F.col("split") != "val") | (F.col("__n") <= one + val_cap))
    return out.drop("__h", "__n", "__k", "__t")


def rank_split(df: DataFrame, shares: tuple[float, float] = (0.8, 0.1), val_cap: int | None = None, seed: int = 42) -> DataFrame:
    """train/val/test by the hash's position in its range, so no global sort is needed.

    ``val_cap`` keeps the first rows of val in hash order (a top-k).
    """
    h = order_hash(F.col("id"), seed)
    at = h.cast("double") / float(1 << 31)
    out = df.withColumn("split", F.when(at < shares[0], "train").when(at < shares[0] + shares[1], "val").otherwise("test"))
    if val_cap is None:
        return out
    val = out.filter("split = 'val'").orderBy(order_hash(F.col("id"), seed), "id").limit(val_cap)
    return out.filter("split <> 'val'").unionByName(val)


def first_n(df: DataFrame, n: int, order: str = "original_idx") -> DataFrame:
    return df.orderBy(order).limit(n)


def k_folds(df: DataFrame, most: int = 5, label: str = "gold", n_classes: int | None = None, seed: int = 42) -> DataFrame:
    """Stratified folds: min(most, max(2, least class count)); a class id missing below the highest counts 0."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    top = n_classes - 1 if n_classes else None
    stat = sizes.agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("seen"), F.max(label).alias("top"))
    missing = F.col("seen") < (F.lit(top) if top is not None else F.col("top")) + 1
    folds = stat.select(F.least(F.lit(most), F.greatest(F.lit(2), F.when(missing, 0).otherwise(F.col("least")))).alias("folds"))
    # one row
    ranked = with_rank(df, label, seed).withColumn("__k", F.lit(1)).join(F.broadcast(folds.withColumn("__k", F.lit(1))), "__k")
    return ranked.withColumn("fold", ((F.col("__n") - 1) % F.col("folds")).cast("int")).drop("__h", "__n", "__k")
