"""Label models over votes: naive Bayes and temperature in SQL, regressions and ensembles in Spark ML."""

from __future__ import annotations

import functools
import itertools
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votelake.functions.text import argmax
from votelake.operators.metrics import confusion, macro_f1, ratio, tally

TEMPERATURES = (0.5, 0.7, 0.85, 1.0, 1.15, 1.3, 1.5, 2.0, 3.0)


# ------------------------------------------------------------------- features


def one_hot(examples: DataFrame, votes: DataFrame, pool: list[str], n_classes: int, abstain_slot: bool = False) -> DataFrame:
    """features: sparse one-hot votes at lf_index * width + slot; rows without votes are zero (or all abstain).

    Votes are words of a fixed vocabulary, so a row costs what it has votes;
    with ``abstain_slot`` the words of abstains are those of the pool that did not vote.
    """
    slots = range(-1, n_classes) if abstain_slot else range(n_classes)
    names = sorted(pool)
    words = [f"{n}={v}" for n in names for v in slots]
    cast = votes.filter((F.col("vote") < n_classes) & F.col("lf").isin(names))
    fired = cast.groupBy("id").agg(F.collect_set(F.concat_ws("=", "lf", F.col("vote").cast("string"))).alias("__w"), F.collect_set("lf").alias("__lf"))
    none = F.array().cast("array<string>")
    rows = examples.join(fired, "id", "left").withColumn("__w", F.coalesce("__w", none))
    if abstain_slot:
        silent = F.array_except(F.array(*[F.lit(n) for n in names]), F.coalesce("__lf", none))
        rows = rows.withColumn("__w", F.concat("__w", F.transform(silent, lambda n: F.concat(n, F.lit("=-1")))))
    model = CountVectorizerModel.from_vocabulary(words, inputCol="__w", outputCol="features", minTF=1.0)
    return model.setBinary(True).transform(rows).drop("__w", "__lf")


def annotator_precision(examples: DataFrame, votes: DataFrame) -> DataFrame:
    """precision(lf, precision) on rows with gold."""
    met = votes.join(examples.filter("gold is not null").select("id", "gold"), "id")
    return met.groupBy("lf").agg((F.count_if(F.col("vote") == F.col("gold")).cast("double") / F.count(F.lit(1))).alias("precision"))


def dense_features(examples: DataFrame, votes: DataFrame, precision: DataFrame, n_classes: int, n_lfs: int) -> DataFrame:
    """dense: counts by class, precision mass by class, abstain rate, vote entropy."""
    v = votes.filter(F.col("vote") < n_classes).join(F.broadcast(precision), "lf", "left")
    aggs = [F.count_if(F.col("vote") == c).cast("double").alias(f"c{c}") for c in range(n_classes)]
    aggs += [F.sum(F.when(F.col("vote") == c, F.coalesce("precision", F.lit(0.0))).otherwise(0.0)).alias(f"p{c}") for c in range(n_classes)]
    names = [f"c{c}" for c in range(n_classes)] + [f"p{c}" for c in range(n_classes)]
    rows = examples.join(v.groupBy("id").agg(*aggs), "id", "left").fillna(0.0, names)
    total = sum((F.col(f"c{c}") for c in range(n_classes)), F.lit(0.0))
    entropy = F.lit(0.0)
    for c in range(n_classes):
        p = F.col(f"c{c}") / F.greatest(total, F.lit(1.0))
        entropy = entropy - F.when(p > 0, p * F.ln(p)).otherwise(0.0)
    return rows.withColumn("dense", F.array(*[F.col(n) for n in names], 1 - total / float(n_lfs), entropy)).drop(*names)


def stack(rows: DataFrame, parts: list[str]) -> DataFrame:
    """features from several vector or array columns."""
    for p in parts:
        if dict(rows.dtypes)[p].startswith("array"):
            rows = rows.withColumn(p, array_to_vector(F.col(p).cast("array<double>")))
    return VectorAssembler(inputCols=parts, outputCol="__f").transform(rows.withColumnRenamed("features", "__in") if "features" in rows.columns and "features" not in parts else rows).drop("features").withColumnRenamed("__f", "features")


# ------------------------------------------------------- naive Bayes, in SQL


def naive_bayes(examples: DataFrame, votes: DataFrame, pool: list[str], n_classes: int, fit_split: str = "val", eps: float = 1.0) -> DataFrame:
    """(id, class, p): P(vote or abstain | class, annotator) counted on one split with +eps, log posterior for all rows.

    The count table has pool x (classes + 1) x classes rows at most and is
    broadcast.  Abstains enter as a base sum a class, so only cast votes are
    joined to rows: score = prior + sum(abstain) + sum over votes (vote - abstain).
    """
    spark = examples.sparkSession
    if len(pool) * (n_classes + 1) * n_classes > 2_000_000:
        raise ValueError("pool too large for a broadcast count table")
    gold = examples.filter((F.col("split") == fit_split) & F.col("gold").between(0, n_classes - 1)).select("id", "gold")
    per_class = spark.range(n_classes).select(F.col("id").cast("int").alias("class")).join(gold.groupBy(F.col("gold").alias("class")).agg(F.count(F.lit(1)).alias("n")), "class", "left").fillna(0, ["n"])
    prior = per_class.withColumn("log_prior", F.ln((F.col("n") + 1) / F.sum(F.col("n") + 1).over(Window.partitionBy())))
    cast = votes.filter(F.col("vote").between(0, n_classes - 1)).join(gold, "id").groupBy("lf", "vote", F.col("gold").alias("class")).agg(F.count(F.lit(1)).alias("k"))
    lfs = spark.createDataFrame([(n,) for n in sorted(pool)], "lf string")
    grid = lfs.select("lf", F.explode(F.sequence(F.lit(-1), F.lit(n_classes - 1))).alias("vote")).select("lf", "vote", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("class"))
    fired = cast.groupBy("lf", "class").agg(F.sum("k").alias("fired"))
    filled = grid.join(cast, ["lf", "vote", "class"], "left").join(fired, ["lf", "class"], "left").join(prior.select("class", "n"), "class").fillna(0, ["k", "fired"])
    count = F.when(F.col("vote") < 0, F.col("n") - F.col("fired")).otherwise(F.col("k")) + eps
    table = filled.select("lf", "vote", "class", F.ln(count / (F.col("n") + eps * (n_classes + 1))).alias("lp"))
    silent = table.filter("vote < 0").select("lf", "class", F.col("lp").alias("lp0"))
    base = silent.groupBy("class").agg(F.sum("lp0").alias("b")).join(prior.select("class", "log_prior"), "class").select("class", (F.col("b") + F.col("log_prior")).alias("base"))
    delta = table.filter("vote >= 0").join(silent, ["lf", "class"]).select("lf", "vote", "class", (F.col("lp") - F.col("lp0")).alias("d"))
    moved = votes.join(F.broadcast(delta), ["lf", "vote"]).groupBy("id", "class").agg(F.sum("d").alias("d"))
    rows = examples.select("id", "split", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("class")).join(F.broadcast(base), "class").join(moved, ["id", "class"], "left")
    scored = rows.withColumn("s", F.col("base") + F.coalesce("d", F.lit(0.0)))
    w = Window.partitionBy("id")
    e = scored.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return e.select("id", "split", "class", (F.col("e") / F.sum("e").over(w)).alias("p"))


def temperature(proba: DataFrame, examples: DataFrame, fit_split: str = "val", grid: tuple[float, ...] = TEMPERATURES) -> tuple[DataFrame, DataFrame]:
    """(best temperature, rescaled (id, split, class, p)); chosen by log loss on a split, the first of equals.

    All temperatures are tried in one pass: a row carries its probabilities in
    an array and the losses are summed side by side.
    """
    wide = proba.groupBy("id", "split").agg(F.array_sort(F.collect_list(F.struct("class", F.ln(F.greatest(F.least("p", F.lit(1.0)), F.lit(1e-12))).alias("l")))).alias("x"))
    gold = wide.join(examples.filter((F.col("split") == fit_split) & F.col("gold").isNotNull()).select("id", "gold"), "id")

    def loss(t: float):  # noqa: ANN202
        e = F.transform("x", lambda v: F.exp(v["l"] / t))
        z = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
        mine = F.get(e, F.col("gold")) / z
        return -F.ln(F.greatest(F.least(mine, F.lit(1.0)), F.lit(1e-12)))

    sums = gold.agg(*[F.sum(loss(t)).alias(f"t{i}") for i, t in enumerate(grid)])
    entries = F.array(*[F.struct(F.col(f"t{i}").alias("nll"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(grid)])
    best = sums.select(F.array_min(entries)["t"].alias("temperature"), F.array_min(entries)["nll"].alias("nll"))
    one = wide.withColumn("__k", F.lit(1)).join(F.broadcast(best.withColumn("__k", F.lit(1))), "__k")
    e = one.withColumn("e", F.transform("x", lambda v: F.struct(v["class"].alias("class"), F.exp(v["l"] / F.col("temperature")).alias("v")))).withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, b: a + b["v"]))
    scaled = e.select("id", "split", "z", F.explode("e").alias("r")).select("id", "split", "r.class", (F.col("r.v") / F.col("z")).alias("p"))
    return best, scaled


# ---------------------------------------------------------------- regressions

#: Fits that run at a time; each is a sequence of short jobs, so the cluster is idle between them.
AT_ONCE = 8
#: Distinct rows in a partition of what a fit passes over again and again.
PACKED = 50_000


def _side_by_side(f, items: list) -> list:  # noqa: ANN001
    """f of each item, several at a time, in order; each call starts Spark jobs of its own."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(f, items))


def cut(df: DataFrame) -> DataFrame:
    """The same rows as a plan without a past: each of the many plans on top would else be analysed down to the files.

    Lost parts are still worked again, from the lineage of the RDD.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), spark)


def shapes(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal features and keys as one, with their number n, held in few partitions.

    A fit weighted by n is the fit of the rows.  Votes of a pool have few
    patterns, so its passes stay short at any number of rows.
    """
    met = rows.groupBy("features", *keys).agg(F.count(F.lit(1)).alias("n")).cache()
    return cut(met.coalesce(max(1, -(-met.count() // PACKED)))).cache()


def _weighted(rows: DataFrame, label: str, n_classes: int, balanced: bool) -> tuple[DataFrame, float, list[int]]:
    """Balanced weights n / (k * n_c), their sum, and the classes present; a row with a column n stands for n rows."""
    many = F.col("n") if "n" in rows.columns else F.lit(1)
    sizes = {r[label]: r["k"] for r in rows.groupBy(label).agg(F.sum(many).alias("k")).collect()}  # one row a class
    n = sum(sizes.values())
    pairs = [(F.lit(int(c)), F.lit(n / (len(sizes) * k) if balanced else 1.0)) for c, k in sizes.items()]
    table = F.create_map(*itertools.chain.from_iterable(pairs)) if pairs else F.create_map().cast("map<int,double>")
    return rows.withColumn("weight", F.element_at(table, F.col(label).cast("int")) * many), float(n), sorted(int(c) for c in sizes)


def fit_logistic(rows: DataFrame, n_classes: int, c: float = 1.0, l1: float = 0.0, label: str = "gold", balanced: bool = True, iterations: int = 50):  # noqa: ANN201
    """Multinomial regression; regParam 1/(c * sum of weights) turns a summed loss into Spark's mean."""
    weighted, total, present = _weighted(rows, label, n_classes, balanced)
    lr = LogisticRegression(family="multinomial" if n_classes > 2 else "auto", labelCol=label, featuresCol="features", weightCol="weight", standardization=False, elasticNetParam=l1, regParam=1.0 / (c * max(total, 1.0)), maxIter=iterations)
    return lr.fit(weighted.withColumn(label, F.col(label).cast("double")))


def _with_proba(model, rows: DataFrame, n_classes: int, name: str = "proba") -> DataFrame:  # noqa: ANN001
    """``name``: probabilities as an array over the whole class list (padded with 0)."""
    out = model.transform(rows).withColumn("__p", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")
    padded = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: F.coalesce(F.get("__p", i), F.lit(0.0)))
    return out.withColumn(name, padded).drop("__p")


def predict(model, rows: DataFrame, n_classes: int, keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: ANN001
    """id, split, proba as array over the whole class list (padded with 0)."""
    return _with_proba(model, rows, n_classes).select("id", "split", *keep, "proba")


def text_vote_regression(rows: DataFrame, n_classes: int, grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), folds: int = 5, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """Main aggregator: fitted on val; val rows are predicted by folds that did not see them.

    ``rows`` has id, split, gold, features.  C is chosen by macro F1 over the
    folds.  Returns id, split, proba and the columns ``keep`` for every row.
    """
    from votelake.operators.sampling import k_folds

    val = rows.filter("split = 'val' and gold is not null")
    held = cut(k_folds(val, folds, n_classes=n_classes, seed=seed)).cache()
    few = shapes(held, "gold", "fold")
    k = held.agg(F.max("folds")).first()[0] or 2
    enough = held.count() >= 2 * k
    best_c, best_f1, best_out = 1.0, -1.0, None
    jobs = [(c, f) for c in grid for f in range(k)] if enough else []
    models = dict(zip(jobs, _side_by_side(lambda j: fit_logistic(few.filter(F.col("fold") != j[1]), n_classes, j[0]), jobs), strict=True))
    if enough:
        # the values of C side by side, each under its number as the split
        parts = [_with_proba(models[c, f], few.filter(F.col("fold") == f), n_classes).select(F.lit(str(i)).alias("split"), "gold", argmax(F.col("proba")).alias("label"), "n") for i, c in enumerate(grid) for f in range(k)]
        scores = {r["split"]: r["macro_f1"] for r in macro_f1(tally(functools.reduce(DataFrame.unionByName, parts)), n_classes).collect()}  # one row a value
        for i, c in enumerate(grid):
            f1 = scores.get(str(i))
            if f1 is not None and f1 > best_f1 + 1e-12:
                best_c, best_f1 = c, f1
                best_out = functools.reduce(DataFrame.unionByName, [predict(models[c, f], held.filter(F.col("fold") == f), n_classes, keep) for f in range(k)])
    final = fit_logistic(few, n_classes, best_c)
    rest = rows.filter("split <> 'val' or gold is null") if best_out is not None else rows
    result = predict(final, rest, n_classes, keep)
    return result.unionByName(best_out) if best_out is not None else result


def multilabel_regression(rows: DataFrame, n_classes: int) -> DataFrame:
    """One balanced binary regression a class on val; a class with under 2 positives or negatives gets its base rate.  ``labels`` holds gold sets."""
    val = shapes(rows.filter("split = 'val'"), "labels")
    stat = val.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(F.when(F.array_contains("labels", F.lit(c)), F.col("n"))), F.lit(0)).alias(f"k{c}") for c in range(n_classes)]).first()
    out = rows
    for c in range(n_classes):
        pos, n = stat[f"k{c}"], stat["n"]
        if pos < 2 or n - pos < 2:
            out = out.withColumn(f"p{c}", F.lit(pos / n if n else 0.0))
            continue
        y = val.withColumn("gold", F.array_contains("labels", F.lit(c)).cast("int"))
        model = fit_logistic(y, 2, 1.0)
        for name, column in (("probabilityCol", f"v{c}"), ("predictionCol", f"d{c}"), ("rawPredictionCol", f"r{c}")):
            model._set(**{name: column})
        out = model.transform(out).withColumn(f"p{c}", F.get(vector_to_array(f"v{c}"), F.lit(1))).drop(f"v{c}", f"d{c}", f"r{c}")
    return out.select("id", "split", F.array(*[F.col(f"p{c}") for c in range(n_classes)]).alias("proba"))


def _fit_each(val: DataFrame, n_classes: int, make) -> list:  # noqa: ANN001
    """A binary model a class fitted on shapes(features, gold, n); None for a class that all rows or none have."""

    def fit(c: int):  # noqa: ANN202
        y = val.withColumn("y", (F.col("gold") == c).cast("double"))
        return make(c).setWeightCol("n").fit(y) if y.select("y").distinct().count() == 2 else None

    return _side_by_side(fit, list(range(n_classes)))


def _apply_each(models: list, rows: DataFrame, n_classes: int, name: str = "proba") -> DataFrame:
    """``name``: probabilities of the models of all classes, normalised over classes."""
    out = rows
    for c, model in enumerate(models):
        if model is None:
            out = out.withColumn(f"p{c}", F.lit(0.0))
            continue
        out = model.transform(out).withColumn(f"p{c}", F.get(vector_to_array("probability"), F.lit(1))).drop("probability", "prediction", "rawPrediction")
    total = sum((F.col(f"p{c}") for c in range(n_classes)), F.lit(0.0))
    return out.withColumn(name, F.array(*[F.when(total > 0, F.col(f"p{c}") / total).otherwise(1.0 / n_classes) for c in range(n_classes)])).drop(*[f"p{c}" for c in range(n_classes)])


def _val(rows: DataFrame) -> DataFrame:
    return shapes(rows.filter("split = 'val' and gold is not null"), "gold")


def _regressions(val: DataFrame, n_classes: int, c: float = 1.0) -> list:
    n = max(1, val.agg(F.sum("n")).first()[0] or 0)
    return _fit_each(val, n_classes, lambda k: LogisticRegression(labelCol="y", standardization=False, regParam=1.0 / (c * n)))


def _trees(val: DataFrame, n_classes: int, rounds: int, depth: int, rate: float = 0.1, seed: int = 42) -> list:
    return _fit_each(val, n_classes, lambda k: GBTClassifier(labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed))


def one_vs_rest(rows: DataFrame, n_classes: int, c: float = 1.0) -> DataFrame:
    return _apply_each(_regressions(_val(rows), n_classes, c), rows, n_classes).select("id", "split", "proba")


def boosted(rows: DataFrame, n_classes: int, rounds: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 42) -> DataFrame:
    return _apply_each(_trees(_val(rows), n_classes, rounds, depth, rate, seed), rows, n_classes).select("id", "split", "proba")


def average(parts: list[DataFrame]) -> DataFrame:
    """Mean of probability arrays by id."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    long = union.select("id", "split", F.posexplode("proba").alias("class", "p")).groupBy("id", "split", "class").agg((F.sum("p") / len(parts)).alias("p"))
    return long.groupBy("id", "split").agg(F.array_sort(F.collect_list(F.struct("class", "p"))).alias("x")).select("id", "split", F.transform("x", lambda v: v["p"]).alias("proba"))


def ensemble(rows: DataFrame, n_classes: int, rounds: int = 20, grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), folds: int = 5, seed: int = 42) -> DataFrame:
    """Mean of a cross-validated regression, boosted trees and an L1 regression."""
    val = _val(rows)
    l1, trees = _side_by_side(lambda f: f(), [lambda: fit_logistic(val, n_classes, 0.1, l1=1.0), lambda: _trees(val, n_classes, rounds, 4, seed=seed)])
    # the others' probabilities ride along as columns, so nothing is joined by id
    both = _apply_each(trees, _with_proba(l1, rows, n_classes, "__l1"), n_classes, "__trees")
    met = text_vote_regression(both, n_classes, grid, folds, seed, keep=("__l1", "__trees"))
    mean = F.transform(F.arrays_zip(F.col("proba").alias("a"), F.col("__trees").alias("b"), F.col("__l1").alias("c")), lambda z: (z["a"] + z["b"] + z["c"]) / 3)
    return met.select("id", "split", mean.alias("proba"))


def stacking(rows: DataFrame, n_classes: int, folds: int = 3, rounds: int = 10, seed: int = 42) -> DataFrame:
    """Out-of-fold probabilities of three base models into a regression."""
    from votelake.operators.sampling import k_folds

    def fitted(val: DataFrame) -> list:
        bases = (lambda: _regressions(val, n_classes), lambda: _trees(val, n_classes, rounds, 3, seed=seed), lambda: fit_logistic(val, n_classes, 0.1, l1=1.0))
        return _side_by_side(lambda f: f(), list(bases))

    def features(models: list, r: DataFrame) -> DataFrame:
        out = _with_proba(models[2], _apply_each(models[1], _apply_each(models[0], r, n_classes, "b0"), n_classes, "b1"), n_classes, "b2")
        return out.withColumn("features", array_to_vector(F.concat("b0", "b1", "b2"))).drop("b0", "b1", "b2")

    held = cut(k_folds(rows.filter("split = 'val' and gold is not null"), folds, n_classes=n_classes, seed=seed)).cache()
    few = shapes(held, "gold", "fold")
    k = held.agg(F.max("folds")).first()[0] or 2
    models = _side_by_side(fitted, [few.filter(F.col("fold") != f) for f in range(k)] + [few])
    base = functools.reduce(DataFrame.unionByName, [features(models[f], few.filter(F.col("fold") == f)) for f in range(k)]).cache()
    model = fit_logistic(base.coalesce(max(1, few.rdd.getNumPartitions())), n_classes, 1.0)
    return predict(model, features(models[k], rows), n_classes)


def cluster_annotators(votes: DataFrame, pool: list[str], precision: DataFrame, n_rows: int, n_clusters: int = 50) -> list[str]:
    """Average-linkage clusters by Hamming distance of votes; the most precise of each cluster is kept.

    Distances are counted in Spark from vote patterns; the linkage runs on the
    pool x pool matrix (at most 2000 annotators).  A pool that is no larger
    than ``n_clusters`` is kept whole.
    """
    names = sorted(pool)
    if len(names) <= n_clusters:
        return names
    if len(names) > 2000:
        raise ValueError("at most 2000 annotators")
    patterns = votes.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("lf", "vote"))).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    x = patterns.select("n", F.explode("s").alias("a"), "s").select("n", "a", F.explode("s").alias("b")).filter("a.lf < b.lf")
    both = {(r["a"], r["b"]): (r["both"], r["same"]) for r in x.groupBy(F.col("a.lf").alias("a"), F.col("b.lf").alias("b")).agg(F.sum("n").alias("both"), F.sum(F.when(F.col("a.vote") == F.col("b.vote"), F.col("n")).otherwise(0)).alias("same")).collect()}
    fires = {r["lf"]: r["n"] for r in votes.groupBy("lf").agg(F.count(F.lit(1)).alias("n")).collect()}
    prec = {r["lf"]: r["precision"] or 0.0 for r in precision.collect()}

    def distance(a: str, b: str) -> float:
        n, same = both.get((min(a, b), max(a, b)), (0, 0))
        return (fires.get(a, 0) + fires.get(b, 0) - n - same) / max(1, n_rows)

    groups = [[n] for n in names]
    gap = {(i, j): distance(names[i], names[j]) for i, j in itertools.combinations(range(len(names)), 2)}
    alive = set(range(len(names)))
    while len(alive) > n_clusters:
        i, j = min((k for k in gap if k[0] in alive and k[1] in alive), key=lambda k: (gap[k], k))
        for k in alive - {i, j}:
            a, b = (min(i, k), max(i, k)), (min(j, k), max(j, k))
            gap[a] = (gap[a] * len(groups[i]) + gap[b] * len(groups[j])) / (len(groups[i]) + len(groups[j]))
        groups[i] += groups[j]
        alive.remove(j)
    return sorted(max(sorted(groups[i]), key=lambda n: prec.get(n, 0.0)) for i in alive)


def decide(proba: DataFrame, multi_label: bool = False, threshold: float = 0.5) -> DataFrame:
    """Labels of probability arrays: the first maximum, or all classes at the threshold with 6-place probabilities."""
    if not multi_label:
        return proba.withColumn("label", argmax(F.col("proba")))
    n = F.size("proba") - 1
    chosen = F.filter(F.sequence(F.lit(0), n), lambda c: F.get("proba", c) >= threshold)
    return proba.withColumn("labels", chosen).withColumn("proba", F.transform("proba", lambda p: F.bround(p, 6)))


def log_loss_weight(agreement_depth: DataFrame) -> DataFrame:
    """Confidence weight agreement * log2(1 + depth); columns agreement, depth."""
    return agreement_depth.withColumn("weight", F.col("agreement") * F.log2(1 + F.col("depth")))


def summary(models: dict[str, DataFrame], examples: DataFrame, n_classes: int) -> DataFrame:
    """macro F1 by model and split."""
    out = None
    for name, proba in models.items():
        part = macro_f1(confusion(examples, decide(proba).select("id", "label")), n_classes).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def agreement(votes: DataFrame) -> DataFrame:
    """id, depth and modal share of votes."""
    c = votes.groupBy("id", "vote").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("id").agg(F.sum("n").alias("depth"), F.max("n").alias("m")).select("id", "depth", ratio("m", "depth").alias("agreement"))
