"""Diagnostics of a pool: uncertainty, coverage gaps, fragility, overlap, targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votelake.functions import text as tx
from votelake.operators.aggregate import counts
from votelake.operators.metrics import ratio
from votelake.operators.sampling import order_hash
from votelake.schema import ABSTAIN


def vote_stats(examples: DataFrame, votes: DataFrame) -> DataFrame:
    """Per example: depth, majority label (ties abstain), disagree, normalised entropy, uncertainty u.

    Entropy divides by the log of the number of classes seen.  u is 1 without
    votes, the entropy on disagreement, 1/(depth+1) on agreement.
    """
    c = counts(votes)
    per = c.groupBy("id").agg(
        F.sum("n").alias("depth"),
        F.count(F.lit(1)).alias("k"),
        F.max(F.struct("n", (-F.col("class")).alias("c"))).alias("top"),
        F.collect_list("n").alias("ns"),
        F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("class_counts"),
    )
    p = lambda n: n.cast("double") / F.col("depth").cast("double")
    entropy = -F.aggregate(F.array_sort("ns"), F.lit(0.0), lambda a, n: a + p(n) * F.ln(p(n))) / F.ln(F.col("k").cast("double"))
    single = F.size(F.filter("ns", lambda n: n == F.col("top.n"))) == 1
    per = per.select(
        "id",
        "depth",
        F.when(single, -F.col("top.c")).otherwise(ABSTAIN).alias("label"),
        (F.col("k") > 1).alias("disagree"),
        F.when(F.col("k") > 1, entropy).otherwise(0.0).alias("entropy"),
        "class_counts",
    )
    out = examples.select("id", "split", "gold").join(per, "id", "left")
    depth = F.coalesce("depth", F.lit(0))
    u = F.when(depth == 0, 1.0).when(F.col("disagree"), F.col("entropy")).otherwise(1.0 / (depth + 1))
    return out.select(
        "id", "split", "gold", depth.alias("depth"), F.coalesce("label", F.lit(ABSTAIN)).cast("int").alias("label"), F.coalesce("disagree", F.lit(False)).alias("disagree"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"), u.alias("u"), "class_counts"
    )


def pool_summary(stats: DataFrame) -> DataFrame:
    """One row a split: examples, covered, coverage, mean depth of covered."""
    out = stats.groupBy("split").agg(F.count(F.lit(1)).alias("n_examples"), F.count_if(F.col("depth") > 0).alias("n_covered"), F.sum("depth").alias("votes"))
    return out.withColumns({"coverage": ratio("n_covered", "n_examples"), "mean_depth_covered": F.coalesce(ratio("votes", "n_covered"), F.lit(0.0))})


def class_recall(stats: DataFrame) -> DataFrame:
    """Coverage recall by gold class."""
    out = stats.filter("gold is not null").groupBy(F.col("gold").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("depth") > 0).alias("covered"))
    return out.withColumn("recall", ratio("covered", "n"))


def annotator_balance(votes: DataFrame) -> DataFrame:
    """How many annotators mainly vote each class (modal vote, the lower class on a tie)."""
    n = votes.groupBy("lf", "vote").agg(F.count(F.lit(1)).alias("n"))
    modal = n.groupBy("lf").agg(F.max(F.struct("n", (-F.col("vote")).alias("v"))).alias("t"))
    return modal.groupBy((-F.col("t.v")).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n_lfs"))


def depth_histogram(stats: DataFrame) -> DataFrame:
    return stats.groupBy("split", "depth").agg(F.count(F.lit(1)).alias("n"))


def coverage_gap(examples: DataFrame, stats: DataFrame, bool_features: tuple[str, ...]) -> DataFrame:
    """Uncovered rows by each feature, by length, and by class x length x first feature: one pass of grouping sets."""
    rows = examples.join(stats.select("id", (F.col("depth") == 0).alias("uncovered")), "id").withColumn("length", tx.length_bucket(F.col("num_words")))
    first = bool_features[0]
    sets = [[f] for f in bool_features] + [["length"], ["gold", "length", first]]
    keys = ["gold", *bool_features, "length"]
    g = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys])
    counted = g.agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("total"), F.count_if("uncovered").alias("uncovered"))
    bits = {c: len(keys) - 1 - i for i, c in enumerate(keys)}
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in sets:
        gid = sum(1 << b for c, b in bits.items() if c not in s)
        label = F.lit("segment" if len(s) > 1 else s[0])
        shown = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in s])
        name, value = F.when(F.col("gid") == gid, label).otherwise(name), F.when(F.col("gid") == gid, shown).otherwise(value)
    return counted.select(name.alias("feature"), value.alias("value"), "total", "uncovered", ratio("uncovered", "total").alias("gap_rate"))


def uncovered_by_class(stats: DataFrame) -> DataFrame:
    return stats.filter("depth = 0 and gold is not null").groupBy(F.col("gold").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def fragility(stats: DataFrame) -> DataFrame:
    """One row a split: depth 1, depth 3 or more, fragile share of covered."""
    out = stats.groupBy("split").agg(F.count_if(F.col("depth") == 1).alias("n_fragile"), F.count_if(F.col("depth") >= 3).alias("n_well_supported"), F.count_if(F.col("depth") > 0).alias("n_covered"))
    return out.withColumn("fragile_fraction", F.coalesce(ratio("n_fragile", "n_covered"), F.lit(0.0)))


def errors(stats: DataFrame) -> DataFrame:
    """id, whether the majority is wrong, whether votes conflict."""
    wrong = F.col("gold").isNotNull() & (F.col("label") != ABSTAIN) & (F.col("label") != F.col("gold"))
    return stats.select("id", "split", "gold", "label", wrong.alias("misclassified"), F.col("disagree").alias("conflict"))


def worst_annotators(stats: DataFrame, votes: DataFrame, k: int = 10) -> DataFrame:
    """The annotators with most wrong votes on misclassified rows (top-k report)."""
    wrong = errors(stats).filter("misclassified").select("id", "gold")
    met = votes.join(wrong, "id").filter(F.col("vote") != F.col("gold"))
    return met.groupBy("lf").agg(F.count(F.lit(1)).alias("wrong_votes")).orderBy(F.desc("wrong_votes"), "lf").limit(k)


def error_samples(stats: DataFrame, k: int = 20, seed: int = 42) -> DataFrame:
    """k misclassified and k conflicting rows in an order by hash."""
    e = errors(stats).select("*", order_hash(F.col("id"), seed).alias("h"))
    parts = [e.filter(c).withColumn("kind", F.lit(c)).orderBy("h", "id").limit(k) for c in ("misclassified", "conflict")]
    return parts[0].unionByName(parts[1]).drop("h")


def overlap(votes: DataFrame, least: float = 0.0) -> DataFrame:
    """Jaccard of the fired sets of every pair of annotators, those without overlap included.

    Intersections are counted from the annotator set of each example, so
    examples with equal sets (few, as a pool has few patterns) are one row:
    the pair step sees distinct patterns, not examples.
    """
    patterns = votes.groupBy("id").agg(F.array_sort(F.collect_set("lf")).alias("lfs")).groupBy("lfs").agg(F.count(F.lit(1)).alias("n"))
    pairs = patterns.select("n", F.explode("lfs").alias("lf_a"), "lfs").select("n", "lf_a", F.explode("lfs").alias("lf_b")).filter("lf_a < lf_b")
    inter = pairs.groupBy("lf_a", "lf_b").agg(F.sum("n").alias("shared"))
    fires = votes.groupBy("lf").agg(F.count_distinct("id").alias("fires"))
    # a pool against itself: pool size squared, bounded by the pool and not by examples
    a, b = fires.select(F.col("lf").alias("lf_a"), F.col("fires").alias("fires_a")), fires.select(F.col("lf").alias("lf_b"), F.col("fires").alias("fires_b"))
    grid = a.join(F.broadcast(b), F.col("lf_a") < F.col("lf_b")).join(inter, ["lf_a", "lf_b"], "left").fillna(0, ["shared"])
    jac = ratio("shared", F.col("fires_a") + F.col("fires_b") - F.col("shared"))
    return grid.select("lf_a", "lf_b", "fires_a", "fires_b", "shared", jac.alias("jaccard")).filter(F.col("jaccard") >= least)


def coverage_detail(votes: DataFrame) -> DataFrame:
    """Per annotator: fires and unique coverage (rows where nothing else fires)."""
    depth = votes.groupBy("id").agg(F.count(F.lit(1)).alias("depth"), F.min("lf").alias("lf"))
    alone = depth.filter("depth = 1").groupBy("lf").agg(F.count(F.lit(1)).alias("unique_fires"))
    return votes.groupBy("lf").agg(F.count(F.lit(1)).alias("fires")).join(alone, "lf", "left").fillna(0, ["unique_fires"])


def efficiency(votes: DataFrame) -> DataFrame:
    """Covered examples over all votes cast."""
    per = votes.groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    return per.agg(F.count(F.lit(1)).alias("covered"), F.sum("d").alias("votes")).withColumn("efficiency", ratio("covered", "votes"))


def keywords(grouped: DataFrame, background: DataFrame, k: int = 15, least: int = 3) -> DataFrame:
    """Distinctive words of each group: grouped(group, tokens) against background(tokens), tokens distinct a row."""
    n_t = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n_t"))
    df_t = grouped.select("group", F.explode("tokens").alias("word")).groupBy("group", "word").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least)
    n_bg = background.agg(F.count(F.lit(1)).alias("n_bg")).withColumn("__k", F.lit(1))
    df_bg = background.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df_bg"))
    return _top_words(df_t, n_t, df_bg, n_bg, k)


def _top_words(df_t: DataFrame, n_t: DataFrame, df_bg: DataFrame, n_bg: DataFrame, k: int) -> DataFrame:
    met = df_t.join(n_t, "group").join(df_bg, "word", "left").fillna(0, ["df_bg"]).withColumn("__k", F.lit(1)).join(n_bg, "__k").drop("__k")
    score = F.coalesce(ratio("df", "n_t"), F.lit(0.0)) / (F.coalesce(ratio("df_bg", "n_bg"), F.lit(0.0)) + 0.005)
    top = Window.partitionBy("group").orderBy(F.desc("score"), "word")
    return met.select("group", "word", "df", score.alias("score")).withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)


def word_counts(rows: DataFrame) -> DataFrame:
    """(group, word, df): how many rows(group, tokens) of a group hold a word; the null word stands for all rows of the group."""
    words = F.concat("tokens", F.array(F.lit(None).cast("string")))
    return rows.select("group", F.explode(words).alias("word")).groupBy("group", "word").agg(F.count(F.lit(1)).alias("df"))


def counted_keywords(counts: DataFrame, k: int = 15, least: int = 3) -> DataFrame:
    """``keywords`` of the groups of ``word_counts`` against all their rows, those without a group too; counts is read several times, so it should be cached."""
    named, known = F.col("group").isNotNull(), F.col("word").isNotNull()
    n_t = counts.filter(~known & named).select("group", F.col("df").alias("n_t"))
    df_t = counts.filter(known & named & (F.col("df") >= least))
    n_bg = counts.filter(~known).agg(F.sum("df").alias("n_bg")).withColumn("__k", F.lit(1))
    df_bg = counts.filter(known).groupBy("word").agg(F.sum("df").alias("df_bg"))
    return _top_words(df_t, n_t, df_bg, n_bg, k)


def seed_stats(stats: DataFrame, seed_ids: DataFrame) -> DataFrame:
    """Class prior and coverage recall on a labelled seed: class, pi, recall."""
    seed = stats.join(seed_ids.select("id"), "id").filter("gold is not null")
    n = seed.groupBy(F.col("gold").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("depth") > 0).alias("covered"))
    total = F.sum("n").over(Window.partitionBy())
    return n.select("class", "n", ratio("n", total).alias("pi"), ratio("covered", "n").alias("recall"))


def class_priority(seeded: DataFrame, classes: DataFrame, epsilon: float = 0.01, gamma: float = 1.0) -> DataFrame:
    """alpha by class, proportional to (1/max(recall, epsilon))^gamma; classes(class_id) without recall count 0."""
    every = classes.select(F.col("class_id").alias("class")).join(seeded.select("class", "recall", "pi"), "class", "full")
    raw = F.pow(1.0 / F.greatest(F.coalesce("recall", F.lit(0.0)), F.lit(max(1e-9, epsilon))), F.lit(float(max(0.0, gamma))))
    r = every.withColumn("raw", raw)
    return r.select("class", F.coalesce("pi", F.lit(0.0)).alias("pi"), (F.col("raw") / F.sum("raw").over(Window.partitionBy())).alias("alpha"))


def importance(stats: DataFrame, priority: DataFrame) -> DataFrame:
    """id, alpha_i and w = u * alpha_i; ties take the expectation under their votes, uncovered under the prior."""
    prior = priority.agg(F.sum(F.col("pi") * F.col("alpha")).alias("e"), F.avg("alpha").alias("m"), F.map_from_entries(F.collect_list(F.struct("class", "alpha"))).alias("alphas"))
    prior = prior.select(F.when(F.col("e") > 0, F.col("e")).otherwise(F.col("m")).alias("expected"), "alphas")
    # one row: bounded by the class list
    x = stats.withColumn("__k", F.lit(1)).join(F.broadcast(prior.withColumn("__k", F.lit(1))), "__k")
    mixed = F.aggregate(F.array_sort(F.map_entries("class_counts")), F.lit(0.0), lambda a, e: a + e["value"] / F.col("depth") * F.coalesce(F.element_at("alphas", e["key"]), F.col("expected")))
    alpha = F.when(F.col("depth") == 0, F.col("expected")).otherwise(F.coalesce(F.element_at("alphas", F.col("label")), F.when(mixed > 0, mixed), F.col("expected")))
    return x.select("id", "split", "depth", "label", "disagree", "u", alpha.alias("alpha")).withColumn("w", F.col("u") * F.col("alpha"))


def weight_mass(weights: DataFrame) -> DataFrame:
    """Mass of w by depth bucket 0, 1, 2, 3+, and of disagreements."""
    by_depth = weights.groupBy(F.least("depth", F.lit(3)).cast("string").alias("bucket")).agg(F.sum("w").alias("mass"), F.count(F.lit(1)).alias("n"))
    fights = weights.filter("disagree").agg(F.lit("disagree").alias("bucket"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("mass"), F.count(F.lit(1)).alias("n"))
    return by_depth.unionByName(fights)


def _at_ranks(df: DataFrame, value: str, wanted: Callable[[Column], Column]) -> DataFrame:
    """(total, r, value): the values at the ranks, from 0, that ``wanted`` gives as an array for the number of rows.

    Equal values are counted first.  Bounds from a sketch cut the distinct values
    into ranges; totals of ranges say which one holds a rank, and only those
    ranges are ordered, each by itself.  The bounds steer the work, not the result.
    """
    distinct = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    cuts = distinct.agg(F.percentile_approx("v", [i / 256 for i in range(1, 256)], 10_000).alias("cuts")).withColumn("__k", F.lit(1))
    # one row of at most 255 bounds
    placed = distinct.withColumn("__k", F.lit(1)).join(F.broadcast(cuts), "__k").select("v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("g"))
    ranges = placed.groupBy("g").agg(F.sum("n").alias("m"))
    # at most 256 rows
    ahead = ranges.withColumn("before", F.sum("m").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1))).withColumn("total", F.sum("m").over(Window.partitionBy()))
    holds = ahead.select("g", "total", F.coalesce("before", F.lit(0)).alias("before"), "m").select("*", F.explode(F.array_distinct(wanted(F.col("total")))).alias("r")).filter((F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("m")))
    run = Window.partitionBy("g").orderBy("v")
    needed = placed.join(F.broadcast(holds.select("g").distinct()), "g", "left_semi").withColumn("hi", F.sum("n").over(run))
    met = needed.join(F.broadcast(holds), "g").withColumn("hi", F.col("hi") + F.col("before"))
    return met.filter((F.col("r") < F.col("hi")) & (F.col("r") >= F.col("hi") - F.col("n"))).select("total", "r", F.col("v").alias("value"))


def quantiles(df: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """(q, value): nearest-rank quantiles at round-half-even(q * (n - 1))."""
    at = lambda q, n: F.bround(q * (n - 1)).cast("long")
    all_qs = F.array(*[F.lit(float(q)) for q in qs])
    found = _at_ranks(df, value, lambda n: F.transform(all_qs, lambda q: at(q, n)))
    return found.select("*", F.explode(all_qs).alias("q")).filter(at(F.col("q"), F.col("total")) == F.col("r")).select("q", "value")


def interpolated(df: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """One row, q: an array of exact quantiles, linear between the two nearest ranks."""
    at = [F.lit(float(q)) * (F.col("total") - 1) for q in qs]
    found = _at_ranks(df, value, lambda n: F.flatten(F.array(*[F.array(F.floor(F.lit(float(q)) * (n - 1)), F.ceil(F.lit(float(q)) * (n - 1))) for q in qs])))
    one = found.groupBy("total").agg(F.map_from_entries(F.collect_list(F.struct("r", "value"))).alias("m"))

    def between(x: Column) -> Column:
        low, high = F.element_at("m", F.floor(x)), F.element_at("m", F.ceil(x))
        return low + (high - low) * (x - F.floor(x))

    return one.select(F.array(*[between(x) for x in at]).alias("q"))


def improvement_targets(examples: DataFrame, stats: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Segments to work on: uncovered by class and length, fragile by class, valued by count and class weight."""
    recall = class_recall(stats)
    if weights is None:
        raw = recall.withColumn("r", 1.0 / F.greatest("recall", F.lit(0.01)))
        weights = raw.select("class", (F.col("r") * F.count(F.lit(1)).over(Window.partitionBy()) / F.sum("r").over(Window.partitionBy())).alias("class_weight"))
    rows = stats.filter("gold is not null and depth <= 1").select("id", F.col("gold").alias("class"), "depth").join(examples.select("id", "num_words"), "id")
    kind = F.when(F.col("depth") == 0, "uncovered").otherwise("fragile")
    detail = F.when(F.col("depth") == 0, tx.length_bucket(F.col("num_words"))).otherwise("")
    seg = rows.groupBy(kind.alias("target_type"), "class", detail.alias("detail")).agg(F.count(F.lit(1)).alias("n_examples"))
    out = seg.join(weights, "class", "left").withColumn("class_weight", F.coalesce("class_weight", F.lit(1.0)))
    return out.withColumn("value", F.col("n_examples") * F.col("class_weight") * F.when(F.col("target_type") == "uncovered", 1.0).otherwise(0.5))


def recommendations(stats: DataFrame, targets: DataFrame, mean_jaccard: float | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Rules on recall, coverage, fragility, redundancy and the top three targets, numbered in order."""
    weights = targets.groupBy("class").agg(F.max("class_weight").alias("w"))
    recall = class_recall(stats).join(weights, "class", "left")
    cols = lambda t, d, v, s1, s2: [F.lit(t).alias("type"), d.alias("subject"), v.cast("double").alias("value"), F.lit(s1).alias("o1"), s2.cast("double").alias("o2")]
    none = F.lit("")
    gaps = recall.filter("recall < 0.5").select(*cols("class_gap", F.col("class").cast("string"), F.col("recall"), 1, F.col("recall")))
    whole = stats.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("depth") > 0).alias("c"), F.count_if((F.col("depth") == 1) & F.col("gold").isNotNull()).alias("f"))
    low = whole.filter(ratio("c", "n") < 0.7).select(*cols("low_coverage", none, ratio("c", "n"), 2, F.lit(0)))
    fragile = whole.filter(F.col("f") / F.greatest("c", F.lit(1)) > 0.3).select(*cols("fragile_labels", none, F.col("f") / F.greatest("c", F.lit(1)), 3, F.lit(0)))
    parts = [gaps, low, fragile]
    if pairs is not None:
        j = pairs.agg(F.avg("jaccard").alias("j"))
        parts.append(j.filter("j > 0.3").select(*cols("high_redundancy", none, F.col("j"), 4, F.lit(0))))
    segment = F.concat_ws("_", "target_type", F.col("class").cast("string"), F.nullif(F.col("detail"), F.lit("")))
    top = targets.orderBy(F.desc("value"), segment).limit(3)
    parts.append(top.select(*cols("target_segment", segment, F.col("value"), 5, -F.col("value"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # a handful of rows
    return out.withColumn("priority", F.row_number().over(Window.orderBy("o1", "o2", "subject"))).select("priority", "type", "subject", "value")


def clusters(assigned: DataFrame, weights: DataFrame, k: int = 6) -> tuple[DataFrame, DataFrame]:
    """Summary of each cluster and its top-k examples by weight; assigned(id, center, sim)."""
    rows = assigned.join(weights, "id")
    total = F.sum("mass").over(Window.partitionBy())
    labels = rows.filter(F.col("label") != ABSTAIN).groupBy("center", "label").agg(F.count(F.lit(1)).alias("n"))
    modal = labels.groupBy("center").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("t")).select("center", (-F.col("t.l")).cast("int").alias("target_label"))
    s = rows.groupBy("center").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum("w").alias("mass"),
        F.avg((F.col("depth") == 0).cast("double")).alias("uncovered_fraction"),
        F.avg((F.col("depth") == 1).cast("double")).alias("fragile_fraction"),
        F.avg(F.col("disagree").cast("double")).alias("disagree_fraction"),
    )
    summary = s.withColumn("mass_fraction", F.col("mass") / total).join(modal, "center", "left")
    rank = Window.partitionBy("center").orderBy(F.desc("w"), "id")
    top = rows.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("center", "rank", "id", "w", "sim")
    return summary, top


def feature_profile(examples: DataFrame, bool_features: tuple[str, ...]) -> DataFrame:
    """profile: a struct of the flags (null is false), the length bucket, the number of words (null is 0) and of exclamation marks."""
    flags = [F.coalesce(f, F.lit(False)).alias(f) for f in bool_features]
    marks = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^!]", ""))
    words = F.coalesce("num_words", F.lit(0))
    return examples.withColumn("profile", F.struct(*flags, tx.length_bucket(words).alias("text_length"), words.alias("num_words"), marks.alias("num_exclamation")))


def cluster_keywords(assigned: DataFrame, tokens: DataFrame, k: int = 10) -> DataFrame:
    """Distinctive words of each cluster against all rows: group is the centre; tokens(id, tokens)."""
    grouped = tokens.join(assigned.select("id", F.col("center").alias("group")), "id", "left")
    return counted_keywords(word_counts(grouped).cache(), k)


def memory_summary(history: DataFrame, coverage: DataFrame, points: int = 5) -> tuple[DataFrame, DataFrame]:
    """Difficulty of each class with its standstill, and the last coverage points; history(iter, class, f1), coverage(iter, coverage).

    difficulty is 1 - the best F1, 3 places.
    """
    s = stagnant(history)
    return s.withColumn("difficulty", F.round(1 - F.coalesce("best_f1", F.lit(0.0)), 3)), coverage.orderBy(F.desc("iter")).limit(points)


def carry_over(flagged: DataFrame) -> DataFrame:
    """Number of iterations in which an id was flagged; flagged(iter, id)."""
    return flagged.select("iter", "id").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("age"))


def last_per_key(df: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    """The last n rows of each key by ``order``."""
    w = Window.partitionBy(key).orderBy(order.desc())
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def stagnant(history: DataFrame, least: int = 2) -> DataFrame:
    """Classes whose best F1 is at least ``least`` iterations old; history(iter, class, f1)."""
    best = history.groupBy("class").agg(F.max(F.struct("f1", (-F.col("iter")).alias("i"))).alias("b"), F.max("iter").alias("last"))
    out = best.select("class", F.col("b.f1").alias("best_f1"), (F.col("last") + F.col("b.i")).cast("int").alias("stagnant_iters"))
    return out.withColumn("stagnant", F.col("stagnant_iters") >= least)


def fail_streak(outcomes: DataFrame) -> DataFrame:
    """Current run of iterations without a new annotator by class; outcomes(iter, class, ok)."""
    order = Window.partitionBy("class").orderBy("iter").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = outcomes.withColumn("g", F.sum(F.col("ok").cast("int")).over(order))
    last = island.withColumn("top", F.max("g").over(Window.partitionBy("class"))).filter("g = top")
    return last.groupBy("class").agg(F.count_if(~F.col("ok")).alias("streak"))
