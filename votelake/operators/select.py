"""Query selection: BALD in closed form, top-k, class floors, greedy batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votelake.schema import ABSTAIN


def bald(examples: DataFrame, votes: DataFrame, prior: list[float], n_lfs: int, smooth: float = 0.1) -> DataFrame:
    """id and BALD score from vote counts alone; no annotator x class tensor is built.

    With n_c votes for class c, D votes in all and A abstaining annotators the
    mean prediction is (n_c(1-s) + (D-n_c)s/(C-1) + A*prior_c) / K, and the
    expected entropy has only two values, one for votes and one for abstains.
    """
    c = len(prior)
    n = votes.filter(F.col("vote") < c).groupBy("id").agg(*[F.count_if(F.col("vote") == i).alias(f"n{i}") for i in range(c)])
    rows = examples.select("id").join(n, "id", "left").fillna(0, [f"n{i}" for i in range(c)])
    fired = sum((F.col(f"n{i}") for i in range(c)), F.lit(0))
    off = smooth / max(1, c - 1)
    p = [(F.col(f"n{i}") * (1 - smooth) + (F.col("d") - F.col(f"n{i}")) * off + (n_lfs - F.col("d")) * prior[i]) / float(n_lfs) for i in range(c)]
    h = lambda x: -x * F.ln(x + F.lit(1e-12))
    he = lambda x: -x * float(np.log(x + 1e-12))
    h_fire = he(1 - smooth) + (c - 1) * he(off)
    h_prior = sum(he(x) for x in prior)
    total = sum((h(x) for x in p[1:]), h(p[0]))
    score = total - (F.col("d") * h_fire + (n_lfs - F.col("d")) * h_prior) / float(n_lfs)
    return rows.withColumn("d", fired).select("id", F.col("d").alias("depth"), score.alias("bald"), F.array(*p).alias("mean"))


def boost(scores: DataFrame, ages: DataFrame, strength: float = 0.1, cap: int = 4) -> DataFrame:
    """Scores times 1 + strength * min(age, cap) for ids carried over; ages(id, age)."""
    met = scores.join(ages.select("id", "age"), "id", "left")
    return met.withColumn("bald", F.col("bald") * (1 + strength * F.least(F.coalesce("age", F.lit(0)), F.lit(cap)))).drop("age")


def prefilter(scores: DataFrame, k: int, times: int = 8) -> DataFrame:
    """The max(k, times * k) best by score: TakeOrderedAndProject."""
    return scores.orderBy(F.desc("bald"), "id").limit(max(k, times * k))


def class_floor(candidates: DataFrame, k: int, floor: int) -> DataFrame:
    """Up to ``floor`` of each pseudo-label among candidates(id, bald, label), at most k in score order; abstains have no class."""
    w = Window.partitionBy("label").orderBy(F.desc("bald"), "id")
    picked = candidates.filter(F.col("label") != ABSTAIN).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= floor)
    return picked.orderBy(F.desc("bald"), "id").limit(k).drop("n")


def top_k(weights: DataFrame, value: str, k: int) -> DataFrame:
    """k rows by value, ids break ties, with their rank (bounded by k)."""
    best = weights.orderBy(F.desc(value), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), "id")))


def percentile_rank(df: DataFrame, value: Column | str) -> DataFrame:
    """(# strictly lower)/(n - 1), 0 for one row; on a selection of bounded size."""
    return df.withColumn("percentile", F.percent_rank().over(Window.orderBy(value)))


def batch_mutual_information(candidates: DataFrame, votes: DataFrame, pool: list[str], prior: list[float], k: int, floor: int = 0, smooth: float = 0.1, samples: int = 500, seed: int = 42) -> list[tuple[int, float]]:
    """Greedy batch of k by joint mutual information with sampled label configurations.

    ``candidates(id, bald, label)`` is a prefiltered set; over 1000 rows is an
    error, as the greedy step is sequential and runs on the driver.
    """
    rows = candidates.orderBy(F.desc("bald"), "id").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("prefilter first: at most 1000 candidates")
    ids, c, n_lfs = [r["id"] for r in rows], len(prior), len(pool)
    at, lf_at = {x: i for i, x in enumerate(ids)}, {n: j for j, n in enumerate(pool)}
    p = np.tile(np.array(prior), (len(ids), n_lfs, 1))
    # a thousand rows at most; named, so that the candidates are not worked again
    named = candidates.sparkSession.createDataFrame([(i,) for i in ids], candidates.select("id").schema)
    held = votes.join(F.broadcast(named), "id", "left_semi").select("id", "lf", "vote").collect()  # candidates x pool at most
    off = smooth / max(1, c - 1)
    for v in held:
        if v["id"] in at and v["lf"] in lf_at and v["vote"] < c:
            p[at[v["id"]], lf_at[v["lf"]]] = off
            p[at[v["id"]], lf_at[v["lf"]], v["vote"]] = 1 - smooth
    eps = 1e-12
    cond = -(p * np.log(p + eps)).sum(axis=2).mean(axis=1)
    rng = np.random.default_rng(seed)
    chosen: list[int] = []
    gains: list[float] = []
    if floor:
        per: dict[int, int] = {}
        for i, r in enumerate(rows):
            if r["label"] >= 0 and per.get(r["label"], 0) < floor and len(chosen) < k:
                per[r["label"]] = per.get(r["label"], 0) + 1
                chosen.append(i)
                gains.append(float(r["bald"]))
    log_joint = np.zeros((samples, n_lfs))  # log p of the sampled labels so far, by annotator
    current = 0.0

    def absorb(i: int) -> None:
        nonlocal log_joint, current
        weight = np.exp(log_joint - log_joint.max(axis=1, keepdims=True))
        post = weight / weight.sum(axis=1, keepdims=True) @ p[i]
        draw = (post.cumsum(axis=1) > rng.random((samples, 1)) * post.sum(axis=1, keepdims=True)).argmax(axis=1)
        log_joint = log_joint + np.log(p[i][:, draw].T + eps)
        peak = log_joint.max(axis=1)
        current = float(-(peak + np.log(np.exp(log_joint - peak[:, None]).mean(axis=1))).mean())

    for i in chosen:
        absorb(i)
    while len(chosen) < min(k, len(ids)):
        weight = np.exp(log_joint - log_joint.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        best, best_gain = -1, -np.inf
        for i in range(len(ids)):
            if i in chosen:
                continue
            post = weight @ p[i]
            gain = float(-(post * np.log(post + eps)).sum(axis=1).mean() - cond[i])
            if gain > best_gain + 1e-15:
                best, best_gain = i, gain
        chosen.append(best)
        gains.append(best_gain)
        absorb(best)
    return [(ids[i], g) for i, g in zip(chosen, gains, strict=True)]
