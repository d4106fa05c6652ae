"""Diagnostics, selection, evolution, sampling and label models: edge rules and properties."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from votelake.operators import analyze as az
from votelake.operators import evolve as ev
from votelake.operators import labelmodel as lm
from votelake.operators import sampling as sm
from votelake.operators import select as sl
from votelake.operators import similarity as si


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(5)
    ex = spark.createDataFrame([(i, ("train", "val", "test")[i % 3], int(rng.integers(0, 3))) for i in range(90)], "id bigint, split string, gold int")
    gold = {r["id"]: r["gold"] for r in ex.collect()}
    v = [(i, ("train", "val", "test")[i % 3], f"lf{j}", gold[i] if rng.random() < 0.7 else int(rng.integers(0, 3))) for i in range(90) for j in range(4) if rng.random() < 0.5]
    return ex, spark.createDataFrame(v, "id bigint, split string, lf string, vote int"), gold, v


def test_vote_stats_by_hand(spark):
    ex = spark.createDataFrame([(i, "val", 0) for i in (1, 2, 3)], "id bigint, split string, gold int")
    v = spark.createDataFrame([(1, "val", "a", 0), (1, "val", "b", 0), (2, "val", "a", 0), (2, "val", "b", 1), (2, "val", "c", 1)], "id bigint, split string, lf string, vote int")
    got = {r["id"]: r for r in az.vote_stats(ex, v).collect()}
    assert got[1]["u"] == pytest.approx(1 / 3) and got[3]["u"] == 1.0
    h = -(1 / 3 * math.log(1 / 3) + 2 / 3 * math.log(2 / 3)) / math.log(2)
    assert got[2]["u"] == pytest.approx(h) and got[2]["label"] == 1 and got[2]["disagree"]


def test_bald_equals_tensor(world):
    ex, votes, _, v = world
    prior, pool, s = [0.5, 0.3, 0.2], [f"lf{j}" for j in range(4)], 0.1
    got = {r["id"]: r["bald"] for r in sl.bald(ex, votes, prior, 4, s).collect()}
    cast = {(i, lf): c for i, _, lf, c in v}
    for i in got:
        p = np.array([prior if (i, lf) not in cast else [1 - s if c == cast[i, lf] else s / 2 for c in range(3)] for lf in pool])
        h = lambda x: -(x * np.log(x + 1e-12)).sum(-1)
        assert got[i] == pytest.approx(h(p.mean(0)) - h(p).mean(), abs=1e-9)
    assert min(got.values()) > -1e-9


def test_batch_selection_is_deterministic_and_bounded(world):
    ex, votes, *_ = world
    cand = sl.bald(ex, votes, [1 / 3] * 3, 4).select("id", "bald").withColumn("label", F.lit(0))
    args = (cand, votes, [f"lf{j}" for j in range(4)], [1 / 3] * 3, 7)
    a = sl.batch_mutual_information(*args, floor=2, samples=50)
    assert a == sl.batch_mutual_information(*args, floor=2, samples=50) and len({i for i, _ in a}) == 7


def test_overlap_matches_sets(world):
    _, votes, _, v = world
    fired = {f"lf{j}": {i for i, _, lf, _ in v if lf == f"lf{j}"} for j in range(4)}
    for r in az.overlap(votes).collect():
        a, b = fired[r["lf_a"]], fired[r["lf_b"]]
        assert r["jaccard"] == pytest.approx(len(a & b) / len(a | b))
    assert az.overlap(votes).count() == 6


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=30), st.floats(0, 1))
def test_nearest_rank_quantile(spark, xs, q):
    df = spark.createDataFrame([(x,) for x in xs], "v int")
    assert az.quantiles(df, "v", [q]).first()["value"] == sorted(xs)[round(q * (len(xs) - 1))]


def test_quantile_rounds_half_to_even(spark):
    df = spark.createDataFrame([(x,) for x in range(6)], "v int")
    assert [r["value"] for r in az.quantiles(df, "v", [0.5, 0.1, 0.3]).orderBy("q").collect()] == [0, 2, 2]


def test_percentile_rank_of_one_row(spark):
    assert sl.percentile_rank(spark.createDataFrame([(1, 3.0)], "id int, w double"), "w").first()["percentile"] == 0.0


def test_one_sided_gap(spark):
    m = spark.createDataFrame([("a", "val", 0.9), ("a", "train", 0.5), ("b", "val", 0.5), ("b", "train", 0.9), ("c", "val", None), ("c", "train", None)], "lf string, split string, precision double")
    assert sorted(r["lf"] for r in ev.consistency_gate(m, 0.3).collect()) == ["b", "c"]


def _fires(spark, sets):
    return spark.createDataFrame([(i, "val", lf, 0) for lf, ids in sets.items() for i in ids], "id bigint, split string, lf string, vote int")


def test_greedy_jaccard_depends_on_order(spark):
    old = _fires(spark, {"o": [1, 2, 3, 4]})
    new = _fires(spark, {"n1": [11, 12, 13, 14], "n2": [11, 12, 13, 14], "n3": [1, 2, 3, 4], "n4": [20]})
    assert ev.greedy_jaccard(old, new, 0.95) == ["n1", "n4"]


def test_subsumption_spares_new(spark):
    v = _fires(spark, {"old": [1, 2], "new": [1, 2, 3], "new2": [1, 2, 3]})
    p = spark.createDataFrame([("old", 0.5), ("new", 0.9), ("new2", 0.4)], "lf string, precision double")
    gone = ev.subsumed(v, p, spark.createDataFrame([("new",), ("new2",)], "lf string"))
    assert [tuple(r) for r in gone.collect()] == [("old", "new")]


def test_kill_log_names_first_gate(spark):
    s = spark.createDataFrame([("a",), ("b",), ("c",)], "lf string")
    only = lambda *n: s.filter(F.col("lf").isin(*n))
    log = ev.kill_log(s, only("c"), [("threshold", only("b", "c")), ("gap", only("c"))])
    assert sorted(map(tuple, log.collect())) == [("a", "threshold"), ("b", "gap")]


def test_ablation_drops_a_bad_new_rule(spark):
    ex = spark.createDataFrame([(i, "val", i % 2) for i in range(20)], "id bigint, split string, gold int")
    v = spark.createDataFrame([(i, "val", "good", i % 2) for i in range(20)] + [(i, "val", lf, 0) for i in range(20) for lf in ("bad",)], "id bigint, split string, lf string, vote int")
    assert ev.ablate(ex, v, ["bad", "good"], 2) == ["bad"]
    assert ev.ablate(ex, v, ["good"], 2) == []


def test_acceptance():
    assert ev.accept(None, 0.1) and ev.accept(0.5, 0.6) and not ev.accept(0.5, 0.47) and not ev.accept(0.5, 0.5) and ev.accept(0.5, 0.49, min_gain=0.0)


def test_folds(spark):
    df = spark.createDataFrame([(i, 0 if i < 10 else 1) for i in range(17)], "id bigint, gold int")
    k = sm.k_folds(df)
    assert k.count() == 17 and k.first()["folds"] == 5
    assert k.groupBy("gold", "fold").count().agg(F.max("count")).first()[0] <= 2
    missing = df.withColumn("gold", F.when(F.col("gold") == 1, 2).otherwise(0))
    assert sm.k_folds(missing).first()["folds"] == 2


def test_strata_sum_to_n(spark):
    df = spark.createDataFrame([(i, i % 7 // 3) for i in range(200)], "id bigint, gold int")
    assert sm.stratified_proportional(df, 33).count() == 33 and sm.stratified_equal(df, 50, 3).count() == 50
    a, b = (sorted(r["id"] for r in sm.stratified_equal(df.repartition(n), 50, 3).collect()) for n in (1, 5))
    assert a == b
    s = sm.rank_split(df, val_cap=3)
    assert s.filter("split = 'val'").count() <= 3 and s.select("id").distinct().count() == s.count()


def test_naive_bayes_sums_to_one_and_matches_counts(world):
    ex, votes, gold, v = world
    pool = [f"lf{j}" for j in range(5)]  # lf4 never fires
    got: dict = {}
    for r in lm.naive_bayes(ex, votes, pool, 3).collect():
        got.setdefault(r["id"], {})[r["class"]] = r["p"]
    cast = {(i, lf): c for i, _, lf, c in v}
    val = [i for i in gold if i % 3 == 1]
    n = np.array([sum(gold[i] == c for i in val) for c in range(3)])
    table = np.ones((5, 4, 3))
    for i in val:
        for j, lf in enumerate(pool):
            table[j, cast.get((i, lf), -1) + 1, gold[i]] += 1
    table = np.log(table / table.sum(axis=1, keepdims=True))
    for i in gold:
        s = np.log((n + 1) / (n + 1).sum()) + sum(table[j, cast.get((i, lf), -1) + 1] for j, lf in enumerate(pool))
        p = np.exp(s - s.max())
        assert [got[i][c] for c in range(3)] == pytest.approx(list(p / p.sum()))


def test_temperature_keeps_sums(world):
    ex, votes, *_ = world
    best, scaled = lm.temperature(lm.naive_bayes(ex, votes, [f"lf{j}" for j in range(4)], 3), ex)
    assert best.first()["temperature"] in lm.TEMPERATURES
    assert all(abs(r["s"] - 1) < 1e-9 for r in scaled.groupBy("id").agg(F.sum("p").alias("s")).collect())


def test_regression_predicts_every_row_once(world):
    ex, votes, *_ = world
    rows = lm.one_hot(ex, votes, [f"lf{j}" for j in range(4)], 3)
    out = lm.text_vote_regression(rows, 3, grid=(1.0,), folds=2)
    assert out.count() == 90 and out.select("id").distinct().count() == 90
    assert out.filter(F.abs(F.aggregate("proba", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-6).count() == 0


def test_abstain_slot_features(world):
    ex, votes, _, v = world
    row = lm.one_hot(ex, votes, [f"lf{j}" for j in range(4)], 3, abstain_slot=True).first()
    assert sum(row["features"].toArray()) == 4.0  # one slot of each annotator


def test_label_decisions(spark):
    p = spark.createDataFrame([(1, "val", [0.4, 0.4, 0.2]), (2, "val", [0.1, 0.5, 0.5])], "id int, split string, proba array<double>")
    assert [r["label"] for r in lm.decide(p).collect()] == [0, 1]
    assert [r["labels"] for r in lm.decide(p, multi_label=True).collect()] == [[], [1, 2]]


def test_cluster_annotators_keeps_the_precise(spark):
    v = _fires(spark, {"a": [1, 2, 3], "b": [1, 2, 3], "c": [9]})
    p = spark.createDataFrame([("a", 0.2), ("b", 0.8), ("c", 0.1)], "lf string, precision double")
    assert lm.cluster_annotators(v, ["a", "b", "c"], p, 10, 2) == ["b", "c"]
    assert lm.cluster_annotators(v, ["a", "b", "c"], p, 10, 3) == ["a", "b", "c"]


def test_similarity_edges(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id bigint, emb array<double>")
    top = {r["query"]: r["id"] for r in si.embedding_cosine(e, e, 1).collect()}
    assert top[1] == 3 and top[3] == 1  # ties go to the lower id
    s = spark.createDataFrame([(["a", None, "c"], ["a", None, "d"])], "a array<string>, b array<string>")
    assert s.select(si.signature_agreement(F.col("a"), F.col("b")).alias("x")).first()["x"] == pytest.approx(2 / 3)
    got = [r[0] for r in spark.createDataFrame([(0.2,), (0.45,), (0.7,)], "c double").select(si.adaptive_alpha(F.col("c"))).collect()]
    assert got == [1.0, 0.65, 0.3]


def test_streaks_and_memory(spark):
    o = spark.createDataFrame([(1, 0, True), (2, 0, False), (3, 0, False), (1, 1, False), (2, 1, False), (1, 2, True)], "iter int, class int, ok boolean")
    assert {r["class"]: r["streak"] for r in az.fail_streak(o).collect()} == {0: 2, 1: 2, 2: 0}
    h = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.4), (3, 0, 0.5)], "iter int, class int, f1 double")
    assert az.stagnant(h).first()["stagnant_iters"] == 2
