"""Steps that once grew faster than their input, or read it more often than once."""

import re

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from votelake.functions import text as tx
from votelake.operators import analyze as az
from votelake.operators import downstream as ds
from votelake.operators import labelmodel as lm
from votelake.operators import metrics as mt
from votelake.operators import providers as pv
from votelake.operators import similarity as si
from votelake.operators.annotators import keyword_rule, regex_rule, run_pool
from votelake.plans.loop import Evolution, Settings


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def patterns(spark):
    rows = [(i, "val" if i % 2 else "train", i % 3, Vectors.sparse(3, {i % 3: 1.0, (i + i // 50) % 3: 1.0})) for i in range(600)]
    return spark.createDataFrame([(i, s, g, v) for i, s, g, v in rows], ["id", "split", "gold", "features"]).withColumn("gold", F.col("gold").cast("int")).cache()


def test_fits_pass_over_distinct_rows(patterns):
    val = patterns.filter("split = 'val'")
    few = lm.shapes(val, "gold")
    assert few.count() <= 9 and few.agg(F.sum("n")).first()[0] == val.count() and few.rdd.getNumPartitions() == 1
    a, b = lm.fit_logistic(few, 3, 1.0), lm.fit_logistic(val, 3, 1.0)
    assert np.allclose(a.coefficientMatrix.toArray(), b.coefficientMatrix.toArray(), atol=1e-3)


def test_tally_of_counted_rows(spark):
    rows = [("val", 0, 0), ("val", 0, 0), ("val", 0, 1), ("val", 1, -1)]
    long = spark.createDataFrame(rows, "split string, gold int, label int")
    short = long.groupBy("split", "gold", "label").agg(F.count(F.lit(1)).alias("n"))
    got = {tuple(r) for r in mt.tally(short).collect()}
    assert got == {tuple(r) for r in mt.tally(long).collect()} == {("val", 0, 2, 0, 1), ("val", 1, 0, 1, 1)}


def test_ensemble_joins_nothing_by_id(patterns):
    out = lm.ensemble(patterns, 3, rounds=2, grid=(1.0,), folds=2)
    assert "Join" not in _plan(out) and out.count() == 600
    assert out.filter(F.abs(F.aggregate("proba", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0


def test_stacking_joins_nothing_by_id(patterns):
    out = lm.stacking(patterns, 3, folds=2, rounds=2)
    assert "Join" not in _plan(out) and out.select("id").distinct().count() == 600


def test_rules_run_once(spark):
    rows = spark.createDataFrame([(1, "a", "x y"), (2, "a", "z")], "id int, split string, text_lower string")
    votes = run_pool(rows, [regex_rule("p", 0, "x"), regex_rule("q", 1, "z|y")], once=True)
    assert sorted(map(tuple, votes.collect())) == [(1, "a", "p", 0), (1, "a", "q", 1), (2, "a", "q", 1)]
    assert "InMemoryTableScan" in _plan(votes)


@pytest.mark.parametrize("odd", [False, True])
def test_topk_by_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(si, "_BLOCK", 16)
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (120, 4)) / 7.0
    v[40:60] = v[3]  # equal vectors: ids decide
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    if odd:
        rows += [(500, None), (501, [1.0]), (502, [float("nan")] * 4)]
    base = spark.createDataFrame(rows, "id long, emb array<double>").repartition(3)
    got = {(r["query"], r["rank"]): (r["id"], r["sim"]) for r in si.embedding_cosine(base.filter("id < 9"), base, 5).collect()}
    q = base.filter("id < 9").select(F.col("id").alias("query"), F.col("emb").alias("q"))
    every = base.crossJoin(q).filter("id <> query").select("query", "id", tx.dot(F.col("q"), F.col("emb")).alias("sim"))
    want = {}
    for n in range(9):
        for k, r in enumerate(every.filter(F.col("query") == n).orderBy(F.desc("sim"), "id").limit(5).collect(), 1):
            want[n, k] = (r["id"], r["sim"])
    assert {k: str(x) for k, x in got.items()} == {k: str(x) for k, x in want.items()}
    assert "MapInArrow" in _plan(si.embedding_cosine(base.filter("id < 9"), base, 5))


def test_terms_stay_with_their_documents(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, [])], "id int, tokens array<string>")
    out = si.tfidf_entries(docs)
    got = {r["id"]: [e["term"] for e in r["entries"]] for r in out.collect()}
    assert got == {1: ["a", "b"], 2: ["b", "c"]}
    assert not re.search(r"Exchange hashpartitioning\(id#\d+L?, term", _plan(out))


def test_keywords_from_one_count(spark):
    rows = spark.createDataFrame([(g, [f"w{g}", "all"] + (["odd"] if i % 2 else [])) for g in (0, 1) for i in range(6)] + [(None, ["all", "w0"])], "group int, tokens array<string>")
    want = {tuple(r) for r in az.keywords(rows, rows, k=3).collect()}
    assert {tuple(r) for r in az.counted_keywords(az.word_counts(rows).cache(), k=3).collect()} == want and want


def test_jaccard_of_sets(spark):
    pairs = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], []), (["a"], ["a"])], "x array<string>, y array<string>")
    assert all(r[0] == r[1] for r in pairs.select(tx.jaccard_sets(F.col("x"), F.col("y")), tx.jaccard(F.col("x"), F.col("y"))).collect())


def test_nearest_center_keeps_columns(spark):
    docs = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "id int, t array<string>")
    centers = spark.createDataFrame([(7, 1, ["a"]), (8, 2, ["b"])], "center int, rank int, t array<string>")
    got = si.nearest_center(docs, centers, lambda c: tx.jaccard_sets(F.col("t"), c["t"]), keep=("t",))
    assert {(r["id"], r["center"], r["t"][0]) for r in got.collect()} == {(1, 7, "a"), (2, 8, "b")}


def test_keyword_rules_share_the_words_of_a_text(spark):
    banks = {"k0": ["der", "und"], "k1": ["d'un", "qu"], "k2": ["x"]}
    texts = ["und so", "wunder", "der\n", "d'un", "ad'un d'una", "qu'd'un", "1der2", "", "x", "ax xb", None]
    rows = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "id int, split string, text_lower string")
    votes = run_pool(rows, [keyword_rule(n, 0, ws) for n, ws in banks.items()])
    want = run_pool(rows, [regex_rule(n, 0, f"(^|[^a-z])({'|'.join(ws)})([^a-z]|$)") for n, ws in banks.items()])
    assert sorted(map(tuple, votes.collect())) == sorted(map(tuple, want.collect()))
    assert votes._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_loop_counts_words_and_metrics_once(spark, monkeypatch):
    rows = [(i, ("train", "train", "val")[i % 3], i % 2, f"w{'ab'[i % 2]} common {'red' if i % 2 else 'blue'}") for i in range(90)]
    ex = spark.createDataFrame(rows, "id long, split string, gold int, text string").withColumn("text_lower", F.lower("text"))
    calls = {"words": 0, "metrics": []}
    count, measure = pv.word_counts, mt.annotator_metrics
    monkeypatch.setattr(pv, "word_counts", lambda r: (calls.__setitem__("words", calls["words"] + 1), count(r))[1])
    monkeypatch.setattr(mt, "annotator_metrics", lambda e, v, p: (calls["metrics"].extend(r["lf"] for r in p.collect()), measure(e, v, p))[1])
    history = Evolution(ex, 2, pv.KeywordMiner(bank=1), Settings(iterations=1, per_round=1)).run()
    assert calls["words"] == 1 and len(calls["metrics"]) == len(set(calls["metrics"]))
    assert history[0]["macro_f1"] == 1.0


def test_self_training_takes_texts_once(spark, monkeypatch):
    rows = [(i, "val" if i % 3 == 0 else "test", "red rose" if i % 2 else "blue sky") for i in range(24)]
    ex = spark.createDataFrame(rows, "id long, split string, text string")
    seed = ex.filter("split = 'val'").select("id", (F.col("id") % 2).cast("int").alias("label"), F.lit(1.0).alias("weight"))
    calls, tokens = [], ds.with_tokens
    monkeypatch.setattr(ds, "with_tokens", lambda e: (calls.append(1), tokens(e))[1])
    out = ds.self_train(ex, seed, rounds=1)
    assert out.filter(F.col("label") == F.col("id") % 2).count() == 24 and len(calls) == 1


def test_grid_takes_texts_once(spark, monkeypatch):
    rows = [(i, "test" if i % 4 == 0 else "train", i % 2, "red rose" if i % 2 else "blue sky") for i in range(40)]
    ex = spark.createDataFrame(rows, "id long, split string, gold int, text string")
    weak = ex.filter("split = 'train'").select("id", F.col("gold").alias("label"), F.lit(0.5).alias("weight"))
    calls, tokens = [], ds.with_tokens
    monkeypatch.setattr(ds, "with_tokens", lambda e: (calls.append(1), tokens(e))[1])
    out = {r["run"] for r in ds.efficiency_grid(ex, weak, 2, sizes=(4,)).select("run").collect()}
    assert out == {"weak", "oracle", "golden_4", "both_4"} and len(calls) == 1
