"""Queries that fit models or run loops: no SQL counterpart."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from votelake.functions import text as tx
from votelake.operators import aggregate as ag
from votelake.operators import downstream as ds
from votelake.operators import labelmodel as lm
from votelake.operators.providers import KeywordMiner
from votelake.plans import tasks as tk
from votelake.plans.label_queries import _NB, C, lang, six
from votelake.plans.loop import Evolution, Settings
from votelake.plans.registry import query

POOL = list(tk.LANG_RULES)


def _features(spark, d):
    ex, v = lang(spark, d)
    return lm.one_hot(ex.select("id", "split", "gold"), v, POOL, C), v


def _label(proba):
    return lm.decide(proba).select("id", "split", "label")


@query()
def text_vote_lr(spark, d):
    return _label(lm.text_vote_regression(_features(spark, d)[0].cache(), C))


@query()
def embedding_vote_lr(spark, d):
    """The ten-class embedding task, from vectors alone."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    rows = e.select(F.col("vec_id").alias("id"), tk._split("vec_id").alias("split"), F.col("label").alias("gold"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return _label(lm.text_vote_regression(rows.cache(), 10))


@query()
def one_vs_rest(spark, d):
    return _label(lm.one_vs_rest(_features(spark, d)[0], C))


@query()
def vote_ensemble(spark, d):
    ex, v = lang(spark, d)
    rows = lm.one_hot(ex.select("id", "split", "gold"), v, POOL, C, abstain_slot=True)
    p = lm.annotator_precision(ex.filter("split = 'val'"), v)
    rows = lm.stack(lm.dense_features(rows, v, p, C, len(POOL)).withColumnRenamed("features", "hot"), ["hot", "dense"]).cache()
    return _label(lm.ensemble(rows, C))


@query()
def vote_stacking(spark, d):
    return _label(lm.stacking(_features(spark, d)[0].cache(), C))


@query()
def clustered_pool(spark, d):
    ex, v = lang(spark, d)
    val = v.filter("split = 'val'")
    p = lm.annotator_precision(ex.filter("split = 'val'"), val)
    names = lm.cluster_annotators(val, POOL, p, ex.filter("split = 'val'").count(), 4)
    return spark.createDataFrame([(n,) for n in names], "lf string")


@query()
def multilabel_lr(spark, d):
    ex = tk.qt(spark, d)
    v = tk.qt_votes(ex)
    rows = lm.one_hot(ex.select("id", "split", "labels"), v, list(tk.QT_RULES), 2)
    out = lm.decide(lm.multilabel_regression(rows, 2), multi_label=True)
    return out.select("id", "split", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query()
def model_summary(spark, d):
    ex, v = lang(spark, d)
    rows = lm.one_hot(ex.select("id", "split", "gold"), v, POOL, C).cache()
    nb = lm.naive_bayes(ex, v, POOL, C).groupBy("id", "split").agg(F.array_sort(F.collect_list(F.struct("class", "p"))).alias("x")).select("id", "split", F.transform("x", lambda z: z["p"]).alias("proba"))
    return lm.summary({"naive_bayes": nb, "one_vs_rest": lm.one_vs_rest(rows, C)}, ex, C)


@query()
def downstream_grid(spark, d):
    ex, v = lang(spark, d)
    weak = ds.confident_rows(ag.majority(ex, v).filter("split = 'train'"), v)
    return ds.efficiency_grid(ex, weak, C)


@query()
def self_training(spark, d):
    ex = tk.lang4(spark, d)
    seed = ex.filter("split = 'val'").select("id", F.col("gold").alias("label"), F.lit(1.0).alias("weight"))
    return ds.self_train(ex, seed).select("id", "split", "label")


@query(f"""WITH {_NB}, mj AS (SELECT id, label FROM (WITH {tk.MV_SQL} SELECT id, label FROM mv)), sp AS (SELECT id, class, p FROM nb WHERE split <> 'test' UNION ALL
  SELECT mj.id, c.class, cast(c.class = mj.label AS INT)::DOUBLE FROM mj JOIN ex USING (id), (SELECT unnest(range({C})) AS class) c WHERE ex.split = 'test' AND mj.label >= 0) SELECT id, cast(class AS INTEGER) AS class, round(p, 6) AS p FROM sp""")
def soft_label_rows(spark, d):
    ex, v = lang(spark, d)
    nb = lm.naive_bayes(ex, v, POOL, C)
    soft = nb.filter("split <> 'test'").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "p"))), lambda z: z["p"]).alias("proba"))
    return ds.soft_rows(ex, soft, ag.majority(ex, v), C).withColumn("p", six("p"))


@query()
def evolution_loop(spark, d):
    ex = tk.lang4(spark, d).select("id", "split", "gold", "text", "text_lower", "num_words")
    run = Evolution(ex, C, KeywordMiner(), Settings())
    return spark.createDataFrame([(h["iter"], h["accepted"], h["pool"], float(h["macro_f1"])) for h in run.run()], "iter int, accepted boolean, pool int, macro_f1 double")


@query()
def hashed_embeddings(spark, d):
    from votelake.operators.providers import hashed_embedding

    e = hashed_embedding(spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text"), 16)
    return e.select("conv_id", "turn", F.round(tx.dot(F.col("emb"), F.col("emb")), 6).alias("norm"))
