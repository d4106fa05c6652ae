"""Queries over votes, aggregated labels and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votelake.operators import aggregate as ag
from votelake.operators import annotators as an
from votelake.operators import labelmodel as lm
from votelake.operators import metrics as mt
from votelake.plans import tasks as tk
from votelake.plans.registry import query

C = tk.LANG.n_classes
six = lambda x: F.round(x, 6)


def lang(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ex = tk.lang4(spark, d)
    return ex, tk.lang_votes(ex)


def qt(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ex = tk.qt(spark, d)
    return ex, tk.qt_votes(ex)


@query(f"WITH {tk.VOTES_SQL} SELECT id, split, lf, vote FROM votes")
def votes_long(spark, d):
    return lang(spark, d)[1]


_CELLS = " || ',' || ".join(f"'{n}=' || CASE WHEN regexp_matches(lt, '{p}') THEN '{c}' ELSE '-1' END" for n, (c, p) in sorted(tk.LANG_RULES.items()))


@query(f"WITH {tk.EX_SQL} SELECT id, {_CELLS} AS votes FROM ex")
def vote_map(spark, d):
    ex, v = lang(spark, d)
    wide = an.vote_map(ex, v, list(tk.LANG_RULES))
    return wide.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("votes")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("votes"))


@query(f"WITH {tk.MV_SQL} SELECT id, split, label FROM mv")
def mv_tie_abstain(spark, d):
    return ag.majority(*lang(spark, d))


@query(f"WITH {tk.MV_SQL} SELECT ex.id, ex.split, coalesce(class, -1) AS label FROM ex LEFT JOIN won USING (id)")
def mv_tie_lowest(spark, d):
    return ag.majority(*lang(spark, d), ties="lowest")


_WEIGHTED = f"""WITH {tk.METRICS_SQL}, s AS (SELECT id, vote AS class, sum(coalesce(w.precision, 1.0)) AS s FROM votes LEFT JOIN (SELECT lf, precision FROM lfm WHERE split = 'val') w USING (lf) GROUP BY id, vote),
  b AS (SELECT id, max(s) AS top FROM s GROUP BY id), x AS (SELECT s.id, count(*) FILTER (b.top - s.s < 1e-9) AS near, max_by(class, s.s) AS class FROM s JOIN b USING (id) GROUP BY s.id)
SELECT ex.id, ex.split, coalesce(CASE WHEN near = 1 THEN class END, -1) AS label FROM ex LEFT JOIN x USING (id)"""


@query(_WEIGHTED)
def wv_precision(spark, d):
    ex, v = lang(spark, d)
    m = mt.annotator_metrics(ex, v, tk.pool_frame(spark, tk.LANG_RULES))
    return ag.weighted(ex, v, m.filter("split = 'val'").select("lf", F.col("precision").alias("weight")))


@query(f"WITH {tk.VOTES_SQL} SELECT ex.id, ex.split, CASE WHEN EXISTS (SELECT 1 FROM votes v WHERE v.id = ex.id AND vote = 2) THEN 2 ELSE -1 END AS label FROM ex")
def at_least_one(spark, d):
    return ag.any_vote(*lang(spark, d), target=2)


@query(f"WITH {tk.QT_SQL} SELECT id, split, array_to_string(labels, ',') AS labels FROM orv")
def ml_or(spark, d):
    return ag.label_sets(*qt(spark, d)).withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), ","))


@query(f"""WITH {tk.QT_SQL}, s AS (SELECT id, string_agg(vote, ',' ORDER BY vote) AS labels FROM (SELECT id, vote FROM votes GROUP BY id, vote HAVING count(*) >= 2) GROUP BY id)
SELECT q.id, q.split, coalesce(s.labels, '') AS labels FROM q LEFT JOIN s USING (id)""")
def ml_threshold(spark, d):
    return ag.label_sets(*qt(spark, d), threshold=2).withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), ","))


@query(f"WITH {tk.QT_SQL} SELECT DISTINCT id, lf, vote AS class FROM votes")
def vote_tensor(spark, d):
    return ag.vote_tensor(qt(spark, d)[1])


@query(f"WITH {tk.METRICS_SQL} SELECT split, lf, n_labeled, fires, correct, incorrect, round(coverage, 6) AS coverage, round(precision, 6) AS precision FROM lfm")
def lf_metrics(spark, d):
    m = mt.annotator_metrics(*lang(spark, d), tk.pool_frame(spark, tk.LANG_RULES))
    return m.withColumn("coverage", six("coverage")).withColumn("precision", six("precision"))


@query(f"WITH {tk.VOTES_SQL} SELECT split, lf, vote, count(*) AS n FROM votes GROUP BY ALL")
def lf_vote_histogram(spark, d):
    return mt.vote_histogram(lang(spark, d)[1])


@query(f"WITH {tk.QT_SQL} SELECT lf, vote AS class, count(*) AS fires, count(*) FILTER (list_contains(q.labels, vote)) AS hits, round(cast(count(*) FILTER (list_contains(q.labels, vote)) AS DOUBLE) / count(*), 6) AS precision FROM votes JOIN q USING (id) GROUP BY lf, vote")
def lf_class_metrics(spark, d):
    return mt.annotator_class_metrics(*qt(spark, d)).withColumn("precision", six("precision"))


@query(f"WITH {tk.VOTES_SQL} SELECT lf, array_to_string(list_sort(list_distinct(list(vote))), ',') AS polarity FROM votes GROUP BY lf")
def lf_polarity(spark, d):
    return mt.polarity(lang(spark, d)[1]).withColumn("polarity", F.array_join(F.col("polarity").cast("array<string>"), ","))


_CAND = f"""WITH {tk.VOTES_SQL}, {tk.POOL_SQL}, c AS (SELECT lf, count(*) AS fires, count(*) FILTER (coalesce(vote = gold, false)) AS hits, list_distinct(list(vote)) AS vs FROM votes JOIN ex USING (id, split) GROUP BY lf)
SELECT pool.lf, coalesce(fires, 0) AS fires, coalesce(hits, 0) AS hits, round(coalesce(cast(hits AS DOUBLE) / fires, 0), 6) AS precision, CASE WHEN len(vs) = 1 THEN vs[1] END AS predicted_label FROM pool LEFT JOIN c USING (lf)"""


@query(_CAND)
def candidate_metrics(spark, d):
    return mt.candidate_metrics(*lang(spark, d), tk.pool_frame(spark, tk.LANG_RULES)).withColumn("precision", six("precision"))


@query(f"WITH {tk.PRF_SQL} SELECT split, class, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf")
def agg_eval(spark, d):
    ex, v = lang(spark, d)
    out = mt.prf(mt.confusion(ex, ag.majority(ex, v)))
    return out.withColumns({c: six(c) for c in ("precision", "recall", "f1")})


@query(f"""WITH {tk.MV_SQL} SELECT split, count(*) AS n_total, count(gold) AS n_labeled, count(*) FILTER (label >= 0) AS n_covered, count(gold) FILTER (label >= 0) AS n_labeled_covered, count(*) FILTER (label = gold) AS n_correct,
  round(cast(count(*) FILTER (label >= 0) AS DOUBLE) / count(*), 6) AS coverage, round(cast(count(*) FILTER (label = gold) AS DOUBLE) / count(gold) FILTER (label >= 0), 6) AS accuracy_on_covered, round(cast(count(*) FILTER (label = gold) AS DOUBLE) / count(gold), 6) AS accuracy_overall FROM mv GROUP BY split""")
def eval_totals(spark, d):
    ex, v = lang(spark, d)
    return mt.evaluate(ex, ag.majority(ex, v)).withColumns({c: six(c) for c in ("coverage", "accuracy_on_covered", "accuracy_overall")})


@query(f"WITH {tk.MV_SQL} SELECT split, label, count(*) AS n FROM mv GROUP BY ALL")
def label_distribution(spark, d):
    ex, v = lang(spark, d)
    return mt.label_distribution(ag.majority(ex, v))


@query(f"""WITH {tk.PRF_SQL} SELECT split, round(sum(coalesce(f1, 0)) / 4.0::DOUBLE, 6) AS by_classes, round(sum(coalesce(f1, 0)) / cast(count(*) AS DOUBLE), 6) AS by_seen, round(sum(coalesce(f1, 0)) / cast(count(f1) AS DOUBLE), 6) AS by_defined FROM prf GROUP BY split""")
def macro_f1_variants(spark, d):
    ex, v = lang(spark, d)
    c = mt.confusion(ex, ag.majority(ex, v))
    kinds = {"by_classes": ("classes", "zero"), "by_seen": ("seen", "zero"), "by_defined": ("seen", "skip")}
    out = None
    for name, (by, undefined) in kinds.items():
        part = mt.macro_f1(c, C, by, undefined).select("split", six("macro_f1").alias(name))
        out = part if out is None else out.join(part, "split")
    return out


_BINARY = f"""{tk.QT_SQL}, g AS (SELECT c.class, list_contains(y, c.class) AS y, list_contains(labels, c.class) AS z FROM orv CROSS JOIN (VALUES (0), (1)) c(class)),
  pc AS (SELECT class, count(*) FILTER (y AND z) AS tp, count(*) FILTER (NOT y AND z) AS fp, count(*) FILTER (y AND NOT z) AS fn FROM g GROUP BY class)"""


@query(f"WITH {_BINARY} SELECT * FROM pc")
def per_class_binary(spark, d):
    ex, v = qt(spark, d)
    return mt.multilabel_confusion(ex, ag.label_sets(ex, v), 2)


@query(f"""WITH {_BINARY}, f AS (SELECT *, coalesce(cast(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(cast(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS p, coalesce(cast(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS r FROM pc),
  a AS (SELECT sum(f1) / 2 AS macro_f1, sum(p) / 2 AS macro_precision, sum(r) / 2 AS macro_recall, cast(2 * sum(tp) AS DOUBLE) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro_f1, sum(f1 * (tp + fn)) / sum(tp + fn) AS weighted_f1, sum(fp + fn) AS wrong FROM f),
  b AS (SELECT count(*) AS n, avg(CASE WHEN len(y) + len(labels) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(y, labels)) / (len(y) + len(labels)) END) AS sample_f1, avg(cast(list_sort(y) = list_sort(labels) AS INT)) AS subset_accuracy,
    avg(cast(len(labels) > 0 AS INT)) AS coverage_anyone, avg(len(labels)) AS mean_predicted, avg(len(y)) AS mean_true FROM orv)
SELECT round(macro_f1, 6) AS macro_f1, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(micro_f1, 6) AS micro_f1, round(weighted_f1, 6) AS weighted_f1, n, round(sample_f1, 6) AS sample_f1,
  round(subset_accuracy, 6) AS subset_accuracy, round(coverage_anyone, 6) AS coverage_anyone, round(mean_predicted, 6) AS mean_predicted, round(mean_true, 6) AS mean_true, round(cast(wrong AS DOUBLE) / (n * 2), 6) AS hamming_loss FROM a, b""")
def multilabel_summary(spark, d):
    ex, v = qt(spark, d)
    s = mt.multilabel_summary(ex, ag.label_sets(ex, v), 2)
    return s.select(*[six(c).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query(f"""WITH {tk.QT_SQL}, t AS (SELECT avg(len(labels)) AS m FROM q) SELECT c.class, (SELECT count(*) FROM q WHERE list_contains(labels, c.class)) AS n, (SELECT count(*) FROM q) AS n_rows,
  round((SELECT m FROM t), 6) AS cardinality, round((SELECT m FROM t) / 2, 6) AS density FROM (VALUES (0), (1)) c(class)""")
def label_stats(spark, d):
    s = mt.label_stats(tk.qt(spark, d), 2)
    return s.withColumn("cardinality", six("cardinality")).withColumn("density", six("density"))


_SPARSE = f"""WITH {tk.DOC_SQL}, ex AS (SELECT doc.*, quality AS gold FROM doc LEFT JOIN labels l ON l.doc_id = doc.id), votes AS {tk._votes_sql(tk.QT_RULES, 'ex')},
  c AS (SELECT id, vote AS class, count(*) AS n FROM votes GROUP BY id, vote), t AS (SELECT id, max(n) AS top FROM c GROUP BY id), w AS (SELECT c.id, min(class) AS class, count(*) AS k FROM c JOIN t ON c.id = t.id AND c.n = t.top GROUP BY c.id),
  mv AS (SELECT ex.id, ex.split, ex.gold, coalesce(CASE WHEN k = 1 THEN class END, -1) AS label FROM ex LEFT JOIN w USING (id))
SELECT split, count(*) AS n_total, count(gold) AS n_labeled, count(*) FILTER (label >= 0) AS n_covered, count(*) FILTER (label = gold) AS n_correct FROM mv GROUP BY split"""


@query(_SPARSE)
def sparse_gold_eval(spark, d):
    ex = tk.quality(spark, d)
    v = tk.qt_votes(ex)
    return mt.evaluate(ex, ag.majority(ex, v)).select("split", "n_total", "n_labeled", "n_covered", "n_correct")


_HYBRID = f"""WITH {tk.VOTES_SQL}, pr AS (SELECT lf, cast(count(*) FILTER (vote = gold) AS DOUBLE) / count(*) AS p FROM votes JOIN ex USING (id, split) WHERE split = 'val' AND gold IS NOT NULL GROUP BY lf),
  s AS (SELECT id, vote AS class, sum(coalesce(p, 0)) AS s FROM votes LEFT JOIN pr USING (lf) GROUP BY id, vote), t AS (SELECT id, sum(s) AS t FROM s GROUP BY id)
SELECT ex.id, c.class, round(CASE WHEN t.t > 0 THEN coalesce(s.s, 0) / t.t ELSE 0.25 END, 6) AS p FROM ex CROSS JOIN (VALUES (0), (1), (2), (3)) c(class) LEFT JOIN t USING (id) LEFT JOIN s ON s.id = ex.id AND s.class = c.class"""


@query(_HYBRID)
def hybrid_scores(spark, d):
    ex, v = lang(spark, d)
    p = lm.annotator_precision(ex.filter("split = 'val'"), v)
    return ag.hybrid_scores(ex, v, p, C).withColumn("p", six("p"))


_NB = f"""{tk.VOTES_SQL}, {tk.POOL_SQL}, cl(class) AS (VALUES (0), (1), (2), (3)), g AS (SELECT id, gold FROM ex WHERE split = 'val' AND gold IS NOT NULL),
  pri AS (SELECT class, count(g.id) AS n FROM cl LEFT JOIN g ON g.gold = class GROUP BY class), lp AS (SELECT class, n, ln((n + 1.0::DOUBLE) / (SELECT sum(n + 1) FROM pri)) AS lprior FROM pri),
  k AS (SELECT lf, vote, gold AS class, count(*) AS k FROM votes JOIN g USING (id) GROUP BY ALL), slots(vote) AS (VALUES (-1), (0), (1), (2), (3)),
  cnt AS (SELECT pool.lf, slots.vote, lp.class, lp.n, CASE WHEN slots.vote < 0 THEN lp.n - coalesce((SELECT sum(k) FROM k WHERE k.lf = pool.lf AND k.class = lp.class), 0) ELSE coalesce((SELECT k FROM k WHERE k.lf = pool.lf AND k.class = lp.class AND k.vote = slots.vote), 0) END AS c FROM pool CROSS JOIN slots CROSS JOIN lp),
  tab AS (SELECT lf, vote, class, ln((c + 1.0::DOUBLE) / (n + 5.0::DOUBLE)) AS lpv FROM cnt),
  sc AS (SELECT ex.id, ex.split, lp.class, lp.lprior + sum(tab.lpv) AS s FROM ex CROSS JOIN lp CROSS JOIN pool LEFT JOIN votes v ON v.id = ex.id AND v.lf = pool.lf JOIN tab ON tab.lf = pool.lf AND tab.class = lp.class AND tab.vote = coalesce(v.vote, -1) GROUP BY ex.id, ex.split, lp.class, lp.lprior),
  nb AS (SELECT id, split, class, exp(s - max(s) OVER (PARTITION BY id)) / sum(exp(s - m)) OVER (PARTITION BY id) AS p FROM (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM sc))"""


@query(f"WITH {_NB} SELECT id, split, class, round(p, 6) AS p FROM nb")
def naive_bayes_lm(spark, d):
    return lm.naive_bayes(*lang(spark, d), list(tk.LANG_RULES), C).withColumn("p", six("p"))


_TEMP = f"""WITH {_NB}, l AS (SELECT id, split, class, ln(greatest(least(p, 1.0), 1e-12)) AS l FROM nb), ts(t) AS (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.85::DOUBLE), (1.0::DOUBLE), (1.15::DOUBLE), (1.3::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)),
  e AS (SELECT id, split, t, class, exp(l / t) AS e, sum(exp(l / t)) OVER (PARTITION BY id, t) AS z FROM l CROSS JOIN ts),
  nll AS (SELECT t, sum(-ln(greatest(least(e / z, 1.0), 1e-12))) AS nll FROM e JOIN ex ON ex.id = e.id AND ex.gold = e.class WHERE e.split = 'val' GROUP BY t) SELECT t AS temperature, round(nll, 4) AS nll FROM nll ORDER BY nll.nll, t LIMIT 1"""


@query(_TEMP)
def temperature_scale(spark, d):
    ex, v = lang(spark, d)
    best, _ = lm.temperature(lm.naive_bayes(ex, v, list(tk.LANG_RULES), C), ex)
    return best.select("temperature", F.round("nll", 4).alias("nll"))


@query(f"WITH {tk.VOTES_SQL}, x AS (SELECT id, sum(n) AS depth, max(n) AS m FROM counts GROUP BY id) SELECT id, cast(depth AS BIGINT) AS depth, round(cast(m AS DOUBLE) / depth, 6) AS agreement, round(cast(m AS DOUBLE) / depth * log2(1 + depth), 6) AS weight FROM x")
def confidence_weights(spark, d):
    w = lm.log_loss_weight(lm.agreement(lang(spark, d)[1]))
    return w.select("id", "depth", six("agreement").alias("agreement"), six("weight").alias("weight"))
