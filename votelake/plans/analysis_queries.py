"""Queries of pool diagnostics, selection, evolution and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votelake.functions import text as tx
from votelake.operators import aggregate as ag
from votelake.operators import analyze as az
from votelake.operators import evolve as ev
from votelake.operators import metrics as mt
from votelake.operators import sampling as sm
from votelake.operators import select as sl
from votelake.operators import similarity as si
from votelake.plans import tasks as tk
from votelake.plans.label_queries import C, lang, six
from votelake.plans.registry import query

POOL = list(tk.LANG_RULES)
BUCKET = "CASE WHEN num_words < 6 THEN 'very_short' WHEN num_words < 15 THEN 'short' WHEN num_words < 30 THEN 'medium' ELSE 'long' END"
HASH = "((id % 2147483648) * 1103515245 + 12387) % 2147483648"


def stats_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ex, v = lang(spark, d)
    return ex, v, az.vote_stats(ex, v)


@query(f"WITH {tk.STATS_SQL} SELECT id, split, depth, label, disagree, round(entropy, 6) AS entropy, round(u, 6) AS u FROM st")
def vote_stats(spark, d):
    s = stats_of(spark, d)[2]
    return s.select("id", "split", "depth", "label", "disagree", six("entropy").alias("entropy"), six("u").alias("u"))


@query(f"WITH {tk.STATS_SQL} SELECT split, count(*) AS n_examples, count(*) FILTER (depth > 0) AS n_covered, cast(sum(depth) AS BIGINT) AS votes, round(cast(count(*) FILTER (depth > 0) AS DOUBLE) / count(*), 6) AS coverage, round(cast(sum(depth) AS DOUBLE) / count(*) FILTER (depth > 0), 6) AS mean_depth_covered FROM st GROUP BY split")
def pool_summary(spark, d):
    return az.pool_summary(stats_of(spark, d)[2]).withColumns({c: six(c) for c in ("coverage", "mean_depth_covered")})


@query(f"WITH {tk.STATS_SQL} SELECT gold AS class, count(*) AS n, count(*) FILTER (depth > 0) AS covered, round(cast(count(*) FILTER (depth > 0) AS DOUBLE) / count(*), 6) AS recall FROM st WHERE gold IS NOT NULL GROUP BY gold")
def class_recall(spark, d):
    return az.class_recall(stats_of(spark, d)[2]).withColumn("recall", six("recall"))


@query(f"WITH {tk.VOTES_SQL}, n AS (SELECT lf, vote, count(*) AS n FROM votes GROUP BY lf, vote), r AS (SELECT *, row_number() OVER (PARTITION BY lf ORDER BY n DESC, vote) AS k FROM n) SELECT vote AS class, count(*) AS n_lfs FROM r WHERE k = 1 GROUP BY vote")
def annotator_balance(spark, d):
    return az.annotator_balance(lang(spark, d)[1])


@query(f"WITH {tk.STATS_SQL} SELECT split, depth, count(*) AS n FROM st GROUP BY ALL")
def depth_histogram(spark, d):
    return az.depth_histogram(stats_of(spark, d)[2])


_GAP = f"""WITH {tk.STATS_SQL}, r AS (SELECT ex.*, depth = 0 AS unc, {BUCKET} AS length FROM ex JOIN st USING (id)),
  g AS (SELECT has_url, has_email, has_digit, has_pipe, length, gold, grouping(has_url) AS g1, grouping(has_email) AS g2, grouping(has_digit) AS g3, grouping(has_pipe) AS g4, grouping(length) AS g5, grouping(gold) AS g6, count(*) AS total, count(*) FILTER (unc) AS uncovered
    FROM r GROUP BY GROUPING SETS ((has_url), (has_email), (has_digit), (has_pipe), (length), (gold, length, has_url)))
SELECT CASE WHEN g6 = 0 THEN 'segment' WHEN g1 = 0 THEN 'has_url' WHEN g2 = 0 THEN 'has_email' WHEN g3 = 0 THEN 'has_digit' WHEN g4 = 0 THEN 'has_pipe' ELSE 'length' END AS feature,
  CASE WHEN g6 = 0 THEN coalesce(gold::VARCHAR, 'unknown') || '|' || length || '|' || has_url::VARCHAR WHEN g1 = 0 THEN has_url::VARCHAR WHEN g2 = 0 THEN has_email::VARCHAR WHEN g3 = 0 THEN has_digit::VARCHAR WHEN g4 = 0 THEN has_pipe::VARCHAR ELSE length END AS value,
  total, uncovered, round(cast(uncovered AS DOUBLE) / total, 6) AS gap_rate FROM g"""


@query(_GAP)
def coverage_gap(spark, d):
    ex, _, s = stats_of(spark, d)
    return az.coverage_gap(ex, s, tk.FEATURES).withColumn("gap_rate", six("gap_rate"))


@query(f"WITH {tk.STATS_SQL} SELECT gold AS class, count(*) AS n FROM st WHERE depth = 0 AND gold IS NOT NULL GROUP BY gold")
def uncovered_by_class(spark, d):
    return az.uncovered_by_class(stats_of(spark, d)[2])


@query(f"WITH {tk.STATS_SQL} SELECT split, count(*) FILTER (depth = 1) AS n_fragile, count(*) FILTER (depth >= 3) AS n_well_supported, count(*) FILTER (depth > 0) AS n_covered, round(cast(count(*) FILTER (depth = 1) AS DOUBLE) / count(*) FILTER (depth > 0), 6) AS fragile_fraction FROM st GROUP BY split")
def fragility(spark, d):
    return az.fragility(stats_of(spark, d)[2]).withColumn("fragile_fraction", six("fragile_fraction"))


@query(f"WITH {tk.STATS_SQL} SELECT id, split, gold, label, gold IS NOT NULL AND label >= 0 AND label <> gold AS misclassified, disagree AS conflict FROM st")
def error_rows(spark, d):
    return az.errors(stats_of(spark, d)[2])


@query(f"WITH {tk.STATS_SQL} SELECT lf, count(*) AS wrong_votes FROM votes JOIN st USING (id) WHERE st.gold IS NOT NULL AND st.label >= 0 AND st.label <> st.gold AND vote <> st.gold GROUP BY lf ORDER BY wrong_votes DESC, lf LIMIT 10")
def error_top_lfs(spark, d):
    _, v, s = stats_of(spark, d)
    return az.worst_annotators(s, v)


@query(f"""WITH {tk.STATS_SQL}, e AS (SELECT id, split, gold, label, coalesce(gold IS NOT NULL AND label <> -1 AND label <> gold, false) AS misclassified, disagree AS conflict, {HASH} AS h FROM st)
(SELECT id, split, gold, label, misclassified, conflict, 'misclassified' AS kind FROM e WHERE misclassified ORDER BY h, id LIMIT 20) UNION ALL (SELECT id, split, gold, label, misclassified, conflict, 'conflict' FROM e WHERE conflict ORDER BY h, id LIMIT 20)""")
def error_samples(spark, d):
    return az.error_samples(stats_of(spark, d)[2])


_OVERLAP = f"""{tk.VOTES_SQL}, f AS (SELECT lf, count(DISTINCT id) AS fires FROM votes GROUP BY lf), i AS (SELECT a.lf AS lf_a, b.lf AS lf_b, count(*) AS shared FROM votes a JOIN votes b ON a.id = b.id AND a.lf < b.lf GROUP BY a.lf, b.lf),
  ov AS (SELECT a.lf AS lf_a, b.lf AS lf_b, a.fires AS fires_a, b.fires AS fires_b, coalesce(shared, 0) AS shared, cast(coalesce(shared, 0) AS DOUBLE) / (a.fires + b.fires - coalesce(shared, 0)) AS jaccard FROM f a JOIN f b ON a.lf < b.lf LEFT JOIN i ON i.lf_a = a.lf AND i.lf_b = b.lf)"""


@query(f"WITH {_OVERLAP} SELECT lf_a, lf_b, fires_a, fires_b, shared, round(jaccard, 6) AS jaccard FROM ov")
def lf_overlap_pairs(spark, d):
    return az.overlap(lang(spark, d)[1]).withColumn("jaccard", six("jaccard"))


@query(f"WITH {tk.VOTES_SQL}, x AS (SELECT id, count(*) AS c FROM votes GROUP BY id) SELECT lf, count(*) AS fires, count(*) FILTER (c = 1) AS unique_fires FROM votes JOIN x USING (id) GROUP BY lf")
def marginal_coverage(spark, d):
    return az.coverage_detail(lang(spark, d)[1])


@query(f"WITH {tk.VOTES_SQL} SELECT count(DISTINCT id) AS covered, count(*) AS votes, round(cast(count(DISTINCT id) AS DOUBLE) / count(*), 6) AS efficiency FROM votes")
def coverage_efficiency(spark, d):
    return az.efficiency(lang(spark, d)[1]).withColumn("efficiency", six("efficiency"))


_KEYWORDS = f"""WITH {tk.EX_SQL}, t AS (SELECT gold AS g, {tk.tokens_sql("text")} AS tokens FROM ex), nt AS (SELECT g, count(*) AS n_t FROM t GROUP BY g), dt AS (SELECT g, w, count(*) AS df FROM (SELECT g, unnest(tokens) AS w FROM t) GROUP BY g, w HAVING count(*) >= 3),
  db AS (SELECT w, count(*) AS df_bg FROM (SELECT unnest(tokens) AS w FROM t) GROUP BY w), s AS (SELECT dt.g, dt.w, df, cast(df AS DOUBLE) / n_t / (cast(df_bg AS DOUBLE) / (SELECT count(*) FROM t) + 0.005::DOUBLE) AS score FROM dt JOIN nt USING (g) JOIN db USING (w)),
  r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, w) AS rank FROM s) SELECT g AS "group", w AS word, df, round(score, 6) AS score, cast(rank AS INTEGER) AS rank FROM r WHERE rank <= 15"""


@query(_KEYWORDS)
def keywords(spark, d):
    rows = tk.lang4(spark, d).select(F.col("gold").alias("group"), tx.tokens(F.col("text")).alias("tokens"))
    return az.counted_keywords(az.word_counts(rows).cache()).withColumn("score", six("score"))


_SEED = f"""{tk.STATS_SQL}, seed AS (SELECT id FROM ex ORDER BY {HASH}, id LIMIT 200), sd AS (SELECT gold AS class, count(*) AS n, count(*) FILTER (depth > 0) AS covered FROM st JOIN seed USING (id) WHERE gold IS NOT NULL GROUP BY gold),
  sds AS (SELECT class, n, cast(n AS DOUBLE) / (SELECT sum(n) FROM sd) AS pi, cast(covered AS DOUBLE) / n AS recall FROM sd)"""
_PRIORITY = f"""{_SEED}, pr AS (SELECT c.class, coalesce(pi, 0) AS pi, 1.0::DOUBLE / greatest(coalesce(recall, 0), 0.01) AS raw FROM (VALUES (0), (1), (2), (3)) c(class) LEFT JOIN sds USING (class)), al AS (SELECT class, pi, raw / (SELECT sum(raw) FROM pr) AS alpha FROM pr)"""
_IMPORTANCE = f"""{_PRIORITY}, e AS (SELECT CASE WHEN sum(pi * alpha) > 0 THEN sum(pi * alpha) ELSE avg(alpha) END AS e FROM al), mix AS (SELECT c.id, sum(cast(c.n AS DOUBLE) / s.depth * coalesce(al.alpha, (SELECT e FROM e))) AS m FROM counts c JOIN st s USING (id) LEFT JOIN al USING (class) GROUP BY c.id),
  iw AS (SELECT st.id, st.split, st.depth, st.label, st.disagree, st.u, CASE WHEN st.depth = 0 THEN (SELECT e FROM e) ELSE coalesce(al.alpha, CASE WHEN mix.m > 0 THEN mix.m END, (SELECT e FROM e)) END AS alpha FROM st LEFT JOIN al ON al.class = st.label LEFT JOIN mix ON mix.id = st.id)"""


def _seeded(spark, d):
    ex, v, s = stats_of(spark, d)
    seed = sm.uniform(ex.select("id"), 200)
    return ex, v, s, az.seed_stats(s, seed)


def _weights(spark, d):
    ex, v, s, seeded = _seeded(spark, d)
    return ex, v, s, az.importance(s, az.class_priority(seeded, tk.LANG.dimension(spark)))


@query(f"WITH {_SEED} SELECT class, n, round(pi, 6) AS pi, round(recall, 6) AS recall FROM sds")
def seed_stats(spark, d):
    return _seeded(spark, d)[3].withColumns({"pi": six("pi"), "recall": six("recall")})


@query(f"WITH {_PRIORITY} SELECT class, round(pi, 6) AS pi, round(alpha, 6) AS alpha FROM al")
def class_priority(spark, d):
    return az.class_priority(_seeded(spark, d)[3], tk.LANG.dimension(spark)).withColumns({"pi": six("pi"), "alpha": six("alpha")})


@query(f"WITH {_IMPORTANCE} SELECT id, split, depth, label, disagree, round(u, 6) AS u, round(alpha, 6) AS alpha, round(u * alpha, 6) AS w FROM iw")
def importance_weights(spark, d):
    return _weights(spark, d)[3].withColumns({c: six(c) for c in ("u", "alpha", "w")})


@query(f"""WITH {_IMPORTANCE}, x AS (SELECT *, u * alpha AS w FROM iw) SELECT least(depth, 3)::VARCHAR AS bucket, round(sum(w), 4) AS mass, count(*) AS n FROM x GROUP BY 1
UNION ALL SELECT 'disagree', round(coalesce(sum(w), 0), 4), count(*) FROM x WHERE disagree""")
def depth_mass(spark, d):
    return az.weight_mass(_weights(spark, d)[3]).withColumn("mass", F.round("mass", 4))


@query("""WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), q AS (SELECT unnest([0.0::DOUBLE, 0.1::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE]) AS q)
SELECT q, value FROM q JOIN v ON v.k = cast(round_even(q * (n - 1), 0) AS BIGINT)""")
def nearest_rank_quantiles(spark, d):
    return az.quantiles(spark.read.parquet(f"{d}/events.parquet"), "value", [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])


_TARGETS = f"""{tk.STATS_SQL}, rc AS (SELECT gold AS class, cast(count(*) FILTER (depth > 0) AS DOUBLE) / count(*) AS recall FROM st WHERE gold IS NOT NULL GROUP BY gold),
  cw AS (SELECT class, 1.0::DOUBLE / greatest(recall, 0.01) * (SELECT count(*) FROM rc) / (SELECT sum(1.0::DOUBLE / greatest(recall, 0.01)) FROM rc) AS class_weight FROM rc),
  sg AS (SELECT CASE WHEN st.depth = 0 THEN 'uncovered' ELSE 'fragile' END AS target_type, st.gold AS class, CASE WHEN st.depth = 0 THEN {BUCKET} ELSE '' END AS detail, count(*) AS n_examples FROM st JOIN ex USING (id) WHERE st.gold IS NOT NULL AND st.depth <= 1 GROUP BY ALL),
  tg AS (SELECT sg.*, class_weight, n_examples * class_weight * CASE WHEN target_type = 'uncovered' THEN 1.0 ELSE 0.5 END AS value FROM sg JOIN cw USING (class))"""


@query(f"WITH {_TARGETS} SELECT target_type, class, detail, n_examples, round(class_weight, 6) AS class_weight, round(value, 6) AS value FROM tg")
def improvement_targets(spark, d):
    ex, _, s = stats_of(spark, d)
    return az.improvement_targets(ex, s).withColumns({"class_weight": six("class_weight"), "value": six("value")})


_RECS = f"""WITH {_TARGETS}, fr AS (SELECT count(*) AS n, count(*) FILTER (depth > 0) AS c, count(*) FILTER (depth = 1 AND gold IS NOT NULL) AS f FROM st),
  a AS (SELECT 'class_gap' AS type, class::VARCHAR AS subject, recall AS value, 1 AS o1, recall AS o2 FROM rc WHERE recall < 0.5
  UNION ALL SELECT 'low_coverage', '', cast(c AS DOUBLE) / n, 2, 0 FROM fr WHERE cast(c AS DOUBLE) / n < 0.7
  UNION ALL SELECT 'fragile_labels', '', cast(f AS DOUBLE) / greatest(c, 1), 3, 0 FROM fr WHERE cast(f AS DOUBLE) / greatest(c, 1) > 0.3
  UNION ALL SELECT * FROM (SELECT 'target_segment', target_type || '_' || class::VARCHAR || CASE WHEN detail = '' THEN '' ELSE '_' || detail END AS sj, value, 5, -value FROM tg ORDER BY value DESC, sj LIMIT 3))
SELECT cast(row_number() OVER (ORDER BY o1, o2, subject) AS INTEGER) AS priority, type, subject, round(value, 6) AS value FROM a"""


@query(_RECS)
def recommendations(spark, d):
    ex, v, s = stats_of(spark, d)
    return az.recommendations(s, az.improvement_targets(ex, s), pairs=az.overlap(v)).withColumn("value", six("value"))


# --------------------------------------------------------- memory, from events

_EVENT_CLASS = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 4 END"


def _event_log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "error", 3).otherwise(4)
    return e.select("event_id", "user_id", kind.alias("class"), (F.col("event_id") % 12).cast("int").alias("iter"), "value")


@query("SELECT user_id AS id, count(DISTINCT event_id % 12) AS age FROM events WHERE event_type = 'error' GROUP BY user_id")
def carry_over_age(spark, d):
    return az.carry_over(_event_log(spark, d).filter("class = 3").select("iter", F.col("user_id").alias("id")))


@query(f"WITH e AS (SELECT event_id, {_EVENT_CLASS} AS class FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY event_id DESC) AS k FROM e) SELECT event_id, class FROM r WHERE k <= 15")
def last_events(spark, d):
    return az.last_per_key(_event_log(spark, d).select("event_id", "class"), "class", F.col("event_id"), 15)


@query(f"""WITH e AS (SELECT {_EVENT_CLASS} AS class, cast(event_id % 12 AS INTEGER) AS iter, max(value) AS f1 FROM events GROUP BY ALL), b AS (SELECT class, max(f1) AS best, max(iter) AS last FROM e GROUP BY class)
SELECT b.class, best AS best_f1, cast(last - (SELECT min(iter) FROM e WHERE e.class = b.class AND e.f1 = b.best) AS INTEGER) AS stagnant_iters, last - (SELECT min(iter) FROM e WHERE e.class = b.class AND e.f1 = b.best) >= 2 AS stagnant FROM b""")
def stagnant_classes(spark, d):
    return az.stagnant(_event_log(spark, d).groupBy("class", "iter").agg(F.max("value").alias("f1")))


@query(f"""WITH e AS (SELECT {_EVENT_CLASS} AS class, event_id % 12 AS iter, max(value) >= 40 AS ok FROM events GROUP BY ALL), l AS (SELECT class, coalesce(max(iter) FILTER (ok), -1) AS last_ok FROM e GROUP BY class)
SELECT e.class, count(*) FILTER (iter > last_ok) AS streak FROM e JOIN l USING (class) GROUP BY e.class""")
def fail_streak(spark, d):
    return az.fail_streak(_event_log(spark, d).groupBy("class", "iter").agg((F.max("value") >= 40).alias("ok")))


@query(f"""WITH e AS (SELECT {_EVENT_CLASS} AS class, cast(event_id % 12 AS INTEGER) AS iter, count(*) AS n FROM events GROUP BY ALL) SELECT class, iter, n, n - lag(n) OVER (PARTITION BY class ORDER BY iter) AS delta FROM e""")
def iteration_delta(spark, d):
    n = _event_log(spark, d).groupBy("class", "iter").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy("class").orderBy("iter")))


# -------------------------------------------------------------------- selection

_N = ", ".join(f"count(*) FILTER (vote = {c}) AS n{c}" for c in range(C))
_P = ["(n{0} * 0.9::DOUBLE + (dd - n{0}) * (0.1::DOUBLE / 3) + (9 - dd) * 0.25::DOUBLE) / 9.0::DOUBLE".format(c) for c in range(C)]
_HP = " + ".join(f"(-({p}) * ln({p} + 1e-12))" for p in _P)
_HF = "(-0.9::DOUBLE * ln(0.9::DOUBLE + 1e-12) + 3 * (-(0.1::DOUBLE / 3) * ln(0.1::DOUBLE / 3 + 1e-12)))"
_HPR = "(4 * (-0.25::DOUBLE * ln(0.25::DOUBLE + 1e-12)))"
_BALD = f"""{tk.VOTES_SQL}, n AS (SELECT id, {_N}, count(*) AS dd FROM votes GROUP BY id), z AS (SELECT ex.id, {", ".join(f"coalesce(n{c}, 0) AS n{c}" for c in range(C))}, coalesce(dd, 0) AS dd FROM ex LEFT JOIN n USING (id)),
  bd AS (SELECT id, dd AS depth, round({_HP} - (dd * {_HF} + (9 - dd) * {_HPR}) / 9.0::DOUBLE, 6) + 0.0 AS bald FROM z)"""


def _bald(spark, d):
    ex, v = lang(spark, d)
    return ex, v, sl.bald(ex, v, [0.25] * C, len(POOL)).withColumn("bald", six("bald") + 0.0)


@query(f"WITH {_BALD} SELECT id, depth, bald FROM bd")
def bald_scores(spark, d):
    return _bald(spark, d)[2].select("id", "depth", "bald")


@query(f"WITH {_BALD}, a AS (SELECT user_id AS id, count(DISTINCT event_id % 12) AS age FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT bd.id, round(bald * (1 + 0.1::DOUBLE * least(coalesce(age, 0), 4)), 6) + 0.0 AS bald FROM bd LEFT JOIN a USING (id)")
def bald_carry_over(spark, d):
    ages = carry_over_age(spark, d)
    return sl.boost(_bald(spark, d)[2].select("id", "bald"), ages).select("id", (six("bald") + 0.0).alias("bald"))


@query(f"WITH {_BALD} SELECT id, depth, bald FROM bd ORDER BY bald DESC, id LIMIT 480")
def bald_prefilter(spark, d):
    return sl.prefilter(_bald(spark, d)[2], 60).select("id", "depth", "bald")


_MVB = _BALD + ", tops AS (SELECT id, max(n) AS top FROM counts GROUP BY id), won AS (SELECT c.id, min(c.class) AS class, count(*) AS w FROM counts c JOIN tops t ON c.id = t.id AND c.n = t.top GROUP BY c.id)"


@query(f"""WITH {_MVB}, c AS (SELECT bd.id, bald, coalesce(CASE WHEN w = 1 THEN class END, -1) AS label FROM (SELECT * FROM bd ORDER BY bald DESC, id LIMIT 480) bd LEFT JOIN won USING (id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY bald DESC, id) AS k FROM c WHERE label >= 0) SELECT id, bald, label FROM r WHERE k <= 2 ORDER BY bald DESC, id LIMIT 60""")
def bald_class_floor(spark, d):
    ex, v, b = _bald(spark, d)
    cand = sl.prefilter(b, 60).select("id", "bald").join(ag.majority(ex, v).select("id", "label"), "id")
    return sl.class_floor(cand, 60, 2)


@query(f"WITH {_IMPORTANCE}, x AS (SELECT id, round(u * alpha, 6) AS w FROM iw ORDER BY round(u * alpha, 6) DESC, id LIMIT 60) SELECT id, w, cast(row_number() OVER (ORDER BY w DESC, id) AS INTEGER) AS rank FROM x")
def uncertainty_topk(spark, d):
    return sl.top_k(_weights(spark, d)[3].select("id", six("w").alias("w")), "w", 60)


@query(f"WITH {_IMPORTANCE}, x AS (SELECT id, round(u * alpha, 6) AS w FROM iw ORDER BY round(u * alpha, 6) DESC, id LIMIT 60) SELECT id, w, round(percent_rank() OVER (ORDER BY w), 6) AS percentile FROM x")
def percentile_rank(spark, d):
    top = _weights(spark, d)[3].select("id", six("w").alias("w")).orderBy(F.desc("w"), "id").limit(60)
    return sl.percentile_rank(top, "w").withColumn("percentile", six("percentile"))


@query()
def batch_selection(spark, d):
    ex, v, b = _bald(spark, d)
    cand = sl.prefilter(b, 20).select("id", "bald").join(ag.majority(ex, v).select("id", "label"), "id")
    picked = sl.batch_mutual_information(cand, v, POOL, [1.0 / C] * C, 20, floor=2, samples=200)
    return spark.createDataFrame([(i, x, float(g)) for i, (x, g) in enumerate(picked, 1)], "rank int, id bigint, gain double")


# --------------------------------------------------------------------- clusters

_CENTERS = f"""{_IMPORTANCE}, wt AS (SELECT id, round(u * alpha, 6) AS w FROM iw), top AS (SELECT id, w FROM wt ORDER BY w DESC, id LIMIT 12), ctr AS (SELECT id, row_number() OVER (ORDER BY w DESC, id) AS rank FROM top),
  tok AS (SELECT id, {tk.tokens_sql("text")} AS t FROM ex), sm AS (SELECT a.id, c.id AS center, c.rank, CASE WHEN len(a.t) + len(b.t) = 0 THEN 0.0::DOUBLE ELSE cast(len(list_intersect(a.t, b.t)) AS DOUBLE) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END AS sim FROM tok a CROSS JOIN ctr c JOIN tok b ON b.id = c.id),
  near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, rank) AS k FROM sm) WHERE k = 1)"""


def _centered(spark, d):
    """(id, center, sim, t) with a document's words in t, and the weights; both are read several times."""
    ex, v, s, w = _weights(spark, d)
    w = w.withColumn("w", six("w")).cache()
    # twelve rows; their words are taken after the join
    top = sl.top_k(w.select("id", "w"), "w", 12)
    centers = ex.select("id", "text").join(F.broadcast(top), "id").select(F.col("id").alias("center"), "rank", tx.tokens(F.col("text")).alias("t"))
    tokens = ex.select("id", tx.tokens(F.col("text")).alias("t"))
    return si.nearest_center(tokens, centers.cache(), lambda c: tx.jaccard_sets(F.col("t"), c["t"]), keep=("t",)), w


def _assigned(spark, d):
    near, w = _centered(spark, d)
    return near.drop("t").cache(), w


@query(f"WITH {_CENTERS} SELECT id, center, round(sim, 6) AS sim FROM near")
def nearest_center(spark, d):
    return _assigned(spark, d)[0].withColumn("sim", six("sim"))


@query(f"""WITH {_CENTERS} SELECT center, count(*) AS size, round(sum(wt.w), 4) AS mass, round(avg(cast(st.depth = 0 AS INT)), 6) AS uncovered_fraction, round(avg(cast(st.depth = 1 AS INT)), 6) AS fragile_fraction, round(avg(cast(st.disagree AS INT)), 6) AS disagree_fraction
FROM near JOIN st USING (id) JOIN wt USING (id) GROUP BY center""")
def cluster_summary(spark, d):
    s, _ = az.clusters(*_assigned(spark, d))
    return s.select("center", "size", F.round("mass", 4).alias("mass"), *[six(c).alias(c) for c in ("uncovered_fraction", "fragile_fraction", "disagree_fraction")])


@query(f"WITH {_CENTERS}, r AS (SELECT center, near.id, w, row_number() OVER (PARTITION BY center ORDER BY w DESC, near.id) AS rank FROM near JOIN wt USING (id)) SELECT center, cast(rank AS INTEGER) AS rank, id, w FROM r WHERE rank <= 6")
def cluster_examples(spark, d):
    return az.clusters(*_assigned(spark, d))[1].select("center", "rank", "id", "w")


# --------------------------------------------------------------- pool evolution


def _metrics(spark, d):
    return mt.annotator_metrics(*lang(spark, d), tk.pool_frame(spark, tk.LANG_RULES))


@query(f"WITH {tk.METRICS_SQL} SELECT lf, fires, round(precision, 6) AS precision FROM lfm WHERE split = 'val' AND coalesce(precision, 0) >= 0.5 AND fires >= 5")
def candidate_gate(spark, d):
    return ev.threshold_gate(_metrics(spark, d).filter("split = 'val'"), 0.5, 5).select("lf", "fires", six("precision").alias("precision"))


@query(f"WITH {tk.METRICS_SQL}, g AS (SELECT lf, max(precision) FILTER (split = 'val') AS val, max(precision) FILTER (split = 'train') AS train FROM lfm GROUP BY lf) SELECT lf, round(val, 6) AS val, round(train, 6) AS train, round(coalesce(val, 0) - coalesce(train, 0), 6) AS gap FROM g WHERE coalesce(val, 0) - coalesce(train, 0) <= 0.005")
def train_val_gap(spark, d):
    return ev.consistency_gate(_metrics(spark, d), 0.005).withColumns({c: six(c) for c in ("val", "train", "gap")})


@query(f"WITH {tk.METRICS_SQL} SELECT lf, round(precision, 6) AS precision, round(coverage, 6) AS coverage FROM lfm WHERE split = 'train' AND precision >= 0.55 AND coverage > 0 AND coverage <= 0.13 ORDER BY precision DESC, lf LIMIT 6")
def refine_targets(spark, d):
    return ev.refine_targets(_metrics(spark, d).filter("split = 'train'"), max_coverage=0.13).select("lf", six("precision").alias("precision"), six("coverage").alias("coverage"))


@query(f"WITH {tk.PRF_SQL} SELECT class, round(coalesce(f1, 0), 6) AS f1 FROM prf WHERE split = 'val' AND coalesce(f1, 0) < 0.9999 AND class <> 1 ORDER BY coalesce(f1, 0), class LIMIT 3")
def low_f1_targets(spark, d):
    ex, v = lang(spark, d)
    f1 = mt.prf(mt.confusion(ex, ag.majority(ex, v))).filter("split = 'val'").select("class", "f1")
    return ev.low_f1_targets(f1, [1], 0.9999).withColumn("f1", six("f1"))


_NEW = ("lf_de_chars", "lf_es_chars", "lf_fr_chars", "lf_en_function_words")
_SUBSUME = f"""WITH {_OVERLAP}, p AS (SELECT lf, cast(count(*) FILTER (vote = gold) AS DOUBLE) / count(*) AS precision FROM votes JOIN ex USING (id, split) GROUP BY lf), nw(lf) AS (VALUES {", ".join(f"('{n}')" for n in _NEW)}),
  sides AS (SELECT lf_a AS old, lf_b AS new, jaccard, cast(shared AS DOUBLE) / fires_a AS cov FROM ov UNION ALL SELECT lf_b, lf_a, jaccard, cast(shared AS DOUBLE) / fires_b FROM ov)
SELECT old AS lf, min(new) AS by FROM sides JOIN p a ON a.lf = old JOIN p b ON b.lf = new WHERE new IN (SELECT lf FROM nw) AND old NOT IN (SELECT lf FROM nw) AND (jaccard >= 0.6 OR cov >= 0.6) AND b.precision >= a.precision + 0.005 GROUP BY old"""


@query(_SUBSUME)
def subsumption(spark, d):
    ex, v = lang(spark, d)
    p = v.join(ex.select("id", "gold"), "id").groupBy("lf").agg((F.count_if(F.col("vote") == F.col("gold")).cast("double") / F.count(F.lit(1))).alias("precision"))
    return ev.subsumed(v, p, spark.createDataFrame([(n,) for n in _NEW], "lf string"), 0.6, 0.005, 0.6)


@query(f"""WITH {tk.METRICS_SQL}, v AS (SELECT * FROM lfm WHERE split = 'val'), g AS (SELECT lf, coalesce(max(precision) FILTER (split = 'val'), 0) - coalesce(max(precision) FILTER (split = 'train'), 0) AS gap FROM lfm GROUP BY lf)
SELECT lf, CASE WHEN NOT (coalesce(precision, 0) >= 0.5 AND fires >= 5) THEN 'threshold' ELSE 'gap' END AS reason FROM v JOIN g USING (lf) WHERE NOT (coalesce(precision, 0) >= 0.5 AND fires >= 5) OR gap > 0.005""")
def kill_log(spark, d):
    m = _metrics(spark, d)
    scored = m.filter("split = 'val'")
    a, b = ev.threshold_gate(scored, 0.5, 5), ev.consistency_gate(m, 0.005)
    kept = a.join(b.select("lf"), "lf", "left_semi")
    return ev.kill_log(scored, kept, [("threshold", a), ("gap", b)]).select("lf", "reason")


def _greedy_sql(limit: float) -> str:
    """Candidates in name order, each against the pool and those kept before it."""
    steps = [f"k0 AS (SELECT lf FROM f WHERE lf NOT IN ({', '.join(repr(n) for n in _NEW)}))"]
    for i, n in enumerate(sorted(_NEW)):
        near = f"SELECT 1 FROM ov JOIN k{i} p ON (lf_a = '{n}' AND lf_b = p.lf) OR (lf_b = '{n}' AND lf_a = p.lf) WHERE jaccard > {limit}"
        steps.append(f"k{i + 1} AS (SELECT lf FROM k{i} UNION ALL SELECT lf FROM f WHERE lf = '{n}' AND NOT EXISTS ({near}))")
    return f"WITH {_OVERLAP}, {', '.join(steps)} SELECT lf FROM k{len(_NEW)} WHERE lf NOT IN (SELECT lf FROM k0)"


@query(_greedy_sql(0.8))
def jaccard_greedy(spark, d):
    v = lang(spark, d)[1]
    new = F.col("lf").isin(*_NEW)
    kept = ev.greedy_jaccard(v.filter(~new), v.filter(new), 0.8)
    return spark.createDataFrame([(n,) for n in kept], "lf string")


@query()
def pool_ablation(spark, d):
    ex, v = lang(spark, d)
    dropped = ev.ablate(ex.filter("split = 'val'"), v.filter("split = 'val'"), POOL, C)
    return spark.createDataFrame([(i, n) for i, n in enumerate(dropped)], "step int, lf string")


# --------------------------------------------------------------------- sampling


@query(f"WITH {tk.EX_SQL} SELECT id, gold FROM ex ORDER BY {HASH}, id LIMIT 100")
def uniform_sample(spark, d):
    return sm.uniform(tk.lang4(spark, d).select("id", "gold"), 100)


@query(f"WITH {tk.EX_SQL}, r AS (SELECT id, gold, row_number() OVER (PARTITION BY gold ORDER BY {HASH}, id) AS k FROM ex) SELECT id, gold FROM r WHERE k <= 8")
def per_class_sample(spark, d):
    return sm.per_class(tk.lang4(spark, d).select("id", "gold"), 8)


@query(f"WITH {tk.EX_SQL}, r AS (SELECT id, gold, {HASH} AS h, row_number() OVER (PARTITION BY gold ORDER BY {HASH}, id) AS k FROM ex) SELECT id, gold FROM r ORDER BY cast(k > 50 AS INT), h, id LIMIT 203")
def stratified_equal(spark, d):
    return sm.stratified_equal(tk.lang4(spark, d).select("id", "gold"), 203, C)


@query(f"""WITH {tk.EX_SQL}, s AS (SELECT gold, greatest(1, cast(round_even(cast(count(*) AS DOUBLE) / (SELECT count(*) FROM ex) * 150, 0) AS BIGINT)) AS q FROM ex GROUP BY gold),
  r AS (SELECT id, ex.gold, {HASH} AS h, row_number() OVER (PARTITION BY ex.gold ORDER BY {HASH}, id) AS k, q FROM ex JOIN s USING (gold)) SELECT id, gold FROM r ORDER BY cast(k > q AS INT), h, id LIMIT 150""")
def stratified_proportional(spark, d):
    return sm.stratified_proportional(tk.lang4(spark, d).select("id", "gold"), 150)


@query(f"""WITH {tk.EX_SQL}, f AS (SELECT least(5, greatest(2, min(c))) AS folds FROM (SELECT count(*) AS c FROM ex GROUP BY gold)) SELECT id, gold, cast(f.folds AS BIGINT) AS folds, cast((row_number() OVER (PARTITION BY gold ORDER BY {HASH}, id) - 1) % f.folds AS INTEGER) AS fold FROM ex, f""")
def kfold(spark, d):
    k = sm.k_folds(tk.lang4(spark, d).select("id", "gold"))
    return k.select("id", "gold", F.col("folds").cast("long").alias("folds"), "fold")


@query(f"""WITH {tk.EX_SQL}, h AS (SELECT id, cast({HASH} AS DOUBLE) / 2147483648.0::DOUBLE AS frac, {HASH} AS h FROM ex), s AS (SELECT id, h, CASE WHEN frac < 0.8 THEN 'train' WHEN frac < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split FROM h),
  r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY h, id) AS k FROM s) SELECT id, split FROM r WHERE split <> 'val' OR k <= 50""")
def rank_split(spark, d):
    return sm.rank_split(tk.lang4(spark, d).select("id"), val_cap=50)


@query(f"""WITH {tk.EX_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY {HASH}, id) AS k, count(*) OVER () AS n FROM ex), s AS (SELECT id, k, n, CASE WHEN k <= floor(0.8::DOUBLE * n) THEN 'train' WHEN k <= floor(0.8::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM r)
SELECT id, split FROM s WHERE split <> 'val' OR k <= floor(0.8::DOUBLE * n) + 50""")
def exact_split(spark, d):
    return sm.exact_split(tk.lang4(spark, d).select("id"), val_cap=50)


@query(f"WITH {tk.EX_SQL}, r AS (SELECT id, gold, {HASH} AS h, row_number() OVER (PARTITION BY gold ORDER BY {HASH}, id) AS k FROM ex WHERE gold IS NOT NULL) SELECT id, gold FROM r WHERE k <= 25 ORDER BY h, id LIMIT 102")
def stratified_clean(spark, d):
    return sm.stratified_clean(tk.lang4(spark, d).select("id", "gold"), 102, C)


@query(f"WITH {tk.EX_SQL} SELECT id, gold FROM ex WHERE split = 'val' ORDER BY id LIMIT 50")
def first_rows(spark, d):
    return sm.first_n(tk.lang4(spark, d).filter("split = 'val'").select("id", "gold"), 50, "id")
