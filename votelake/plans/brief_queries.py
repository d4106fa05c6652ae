"""Queries of claim enrichment, briefs for a language model, memory, and aggregation by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from votelake.functions import text as tx
from votelake.operators import analyze as az
from votelake.operators import enrich as en
from votelake.operators import labelmodel as lm
from votelake.plans import aggregation as agg
from votelake.plans import prompts as pr
from votelake.plans import tasks as tk
from votelake.plans.analysis_queries import _CENTERS, _EVENT_CLASS, _centered, _event_log
from votelake.plans.label_queries import C, lang, six
from votelake.plans.registry import query
from votelake.plans.text_queries import _turn_pairs

#: A lexicon of opposites to try the operator with; a full one is a table of the same form.
OPPOSITES = (
    ("good", "bad"), ("big", "small"), ("hot", "cold"), ("new", "old"), ("first", "last"), ("true", "false"),
    ("open", "closed"), ("high", "low"), ("fast", "slow"), ("more", "less"), ("before", "after"), ("always", "never"),
    ("can", "cannot"), ("with", "without"), ("all", "none"), ("this", "that"), ("yes", "not"), ("start", "end"),
)

_PAIR_SQL = "p AS (SELECT a.conv_id || '-' || a.turn AS id, a.text AS ca, b.text AS ev FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"


def pairs(spark, d):
    return _turn_pairs(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "claim", "evidence")


def opposites(spark):
    return spark.createDataFrame([*OPPOSITES, *((b, a) for a, b in OPPOSITES)], "word string, antonym string")


# ------------------------------------------------------------------- enrichment


_SEMANTIC = f"""WITH {_PAIR_SQL}, d AS (SELECT id, 'c' AS s, ca AS t FROM p UNION ALL SELECT id, 'e', ev FROM p), w AS (SELECT id, s, regexp_extract_all(strip_accents(lower(coalesce(t, ''))), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM d),
  g AS (SELECT id, s, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), c AS (SELECT id, s, term, count(*) AS c FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM c GROUP BY term), n AS (SELECT count(*) AS n FROM d),
  x AS (SELECT id, s, term, (1 + ln(c)) * (ln((n + 1)::DOUBLE / (df + 1)) + 1) AS x FROM c JOIN df USING (term), n WHERE df >= 2 AND df <= 0.95::DOUBLE * n), m AS (SELECT id, s, sqrt(sum(x * x)) AS m FROM x GROUP BY id, s), u AS (SELECT id, s, term, x / m AS v FROM x JOIN m USING (id, s)),
  dots AS (SELECT a.id, sum(a.v * b.v) AS v FROM u a JOIN u b ON a.id = b.id AND a.term = b.term WHERE a.s = 'c' AND b.s = 'e' GROUP BY a.id)
SELECT p.id, round(least(1, coalesce(dots.v, 0)), 6) AS sim_semantic FROM p LEFT JOIN dots USING (id)"""


@query(_SEMANTIC)
def semantic_similarity(spark, d):
    return en.semantic_similarity(pairs(spark, d)).select("id", six("sim_semantic").alias("sim_semantic"))


_LEXICON_SQL = "lex(word, antonym) AS (VALUES " + ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in OPPOSITES) + ")"


@query(rf"""WITH {_PAIR_SQL}, {_LEXICON_SQL}, w AS (SELECT id, list_filter(string_split_regex(lower(ca), '\s+'), lambda x: len(x) > 2) AS cw, list_filter(string_split_regex(lower(ev), '\s+'), lambda x: len(x) > 2) AS ew FROM p),
  e AS (SELECT id, ew, unnest(cw) AS word, generate_subscripts(cw, 1) AS k FROM w), h AS (SELECT DISTINCT e.id, e.k FROM e JOIN lex USING (word) WHERE list_contains(e.ew, lex.antonym))
SELECT p.id, cast((SELECT count(*) FROM h WHERE h.id = p.id) AS INTEGER) AS antonym_score_ext FROM p""")
def antonym_score(spark, d):
    return en.antonyms(pairs(spark, d), opposites(spark)).select("id", "antonym_score_ext")


@query(f"""WITH {_PAIR_SQL}, w AS (SELECT id, lower(ev) AS ev, list_transform(regexp_extract_all(ca, '[A-Za-z]{{2,}}'), lambda x: lower(x)) AS w FROM p), r AS (SELECT id, ev, coalesce(w[1], '') AS claim_subj, coalesce(w[2], '') AS claim_verb, CASE WHEN len(w) > 2 THEN w[len(w)] ELSE '' END AS claim_obj FROM w)
SELECT id, claim_subj, claim_verb, claim_obj, claim_subj <> '' AND contains(ev, claim_subj) AS subj_in_evidence, claim_verb <> '' AND contains(ev, claim_verb) AS verb_in_evidence, claim_obj <> '' AND contains(ev, claim_obj) AS obj_in_evidence FROM r""")
def role_containment(spark, d):
    return en.role_containment(pairs(spark, d), en.positional_roles).drop("claim", "evidence")


@query(f"WITH {tk.DOC_SQL} SELECT id, has_url, has_email, has_digit, has_pipe, CASE WHEN num_words < 6 THEN 'very_short' WHEN num_words < 15 THEN 'short' WHEN num_words < 30 THEN 'medium' ELSE 'long' END AS text_length, num_words, cast(length(regexp_replace(text, '[^!]', '', 'g')) AS INTEGER) AS num_exclamation FROM doc")
def feature_profile(spark, d):
    return az.feature_profile(tk.lang4(spark, d), tk.FEATURES).select("id", "profile.*")


# ----------------------------------------------------------------------- briefs


_WORDS_SQL = f"""{_CENTERS}, bg AS (SELECT w, count(*) AS dfb FROM (SELECT unnest(t) AS w FROM tok) GROUP BY w), nb AS (SELECT count(*) AS nb FROM tok), nt AS (SELECT center, count(*) AS nt FROM near GROUP BY center),
  dt AS (SELECT center, w, count(*) AS df FROM (SELECT center, unnest(t) AS w FROM near JOIN tok USING (id)) GROUP BY ALL HAVING count(*) >= 3),
  kw AS (SELECT center, w, df, row_number() OVER (PARTITION BY center ORDER BY (df::DOUBLE / nt) / (dfb::DOUBLE / nb + 0.005::DOUBLE) DESC, w) AS k FROM dt JOIN nt USING (center) JOIN bg USING (w), nb)"""


def _cluster_words(near):
    """Every document has a centre, so its words are counted beside it: no text is shuffled."""
    return az.counted_keywords(az.word_counts(near.select(F.col("center").alias("group"), F.col("t").alias("tokens"))).cache(), pr.WORDS)


@query(f"WITH {_WORDS_SQL} SELECT center, w AS word, df, cast(k AS INTEGER) AS rank FROM kw WHERE k <= 10")
def cluster_keywords(spark, d):
    return _cluster_words(_centered(spark, d)[0]).select(F.col("group").alias("center"), "word", "df", "rank")


_NAMES = "['" + "', '".join(tk.LANG.classes) + "']"


@query(f"""WITH {_WORDS_SQL}, mass AS (SELECT center, sum(w) AS mass FROM near JOIN wt USING (id) GROUP BY center), pos AS (SELECT *, row_number() OVER (ORDER BY round(mass, 6) DESC, center) AS position FROM mass),
  lb AS (SELECT center, label, count(*) AS n FROM near JOIN st USING (id) WHERE label <> -1 GROUP BY ALL), tl AS (SELECT center, label FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY n DESC, label) AS k FROM lb) WHERE k = 1),
  sx AS (SELECT center, near.id, row_number() OVER (PARTITION BY center ORDER BY w DESC, near.id) AS k FROM near JOIN wt USING (id)), sh AS (SELECT center, string_agg('  - ' || substr(trim(replace(text, chr(10), ' ')), 1, 300), chr(10) ORDER BY k) AS t FROM sx JOIN ex ON ex.id = sx.id WHERE k <= 6 GROUP BY center),
  sw AS (SELECT center, 'words: ' || string_agg(w, ', ' ORDER BY k) AS t FROM kw WHERE k <= 10 GROUP BY center)
SELECT cast(position AS INTEGER) AS position, CASE WHEN label IS NULL THEN 'Cluster ' || position || ': mostly without votes' ELSE 'Cluster ' || position || ': class ' || label || ' (' || {_NAMES}[label + 1] || ')' END || coalesce(chr(10) || sw.t, '') || coalesce(chr(10) || sh.t, '') AS text
FROM pos LEFT JOIN tl USING (center) LEFT JOIN sw USING (center) LEFT JOIN sh USING (center) WHERE position <= 6""")
def cluster_brief(spark, d):
    near, w = _centered(spark, d)
    summary, top = az.clusters(near.drop("t").cache(), w)
    # six rows a cluster
    examples = tk.lang4(spark, d).select("id", "text").join(F.broadcast(top), "id")
    return pr.render_clusters(summary.withColumn("mass", six("mass")), _cluster_words(near), examples, tk.LANG)


@query(f"""WITH e AS (SELECT {_EVENT_CLASS} AS class, event_id, cast(event_id % 12 AS INTEGER) AS iter, event_type, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY event_id DESC) AS k FROM e),
  n AS (SELECT class, count(*) AS n_events FROM e GROUP BY class)
SELECT n.class, n.n_events, 'F1: ' || (SELECT string_agg(printf('%.3f', cast((event_id % 1000) AS DOUBLE) / 1000), ', ' ORDER BY event_id) FROM r WHERE r.class = n.class AND k <= 8) || chr(10) ||
  (SELECT string_agg('lf_' || event_id || ' (round ' || iter || '): ' || event_type, chr(10) ORDER BY event_id) FROM r WHERE r.class = n.class AND k <= 15) AS text FROM n""")
def reflection_texts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    log = _event_log(spark, d).join(e, "event_id")
    dropped = log.select(F.col("event_id").alias("seq"), "class", F.concat(F.lit("lf_"), F.col("event_id")).alias("name"), "iter", F.col("event_type").alias("reason"))
    scores = log.select(F.col("event_id").alias("seq"), "class", ((F.col("event_id") % 1000).cast("double") / 1000).alias("f1"))
    return pr.reflection_texts(dropped, scores)


_HISTORY = f"e AS (SELECT {_EVENT_CLASS} AS class, cast(event_id % 12 AS INTEGER) AS iter, max(value) / 1000 AS f1, count(*) AS n FROM events GROUP BY ALL)"


def _memory(spark, d):
    log = _event_log(spark, d)
    history = log.groupBy("class", "iter").agg((F.max("value") / 1000).alias("f1"))
    return az.memory_summary(history, log.groupBy("iter").agg(F.count(F.lit(1)).alias("coverage")))


@query(f"WITH {_HISTORY}, b AS (SELECT class, max(f1) AS best, max(iter) AS last FROM e GROUP BY class), s AS (SELECT b.class, best AS best_f1, cast(last - (SELECT min(iter) FROM e WHERE e.class = b.class AND e.f1 = b.best) AS INTEGER) AS stagnant_iters FROM b) SELECT *, stagnant_iters >= 2 AS stagnant, round(1 - best_f1, 3) AS difficulty FROM s")
def class_difficulty(spark, d):
    return _memory(spark, d)[0]


@query("SELECT cast(event_id % 12 AS INTEGER) AS iter, count(*) AS coverage FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
def coverage_trajectory(spark, d):
    return _memory(spark, d)[1]


# ----------------------------------------------------------- aggregation by name


@query(f"WITH {tk.MV_SQL} SELECT id, split, label FROM mv")
def aggregate_mv(spark, d):
    return agg.aggregate(*lang(spark, d), list(tk.LANG_RULES), C, "mv")


@query(f"WITH {tk.QT_SQL} SELECT id, split, array_to_string(labels, ',') AS labels FROM orv")
def aggregate_mv_sets(spark, d):
    ex = tk.qt(spark, d)
    return agg.aggregate(ex, tk.qt_votes(ex), list(tk.QT_RULES), 2, "mv", multi_label=True).select("id", "split", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


def _embeddings(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))


@query()
def embedding_vote_features_lr(spark, d):
    """Votes and the embedding of the same id side by side, all folds and all values of C."""
    ex, v = lang(spark, d)
    rows = agg.joined_features(ex.select("id", "split", "gold"), v, list(tk.LANG_RULES), C, _embeddings(spark, d), 64).cache()
    return lm.decide(lm.text_vote_regression(rows, C)).select("id", "split", "label")


@query()
def text_aware_lr(spark, d):
    ex, v = lang(spark, d)
    return lm.decide(agg.text_aware(ex.select("id", "split", "gold"), v, list(tk.LANG_RULES), C, _embeddings(spark, d), 64)).select("id", "split", "label")
