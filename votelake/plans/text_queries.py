"""Queries of scalar text functions, data preparation and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from votelake.functions import text as tx
from votelake.operators import analyze as az
from votelake.operators import sampling as sm
from votelake.operators import similarity as si
from votelake.plans import tasks as tk
from votelake.plans.label_queries import six
from votelake.plans.registry import query
from votelake.sources import readers as rd
from votelake.sources import sinks as sk

_WS = r"[\x20\x09-\x0D]"


@query(rf"SELECT doc_id AS id, lower(regexp_replace(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+', ' ', 'g')) AS text_normalized FROM documents")
def normalize_text(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), tx.normalize(F.col("text")).alias("text_normalized"))


@query(rf"""SELECT doc_id AS id, cast(length(text) AS INTEGER) AS num_chars, cast(len(list_filter(string_split_regex(text, '{_WS}+'), lambda w: w <> '')) AS INTEGER) AS num_words, regexp_matches(text, 'https?://') AS has_url, regexp_matches(text, '[^\s@]@[^\s@]') AS has_email,
  cast(greatest(1, length(text) // 4) AS INTEGER) AS token_estimate, CASE WHEN len(regexp_replace(text, '[^!]', '', 'g')) >= 3 THEN '3+' ELSE len(regexp_replace(text, '[^!]', '', 'g'))::VARCHAR END AS exclamations, substr(text, 1, 120) AS head FROM documents""")
def text_features(spark, d):
    t = F.col("text")
    return spark.read.parquet(f"{d}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.length(t).alias("num_chars"), tx.num_words(t).alias("num_words"), tx.has_url(t).alias("has_url"), tx.has_email(t).alias("has_email"), tx.token_estimate(t).alias("token_estimate"), tx.exclamation_bucket(t).alias("exclamations"), F.substring(t, 1, 120).alias("head")
    )


@query(f"WITH {tk.DOC_SQL} SELECT split, CASE WHEN num_words < 6 THEN 'very_short' WHEN num_words < 15 THEN 'short' WHEN num_words < 30 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n FROM doc GROUP BY ALL")
def length_bucket(spark, d):
    ex = tk.lang4(spark, d)
    return ex.groupBy("split", tx.length_bucket(F.col("num_words")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _phrases(phrases: tuple[str, ...], text: str) -> str:
    return " + ".join("cast(contains({}, '{}') AS INT)".format(text, p.replace("'", "''")) for p in phrases)


@query(f"SELECT conv_id, turn, {_phrases(tx.REFUTES, 'lower(text)')} AS refutes, {_phrases(tx.SUPPORTS, 'lower(text)')} AS supports, {_phrases(tx.UNDECIDED, 'lower(text)')} AS undecided FROM conversations")
def phrase_counts(spark, d):
    t = F.col("text")
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", tx.phrases_contained(t, tx.REFUTES).alias("refutes"), tx.phrases_contained(t, tx.SUPPORTS).alias("supports"), tx.phrases_contained(t, tx.UNDECIDED).alias("undecided"))


_PAIRS = f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS ca, b.text AS ev FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
  t AS (SELECT *, {tk.tokens_sql("ca")} AS ta, {tk.tokens_sql("ev")} AS tb, list_distinct(regexp_extract_all(ca, '([0-9]+)', 1)) AS na, list_distinct(regexp_extract_all(ev, '([0-9]+)', 1)) AS nb,
    cast(len(list_filter(string_split_regex(ca, '{_WS}+'), lambda w: w <> '')) AS INTEGER) AS wa, cast(len(list_filter(string_split_regex(ev, '{_WS}+'), lambda w: w <> '')) AS INTEGER) AS wb,
    list_has_any(regexp_extract_all(lower(ca), '([a-z]+)', 1), ['not','no','never','none','neither','cannot','without']) OR contains(lower(ca), 'n''t') AS ga, list_has_any(regexp_extract_all(lower(ev), '([a-z]+)', 1), ['not','no','never','none','neither','cannot','without']) OR contains(lower(ev), 'n''t') AS gb FROM p),
  x AS (SELECT *, len(list_intersect(ta, tb)) AS sh, len(list_intersect(na, nb)) AS sn FROM t)
SELECT conv_id, turn, round(coalesce(cast(sh AS DOUBLE) / nullif(len(ta) + len(tb) - sh, 0), 0), 6) AS token_overlap, round(coalesce(cast(sh AS DOUBLE) / nullif(len(ta), 0), 0), 6) AS claim_in_evidence, round(coalesce(cast(sh AS DOUBLE) / nullif(len(tb), 0), 0), 6) AS evidence_in_claim,
  len(na) > 0 AND len(nb) > 0 AS has_numbers_both, len(na) > 0 AND len(nb) > 0 AND sn > 0 AS numbers_match, len(na) > 0 AND len(nb) > 0 AND sn = 0 AS numbers_mismatch, ga <> gb AS negation_mismatch, wa AS claim_word_count, wb AS evidence_word_count, round(coalesce(cast(wb AS DOUBLE) / nullif(wa, 0), 0), 6) AS length_ratio FROM x"""


def _turn_pairs(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    a = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("claim"))
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("evidence"))
    return a.join(b, ["conv_id", "turn"])


@query(_PAIRS)
def pair_features(spark, d):
    f = tx.pair_features(F.col("claim"), F.col("evidence"))
    ratios = ("token_overlap", "claim_in_evidence", "evidence_in_claim", "length_ratio")
    return _turn_pairs(spark, d).select("conv_id", "turn", *[(six(c) if n in ratios else c).alias(n) for n, c in f.items()])


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""WITH v AS (SELECT vec_id, label, list_reduce(list_transform(list_zip(embedding, [0.125 for i in range(64)]), lambda z: cast(z[1] AS DOUBLE) * cast(z[2] AS DOUBLE)), lambda a, b: a + b) AS sim FROM embeddings), q AS (SELECT quantile_cont(sim, 0.25) AS a, quantile_cont(sim, 0.5) AS b, quantile_cont(sim, 0.75) AS c FROM v)
SELECT vec_id AS id, CASE WHEN sim < a THEN 0 WHEN sim < b THEN 1 WHEN sim < c THEN 2 ELSE 3 END AS bin FROM v, q""")
def quartile_bins(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), tx.dot(F.col("embedding"), F.array_repeat(F.lit(0.125), 64)).alias("sim"))
    q = az.interpolated(e, "sim", [0.25, 0.5, 0.75])
    # one row of three numbers
    met = e.withColumn("k", F.lit(1)).join(F.broadcast(q.withColumn("k", F.lit(1))), "k")
    cut = F.when(F.col("sim") < F.col("q")[0], 0).when(F.col("sim") < F.col("q")[1], 1).when(F.col("sim") < F.col("q")[2], 2).otherwise(3)
    return met.select("id", cut.alias("bin"))


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [(doc_id % 5)::VARCHAR, 'x', (doc_id % 2)::VARCHAR, (doc_id % 5)::VARCHAR] END AS tl, CASE WHEN doc_id % 3 = 1 THEN (doc_id % 7 - 1)::VARCHAR END AS t FROM documents)
SELECT doc_id AS id, CASE WHEN tl IS NOT NULL THEN array_to_string(list_sort(list_distinct(list_filter(list_transform(tl, lambda x: try_cast(x AS INTEGER)), lambda x: x IS NOT NULL))), ',') WHEN try_cast(t AS INTEGER) >= 0 THEN t ELSE '' END AS true_labels,
  CASE WHEN t IS NOT NULL THEN try_cast(t AS INTEGER) WHEN tl IS NOT NULL THEN cast(least(doc_id % 5, doc_id % 2) AS INTEGER) ELSE -1 END AS true_label FROM r""")
def multilabel_normalize(spark, d):
    i = F.col("doc_id")
    many = F.when(i % 3 == 0, F.array((i % 5).cast("string"), F.lit("x"), (i % 2).cast("string"), (i % 5).cast("string")))
    rows = spark.read.parquet(f"{d}/documents.parquet").select(i.alias("id"), many.alias("true_labels"), F.when(i % 3 == 1, (i % 7 - 1).cast("string")).alias("true_label"))
    return rd.normalize_labels(rows).withColumn("true_labels", F.array_join(F.col("true_labels").cast("array<string>"), ","))


@query(f"WITH {tk.EX_SQL} SELECT split, gold AS label, count(*) AS n, 1.0::DOUBLE AS mean_labels, sum(count(*)) OVER (PARTITION BY split)::BIGINT AS rows FROM ex GROUP BY split, gold")
def manifest(spark, d):
    ex = tk.lang4(spark, d).withColumn("true_labels", F.array("gold"))
    return sk.manifest(ex)


@query("WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'lf_x_c' || doc_id % 9 || 'b2' WHEN 1 THEN 'lf_class' || doc_id % 9 || '_k' WHEN 2 THEN 'lf_c' || doc_id % 9 || '_z' ELSE 'lf_none' END AS lf FROM documents) SELECT doc_id AS id, cast(CASE WHEN doc_id % 4 = 3 THEN -1 ELSE doc_id % 9 END AS INTEGER) AS class FROM n")
def class_from_name(spark, d):
    i = F.col("doc_id")
    n = (i % 9).cast("string")
    name = F.when(i % 4 == 0, F.concat(F.lit("lf_x_c"), n, F.lit("b2"))).when(i % 4 == 1, F.concat(F.lit("lf_class"), n, F.lit("_k"))).when(i % 4 == 2, F.concat(F.lit("lf_c"), n, F.lit("_z"))).otherwise("lf_none")
    return spark.read.parquet(f"{d}/documents.parquet").select(i.alias("id"), tx.class_from_name(name).alias("class"))


@query(f"WITH {tk.QT_SQL} SELECT id, array_to_string([cast(list_contains(labels, 0) AS INT), cast(list_contains(labels, 1) AS INT)], ',') AS y FROM q")
def multi_hot(spark, d):
    return tk.qt(spark, d).select("id", F.array_join(rd.multi_hot(F.col("labels"), 2).cast("array<string>"), ",").alias("y"))


@query("SELECT doc_id AS id, sha256('{\"text\": ' || text || '}') AS cache_key FROM documents")
def cache_keys(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), tx.cache_key(F.concat(F.lit('{"text": '), "text", F.lit("}"))).alias("cache_key"))


# ------------------------------------------------------------------- similarity

_TOK = f"tok AS (SELECT doc_id AS id, {tk.tokens_sql('text')} AS t FROM documents)"
_NEXT = "p AS (SELECT a.id AS a, b.id AS b, a.t AS x, b.t AS y FROM tok a JOIN tok b ON b.id = a.id + 1)"


def _tokens(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), tx.tokens(F.col("text")).alias("tokens"))


def _neighbours(docs):
    return docs.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).join(docs.select(F.col("id").alias("b")), "b")


@query(f"WITH {_TOK}, {_NEXT} SELECT a, b, round(CASE WHEN len(x) + len(y) = 0 THEN 0 ELSE cast(len(list_intersect(x, y)) AS DOUBLE) / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS jaccard FROM p")
def jaccard_tokens(spark, d):
    t = _tokens(spark, d)
    a, b = t.select(F.col("id").alias("a"), F.col("tokens").alias("x")), t.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("tokens").alias("y"))
    return a.join(b, "a").select("a", "b", six(tx.jaccard(F.col("x"), F.col("y"))).alias("jaccard"))


_TFIDF = f"""WITH {_TOK}, e AS (SELECT id, unnest(t) AS w FROM tok), df AS (SELECT w, count(*) AS df FROM e GROUP BY w), r AS (SELECT id, w, ln((cast((SELECT count(*) FROM tok) AS DOUBLE) + 1) / (df + 1)) + 1 AS x FROM e JOIN df USING (w)), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM r GROUP BY id),
  u AS (SELECT id, w, x / n AS v FROM r JOIN n USING (id)) SELECT a.id AS a, a.id + 1 AS b, round(least(1, greatest(0, coalesce((SELECT sum(p.v * q.v) FROM u p JOIN u q ON p.w = q.w WHERE p.id = a.id AND q.id = a.id + 1), 0))), 6) AS cosine FROM tok a WHERE a.id + 1 IN (SELECT id FROM tok)"""


@query(_TFIDF)
def tfidf_cosine(spark, d):
    docs = _tokens(spark, d)
    return si.tfidf_cosine(si.tfidf_entries(docs), _neighbours(docs)).withColumn("cosine", six("cosine"))


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query, e.vec_id AS id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.embedding, e.embedding), lambda z: cast(z[1] AS DOUBLE) * cast(z[2] AS DOUBLE))), lambda a, b: a + b) AS sim FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM s) SELECT query, id, round(sim, 6) AS sim, cast(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def embedding_topk(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))
    return si.embedding_cosine(e.filter("id % 100 = 0"), e, 5).withColumn("sim", six("sim"))


@query(f"""WITH {tk.VOTES_SQL}, s AS (SELECT id, list_distinct(list(lf)) AS x FROM votes GROUP BY id), p AS (SELECT a.id AS a, b.id AS b FROM ex a JOIN ex b ON b.id = a.id + 1)
SELECT a, b, round(coalesce(len(list_intersect(u.x, w.x)) / sqrt(cast(len(u.x) AS DOUBLE) * len(w.x)), 0), 6) AS cosine FROM p LEFT JOIN s u ON u.id = a LEFT JOIN s w ON w.id = b""")
def coverage_cosine(spark, d):
    ex = tk.lang4(spark, d)
    return si.coverage_cosine(tk.lang_votes(ex), _neighbours(ex.select("id"))).withColumn("cosine", six("cosine"))


@query("""SELECT vec_id AS id, round(CASE WHEN vec_id % 101 / 100.0::DOUBLE <= 0.3 THEN 1.0 WHEN vec_id % 101 / 100.0::DOUBLE >= 0.6 THEN 0.3 ELSE round(1.0 - 0.7::DOUBLE * (vec_id % 101 / 100.0::DOUBLE - 0.3::DOUBLE) / 0.3::DOUBLE, 3) END, 2) AS alpha FROM embeddings""")
def adaptive_alpha(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.round(si.adaptive_alpha((F.col("vec_id") % 101).cast("double") / 100.0), 2).alias("alpha"))


@query("SELECT doc_id AS id, CASE WHEN e.vec_id IS NULL THEN 0 ELSE 1 END AS found FROM documents LEFT JOIN embeddings e ON e.vec_id = doc_id")
def embedding_lookup(spark, d):
    ex = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"))
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))
    return si.embedding_lookup(ex, e, 64).select("id", F.exists("emb", lambda x: x != 0).cast("int").alias("found"))


@query("SELECT doc_id % 10 AS bucket, count(*) AS n FROM documents GROUP BY 1")
def split_sizes(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").groupBy((F.col("doc_id") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS id, ((doc_id % 2147483648) * 1103515245 + 12387) % 2147483648 AS h FROM documents")
def order_hash(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), sm.order_hash(F.col("doc_id")).alias("h"))


@query("SELECT event_id AS id, cast(len(string_split(event_type, 'i')) AS INTEGER) AS parts, event_type || '. One. Two. Three.' AS first FROM events")
def sentences(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.concat("event_type", F.lit(". One. Two. Three. Four. Five."))
    return e.select(F.col("event_id").alias("id"), F.size(F.split("event_type", "i")).alias("parts"), tx.first_sentences(text, 4).alias("first"))


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 0.001::DOUBLE * (event_id % 97) WHEN 1 THEN 1.0::DOUBLE * (event_id % 97) WHEN 2 THEN 60.0::DOUBLE * (event_id % 97) ELSE 3600.0::DOUBLE * (event_id % 97) END AS seconds FROM events""")
def durations(spark, d):
    i = F.col("event_id")
    unit = F.element_at(F.array(F.lit("ms"), F.lit("s"), F.lit("m"), F.lit("h")), (i % 4 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select(i.alias("id"), tx.duration_seconds(F.concat((i % 97).cast("string"), unit)).alias("seconds"))
