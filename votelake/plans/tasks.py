"""Labelling tasks over the given tables, their annotator pools, and the SQL of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votelake.functions import text as tx
from votelake.operators.annotators import Annotator, regex_rule, run_pool
from votelake.schema import get_task

LANG = get_task("lang4")
QT = get_task("qt")
FEATURES = LANG.bool_features


def _words(words: str) -> str:
    return f"(^|[^a-z])({words})([^a-z]|$)"


#: name: (class, pattern on lower-case text); the patterns mean the same to Java and RE2.
LANG_RULES = {
    "lf_de_function_words": (0, _words("der|das|und|von")),
    "lf_en_function_words": (1, _words("the|and|that|is")),
    "lf_es_function_words": (2, _words("los|del|para|que")),
    "lf_fr_function_words": (3, _words("le|les|dans|elle")),
    "lf_de_chars": (0, "[äöüß]"),
    "lf_es_chars": (2, "[ñíó]"),
    "lf_fr_chars": (3, "[èêç]"),
    "lf_en_th": (1, "th"),
    "lf_never_c1": (1, "zzqzz"),
}
QT_RULES = {
    "lf_insults": (1, _words("idiot|moron|scum|trash|clown|worthless|pathetic|loser")),
    "lf_stupid": (1, _words("stupid|disgusting")),
    "lf_sentences": (0, "[a-zà-ÿ]{2,}\\. [a-zà-ÿ]"),
    "lf_no_symbols": (0, "^[^|#$%&*]*$"),
    "lf_commas": (0, "[a-zà-ÿ], [a-zà-ÿ]"),
}


def pool(rules: dict[str, tuple[int, str]]) -> list[Annotator]:
    return [regex_rule(n, c, p) for n, (c, p) in rules.items()]


def pool_frame(spark: SparkSession, rules: dict[str, tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame([(n, c) for n, (c, _) in rules.items()], "lf string, target int")


def _split(i: str = "doc_id"):  # noqa: ANN202
    return F.when(F.col(i) % 10 < 8, "train").when(F.col(i) % 10 == 8, "val").otherwise("test")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    return d.select(
        F.col("doc_id").alias("id"),
        _split().alias("split"),
        "text",
        F.lower(text).alias("text_lower"),
        tx.num_words(text).alias("num_words"),
        tx.has_url(text).alias("has_url"),
        tx.has_email(text).alias("has_email"),
        text.rlike("[0-9]").alias("has_digit"),
        text.contains("|").alias("has_pipe"),
        "lang",
    )


def lang4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is labelled with its language."""
    gold = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).when(F.col("lang") == "fr", 3)
    return _documents(spark, sf_dir).withColumn("gold", gold).drop("lang")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality where it is labelled, null elsewhere."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("gold"))
    return _documents(spark, sf_dir).join(labels, "id", "left")


def qt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label sets {quality -> 0, toxic -> 1} of labelled documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), "quality", "toxic")
    sets = F.filter(F.array(F.when(F.col("quality") == 1, F.lit(0)), F.when(F.col("toxic") == 1, F.lit(1))), lambda x: x.isNotNull())
    return _documents(spark, sf_dir).join(labels, "id").withColumn("labels", sets).drop("quality", "toxic", "lang")


def lang_votes(examples: DataFrame) -> DataFrame:
    return run_pool(examples, pool(LANG_RULES), once=True)


def qt_votes(examples: DataFrame) -> DataFrame:
    return run_pool(examples, pool(QT_RULES), once=True)


# ------------------------------------------------------------------ the same in SQL


def _votes_sql(rules: dict[str, tuple[int, str]], source: str) -> str:
    cells = ", ".join(f"{{'lf': '{n}', 'vote': CASE WHEN regexp_matches(lt, '{p}') THEN {c} END}}" for n, (c, p) in rules.items())
    return f"(SELECT id, split, u.lf AS lf, u.vote AS vote FROM (SELECT id, split, unnest([{cells}]) AS u FROM {source}) WHERE u.vote IS NOT NULL)"


SPLIT_SQL = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END"
DOC_SQL = rf"""doc AS (SELECT doc_id AS id, {SPLIT_SQL} AS split, text, lower(text) AS lt, lang,
  cast(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS INTEGER) AS num_words,
  regexp_matches(text, 'https?://') AS has_url, regexp_matches(text, '[^\s@]@[^\s@]') AS has_email, regexp_matches(text, '[0-9]') AS has_digit, contains(text, '|') AS has_pipe FROM documents)"""
EX_SQL = f"{DOC_SQL}, ex AS (SELECT *, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END AS gold FROM doc)"
VOTES_SQL = f"{EX_SQL}, votes AS {_votes_sql(LANG_RULES, 'ex')}, counts AS (SELECT id, vote AS class, count(*) AS n FROM votes GROUP BY id, vote)"
MV_SQL = f"""{VOTES_SQL}, tops AS (SELECT id, max(n) AS top FROM counts GROUP BY id),
  won AS (SELECT c.id, min(c.class) AS class, count(*) AS winners FROM counts c JOIN tops t ON c.id = t.id AND c.n = t.top GROUP BY c.id),
  mv AS (SELECT ex.id, ex.split, ex.gold, coalesce(CASE WHEN winners = 1 THEN class END, -1) AS label FROM ex LEFT JOIN won USING (id))"""
CONFUSION_SQL = f"""{MV_SQL}, conf AS (SELECT split, class, cast(sum(tp) AS BIGINT) AS tp, cast(sum(fp) AS BIGINT) AS fp, cast(sum(fn) AS BIGINT) AS fn FROM (
  SELECT split, gold AS class, cast(label = gold AS INT) AS tp, 0 AS fp, cast(label <> gold AS INT) AS fn FROM mv WHERE gold IS NOT NULL
  UNION ALL SELECT split, label, 0, cast(label <> gold AS INT), 0 FROM mv WHERE gold IS NOT NULL AND label >= 0) GROUP BY split, class)"""
PRF_SQL = f"""{CONFUSION_SQL}, prf AS (SELECT *, cast(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, cast(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall,
  CASE WHEN tp + fn > 0 AND tp + fp > 0 THEN cast(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1 FROM conf)"""
STATS_SQL = f"""{VOTES_SQL}, per AS (SELECT id, cast(sum(n) AS BIGINT) AS depth, count(*) AS k, max(n) AS top, list_sort(list(n)) AS ns FROM counts GROUP BY id),
  per2 AS (SELECT p.*, (SELECT min(class) FROM counts c WHERE c.id = p.id AND c.n = p.top) AS c0, len(list_filter(ns, lambda n: n = top)) AS winners FROM per p),
  stats AS (SELECT ex.id, ex.split, ex.gold, coalesce(depth, 0) AS depth, coalesce(CASE WHEN winners = 1 THEN c0 END, -1) AS label, coalesce(k > 1, false) AS disagree,
    CASE WHEN k > 1 THEN -list_sum(list_transform(ns, lambda n: cast(n AS DOUBLE) / depth * ln(cast(n AS DOUBLE) / depth))) / ln(cast(k AS DOUBLE)) ELSE 0.0 END AS entropy FROM ex LEFT JOIN per2 USING (id)),
  st AS (SELECT *, CASE WHEN depth = 0 THEN 1.0::DOUBLE WHEN disagree THEN entropy ELSE 1.0::DOUBLE / (depth + 1) END AS u FROM stats)"""
FIRED_SQL = """m AS (SELECT split, lf, count(*) AS fires, count(*) FILTER (vote = gold) AS correct FROM votes JOIN ex USING (id, split) WHERE gold IS NOT NULL GROUP BY split, lf)"""
POOL_SQL = "pool(lf) AS (VALUES " + ", ".join(f"('{n}')" for n in LANG_RULES) + ")"
METRICS_SQL = f"""{VOTES_SQL}, {FIRED_SQL}, {POOL_SQL}, lfm AS (SELECT s.split, pool.lf, s.n AS n_labeled, coalesce(fires, 0) AS fires, coalesce(correct, 0) AS correct, coalesce(fires, 0) - coalesce(correct, 0) AS incorrect,
  cast(coalesce(fires, 0) AS DOUBLE) / s.n AS coverage, cast(correct AS DOUBLE) / nullif(fires, 0) AS precision
  FROM (SELECT split, count(*) AS n FROM ex WHERE gold IS NOT NULL GROUP BY split) s CROSS JOIN pool LEFT JOIN m ON m.split = s.split AND m.lf = pool.lf)"""
QT_SQL = f"""{DOC_SQL}, q AS (SELECT doc.*, list_filter([CASE WHEN quality = 1 THEN 0 END, CASE WHEN toxic = 1 THEN 1 END], lambda x: x IS NOT NULL) AS labels FROM doc JOIN labels l ON l.doc_id = doc.id),
  votes AS {_votes_sql(QT_RULES, 'q')}, orv AS (SELECT q.id, q.split, q.labels AS y, coalesce(s.labels, []) AS labels FROM q LEFT JOIN (SELECT id, list_sort(list_distinct(list(vote))) AS labels FROM votes GROUP BY id) s USING (id))"""
STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOPWORDS) + "]"


def tokens_sql(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '([a-z'']+)', 1)), lambda w: len(w) >= 2 AND NOT list_contains({STOP_SQL}, w))"
