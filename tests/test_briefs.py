"""Enrichment, briefs, pool, embedding and enriched sinks, aggregation by name, ranks and quantiles."""

import json
import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from votelake.functions import text as tx
from votelake.operators import analyze as az
from votelake.operators import enrich as en
from votelake.operators import sampling as sm
from votelake.operators import similarity as si
from votelake.plans import aggregation as agg
from votelake.plans import prompts as pr
from votelake.schema import get_task
from votelake.sources import sinks as sk


def test_ngrams_and_accents(spark):
    texts = ["Él niño a café_1", "x", None, "Straße ÀÉÎõü", "été là"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tx.word_ngrams(F.col("t"))).collect()]
    assert got[0] == ["el", "nino", "cafe_1", "el nino", "nino cafe_1"] and got[1] == [] and got[2] == []
    assert got[3] == ["straße", "aeiou", "straße aeiou"] and got[4] == ["ete", "la", "ete la"]


def _cosine(pairs, min_df, max_df):
    def grams(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", (t or "").lower()) if not unicodedata.combining(c))
        w = [x for x in "".join(c if c.isalnum() or c == "_" else " " for c in t).split() if len(x) > 1]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    docs = [grams(t) for p in pairs for t in p]
    df = {g: sum(g in d for d in docs) for d in docs for g in d}
    out = []
    for i in range(0, len(docs), 2):
        vs = []
        for d in docs[i : i + 2]:
            v = {g: (1 + math.log(d.count(g))) * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g in set(d) if min_df <= df[g] <= max_df * len(docs)}
            n = math.sqrt(sum(x * x for x in v.values())) or 1.0
            vs.append({g: x / n for g, x in v.items()})
        out.append(sum(x * vs[1].get(g, 0.0) for g, x in vs[0].items()))
    return out


def test_semantic_similarity_against_brute_force(spark):
    pairs = [("the cat sat", "the cat sat down, the cat"), ("A dog barks", "no dogs here"), (None, "the cat"), ("", ""), ("the cat sat", "the cat sat"), ("dog dog dog", "the dog")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, claim string, evidence string")
    got = {r["id"]: r["sim_semantic"] for r in en.semantic_similarity(rows).collect()}
    assert len(got) == len(pairs)
    for i, want in enumerate(_cosine(pairs, 2, 0.95)):
        assert got[i] == pytest.approx(want, abs=1e-9)
    assert en.semantic_similarity(rows.limit(0)).count() == 0
    bins = {r["id"]: r["sim_semantic_bin"] for r in en.with_bins(rows.withColumn("sim_semantic", F.col("id") / 5.0)).collect()}
    assert bins == {0: "very_low", 1: "very_low", 2: "low", 3: "med", 4: "high", 5: "high"}


def test_antonyms_roles_and_enrich(spark):
    lex = spark.createDataFrame([("good", "bad"), ("good", "evil"), ("Hot", "cold"), ("is", "not")], "word string, antonym string")
    rows = spark.createDataFrame([(1, "Good good HOT is", "bad and not cold"), (2, "good", "fine"), (3, None, None), (4, "hot", "warm cold")], "id int, claim string, evidence string")
    got = {r["id"]: r["antonym_score_ext"] for r in en.antonyms(rows, lex).collect()}
    assert got == {1: 3, 2: 0, 3: 0, 4: 1}
    r = {r["id"]: r for r in en.role_containment(rows, en.positional_roles).collect()}
    assert (r[1]["claim_subj"], r[1]["claim_obj"], r[1]["subj_in_evidence"]) == ("good", "is", False)
    assert r[3]["claim_subj"] == "" and not r[3]["subj_in_evidence"]
    full = en.enrich(rows, "a, C,D,E", lexicon=lex)
    assert {"sim_semantic_bin", "sim_semantic_backend", "verb_in_evidence", "antonym_score_ext", "nei_phrase_count"} <= set(full.columns) and full.count() == 4
    with pytest.raises(ValueError, match="unknown"):
        en.enrich(rows, "Z")
    with pytest.raises(ValueError, match="provider"):
        en.enrich(rows, "B")


def test_sinks(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    (src / "train.jsonl").write_text('{"id": "a", "x": 1}\n{"id": "b", "x": 2}\n')
    (src / "label_map.json").write_text('{"0": "n"}')
    done = sk.write_enriched(spark, str(src), str(out), lambda d: d.withColumn("y", F.col("x") + 1), ["A"])
    assert done == ["train"] and (out / "label_map.json").read_text() == '{"0": "n"}'
    assert sorted(r["y"] for r in spark.read.json(str(out / "train.jsonl")).collect()) == [2, 3]
    assert json.loads((out / ".enriched_features.json").read_text())["features"] == ["A"]

    blocks = ["def lf_a(ex):\n    return 1\n\n", "def lf_a(ex):\n    return 1", "", "def helper():\n    return 0"]
    sk.write_pool(spark, blocks, ["lf_a", "helper"], str(tmp_path / "pool.py"), "two\nlines")
    scope = {}
    exec((tmp_path / "pool.py").read_text(), scope)  # noqa: S102
    assert [f.__name__ for f in scope["ANNOTATORS"]] == ["lf_a"] and (tmp_path / "pool.py").read_text().count("def lf_a") == 1

    sk.write_embeddings(spark.createDataFrame([(1, "val", [0.5, 2.0])], "id int, split string, emb array<double>"), str(tmp_path / "emb"), "m")
    assert spark.read.parquet(str(tmp_path / "emb")).first().asDict() == {"id": "1", "split": "val", "emb": [0.5, 2.0], "model": "m"}

    log, archive = str(tmp_path / "log"), str(tmp_path / "archive")
    sk.append_events(spark.createDataFrame([(1,)], "e int"), log)
    sk.archive_events(spark, log, archive, 1)
    sk.archive_events(spark, log, archive, 2)
    sk.append_events(spark.createDataFrame([(2,)], "e int"), log)
    sk.archive_events(spark, log, archive, 2)
    assert sorted(map(tuple, spark.read.json(archive).select("period", "e").collect())) == [(1, 1), (2, 2)]


def test_briefs(spark):
    task = get_task("lang4")
    assert pr.guide(get_task("fever")) != pr.guide(task) and "0 = de" in pr.task_brief(task)
    assert "Names in use: a, b" in pr.improver_brief(task, "", ["b", "a"])
    summary = spark.createDataFrame([(7, 2.0, 1), (8, 3.0, None)], "center int, mass double, target_label int")
    words = spark.createDataFrame([(7, "w", 1), (7, "v", 11)], "group int, word string, rank int")
    examples = spark.createDataFrame([(7, 1, " x\ny" + "z" * 400), (7, 7, "late")], "center int, rank int, text string")
    got = {r["position"]: r["text"].split("\n") for r in pr.render_clusters(summary, words, examples, task).collect()}
    assert got[1] == ["Cluster 1: mostly without votes"]
    assert got[2][:2] == ["Cluster 2: class 1 (en)", "words: w"] and len(got[2]) == 3 and len(got[2][2]) == 304

    dropped = spark.createDataFrame([(i, 0, f"lf_{i}", i, "weak") for i in range(20)], "seq int, class int, name string, iter int, reason string")
    scores = spark.createDataFrame([(1, 5, 0.5)], "seq int, class int, f1 double")
    r = pr.reflection_texts(dropped, scores).first()
    assert r["n_events"] == 20 and r["text"].split("\n")[:2] == ["F1: no data", "lf_5 (round 5): weak"] and r["text"].count("\n") == 15
    lessons = spark.createDataFrame([(c, "One. Two. Three. Four. Five.") for c in range(5)], "class int, lesson string")
    f1 = spark.createDataFrame([(c, c / 10) for c in range(5)], "class int, f1 double")
    assert all(r["keep"] and r["lesson"] == "One. Two. Three. Four." for r in pr.keep_lessons(lessons, f1).collect())
    assert sorted(r["class"] for r in pr.keep_lessons(lessons, f1, limit_tokens=10).collect() if r["keep"]) == [0, 1, 2]


def test_aggregation_by_name(spark, tmp_path):
    rows = [(i, "val" if i % 2 else "train", i % 3) for i in range(60)]
    ex = spark.createDataFrame(rows, "id bigint, split string, gold int")
    votes = ex.select("id", "split", F.lit("a").alias("lf"), F.col("gold").alias("vote"))
    assert agg.aggregate(ex, votes, ["a"], 3, "mv").join(ex, "id").filter("label <> gold").count() == 0
    with pytest.warns(UserWarning, match="votes only"):
        out = agg.aggregate(ex, votes, ["a"], 3, cache=str(tmp_path / "none"), dim=2, folds=2, grid=(1.0,))
    assert out.join(ex, "id").filter("label = gold").count() == 60
    emb = spark.createDataFrame([(1, [3.0, 4.0])], "id bigint, emb array<double>")
    f = {r["id"]: list(r["features"].toArray()) for r in agg.joined_features(ex, votes, ["a"], 3, emb, 2).collect()}
    assert f[1] == [3.0, 4.0, 0.0, 1.0, 0.0] and f[2] == [0.0, 0.0, 0.0, 0.0, 1.0]
    assert agg.normalized(emb).first()["emb"] == pytest.approx([0.6, 0.8])
    with pytest.raises(ValueError, match="unknown"):
        agg.aggregate(ex, votes, ["a"], 3, "best")


def test_ranks_and_quantiles(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3) for i in range(500)] + [(5, 1)], "id bigint, gold int").repartition(7)
    key = lambda r: (((r["id"] % 2147483648) * 1103515245 + 12387) % 2147483648, r["id"])
    got = sm.with_rank(rows, "gold").collect()
    assert len(got) == 501
    for g in (None, 0, 1, 2):
        part = sorted((r for r in got if r["gold"] == g), key=lambda r: (key(r), r["__n"]))
        assert [r["__n"] for r in part] == list(range(1, len(part) + 1))
    split = {r["split"]: r["count"] for r in sm.exact_split(rows).groupBy("split").count().collect()}
    assert split == {"train": 400, "val": 50, "test": 51}

    values = [float(x) for x in (3, 1, 1, 1, 9, 4, 4, 8)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    nearest = {r["q"]: r["value"] for r in az.quantiles(df, "v", [0.0, 0.5, 0.75, 1.0]).collect()}
    ordered = sorted(v for v in values if v is not None)
    assert nearest == {q: ordered[round(q * 7)] for q in (0.0, 0.5, 0.75, 1.0)}
    assert az.interpolated(df, "v", [0.25, 0.5, 1.0]).first()["q"] == pytest.approx([1.0, 3.5, 9.0])
    assert az.interpolated(df.limit(0), "v", [0.5]).count() == 0


def test_nearest_center_without_and_with_too_many(spark):
    ex = spark.createDataFrame([(1, ["a"]), (2, [])], "id int, t array<string>")
    centers = spark.createDataFrame([(9, 1, ["a"]), (8, 2, ["a"])], "center int, rank int, t array<string>")
    jac = lambda c: tx.jaccard(F.col("t"), c["t"])
    assert {(r["id"], r["center"], r["sim"]) for r in si.nearest_center(ex, centers, jac).collect()} == {(1, 9, 1.0), (2, 9, 0.0)}
    assert si.nearest_center(ex, centers.limit(0), jac).count() == 0
    many = spark.range(1001).select(F.col("id").alias("center"), F.col("id").alias("rank"), F.array(F.lit("a")).alias("t"))
    with pytest.raises(Exception, match="at most 1000"):
        si.nearest_center(ex, many, jac).collect()


def test_evidence_pieces(spark):
    from votelake.sources.readers import evidence_pieces, flatten_evidence

    values = ['[["Page", 3, " a b "], "bare", ["Page", 4], ["P", 0, "c"]]', "[]", None, '["x", "y"]']
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in rows.orderBy("i").select(flatten_evidence(evidence_pieces(F.col("v")))).collect()]
    assert got == ["a b  bare c", "", None, "x y"]


def test_command_line(spark, tmp_path):
    from votelake import __main__ as cli

    rows = [(i, ("train", "val", "test")[i % 3], i % 2, ("red apple fruit" if i % 2 else "blue ocean water") + f" w{i}", 4) for i in range(90)]
    ex = spark.createDataFrame(rows, "id bigint, split string, gold int, text string, num_words int").withColumn("text_lower", F.lower("text"))
    ex.write.parquet(str(tmp_path / "ex"))
    go = lambda *a: cli.COMMANDS[a[0]](spark, cli.parser().parse_args(list(a)))
    go("run", "--examples", str(tmp_path / "ex"), "--task", "quality", "--iterations", "1", "--per-round", "1", "--out", str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/history")).count() == 2
    votes = str(tmp_path / "run/votes")
    go("aggregate", "--examples", str(tmp_path / "ex"), "--votes", votes, "--task", "quality", "--method", "mv", "--out", str(tmp_path / "labels"))
    go("evaluate", "--examples", str(tmp_path / "ex"), "--labels", str(tmp_path / "labels"), "--task", "quality", "--out", str(tmp_path / "scores"))
    assert {r["split"]: r["n_total"] for r in spark.read.parquet(str(tmp_path / "scores/splits")).collect()} == {"train": 30, "val": 30, "test": 30}
    assert spark.read.parquet(str(tmp_path / "scores/classes")).filter("f1 > 0.9").count() == 6
    with pytest.raises(KeyError, match="no query"):
        go("query", "none", "--data", "x", "--out", "y")
    with pytest.raises(KeyError, match="unknown task"):
        go("aggregate", "--examples", str(tmp_path / "ex"), "--votes", votes, "--task", "none", "--out", "y")
    sets = spark.createDataFrame([(1, "val", [0]), (2, "val", [0, 1]), (3, "val", [])], "id bigint, split string, labels array<int>")
    sets.write.parquet(str(tmp_path / "sets"))
    go("evaluate", "--examples", str(tmp_path / "sets"), "--labels", str(tmp_path / "sets"), "--task", "qt", "--out", str(tmp_path / "multi"))
    assert spark.read.parquet(str(tmp_path / "multi/summary")).count() >= 1
