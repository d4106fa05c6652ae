"""Text functions, readers, sinks, streaming, the loop."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from votelake.functions import text as tx
from votelake.operators.annotators import regex_rule
from votelake.operators.providers import KeywordMiner, Responses, backoff_seconds
from votelake.plans.loop import Evolution, Settings
from votelake.sources import readers as rd
from votelake.sources import sinks as sk
from votelake.streaming.scoring import EVENTS, consume_events, lessons_by_class, score_stream


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, tx.normalize(lit("\u00a0 A\tB \n"))) == "a b"
    assert one(spark, tx.num_words(lit("  a  b\n"))) == 2 and one(spark, tx.num_words(lit(None).cast("string"))) == 0
    assert one(spark, tx.length_bucket(lit(None).cast("int"))) == "very_short" and one(spark, tx.length_bucket(lit(30))) == "long"
    assert one(spark, tx.tokens(lit("The cat, the CAT's hat a")))== ["cat", "cat's", "hat"]
    assert one(spark, tx.phrases_contained(lit("It is NOT so, not at all"), tx.REFUTES)) == 2  # "is not" and "not ", the latter once
    assert one(spark, tx.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert [one(spark, tx.class_from_name(lit(n))) for n in ("lf_q_c3b1", "lf_c12_x", "lf_class4y", "lf_q")] == [3, 12, 4, -1]
    assert one(spark, tx.fenced_block(lit("a\n```json\n{}\n```"))) == "{}" and one(spark, tx.fenced_block(lit(" a "))) == "a"
    assert one(spark, tx.duration_seconds(lit("250ms"))) == 0.25 and one(spark, tx.duration_seconds(lit("2 m"))) == 120.0 and one(spark, tx.duration_seconds(lit("x"))) is None
    assert one(spark, tx.retry_after(lit("Please try again in 1.5s."))) == 1.5
    assert one(spark, tx.response_text(lit('{"choices": [{"message": {"content": "hi"}}]}'))) == "hi"
    assert one(spark, tx.response_text(lit('{"output": [{"type": "reasoning"}, {"content": [{"text": "a"}, {"x": 1}, {"text": "b"}]}, {"content": [{"text": "c"}]}]}'))) == "abc"
    assert one(spark, tx.argmax(F.array(lit(0.2), lit(0.4), lit(0.4)))) == 1
    f = tx.pair_features(lit("It has 3 dogs"), lit("It does not have 4 dogs"))
    got = spark.range(1).select(*[c.alias(n) for n, c in f.items()]).first()
    assert got["numbers_mismatch"] and got["negation_mismatch"] and got["token_overlap"] == pytest.approx(1.0)


def test_labels_and_jsonl(spark, tmp_path):
    rows = [{"id": "a", "text": "x", "true_labels": [2, 1, 2]}, {"id": "b", "true_label": 3}, {"id": "c"}, {"id": "d", "true_label": "q"}]
    p = tmp_path / "train.jsonl"
    p.write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    got = {r["id"]: (r["true_label"], r["true_labels"]) for r in rd.read_examples(spark, str(p)).collect()}
    assert got == {"a": (1, [1, 2]), "b": (3, [3]), "c": (-1, []), "d": (-1, [])}
    p.write_text('{"id": "a"}\n{broken\n')
    assert rd.read_examples(spark, str(p), mode="lenient").count() == 1
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        rd.read_examples(spark, str(p)).collect()
    assert rd.read_examples(spark, str(tmp_path / "none.jsonl"), mode="lenient").count() == 0
    with pytest.raises(Exception, match="row without"):
        p.write_text('{"id": "a"}\n')
        rd.read_multilabel(spark, str(p), 3).collect()


def test_prepare(spark, tmp_path):
    (tmp_path / "rel").mkdir()
    for s in ("train", "val", "test"):
        (tmp_path / "rel" / f"{s}.json").write_text(json.dumps({"7": {"label": 1, "data": {"text": " A b ", "entity1": "x", "entity2": "y", "span1": [0, 1], "span2": [2, 3]}}}))
    r = rd.prepare(spark, {"task": "chemprot", "raw": str(tmp_path / "rel")})
    assert r.count() == 3 and r.first()["metadata"]["text_normalized"] == "a b"
    claims = tmp_path / "claims.json"
    claims.write_text(json.dumps({"id": "1", "split": "val", "claim": "c", "label": 2, "evidence": [["p", "0", "first"], ["p", "1", "second"]]}) + "\n" + json.dumps({"id": "2", "split": "val", "claim": "d", "label": 0, "evidence": []}))
    texts = sorted(r["text"] for r in rd.prepare(spark, {"task": "fever", "raw": str(claims)}).collect())
    assert texts == ["Claim: c\nEvidence: first second", "Claim: d\nEvidence: (none found)"]
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("__MACOSX/big.csv", "x" * 9999)
        z.writestr("small.csv", "a\n1\n")
        z.writestr("data.csv", 'abstractText,A,B,pmid\n"one, two\nlines",1,0,9\nthree,0,1,8\n')
    t = rd.prepare(spark, {"task": "pubmed", "raw": str(tmp_path / "t.zip")})
    assert sorted((r["text"], r["true_labels"]) for r in t.collect()) == [("one, two\nlines", [0]), ("three", [1])]
    with pytest.raises(KeyError):
        rd.prepare(spark, {"task": "nope"})


def test_config_and_folders(spark, tmp_path):
    c = tmp_path / "c.yaml"
    c.write_text("a:\n  b: 5\n  c: x${a.b}\nd: ${a.c}\ne: ${zz.q}\nf: ${a.b}\n")
    got = rd.load_config(str(c))
    assert got["d"] == "x5" and got["e"] == "${zz.q}" and got["f"] == 5 and rd.lookup(got, "a.q", 1) == 1
    assert rd.newest_iteration(spark, str(tmp_path)) is None
    for n in ("iter_2", "iter_10"):
        (tmp_path / "pipeline" / n).mkdir(parents=True)
    assert rd.newest_iteration(spark, str(tmp_path)).endswith("pipeline/iter_10")


def test_sinks(spark, tmp_path):
    ex = spark.createDataFrame([(1, "val", 0, [0]), (2, "val", 1, [1])], "id bigint, split string, gold int, true_labels array<int>")
    v = spark.createDataFrame([(1, "val", "a", 0)], "id bigint, split string, lf string, vote int")
    from votelake.operators.aggregate import majority

    lab = sk.labeled_rows(ex, v, {"majority_vote": majority(ex, v), "weighted_vote": majority(ex, v)}, ["a", "b"])
    proba = spark.createDataFrame([(1, "val", [0.1, 0.9]), (2, "val", [0.7, 0.3])], "id bigint, split string, proba array<double>")
    dumped = {r["id"]: r for r in sk.dump_labels(lab, proba, "model").collect()}
    assert dumped[1]["aggregated_labels"]["model"] == 1 and dumped[1]["aggregated_labels"]["majority_vote"] == 1 and dumped[2]["votes"] == {"a": -1, "b": -1}
    stored = spark.createDataFrame([(1, -1)], "id bigint, label int")
    assert {r["id"]: r["majority_vote"] for r in sk.dump_majority(stored, majority(ex, v)).collect()} == {1: -1, 2: -1}
    sk.write_jsonl(lab, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    sk.write_document(sk.manifest(ex), str(tmp_path / "m"))
    assert rd.read_document(spark, str(tmp_path / "m")).count() == 2
    built = []
    build = lambda: (built.append(1), ex)[1]
    assert sk.resume(spark, str(tmp_path / "r"), build).count() == 2 and sk.resume(spark, str(tmp_path / "r"), build).count() == 2 and len(built) == 1
    sk.append_events(ex.select("id"), str(tmp_path / "log"))
    sk.archive_events(spark, str(tmp_path / "log"), str(tmp_path / "arch"), 1)
    assert not rd.exists(spark, str(tmp_path / "log")) and spark.read.json(str(tmp_path / "arch")).count() == 2


def test_streams(spark, tmp_path):
    schema = "id bigint, split string, text_lower string"
    src = tmp_path / "in"
    spark.createDataFrame([(1, "val", "aa"), (2, "val", "b")], schema).write.parquet(str(src))
    q = score_stream(spark.readStream.schema(schema).parquet(str(src)), [regex_rule("lf_a", 0, "a")], str(tmp_path / "votes"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "votes")).collect()] == [(1, "val", "lf_a", 0)]
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text('{"iter": 1, "type": "dropped", "name": "lf_x", "target_class": 2, "reason": "gap"}\n{"iter": 1, "type": "class_f1", "class": 2, "f1": 0.5}\n')
    consume_events(spark, str(log), str(tmp_path / "lessons"), str(tmp_path / "ck2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "lessons")).filter("target = 2").count() == 2
    d, f = lessons_by_class(spark.read.schema(EVENTS).json(str(log)))
    assert d.count() == 1 and f.first()["f1"] == 0.5


def test_responses(spark):
    cache = spark.createDataFrame([], "cache_key string, response string")
    asked = []
    r = Responses(cache, lambda ps: (asked.extend(ps), [p.upper() for p in ps])[1])
    req = spark.createDataFrame([("a",), ("b",), ("a",)], "payload string")
    assert sorted(x["response"] for x in r.resolve(req).collect()) == ["A", "A", "B"]
    r.resolve(req)
    assert sorted(asked) == ["a", "b"] and backoff_seconds(9) == 60.0 and backoff_seconds(1, 300) == 90.0
    with pytest.raises(LookupError):
        Responses(cache).resolve(req)


def test_evolution_loop(spark):
    words = {0: "apple pear plum", 1: "iron zinc lead"}
    rows = [(i, ("train", "val", "test")[i % 3], i % 2, f"{words[i % 2]} item{i % 5}", f"{words[i % 2]} item{i % 5}", 4) for i in range(120)]
    ex = spark.createDataFrame(rows, "id bigint, split string, gold int, text string, text_lower string, num_words int")
    run = Evolution(ex, 2, KeywordMiner(bank=1), Settings(iterations=1, per_round=2, min_fires=3))
    history = run.run()
    assert history[0]["macro_f1"] == 1.0 and history[-1]["macro_f1"] >= history[0]["macro_f1"] - 0.02
    assert run.brief()["pool_summary"].count() == 3


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90
    assert e.entry(spark).count() >= 0
