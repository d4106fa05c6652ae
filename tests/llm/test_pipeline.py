"""The corpus pipeline stage by stage against what each operator decides alone."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from votelake.llm import bpe, exact_dedup, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    words = [f"{a}{b}" for a in "lan tre mo qui sar bel".split() for b in "do ve lin ta ques ron".split()]
    rows, labels = [], []
    for i in range(300):
        body = [words[(i * 7 + k * (i % 11 + 1)) % len(words)] + str((i * 31 + k * k) % 97) for k in range(60 + i % 40)]
        if i % 5 == 0:
            body[10] = body[30] = "idiot"
        rows.append((i, " ".join(body), "en", "s" + str(i % 4), len(" ".join(body))))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000 + i, "  " + rows[i][1] + "\n", "en", "s0", 1) for i in range(1, 100, 2)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, corpus, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]
    docs, seen = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs)
        if name != "bpe":
            assert docs.columns == COLUMNS
    before, after = seen["toxicity"]
    kept = {r["doc_id"] for r in after.collect()}
    toxic = [i for i in range(300) if i % 5 == 0]
    assert sum(i in kept for i in toxic) <= 3 and sum(i not in kept for i in range(300) if i % 5) <= 3
    before, after = seen["exact_dedup"]
    digest = exact_dedup.digest(F.col("text"))
    assert after.count() == before.select(digest).distinct().count() == after.select(digest).distinct().count()
    before, after = seen["simhash_near_dedup"]
    found = simhash.near_duplicates(before).collect()
    assert {r["doc_id"] for r in after.collect()} == {r["component_id"] for r in found} and after.count() == len({r["component_id"] for r in found})
    before, after = seen["mixing"]
    assert after.groupBy("doc_id").count().filter("count > 3").count() == 0
    assert after.join(before, "doc_id", "left_anti").count() == 0
    before, after = seen["bpe"]
    c = bpe.Codec(bpe.vocabulary_path())
    want = sorted((r["doc_id"], len(c.encode(r["text"])), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in before.collect())
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in after.collect()) == want
    whole = sorted(map(tuple, corpus_pipeline.run(spark, corpus).collect()))
    assert whole == sorted(map(tuple, after.collect()))


CLASHES = ["score", "digest", "keep_id", "kept", "group_size", "fp", "component_id", "rows", "size", "taken", "position", "weight", "ids", "n_tokens", "b", "h", "n", "toxic"]


def test_stages_with_nulls_repeats_and_clashing_columns(spark, corpus, tmp_path):
    """A null in every column, rows delivered twice, a very long text, and columns named as operators name theirs."""
    words = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(5000 + i, f"plain text number {i} about {i * i} things", "en", None if i == 3 else "s" + str(i % 2), 1) for i in range(12)]
    rows += [rows[4], rows[4], (5020, words, "en", "s0", 1), (5021, words + " more", None, "s0", None), (5022, None, None, None, None), (None, "without a key", "en", "s1", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit("clash") for c in CLASHES})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, columns, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), [*COLUMNS, *CLASHES], {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == columns and all(r[c] == "clash" for r in left[name] for c in CLASHES)
    assert len(left["toxicity"]) == len(rows)  # none is labelled, so none is rejected
    assert len(left["exact_dedup"]) == 12 + 2 + 1 + 1  # plain texts, long ones, one empty, the one without a key
    kept = [r["doc_id"] for r in left["simhash_near_dedup"]]
    assert 5020 in kept and 5021 not in kept and len(kept) == len(set(kept))
    assert {r["doc_id"] for r in left["mixing"]} <= set(kept) and len(left["bpe"]) == len(left["mixing"]) > 0


def test_stages_on_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        assert out.count() == 0 and (name == "bpe" or out.columns == COLUMNS)
