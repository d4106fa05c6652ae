"""Near-duplicates by Jaccard similarity against brute force."""

import random

import pytest

import corpus_pipeline
from votelake.llm import common, simhash, similar

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    line = "all rights reserved by the owner of this text and of others"
    words = [f"w{i}" for i in range(800)]
    texts = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 60, 150]))] + line.split() * (k % 2)
        texts.append(" ".join(base))
        for _ in range(30 if k == 7 else rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, "one", "ONE ", line, line + " too"]
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)], spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.mark.parametrize("list_rows", [16, 10_000])
def test_copies(spark, corpus, monkeypatch, list_rows):
    monkeypatch.setattr(similar, "LIST_ROWS", list_rows)
    rows, docs = corpus
    sets = {i: shingles(t) for i, t, *_ in rows}
    link = lambda i, j: near(sets[i], sets[j])
    root = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if link(i, j) and root[i] != root[j]:
                root = {k: min(root[i], root[j]) if r in (root[i], root[j]) else r for k, r in root.items()}
    numbers = common.numbered(docs)
    kept = {r["doc_id"] for r in common.without_rows(numbers, similar.copies(numbers)).collect()}
    assert not any(link(i, j) for i in kept for j in kept if j < i)
    assert {root[i] for i in kept} == set(root.values()) and len(kept) < len(rows) - 20
    if list_rows > len(rows):
        assert kept == set(root.values())
    assert similar.copies(common.numbered(docs.limit(0))).count() == 0


def test_stage_leaves_no_near_copy(spark, corpus):
    rows, docs = corpus
    once = docs.filter("text is not null")
    sets = {i: shingles(t) for i, t, *_ in rows}
    pairs = lambda ids: sum(near(sets[i], sets[j]) for i in ids for j in ids if j < i)
    before = {r["doc_id"] for r in simhash.keep_one(once).collect()}
    out = corpus_pipeline.drop_near_copies(spark, once, "")
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == docs.columns and kept <= before
    assert pairs(before) > 20 and pairs(kept) == 0
