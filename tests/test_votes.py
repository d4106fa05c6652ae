"""Edge rules of votes, aggregation and metrics on tables small enough to work out by hand."""

import pytest
from pyspark.sql import functions as F

from votelake.operators import aggregate as ag
from votelake.operators import annotators as an
from votelake.operators import metrics as mt
from votelake.schema import get_task


@pytest.fixture(scope="module")
def ex(spark):
    rows = [(1, "val", 0, "aa"), (2, "val", 1, "bb"), (3, "val", 1, "ab"), (4, "val", None, "a"), (5, "val", 0, "zz")]
    return spark.createDataFrame(rows, "id bigint, split string, gold int, text_lower string")


@pytest.fixture(scope="module")
def votes(spark):
    rows = [(1, "x", 0), (1, "y", 0), (1, "z", 1), (2, "x", 1), (3, "x", 1), (3, "y", 0), (4, "x", 0)]
    return spark.createDataFrame([(i, "val", lf, v) for i, lf, v in rows], "id bigint, split string, lf string, vote int")


def labels(df):
    return {r["id"]: r["label"] for r in df.collect()}


def test_majority_ties(ex, votes):
    assert labels(ag.majority(ex, votes)) == {1: 0, 2: 1, 3: -1, 4: 0, 5: -1}
    assert labels(ag.majority(ex, votes, ties="lowest")) == {1: 0, 2: 1, 3: 0, 4: 0, 5: -1}


def test_weighted(spark, ex, votes):
    w = spark.createDataFrame([("x", 0.9), ("y", 0.2), ("z", 1.1 + 1e-12)], "lf string, weight double")
    assert labels(ag.weighted(ex, votes, w)) == {1: -1, 2: 1, 3: 1, 4: 0, 5: -1}
    assert labels(ag.weighted(ex, votes)) == labels(ag.majority(ex, votes))


def test_any_and_sets(ex, votes):
    assert labels(ag.any_vote(ex, votes, 1)) == {1: 1, 2: 1, 3: 1, 4: -1, 5: -1}
    sets = {r["id"]: r["labels"] for r in ag.label_sets(ex, votes).collect()}
    assert sets == {1: [0, 1], 2: [1], 3: [0, 1], 4: [0], 5: []}
    assert {r["id"]: r["labels"] for r in ag.label_sets(ex, votes, 2).collect()}[1] == [0]


def test_annotator_metrics(spark, ex, votes):
    pool = spark.createDataFrame([("x",), ("y",), ("z",), ("never",)], "lf string")
    m = {r["lf"]: r for r in mt.annotator_metrics(ex, votes, pool).collect()}
    assert (m["x"]["fires"], m["x"]["correct"]) == (3, 3)  # the row without gold counts nowhere
    assert m["never"]["precision"] is None and m["never"]["coverage"] == 0.0
    c = {r["lf"]: r for r in mt.candidate_metrics(ex, votes, pool).collect()}
    assert c["never"]["precision"] == 0.0 and c["x"]["predicted_label"] is None and c["z"]["predicted_label"] == 1


def test_confusion_abstain_is_a_miss(ex, votes):
    got = {r["class"]: (r["tp"], r["fp"], r["fn"]) for r in mt.confusion(ex, ag.majority(ex, votes)).collect()}
    assert got == {0: (1, 0, 1), 1: (1, 0, 1)}
    scored = {r["class"]: r["f1"] for r in mt.prf(mt.confusion(ex, ag.majority(ex, votes))).collect()}
    assert scored == {0: pytest.approx(2 / 3), 1: pytest.approx(2 / 3)}
    assert mt.macro_f1(mt.confusion(ex, ag.majority(ex, votes)), 4).first()["macro_f1"] == pytest.approx(1 / 3)


def test_multilabel_empty_pair(spark):
    y = spark.createDataFrame([(1, [0]), (2, []), (3, [0, 1])], "id bigint, labels array<int>")
    z = spark.createDataFrame([(1, [0]), (2, []), (3, [1])], "id bigint, labels array<int>")
    a, b = mt.multilabel_summary(y, z, 2).first(), mt.multilabel_summary(y, z, 2, empty_pair=1.0).first()
    assert a["sample_f1"] == pytest.approx((1 + 0 + 2 / 3) / 3) and b["sample_f1"] == pytest.approx((1 + 1 + 2 / 3) / 3)
    assert a["subset_accuracy"] == pytest.approx(2 / 3) and a["hamming_loss"] == pytest.approx(1 / 6)


def test_run_pool_abstains_and_width(spark, ex):
    pool = [an.regex_rule("lf_a", 0, "a"), an.regex_rule("lf_b", 1, "b"), an.Annotator("lf_null", lambda: F.lit(None)), an.Annotator("lf_neg", lambda: F.lit(-7))]
    one = sorted(map(tuple, an.run_pool(ex, pool).collect()))
    assert one == sorted(map(tuple, an.run_pool(ex.repartition(3), pool, width=1).collect()))
    assert {r[2] for r in one} == {"lf_a", "lf_b"} and len(one) == 5
    assert an.run_pool(ex, []).count() == 0
    wide = {r["id"]: r["votes"] for r in an.vote_map(ex, an.run_pool(ex, pool), [a.name for a in pool]).collect()}
    assert wide[5] == {"lf_a": -1, "lf_b": -1, "lf_null": -1, "lf_neg": -1}


def test_normalize_votes(spark):
    v = spark.createDataFrame([("3",), ("-1",), (None,), ("x",), ("9",)], "vote string")
    assert [r["vote"] for r in an.normalize_votes(v, 5).collect()] == [3]


def test_parsing_generated_rules():
    seen: set[str] = set()
    reply = "text\n```python\ndef lf_a(ex):\n    return -1 if ex['x'] == -1 else 2\ndef helper(x): return x\ndef lf_two(a, b): return 1\n```\n```\ndef broken(:\n```"
    found = an.parse_rules(reply, seen)
    assert [n for n, _ in found] == ["lf_a"] and "return ABSTAIN" in found[0][1] and "== ABSTAIN" in found[0][1]
    taken = {"lf_a_t1"}
    assert an.unique_name("lf_a", taken, "t1") == "lf_a_t1_2"
    out = an.prefix_helpers("K = 3\ndef h(x):\n    return x + K\ndef lf_q(ex):\n    return h(1)\n", "b0")
    assert "b0_h(1)" in out and "b0_K" in out and "def lf_q" in out
    block = "import re\né = 'K'; K = 1  # K\n@staticmethod\ndef h(x, K=K):\n    global N\n    N = 2\n    return x.K + K\ndef lf_q(x):\n    h = 3\n    return h + N + len(f'{é}') + [K for K in x][0]\n"
    want = "import re\nb0_é = 'K'; b0_K = 1  # K\n@staticmethod\ndef b0_h(x, K=b0_K):\n    global b0_N\n    b0_N = 2\n    return x.K + K\ndef lf_q(x):\n    h = 3\n    return h + b0_N + len(f'{b0_é}') + [K for K in x][0]\n"
    assert an.prefix_helpers(block, "b0") == want and an.prefix_helpers("def broken(:", "b0") == "def broken(:"
    assert an.abstain_literals("return - 1 if x == -1 else -1.5\nreturn -1.5\nif y != -10: return -1") == "return ABSTAIN if x == ABSTAIN else -1.5\nreturn -1.5\nif y != -10: return ABSTAIN"
    with pytest.raises(PermissionError):
        an.source_rule("lf_a", "def lf_a(ex): return 1", ["text"])


def test_trusted_source_rule(spark, ex):
    src = "def lf_s(ex):\n    if ex['text_lower'] == 'zz':\n        raise ValueError\n    return 1 if 'b' in ex['text_lower'] else ABSTAIN\n"
    v = an.run_pool(ex, [an.source_rule("lf_s", src, ["text_lower"], trusted=True)])
    assert sorted(r["id"] for r in v.collect()) == [2, 3]


def test_pools(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "lf string, n int")
    b = spark.createDataFrame([("y", 2), ("z", 2)], "lf string, n int")
    assert sorted(map(tuple, an.merge_pools(a, b).collect())) == [("x", 1), ("y", 1), ("z", 2)]
    assert [r["lf"] for r in an.purge(a, b).collect()] == ["x"]


def test_tasks(spark):
    assert get_task("pubmed").label_key == "true_labels" and get_task("chemprot").n_classes == 10
    with pytest.raises(KeyError, match="fever"):
        get_task("none")
    assert get_task("fever").dimension(spark).count() == 3
