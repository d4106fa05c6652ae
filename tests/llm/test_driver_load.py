"""Tables that grow with the corpus are not broadcast, as each broadcast goes through the driver; training in slices."""

import numpy as np

from votelake.llm import common, similar, simhash, toxicity


def broadcast_joins(spark, run):
    """How many of the plans that ``run`` executes broadcast a side of a join, and what it returns."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    known = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    out = run()
    bus.waitUntilEmpty()
    ran = [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    ran = [x.physicalPlanDescription() for x in ran if x.executionId() not in known]
    assert ran
    return sum("BroadcastHashJoin" in x for x in ran), out


def test_simhash_links_and_components_broadcast_nothing(spark):
    fps = [k << 20 | bits for k in range(1, 40) for bits in (0, 1, 3, 7, 31)]
    distinct = common.materialize(spark.createDataFrame([(x,) for x in fps], "fp bigint"))
    n, got = broadcast_joins(spark, lambda: simhash.components(simhash.links(distinct)).collect())
    assert n == 0
    near = lambda a, b: (a ^ b).bit_count() <= simhash.BITS
    root = {x: x for x in fps}
    while (new := {x: min(root[y] for y in fps if near(x, y)) for x in fps}) != root:
        root = new
    assert {r["node"]: r["root"] for r in got} == {x: r for x, r in root.items() if sum(near(x, y) for y in fps) > 1}


def test_near_copies_broadcast_no_numbers_beyond_the_limit(spark, monkeypatch):
    texts = [" ".join(f"w{(i * 13 + k) % 400}" for k in range(60)) for i in range(30)]
    texts += [t + " end" for t in texts[:9]]
    rows = common.materialize(spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], f"doc_id bigint, text string, {common.ROW} bigint"))
    gone = lambda: sorted(r[0] for r in similar.copies(rows).collect())
    want = gone()
    assert set(range(30, 39)) <= set(want)
    monkeypatch.setattr(common, "MOST_NUMBERS", 0)
    n, got = broadcast_joins(spark, gone)
    assert n == 0 and got == want
    listed = rows.filter("doc_id % 3 = 0").select(common.ROW)
    n, got = broadcast_joins(spark, lambda: common.by_number(rows, listed, "left_anti").select("doc_id").collect())
    assert n == 0 and {r[0] for r in got} == {i for i in range(39) if i % 3}


def test_tokens_hashed_in_slices(monkeypatch):
    tokens = [f"word{i * 37 % 1009}x{'y' * (i % 5)}" for i in range(700)] + ["", "--", "é"]
    row, owner = toxicity.bags(tokens)
    order = np.argsort(owner, kind="stable")
    calls = []
    bags = toxicity.bags
    monkeypatch.setattr(toxicity, "bags", lambda t: calls.append(len(t)) or bags(t))
    monkeypatch.setattr(toxicity, "SLICE", 64)
    got = toxicity.sorted_bags(tokens)
    assert max(calls) <= 64 and got[0].tolist() == row[order].tolist() and got[1].tolist() == owner[order].tolist()
    assert toxicity.sorted_bags([])[0].size == 0
    calls.clear()
    toxicity.fit([" ".join(tokens[:350]), " ".join(tokens[350:])], [0, 1])
    assert max(calls) <= 64
