"""Walks of a graph to the end: what they find, and what they send to all executors."""

import random

import pytest

from platterlake.operators import trees


def by_hand(edges, root):
    """Least steps to each node, by a queue; a missing child is one node without edges."""
    below, depth, now = {}, {root: 0}, [root]
    for parent, child in edges:
        below.setdefault(parent, []).append(child)
    while now:
        now = [c for p in now if p is not None for c in below.get(p, []) if depth.setdefault(c, depth[p] + 1) == depth[p] + 1]
        now = list(dict.fromkeys(now))
    return depth


def broadcasts(spark, after):
    """(id of the last execution, rows of each table sent to all executors since ``after``)."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, rows = spark._jsparkSession.sharedState().statusStore(), []
    runs = store.executionsList()
    ids = [i for k in range(runs.size()) if (i := runs.apply(k).executionId()) > after]
    for i in ids:
        values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name() == "BroadcastExchange":
                of = [m for m in (node.metrics().apply(k) for k in range(node.metrics().size())) if m.name() == "number of output rows"]
                rows += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in of if values.contains(m.accumulatorId())]
    return max(ids, default=after), rows


@pytest.mark.parametrize("few", [1, 50, 100_000])
def test_a_walk_sends_few_nodes_to_all_executors(spark, monkeypatch, few):
    monkeypatch.setattr(trees, "FEW", few, raising=False)
    n = 2_000
    edges = [(i, c) for i in range(n) for c in (i * 2 % n, (i * 2 + 1) % n)]
    table = spark.createDataFrame(edges, "parent long, child long").repartition(4)
    at, _ = broadcasts(spark, -1)
    got = trees.reach(table, 1, "long").collect()
    _, sent = broadcasts(spark, at)
    assert {r["id"]: r["depth"] for r in got} == by_hand(edges, 1) and len(got) == n
    assert sent and max(sent) <= min(few, n)


@pytest.mark.parametrize("few", [1, 3, 100_000])
def test_a_walk_over_odd_edges(spark, monkeypatch, few):
    monkeypatch.setattr(trees, "FEW", few, raising=False)
    draw = random.Random(5)
    edges = [(str(draw.randrange(60)), str(draw.randrange(90))) for _ in range(150)]
    edges += [("7", "7"), ("0", "1"), ("0", "1"), ("1", "0"), ("0", "2"), ("2", "3"), ("2", None), ("3", None), (None, "lost"), ("far", "0")]
    edges += [("1", f"hub{k}") for k in range(200)] + [(f"hub{k}", "after") for k in range(200)]
    got = trees.reach(spark.createDataFrame(edges, "parent string, child string"), "0").collect()
    assert {r["id"]: r["depth"] for r in got} == by_hand(edges, "0") and len(got) == len({r["id"] for r in got})


def test_a_walk_from_a_node_without_edges(spark):
    edges = spark.createDataFrame([("a", "b")], "parent string, child string")
    assert [tuple(r) for r in trees.reach(edges, "b").collect()] == [("b", 0)]
    assert [tuple(r) for r in trees.reach(edges.limit(0), "b").collect()] == [("b", 0)]
