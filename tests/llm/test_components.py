"""Components of edges in any order, and the rows that their rounds move."""

import random

from tidewater.llm import components, minhash, storage


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {x: root(x) for x in parent}


def labels(frame):
    rows = frame.collect()
    found = {r.node: r.component for r in rows}
    assert len(found) == len(rows)
    return found


def test_random_graphs(spark):
    rng = random.Random(5)
    for n, m in ((40, 25), (60, 90), (300, 260)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(0, 0)]
        assert labels(components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")) == brute(edges)
    path = [(i, i + 1) for i in range(70)]
    assert labels(components.connected_components(spark.createDataFrame(path, "a long, b long"), "a", "b")) == brute(path)


def test_a_round_makes_no_rows_but_its_edges(spark, monkeypatch):
    plans, write = [], storage.materialize

    def spy(df, *a, **b):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *a, **b)

    monkeypatch.setattr(storage, "materialize", spy)
    edges = [(a, b) for a in range(12) for b in range(a)]
    assert set(labels(components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")).values()) == {0}
    assert len(plans) > 2
    assert not any("Generate" in p for p in plans)


def test_further_links_join_components_not_their_links(spark, monkeypatch):
    """A component goes on as one edge for each node, however many links made it."""
    sizes, run = [], minhash.connected_components

    def spy(edges, *a):
        sizes.append(edges.count())
        return run(edges, *a)

    monkeypatch.setattr(minhash, "connected_components", spy)
    found = spark.createDataFrame([(5, 1), (1, 1), (9, 2), (2, 2)], "node long, component long")
    joined = minhash._joined(found, spark.createDataFrame([(9, 5, 3, True)], "a long, b long, shared long, linked boolean"))
    assert labels(joined) == {1: 1, 2: 1, 5: 1, 9: 1}
    assert sizes == [5]
