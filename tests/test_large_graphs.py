"""Graphs that fit a task and graphs that don't give the same nodes."""

import random

import pytest

from prismgraph.operators import sizes
from prismgraph.operators.check import cyclic_nodes
from prismgraph.plans.view import reachable


def graphs():
    rng = random.Random(5)
    edges = [(g, rng.randrange(n), rng.randrange(n)) for g, n, m in (("a", 6, 5), ("b", 40, 45), ("c", 40, 60)) for _ in range(m)]
    return edges + [("chain", i, i + 1) for i in range(9)]


def reached(edges, roots):
    seen = set(roots)
    while True:
        more = {(g, t) for g, s, t in edges if (g, s) in seen} - seen
        if not more:
            return seen
        seen |= more


@pytest.mark.parametrize("fits", [250_000, 20, 0])
def test_large_and_small(spark, monkeypatch, fits):
    monkeypatch.setattr(sizes, "EDGES_IN_TASK", fits)
    edges, roots = graphs(), [("a", 0), ("b", 1), ("b", 2), ("chain", 3), ("alone", 7)]
    table = spark.createDataFrame([*edges, *edges[:9], (None, 1, 2), ("a", None, 0), ("a", 0, None)], "gid string, s long, t long")
    starts = spark.createDataFrame([*roots, roots[0], (None, 1), ("a", None)], "gid string, key long")
    assert sorted(tuple(r) for r in reachable(table, starts).collect()) == sorted(reached(edges, roots))
    nodes = {(g, x) for g, s, t in edges for x in (s, t)}
    on = {(g, x) for g, x in nodes if (g, x) in reached(edges, [(h, t) for h, s, t in edges if (h, s) == (g, x)])}
    assert sorted(tuple(r) for r in cyclic_nodes(table).collect()) == sorted(on)


def test_no_edges(spark):
    none = spark.createDataFrame([], "gid string, s long, t long")
    roots = spark.createDataFrame([("a", 1)], "gid string, key long")
    assert [tuple(r) for r in reachable(none, roots).collect()] == [("a", 1)]
    assert cyclic_nodes(none).collect() == []
