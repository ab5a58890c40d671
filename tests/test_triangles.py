"""Triangles by colours against brute force, whatever the colours, ids and hubs."""

import random

import pytest
from pyspark.sql import functions as F

from quiltgraph.operators import analytics, neighbours, triangles
from quiltgraph.operators.subgraphs import form_subgraphs
from quiltgraph.sources import tables


def brute(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return sorted((a, b, c) for a in near for b in near[a] if a < b for c in near[a] & near[b] if b < c)


def some_edges(seed, names):
    rng = random.Random(seed)
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(150)]
    return edges + edges[:20] + [(b, a) for a, b in edges[:20]] + [(names[0], n) for n in names]  # a hub, loops, repeats


@pytest.mark.parametrize("names", [list(range(30)), [-(1 << 62), -7, *range(15), 1 << 31, 1 << 40, (1 << 63) - 1]])
@pytest.mark.parametrize("task_edges", [16_000_000, 200, 20])
def test_triangles_by_colours(spark, monkeypatch, names, task_edges):
    monkeypatch.setattr(triangles, "TASK_EDGES", task_edges)
    monkeypatch.setattr(triangles, "PAIRS", 10)
    edges = some_edges(task_edges, names)
    held = neighbours.of_edges(spark.createDataFrame(edges, "src long, dst long"))
    values = spark.createDataFrame([(n, i - 3) for i, n in enumerate(names)], "vertex_id long, value long")
    value = dict((n, i - 3) for i, n in enumerate(names))
    want = brute(edges)
    assert sorted(map(tuple, triangles.find(held).collect())) == want
    assert sorted(map(tuple, triangles.find(held, values).collect())) == [(a, b, c, value[a], value[b], value[c]) for a, b, c in want]


def test_no_pairs_of_edges_are_shuffled(spark):
    """Each undirected edge is dealt once with a degree, and then sent once a colour; vertices' subgraphs come along."""
    g = tables.copurchase(spark, "/root/testdata/sf0.001")
    for df in (analytics.triangles(g), analytics.placed_triangles(form_subgraphs(g))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") <= 2
    assert analytics.triangles(g.__class__(g.vertices.where("false"), g.edges.where("false"), g.vertices.where("false"))).count() == 0
    assert analytics.triangle_total(g).first()[0] == len(brute([tuple(r) for r in g.edges.select("src", "dst").where(F.col("src") < F.col("dst")).collect()]))
