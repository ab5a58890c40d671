"""Tables of neighbours against edge tables and brute force, and that they need no shuffle of edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltgraph.functions import ids
from quiltgraph.operators import access, analytics, components, forest, messaging, neighbours
from quiltgraph.operators.components import contract
from quiltgraph.operators.graph import build_graph, graph_of_neighbours
from quiltgraph.operators.subgraphs import form_subgraphs
from quiltgraph.sources import tables, writers

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def members(spark, seed=1, ids=range(40), groups=30):
    rng, ids = random.Random(seed), list(ids)
    return [(g, rng.choice(ids)) for g in range(groups) for _ in range(rng.choice([1, 2, 2, 3]))] + [(None, ids[0]), (1, None)]


def brute(pairs):
    held = {}
    for g, m in pairs:
        if g is not None and m is not None:
            held.setdefault(g, set()).add(m)
    return sorted({(a, b) for s in held.values() for a in s for b in s if a != b})


@pytest.mark.parametrize("wanted", [range(40), [-(1 << 62), -5, 0, 7, 1 << 40, (1 << 63) - 1, 12, 13]])
def test_neighbours_of_groups(spark, monkeypatch, wanted):
    monkeypatch.setattr(neighbours, "CHUNK_PAIRS", 8)
    pairs = members(spark, ids=wanted)
    got = neighbours.of_groups(spark.createDataFrame(pairs, "group_id long, member long"))
    assert all(r["sinks"] == sorted(r["sinks"]) for r in got.collect())
    assert rows(got.select("vertex_id", F.explode("sinks"))) == sorted(brute(pairs), key=repr)
    assert got.count() == got.select("vertex_id").distinct().count()


@pytest.mark.parametrize("modulus", [4, 1, 100])
def test_neighbours_give_what_edges_give(spark, modulus):
    for seed in range(3):
        pairs = members(spark, seed, groups=25)
        held = graph_of_neighbours(neighbours.of_groups(spark.createDataFrame(pairs, "group_id long, member long")), modulus)
        edges = brute(pairs)
        vertices = spark.createDataFrame(sorted({(a, a % modulus) for a, _ in edges}), "vertex_id long, partition_id int")
        plain = build_graph(vertices, spark.createDataFrame(edges, "src long, dst long"))
        s, t = form_subgraphs(held), form_subgraphs(plain)
        assert rows(held.numbered_edges) == rows(plain.numbered_edges) and rows(held.edges_by_sink) == rows(plain.edges, "src", "dst")
        for table in ("vertex_subgraph", "remote_vertices", "meta_edges", "subgraphs", "edges"):
            columns = getattr(t, table).columns
            assert rows(getattr(s, table), *columns) == rows(getattr(t, table), *columns)
        assert rows(access.subgraph_edges(s)) == rows(access.subgraph_edges(t))
        assert rows(writers.subgraph_lines(s)) == rows(writers.subgraph_lines(t))
        for edge in [r["edge_id"] for r in plain.numbered_edges.limit(5).collect()] + [-1, 1 << 50]:
            assert rows(access.edge_by_id(s, edge)) == rows(access.edge_by_id(t, edge))
        assert rows(analytics.placed_triangles(s)) == rows(analytics.placed_triangles(t))


def test_subgraphs_of_neighbours_move_no_edges(spark):
    g = tables.copurchase(spark, SF)
    assert g.neighbours is not None
    for df in (neighbours.links(g.neighbours, g.modulus), neighbours.stubs(g.neighbours, g.modulus)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    n = g.vertices.count()
    # every task's links are a forest
    assert 0 < neighbours.links(g.neighbours, g.modulus).count() < n * g.neighbours.rdd.getNumPartitions()


def test_folding_gathers_no_inbox(spark):
    messages = spark.range(100).select((F.col("id") % 3).alias("dst_sg"), F.col("id").alias("n"))
    folded = messaging.fold(messages, n_messages=F.count(F.lit(1)), total=F.sum("n"))
    assert "collect_list" not in folded._jdf.queryExecution().executedPlan().toString()
    assert rows(folded) == [(k, len(range(k, 100, 3)), sum(range(k, 100, 3))) for k in range(3)]


def plain_sets(pairs):
    least = {x: x for p in pairs for x in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return {x: m for x, m in least.items() if x != m}


@pytest.mark.parametrize("direct,limit", [(1 << 25, 8_000_000), (0, 8_000_000), (20, 3)])
def test_forests(monkeypatch, direct, limit):
    monkeypatch.setattr(forest, "DIRECT", direct)
    monkeypatch.setattr(forest, "LIMIT", limit)
    monkeypatch.setattr(forest, "BLOCK", 7)
    rng = random.Random(direct)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    held, out = forest.Forest(), []
    for i in range(0, len(pairs), 5):
        u, v = (np.array([p[k] for p in pairs[i : i + 5]], np.int64) for k in (0, 1))
        out += list(held.add(u, v))
    out += list(held.flush())
    found = [(a, b) for batch in out for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    assert plain_sets(found) == plain_sets(pairs) and (limit == 3 or len(found) < 60)


@pytest.mark.parametrize("one_task,longs", [(100_000, 8_000_000), (100_000, 3), (0, 8_000_000)])
def test_contract_of_longs(spark, monkeypatch, one_task, longs):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", one_task)
    monkeypatch.setattr(components, "ONE_TASK_LONGS", longs)
    monkeypatch.setattr(components, "MERGED_TASKS", 2)
    pairs = [(i, i + 2) for i in range(100)] + [(-(1 << 62), 1 << 61), (1 << 61, 500), (7, 7)]
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(5)
    assert dict(rows(contract(edges))) == plain_sets(pairs)


def test_sums_before(spark):
    df = spark.range(500).select((F.col("id") % 3).cast("int").alias("g"), (F.col("id") * 7 % 500).alias("x"), (F.col("id") % 5).alias("w"))
    assert rows(ids.with_rank(df, "g", ["x"], "r", window_rows=10, weight="w")) == rows(ids.with_rank(df, "g", ["x"], "r", weight="w"))
    first = {(r["g"], r["x"]): r["r"] for r in ids.with_rank(df, "g", ["x"], "r", weight="w").collect()}
    want, at = {}, {}
    for g, x, w in sorted(map(tuple, df.collect())):
        want[g, x] = at.get(g, 0)
        at[g] = want[g, x] + w
    assert first == want


def test_lines_gather_no_edges(spark):
    """Vertices' sinks come from their rows, not from edges gathered again."""
    lines = writers.subgraph_lines(form_subgraphs(tables.copurchase(spark, SF)))
    assert "collect_list(dst#" not in lines._jdf.queryExecution().optimizedPlan().toString()
