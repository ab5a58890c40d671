import pytest

from quiltgraph.operators import analytics
from quiltgraph.operators.graph import build_graph
from quiltgraph.operators.subgraphs import form_subgraphs


@pytest.mark.parametrize("limit", [1, 3, 100])
def test_graph_stats_of_more_subgraphs_than_a_block(spark, monkeypatch, limit):
    for name in ("MAX_DIAMETER_SUBGRAPHS", "DIAMETER_BLOCK"):
        monkeypatch.setattr(analytics, name, limit, raising=False)
    home = {1: 0, 2: 0, 3: 0, 10: 1, 20: 2, 30: 2}
    vertices = spark.createDataFrame(list(home.items()), "vertex_id long, partition_id int")
    edges = spark.createDataFrame([(1, 10), (2, 10), (10, 20), (30, 1)], "src long, dst long")
    s = form_subgraphs(build_graph(vertices, edges))
    assert [tuple(r) for r in analytics.graph_stats(s).collect()] == [(6, 4, 5, 4)]
    pairs = [tuple(r) for r in analytics.meta_distances(s).select("hops").collect()]
    assert sorted(h for h, in pairs) == [0] * 5 + [1] * 3 + [2] * 2 + [3]
