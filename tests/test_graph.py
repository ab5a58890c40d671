"""Micro-graphs with known answers, random graphs, and every registered graph query against its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quiltgraph import queries
from quiltgraph.functions import ids
from quiltgraph.operators import access, analytics, components, messaging, program
from quiltgraph.operators.components import contract
from quiltgraph.operators.graph import build_graph
from quiltgraph.operators.sets import DisjointSets
from quiltgraph.operators.subgraphs import form_subgraphs
from quiltgraph.plans import loop
from quiltgraph.sources import readers, writers

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def graph(spark, edges, parts, **options):
    v = spark.createDataFrame([(v, p) for p, own in parts.items() for v in own], "vertex_id long, partition_id int")
    e = spark.createDataFrame(edges, "src long, dst long")
    return build_graph(v, e, **options)


def sg(text):
    p, k = map(int, text.split(":"))
    return p << 32 | k


M1_EDGES = [(1, 2), (2, 3), (1, 3), (3, 4), (2, 4), (4, 7), (3, 7), (7, 8), (5, 6)]


@pytest.fixture(scope="module")
def m1(spark):
    return form_subgraphs(graph(spark, M1_EDGES + [(b, a) for a, b in M1_EDGES], {0: [1, 2, 3], 1: [4, 5, 9], 2: [6, 7, 8]}))


@pytest.fixture(scope="module")
def m2(spark):
    return form_subgraphs(graph(spark, [(1, 10), (2, 10), (10, 20), (30, 1)], {0: [1, 2, 3], 1: [10], 2: [20, 30]}))


def test_m1_structure(m1):
    want = {1: "0:0", 2: "0:0", 3: "0:0", 4: "1:0", 5: "1:1", 9: "1:2", 6: "2:0", 7: "2:1", 8: "2:1"}
    assert {r["vertex_id"]: r["subgraph_id"] for r in m1.vertex_subgraph.collect()} == {k: sg(v) for k, v in want.items()}
    assert rows(m1.subgraphs) == sorted([(sg("0:0"), 0, 3, 2, 9), (sg("1:0"), 1, 1, 3, 3), (sg("1:1"), 1, 1, 1, 1), (sg("1:2"), 1, 1, 0, 0), (sg("2:0"), 2, 1, 1, 1), (sg("2:1"), 2, 2, 2, 4)], key=repr)
    meta = [("0:0", "1:0"), ("0:0", "2:1"), ("1:0", "0:0"), ("1:0", "0:0"), ("1:0", "2:1"), ("1:1", "2:0"), ("2:0", "1:1"), ("2:1", "0:0"), ("2:1", "1:0")]
    assert rows(analytics.meta_graph(m1)) == sorted([(sg(a), sg(b)) for a, b in meta], key=repr)
    assert rows(m1.graph.numbered_edges, F.shiftright("edge_id", 32).alias("p"), F.col("edge_id").bitwiseAND(F.lit(2**32 - 1)).alias("k")) == sorted([(0, k) for k in range(9)] + [(1, k) for k in range(4)] + [(2, k) for k in range(5)], key=repr)


def test_m1_analytics(m1):
    assert rows(analytics.graph_stats(m1)) == [(9, 18, 6, 2)]
    labels = {"0:0": "0:0", "1:0": "0:0", "1:1": "1:1", "1:2": "1:2", "2:0": "1:1", "2:1": "0:0"}
    assert rows(analytics.subgraph_components(m1)) == sorted([(sg(a), sg(b)) for a, b in labels.items()], key=repr)
    assert rows(analytics.label_propagation(m1)) == sorted([(sg(a), sg(b)) for a, b in labels.items()], key=repr)
    assert rows(analytics.shortest_paths(m1.graph, 1)) == [(1, 0, -1), (2, 1, 1), (3, 1, 1), (4, 2, 2), (7, 2, 3), (8, 3, 7)]
    assert rows(analytics.placed_triangles(m1)) == [(1, 2, 3, 1, sg("0:0")), (2, 3, 4, 2, sg("0:0")), (3, 4, 7, 3, sg("2:1"))]
    assert rows(analytics.triangles_by_subgraph(m1)) == sorted([(sg("0:0"), 2), (sg("1:0"), 0), (sg("1:1"), 0), (sg("1:2"), 0), (sg("2:0"), 0), (sg("2:1"), 1)], key=repr)
    assert rows(analytics.triangle_total(m1.graph)) == [(3,)]


def test_m1_pagerank(m1):
    ranked = lambda **k: [round(r[1], 6) for r in rows(analytics.pagerank(m1.graph, **k), "vertex_id", "rank")]
    assert ranked() == [0.758245, 1.082501, 1.418995, 1.089567, 1.0, 1.0, 1.16937, 0.481322, 0.15]
    assert ranked(mode="partition_lag") == [0.750399, 1.06987, 1.401645, 1.07579, 0.925749, 0.925749, 1.15589, 0.477322, 0.15]
    assert ranked(mode="partition_lag", iterations=1) == [0.645833, 0.7875, 0.858333, 0.15, 0.15, 0.15, 1.0, 0.433333, 0.15]
    assert ranked(mode="partition_lag", iterations=2) == [0.555521, 0.890208, 1.214271, 0.929167, 1.0, 1.0, 1.014167, 0.433333, 0.15]


def test_m2(m2):
    want = {1: "0:0", 2: "0:0", 3: "0:1", 10: "1:0", 20: "2:0", 30: "2:1"}
    assert {r["vertex_id"]: r["subgraph_id"] for r in m2.vertex_subgraph.collect()} == {k: sg(v) for k, v in want.items()}
    assert rows(analytics.meta_graph(m2)) == sorted([(sg("0:0"), sg("1:0")), (sg("1:0"), sg("2:0")), (sg("2:1"), sg("0:0"))], key=repr)
    assert rows(analytics.graph_stats(m2)) == [(6, 4, 5, 4)]
    assert {r["subgraph_id"]: r["label"] for r in analytics.label_propagation(m2).collect()} == {sg("0:0"): 0, sg("0:1"): 1, sg("1:0"): 0, sg("2:0"): 0, sg("2:1"): 0}
    assert rows(analytics.shortest_paths(m2.graph, 1)) == [(1, 0, -1), (10, 1, 1), (20, 2, 10)]
    assert [(r[0], round(r[1], 6)) for r in rows(analytics.pagerank(m2.graph))] == [(1, 0.2775), (10, 0.513375), (2, 0.15), (20, 0.586369), (3, 0.15), (30, 0.15)]


def test_m3_labels_are_not_components(spark):
    s = form_subgraphs(graph(spark, [(20, 10), (10, 1)], {0: [1], 1: [10], 2: [20]}))
    assert {r["subgraph_id"]: r["label"] for r in analytics.label_propagation(s).collect()} == {sg("2:0"): sg("1:0"), sg("1:0"): 0, sg("0:0"): 0}
    assert {r["component"] for r in analytics.subgraph_components(s).collect()} == {0}
    assert {r["label"] for r in analytics.label_propagation(s, direction="both").collect()} == {0}


def test_odd_graphs(spark):
    e = [(1, 2), (1, 2), (2, 2), (1, 99), (None, 3), (3, None)]
    g = graph(spark, e, {0: [1, 2, 3], 4: [1, 5]})
    assert rows(g.vertices, "vertex_id", "partition_id") == [(1, 0), (2, 0), (3, 0), (5, 4), (99, 0)]
    assert rows(analytics.edge_list(g)) == [(1, 2), (1, 2), (1, 99), (2, 2)] and rows(analytics.vertex_count(g)) == [(4,)]
    assert rows(analytics.degrees(g)) == sorted([(1, 3, 0), (2, 1, 3), (3, 0, 0), (5, 0, 0), (99, 0, 1)], key=repr)
    assert rows(analytics.edge_list(graph(spark, e, {0: [1, 2, 3]}, undeclared="drop"))) == [(1, 2), (1, 2), (2, 2)]
    with pytest.raises(ValueError):
        graph(spark, e, {0: [1, 2, 3]}, undeclared="error")
    empty = form_subgraphs(graph(spark, [], {}))
    assert rows(empty.subgraphs) == [] and rows(analytics.connected_components(empty)) == [] and rows(analytics.pagerank(empty.graph)) == []
    assert rows(analytics.shortest_paths(empty.graph, 1)) == [] and rows(analytics.triangles(empty.graph)) == []


def plain_subgraphs(edges, part):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for v, p in part.items():
        find((p, v))
    for a, b in edges:
        parent[find((part[a], a))] = find((part[a], b))
    least = {}
    for v, p in part.items():
        least[find((p, v))] = min(v, least.get(find((p, v)), v))
    out = {}
    for v, p in part.items():
        out[v] = p << 32 | sorted(x for r, x in least.items() if r[0] == p).index(least[find((p, v))])
    return out


def test_random_graphs(spark):
    for seed in range(4):
        rng = random.Random(seed)
        n = 30
        part = {v: rng.randrange(4) for v in range(n)}
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([15, 40]))]
        s = form_subgraphs(graph(spark, edges, {p: [v for v in part if part[v] == p] for p in range(4)}))
        assert {r["vertex_id"]: r["subgraph_id"] for r in s.vertex_subgraph.collect()} == plain_subgraphs(edges, part)
        assert s.subgraphs.agg(F.sum("n_local"), F.sum("n_edges")).first() == (n, len(edges))
        simple = {frozenset(e) for e in edges if e[0] != e[1]}
        want = sum(1 for a in range(n) for b in range(a) for c in range(b) if {frozenset((a, b)), frozenset((b, c)), frozenset((a, c))} <= simple)
        assert rows(analytics.triangle_total(s.graph)) == [(want,)]
        distance = {r["vertex_id"]: r for r in analytics.shortest_paths(s.graph, 0).collect()}
        for v, r in distance.items():
            assert v == 0 or distance[r["parent"]]["distance"] == r["distance"] - 1 and (r["parent"], v) in edges
        one = graph(spark, edges, {0: list(range(n))})
        a, b = (rows(analytics.pagerank(one, iterations=5, mode=m).withColumn("rank", F.round("rank", 9))) for m in ("sync", "partition_lag"))
        assert a == b


@pytest.mark.parametrize("one_task", [0, 100_000])
def test_contract(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", one_task)
    pairs = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (5, 5), (None, 1)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    assert dict(rows(contract(edges))) == {i: 0 for i in range(1, 201)} | {301: 300}
    node = lambda c: F.struct((F.col(c) % 2).alias("p"), F.col(c).cast("string").alias("id"))
    some = contract(edges.where("u >= 300").select(node("u").alias("u"), node("v").alias("v")))
    assert [(tuple(r["u"]), tuple(r["v"])) for r in some.collect()] == [((1, "301"), (0, "300"))]
    assert contract(edges.where("u = 5 and v = 5")).collect() == []


def test_sets(spark):
    elements = spark.createDataFrame([(i,) for i in [1, 2, 3, 4, 4, None]], "element long")
    sets = DisjointSets.of(elements).union(spark.createDataFrame([(1, 2), (2, 1)], "x long, y long")).union(spark.createDataFrame([(2, 4)], "x long, y long"))
    assert rows(sets.sets()) == [(1, [1, 2, 4], 3), (3, [3], 1)] and rows(sets.count()) == [(2,)]
    assert rows(sets.members(4)) == [(1,), (2,), (4,)] and rows(sets.find(elements.where("element = 4").distinct())) == [(4, 1)]
    with pytest.raises(ValueError):
        sets.members(9)
    with pytest.raises(ValueError):
        sets.union(spark.createDataFrame([(1, 9)], "x long, y long"))


def test_ranks_of_large_groups(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("int").alias("g"), (F.col("id") * 7 % 1000).alias("x"))
    assert rows(ids.with_rank(df, "g", ["x"], "r", window_rows=10)) == rows(ids.with_rank(df, "g", ["x"], "r"))


def test_programs(m1, m2):
    for s in (m1, m2):
        n = s.graph.vertices.count()
        value, metrics = program.run_program(s, program.vertex_count_program)
        assert {r["value"] for r in value.collect()} == {str(n)} and len(metrics) == 2
        labels, _ = program.run_program(s, program.min_label_program)
        assert {(r["subgraph_id"], int(r["value"])) for r in labels.collect()} == set(rows(analytics.label_propagation(s)))


def test_program_messages_and_limits(m1):
    def to_vertex_program(context, messages):
        if context.superstep == 0:
            for v, _ in context.remote:
                context.send_to_vertex(v, [context.subgraph_id, v])
            context.send(1 << 60, "nobody is there")
        else:
            context.value = sorted(m[1] for m in messages)
            assert all(m[1] in context.vertices for m in messages)
        context.vote_to_halt()

    def endless_program(context, messages):
        context.send_to_all(context.initial)

    value, metrics = program.run_program(m1, to_vertex_program)
    got = {r["subgraph_id"]: r["value"] for r in value.collect()}
    assert got[sg("1:0")] == "[4, 4]" and got[sg("1:2")] == "null" and metrics[0]["messages"] > 0
    with pytest.raises(RuntimeError):
        program.run_program(m1, endless_program, initial="x", max_supersteps=2)
    with pytest.raises(RuntimeError):
        loop.supersteps(m1.subgraphs, lambda t, i: t, lambda r: False, {"n": F.count(F.lit(1))}, "never", max_supersteps=2)


def test_values_and_partitions(m1):
    new = m1.subgraphs.sparkSession.createDataFrame([(sg("0:0"), "a"), (sg("1:0"), None)], "subgraph_id long, value string")
    first = access.with_values(m1.subgraphs, "subgraph_id", new)
    assert {r["subgraph_id"]: r["value"] for r in first.collect()}[sg("0:0")] == "a"
    again = access.with_values(first, "subgraph_id", new.where("value is null").withColumn("subgraph_id", F.lit(sg("0:0"))))
    assert {r["value"] for r in again.collect()} == {None}
    assert [r["subgraph_id"] for r in access.partition_subgraphs(m1, 1).collect()] == [sg("1:0"), sg("1:1"), sg("1:2")]
    rest = access.remove_subgraphs(m1.subgraphs, new)
    assert rest.count() == 4 and access.add_subgraphs(rest, m1.subgraphs.limit(1)).count() == 5
    assert rows(messaging.inbox(messaging.send_to_all(m1.subgraphs.select(F.col("subgraph_id").alias("src_sg")), m1)).select(F.size("messages").alias("n"))) == [(6,)] * 6


def test_readers_on_odd_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1").write_text("1 0  2\t3 3 \n\n  2 1\nx 1 2\n3 0 y\n4\n1 0 5\n")
    with pytest.raises(Exception, match="malformed line"):
        readers.read_graph(spark, f"{tmp_path}/a")
    g = readers.read_graph(spark, f"{tmp_path}/a", mode="permissive")
    assert rows(g.edges, "src", "dst") == [(1, 2), (1, 3), (1, 3), (1, 5)] and rows(g.declared) == [(1, 0), (2, 1)]
    assert rows(readers.bad_rows(spark, f"{tmp_path}/a", "adj")) == [("3 0 y",), ("4",), ("x 1 2",)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/0").write_text('[1, "name:String:a:b$age:Long:5$age:Long:6$bad$ k:S:", [[2, 100, "w:Double:0.5"], [2, 101, ""]]]\n')
    (tmp_path / "m/1").write_text('[2, "", []]\n[3]\n')
    g = readers.read_graph(spark, f"{tmp_path}/m", "json_map", mode="permissive")
    assert {r["vertex_id"]: (r["partition_id"], r["value"]) for r in g.vertices.collect()} == {1: (0, {"name": "a", "age": "6", " k": ""}), 2: (1, {})}
    assert {r["edge_id"]: r["value"] for r in g.edges.collect()} == {100: {"w": "0.5"}, 101: {}}
    (tmp_path / "e").write_text("# comment\n1 2\n2\t3\n")
    g = readers.read_graph(spark, f"{tmp_path}/e", "edgelist", partitions=2)
    assert rows(g.vertices) == [(1, 1), (2, 0), (3, 1)] and g.edges.count() == 2
    with pytest.raises(ValueError):
        readers.read_graph(spark, "x", "xml")

    def own(lines):
        n = F.split("line", "\\s+").cast("array<bigint>")
        return lines.where("line rlike '^[0-9]'").select("line", F.lit(False).alias("bad"), n[0].alias("src"), F.lit(3).alias("partition_id"), F.array(F.struct(n[1].alias("dst"))).alias("out"))

    assert rows(readers.read_graph(spark, f"{tmp_path}/e", own).vertices) == [(1, 3), (2, 3), (3, 3)]


def test_lines(m1, m2, spark, tmp_path):
    assert rows(writers.adjacency_lines(m2.graph), "value") == [("1 0 10",), ("10 1 20",), ("2 0 10",), ("20 2",), ("3 0",), ("30 2 1",)]
    dump = [r["value"] for r in writers.subgraph_lines(m2).where(F.col("subgraph_id") == sg("1:0")).orderBy("kind", "at").collect()]
    assert dump == [f"{sg('1:0')}\t1\t{sg('2:0')}\t2", "10\t0\t20", "SG_END"]
    writers.write_rows(analytics.edge_list(m2.graph), f"{tmp_path}/rows")
    assert {r["value"] for r in spark.read.text(f"{tmp_path}/rows").collect()} == {"1\t10", "10\t20", "2\t10", "30\t1"}
    m1.register("m1_")
    assert spark.sql("select count(*) from m1_meta_edges").first()[0] == 8


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted(df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None), key=repr)
    assert plain(got) == plain(want)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
