"""The library of analytics over graphs and their subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.operators import neighbours
from quiltgraph.operators.components import contract
from quiltgraph.operators.graph import Graph
from quiltgraph.operators.subgraphs import Subgraphs
from quiltgraph.operators.triangles import find
from quiltgraph.plans.loop import materialise_observed, supersteps
from quiltgraph.plans.storage import materialise

DAMPING, BASE, UPDATES = 0.85, 0.15, 31
#: Updates after which PageRank writes its table; in between, the plan just grows.
CUT_EVERY = 8
#: Out-edges of a vertex beyond which they are spread over several tasks.
HUB_EDGES = 1_000_000
#: Subgraphs, about, from which the diameter is searched at once.
DIAMETER_BLOCK = 20_000


def vertex_count(graph: Graph) -> DataFrame:
    """One row: the number of declared vertices."""
    return graph.declared.agg(F.count(F.lit(1)).alias("n_vertices"))


def edge_list(graph: Graph) -> DataFrame:
    return graph.edges.select("src", "dst")


def degrees(graph: Graph) -> DataFrame:
    """(vertex_id, out_degree, in_degree), repeated edges counted; every vertex has a row."""
    ends = graph.edges.select(F.explode(F.array(*[F.struct(F.col(end).alias("vertex_id"), F.lit(o).alias("o"), F.lit(1 - o).alias("i")) for end, o in (("src", 1), ("dst", 0))])).alias("e")).select("e.*")
    every = ends.unionByName(graph.vertices.select("vertex_id", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return every.groupBy("vertex_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def meta_graph(subgraphs: Subgraphs) -> DataFrame:
    """(src_sg, dst_sg), a row for each remote vertex of a subgraph."""
    return subgraphs.remote_vertices.select(F.col("subgraph_id").alias("src_sg"), F.col("owner_subgraph_id").alias("dst_sg"))


def meta_distances(subgraphs: Subgraphs) -> DataFrame:
    """(src_sg, dst_sg, hops) of all ordered pairs of subgraphs with a path, by breadth-first search from all at once.
    The rows may grow with the square of the subgraphs, as the meaning demands."""
    return _distances_from(subgraphs.subgraphs, subgraphs)[0]


def _distances_from(sources: DataFrame, subgraphs: Subgraphs) -> tuple[DataFrame, int]:
    """The distances from some subgraphs, and the largest of them."""
    meta = subgraphs.meta_edges.select(F.col("src_sg").alias("via"), "dst_sg")
    start = sources.select(F.col("subgraph_id").alias("src_sg"), F.col("subgraph_id").alias("dst_sg"), F.lit(0).alias("hops"))
    levels, front, hops = [], materialise(start, "distances"), 0
    n = 1
    while n:
        levels.append(front)
        hops += 1
        reached = front.select("src_sg", F.col("dst_sg").alias("via")).join(meta, "via").select("src_sg", "dst_sg").distinct()
        if len(levels) > 16:
            levels = [materialise(_union(levels), "distances")]
        reached = reached.join(_union(levels).select("src_sg", "dst_sg"), ["src_sg", "dst_sg"], "left_anti")
        front, row = materialise_observed(reached.withColumn("hops", F.lit(hops)), "distances", n=F.count(F.lit(1)))
        n = row["n"]
    return _union(levels), hops - 1


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def graph_stats(subgraphs: Subgraphs) -> DataFrame:
    """One row: n_vertices, n_edges, n_subgraphs and meta_diameter, the most subgraphs on a shortest path of the
    directed graph of subgraphs (hops + 1, so 1 at least). The search starts from a block of subgraphs at a time,
    of which only the largest distance is held."""
    totals = subgraphs.subgraphs.agg(F.sum("n_local").alias("n_vertices"), F.sum("n_edges").alias("n_edges"), F.count(F.lit(1)).alias("n_subgraphs"))
    blocks = -(-subgraphs.subgraphs.count() // DIAMETER_BLOCK)
    block = F.pmod(F.xxhash64("subgraph_id"), F.lit(max(1, blocks)))
    longest = [_distances_from(subgraphs.subgraphs.where(block == i), subgraphs)[1] for i in range(blocks)]
    return totals.withColumn("meta_diameter", F.lit(max(longest) + 1 if longest else None).cast("long"))


def subgraph_components(subgraphs: Subgraphs) -> DataFrame:
    """(subgraph_id, component): weakly connected components of the graph of subgraphs, by smallest subgraph id."""
    roots = contract(subgraphs.meta_edges.select(F.col("src_sg").alias("u"), F.col("dst_sg").alias("v")))
    joined = subgraphs.subgraphs.select("subgraph_id").join(roots.select(F.col("u").alias("subgraph_id"), "v"), "subgraph_id", "left")
    return joined.select("subgraph_id", F.coalesce("v", "subgraph_id").alias("component"))


def connected_components(subgraphs: Subgraphs) -> DataFrame:
    """(vertex_id, component): true weakly connected components, labelled by their smallest subgraph id."""
    return subgraphs.vertex_subgraph.join(subgraph_components(subgraphs), "subgraph_id").select("vertex_id", "component")


def label_propagation(subgraphs: Subgraphs, direction: str = "out") -> DataFrame:
    """(subgraph_id, label): each subgraph starts with the smallest of its own and its out-neighbours' ids, and labels
    travel along directed meta-edges while they improve. On symmetric graphs these are the components; on
    directed ones they need not be. direction 'both' makes the meta-graph symmetric first."""
    meta = subgraphs.meta_edges.select(F.col("src_sg").alias("s"), F.col("dst_sg").alias("t"))
    if direction == "both":
        meta = meta.unionByName(meta.select(F.col("t").alias("s"), F.col("s").alias("t"))).distinct()
    meta = materialise(meta, "meta")
    first = meta.groupBy(F.col("s").alias("subgraph_id")).agg(F.min("t").alias("m"))
    start = subgraphs.subgraphs.select("subgraph_id").join(first, "subgraph_id", "left").select("subgraph_id", F.least("subgraph_id", "m").alias("label"), F.lit(True).alias("changed"))

    def step(table: DataFrame, _: int) -> DataFrame:
        sent = table.where("changed").select(F.col("subgraph_id").alias("s"), "label").join(meta, "s").groupBy(F.col("t").alias("subgraph_id")).agg(F.min("label").alias("got"))
        joined = table.join(sent, "subgraph_id", "left")
        return joined.select("subgraph_id", F.least("label", "got").alias("label"), F.coalesce(F.col("got") < F.col("label"), F.lit(False)).alias("changed"))

    start = materialise(start, "labels")
    return supersteps(start, step, lambda r: not r["n"], {"n": F.count_if("changed")}, "labels").table.select("subgraph_id", "label")


def shortest_paths(graph: Graph, source: int) -> DataFrame:
    """(vertex_id, distance, parent) of the vertices that the source reaches, in directed hops. The parent is the
    smallest predecessor one hop nearer; the source's is -1. A superstep a hop, over the new frontier only."""
    hops = materialise(graph.edges.where("src <> dst").select(F.col("src").alias("parent"), F.col("dst").alias("vertex_id")).distinct(), "hops")
    front = graph.vertices.where(F.col("vertex_id") == source).select("vertex_id", F.lit(0).alias("distance"), F.lit(-1).cast("long").alias("parent"))
    front, row = materialise_observed(front, "paths", n=F.count(F.lit(1)))
    levels, distance = [front], 0
    while row["n"]:
        distance += 1
        reached = front.select(F.col("vertex_id").alias("parent")).join(hops, "parent").groupBy("vertex_id").agg(F.min("parent").alias("parent"))
        if len(levels) > 16:
            levels = [materialise(_union(levels), "paths")]
        reached = reached.join(_union(levels).select("vertex_id"), "vertex_id", "left_anti")
        front, row = materialise_observed(reached.select("vertex_id", F.lit(distance).alias("distance"), "parent"), "paths", n=F.count(F.lit(1)))
        levels.append(front)
    return _union(levels)


def pagerank(graph: Graph, iterations: int = UPDATES, mode: str = "sync") -> DataFrame:
    """(vertex_id, rank): un-normalised, start 1, rank = 0.15 + 0.85 * the sum of rank / out-degree of the sources, for
    ``iterations`` updates. Vertices without out-edges pass nothing on; repeated edges count each.

    In the mode partition_lag, edges between partitions deliver the rank of the update before, and nothing at
    the first. Every vertex has an edge to itself that carries its last rank along, so an update is one join
    with edges that stay where they are, and one aggregation whose result lies as the next join needs it.
    """
    if mode not in ("sync", "partition_lag"):
        raise ValueError("mode is sync or partition_lag")
    home = graph.vertices.select("vertex_id", "partition_id")
    out = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    edges = graph.edges.select("src", "dst").join(out, "src")
    if mode == "sync":
        edges = edges.withColumn("kind", F.lit(0))
    else:
        a, b = (home.select(F.col("vertex_id").alias(end), F.col("partition_id").alias(p)) for end, p in (("src", "p"), ("dst", "q")))
        edges = edges.join(a, "src").join(b, "dst").withColumn("kind", (F.col("p") != F.col("q")).cast("int"))
    # a hub's edges are in several parts by their sink, and its rank is sent to each; the edge to itself knows of how many
    spread = F.ceil(F.col("degree") / HUB_EDGES).cast("int")
    hubs = not out.where(F.col("degree") > HUB_EDGES).isEmpty()
    edges = edges.select("src", "dst", "degree", "kind", F.pmod(F.xxhash64("dst"), spread).cast("int").alias("part"), F.lit(1).alias("parts"))
    own = home.join(out.select(F.col("src").alias("vertex_id"), spread.alias("parts")), "vertex_id", "left")
    own = own.select(F.col("vertex_id").alias("src"), F.col("vertex_id").alias("dst"), F.lit(1).cast("long").alias("degree"), F.lit(2).alias("kind"), F.lit(0).alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"))
    key = ["src", "part"] if hubs else ["src"]
    parts = int(graph.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.unionByName(own).repartition(parts, *key).persist()
    state = own.select(F.col("src").alias("vertex_id"), F.lit(1.0).alias("w"), F.lit(0.0).alias("last"), "parts")
    for i in range(iterations):
        sent = state.select(F.col("vertex_id").alias("src"), "w", "last", *([F.explode(F.expr("sequence(0, parts - 1)")).alias("part")] if hubs else []))
        moved = sent.join(edges, key)
        share = F.when(F.col("kind") == 0, F.col("w")).when(F.col("kind") == 1, F.col("last")).otherwise(F.lit(0.0)) / F.col("degree")
        state = moved.groupBy(F.col("dst").alias("vertex_id")).agg((F.lit(BASE) + F.lit(DAMPING) * F.sum(share)).alias("w"), F.max(F.when(F.col("kind") == 2, F.col("w"))).alias("last"), F.max("parts").alias("parts"))
        if (i + 1) % CUT_EVERY == 0 or i + 1 == iterations:
            state = materialise(state, "pagerank")
    edges.unpersist()
    return state.select("vertex_id", F.col("w").alias("rank"))


def _neighbours(graph: Graph) -> DataFrame:
    return neighbours.of_edges(graph.edges) if graph.neighbours is None else graph.neighbours


def triangles(graph: Graph) -> DataFrame:
    """(a, b, c) with a < b < c, once for each triangle of the graph without directions, loops and repeated edges."""
    return find(_neighbours(graph))


def triangle_total(graph: Graph) -> DataFrame:
    return triangles(graph).agg(F.count(F.lit(1)).alias("n_triangles"))


def triangles_by_vertex(graph: Graph) -> DataFrame:
    """(vertex_id, n_triangles) of vertices in at least one triangle."""
    return triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("vertex_id")).groupBy("vertex_id").agg(F.count(F.lit(1)).alias("n_triangles"))


def placed_triangles(subgraphs: Subgraphs) -> DataFrame:
    """Triangles with kind (1: in one subgraph, 2: two vertices in one, 3: in three) and the subgraph that counts it:
    the one with most of its vertices, or that of the largest vertex."""
    out = find(_neighbours(subgraphs.graph), subgraphs.vertex_subgraph.select("vertex_id", F.col("subgraph_id").alias("value")))
    a, b, c = F.col("va"), F.col("vb"), F.col("vc")
    kind = F.when((a == b) & (b == c), 1).when((a == b) | (b == c) | (a == c), 2).otherwise(3)
    home = F.when((a == b) | (a == c), a).when(b == c, b).otherwise(c)
    return out.select("a", "b", "c", kind.alias("kind"), home.alias("subgraph_id"))


def triangles_by_subgraph(subgraphs: Subgraphs) -> DataFrame:
    """(subgraph_id, n_triangles) of all subgraphs; the numbers add up to the total."""
    counted = placed_triangles(subgraphs).groupBy("subgraph_id").agg(F.count(F.lit(1)).alias("n_triangles"))
    return subgraphs.subgraphs.select("subgraph_id").join(counted, "subgraph_id", "left").na.fill(0, ["n_triangles"])


def triangles_by_kind(subgraphs: Subgraphs) -> DataFrame:
    return placed_triangles(subgraphs).groupBy("kind").agg(F.count(F.lit(1)).alias("n_triangles"))
