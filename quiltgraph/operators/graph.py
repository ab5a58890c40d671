"""The data model: a graph as vertex and edge tables with a logical partition.

vertices(vertex_id bigint, partition_id int, ...) and edges(src bigint, dst bigint, ...); further columns, such as value or
edge_id, ride along. Edges are directed, repeated ones are kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions.ids import packed_id, with_rank
from quiltgraph.plans.storage import materialise

UNDECLARED = ("add", "drop", "error", "none")


@dataclass
class Graph:
    """declared is the table of vertices that the input itself has; vertices also has those added.

    A symmetric graph without repeated edges may be held as its neighbours (vertex_id, sinks): each vertex with an edge
    once, with its sinks in ascending order. Its partitions are then ids modulo ``modulus``, and vertices and edges are
    views of that table.
    """

    vertices: DataFrame
    edges: DataFrame
    declared: DataFrame
    neighbours: DataFrame | None = None
    modulus: int = 0

    @cached_property
    def edges_by_sink(self) -> DataFrame:
        """(src, dst): the edges, those of a sink together if that costs nothing."""
        if self.neighbours is None:
            return self.edges.select("src", "dst")
        return self.neighbours.select(F.explode("sinks").alias("src"), F.col("vertex_id").alias("dst"))

    @cached_property
    def first_edges(self) -> DataFrame:
        """(vertex_id, partition_id, n, first) of a table of neighbours: each vertex's number of edges, and the rank of the first in its
        partition."""
        numbers = self.neighbours.select("vertex_id", F.pmod("vertex_id", F.lit(self.modulus)).cast("int").alias("partition_id"), F.size("sinks").cast("long").alias("n"))
        return materialise(with_rank(numbers, "partition_id", ["vertex_id"], "first", weight="n"), "first-edges")

    def edges_of(self, vertices: DataFrame) -> DataFrame:
        """The edges (edge_id, src, dst) of the vertices of a table (vertex_id, partition_id, first, ...), whose other columns come first."""
        others = [c for c in vertices.columns if c not in ("vertex_id", "partition_id", "first")]
        each = self.neighbours.join(vertices, "vertex_id").select(*others, "partition_id", "first", F.col("vertex_id").alias("src"), F.posexplode("sinks").alias("_at", "dst"))
        return each.select(*others, packed_id(F.col("partition_id"), F.col("first") + F.col("_at")).alias("edge_id"), "src", "dst")

    @cached_property
    def numbered_edges(self) -> DataFrame:
        """Edges (edge_id, src, dst, ...). Those without an id from the input get canonical ones: the source's partition
        in the upper 32 bits, and the rank there by source, place in the input's line, and sink."""
        if "edge_id" in self.edges.columns:
            return self.edges
        if self.neighbours is not None:
            return self.edges_of(self.first_edges.drop("n"))
        order = ["src", *[c for c in self.edges.columns if c == "position"], "dst"]
        placed = self.edges.join(self.vertices.select(F.col("vertex_id").alias("src"), "partition_id"), "src")
        ranked = with_rank(placed, "partition_id", order, "_rank")
        numbered = ranked.select(packed_id(F.col("partition_id"), F.col("_rank")).alias("edge_id"), "src", "dst", *[c for c in self.edges.columns if c not in ("src", "dst", "position")])
        return materialise(numbered, "numbered-edges")

    def register(self, prefix: str = "") -> None:
        """Temporary views, so that SQL can query the graph."""
        self.vertices.createOrReplaceTempView(f"{prefix}vertices")
        self.numbered_edges.createOrReplaceTempView(f"{prefix}edges")


def graph_of_neighbours(neighbours: DataFrame, modulus: int) -> Graph:
    """The symmetric graph of a table of neighbours, which is held where it is."""
    vertices = neighbours.select("vertex_id", F.pmod("vertex_id", F.lit(modulus)).cast("int").alias("partition_id"))
    return Graph(vertices, neighbours.select(F.col("vertex_id").alias("src"), F.explode("sinks").alias("dst")), vertices, neighbours, modulus)


def build_graph(vertices: DataFrame, edges: DataFrame, undeclared: str = "add") -> Graph:
    """A graph of vertex and edge tables, written once to the shared folder.

    A vertex that is declared more than once is one vertex, in its smallest partition, with all edges. Sinks
    and sources without a declaration are added (a sink to the smallest partition that refers to it, a
    source to partition 0), their edges dropped, or an error; with "none" the caller knows that there is none, and
    it isn't looked for.
    """
    if undeclared not in UNDECLARED:
        raise ValueError(f"undeclared is one of {', '.join(UNDECLARED)}")
    declared = vertices.where("vertex_id is not null")
    others = [c for c in vertices.columns if c not in ("vertex_id", "partition_id")]
    first = F.min(F.struct("partition_id", *[F.col(c) for c in others if dict(vertices.dtypes)[c][:3] != "map"]))
    if any(dict(vertices.dtypes)[c].startswith("map") for c in others):
        first = F.min_by(F.struct("partition_id", *others), "partition_id")
    declared = declared.groupBy("vertex_id").agg(first.alias("_one")).select("vertex_id", F.coalesce(F.col("_one.partition_id").cast("int"), F.lit(0)).alias("partition_id"), *[F.col(f"_one.{c}").alias(c) for c in others])
    declared = materialise(declared, "vertices")
    edges = materialise(edges.where("src is not null and dst is not null"), "edges")
    if undeclared == "none":
        return Graph(declared, edges, declared)
    owner = declared.select("vertex_id", "partition_id")
    ends = edges.select("src", "dst").distinct()
    unknown = ends.join(owner.select(F.col("vertex_id").alias("dst")), "dst", "left_anti")
    sources = ends.join(owner.select(F.col("vertex_id").alias("src")), "src", "left_anti").select(F.col("src").alias("vertex_id"), F.lit(0).alias("partition_id"))
    added = unknown.join(owner.withColumnRenamed("vertex_id", "src"), "src", "left").select(F.col("dst").alias("vertex_id"), F.coalesce("partition_id", F.lit(0)).alias("partition_id"))
    added = materialise(added.unionByName(sources).groupBy("vertex_id").agg(F.min("partition_id").alias("partition_id")), "added")
    if added.isEmpty():
        return Graph(declared, edges, declared)
    if undeclared == "error":
        raise ValueError("edges refer to vertices that are not declared")
    if undeclared == "add":
        return Graph(declared.unionByName(added, allowMissingColumns=True), edges, declared)
    for end in ("src", "dst"):
        edges = edges.join(added.select(F.col("vertex_id").alias(end)), end, "left_anti")
    return Graph(declared, materialise(edges, "edges"), declared)
